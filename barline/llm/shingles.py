"""Word shingles of texts as 64-bit hashes, computed for a slice of texts at once in numpy.

Words are what stands between blanks and the control characters 9 to 13, with A-Z lowered. A word's hash is a
polynomial over its bytes' random values; a shingle's hash mixes the hashes of SIZE consecutive words. A text of fewer words is
one shingle. Equal shingles have equal hashes; different ones share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_random = np.random.default_rng(20240101)
_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z
_ORDER = _random.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64, for n places (rounded up, so that few tables are made)."""
    n = 1 << max(n - 1, 1).bit_length()
    if n not in _powers:
        _powers.clear()
        steps = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            steps.append(np.cumprod(table))
        _powers[n] = tuple(steps)
    return _powers[n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; none without words."""
    data = b"\n".join(t or b"" for t in texts)
    buffer = np.frombuffer(data + b"\n", np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(buffer))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[buffer] * up[: len(buffer)])])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    del sums
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    rolled = np.zeros(max(len(words) - SIZE + 1, 0), np.uint64)
    for k in range(SIZE):
        rolled += words[k : k + len(rolled)] * _ORDER[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SIZE:
            out.append(np.unique(rolled[a : b - SIZE + 1]))
        elif b > a:
            short = (words[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
