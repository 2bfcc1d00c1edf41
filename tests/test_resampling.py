"""Resampled tests of many candidates against a plain computation with numpy."""

import hashlib

import numpy as np
import pytest

from barline.operators import resampling

BLOCK, RESAMPLES = 4, 120


def indices(key, n):
    out = []
    for b in range(1, RESAMPLES + 1):
        own = []
        for j in range(-(-n // BLOCK)):
            start = int(hashlib.md5(f"{key}-{b}-{j}".encode()).hexdigest()[:8], 16) % n
            own += [(start + k) % n for k in range(BLOCK)]
        out.append(own[:n])
    return np.array(out)


def plain(x, key, alpha):
    """x: candidates by sessions. The t values, three p-values and the candidates that a step-down loop rejects."""
    k, n = x.shape
    mean, boot = x.mean(axis=1), x[:, indices(key, n)].mean(axis=2).T
    omega = np.sqrt(n) * boot.std(axis=0)
    t = np.sqrt(n) * mean / omega
    stat = max(0.0, t.max())
    far = mean < -np.sqrt(omega**2 / n * 2 * np.log(np.log(n)))
    p = [np.mean(np.maximum(0, (np.sqrt(n) * (boot - c) / omega).max(axis=1)) >= stat) for c in (np.maximum(mean, 0), np.where(far, 0, mean), mean)]
    z, active, rejected = np.sqrt(n) * (boot - mean) / omega, list(range(k)), set()
    while active:
        critical = np.quantile(z[:, active].max(axis=1), 1 - alpha)
        new = [i for i in active if t[i] > critical]
        if not new:
            break
        rejected |= set(new)
        active = [i for i in active if i not in rejected]
    return t, p, rejected


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(11)
    common = rng.normal(0, 1, 61)
    good = np.array([0.6 * common + rng.normal(m, 1, 61) for m in (0.9, 0.6, 0.35, 0.3, 0.1, 0.0, -0.4, -3.0)])
    poor = np.array([rng.normal(m, 1, 23) for m in (-0.2, 0.1)])
    return {"good": good, "poor": poor}


@pytest.fixture(scope="module")
def z(spark, tables):
    rows = [(key, f"c{i}", 1000 + 7 * d, float(v)) for key, x in tables.items() for i, own in enumerate(x) for d, v in enumerate(own)]
    rows += [("good", "c0", 5000, 99.0), ("good", "flat", 1, 1.0)] + [("good", "flat", 1000 + 7 * d, 0.25) for d in range(61)]  # a session of few, and a constant gain
    df = spark.createDataFrame(rows, "h string, arm string, day int, gain double")
    return resampling.standardised(resampling.aligned(df, ["h"], "arm", "day", "gain"), ["h"], "arm", BLOCK, RESAMPLES).persist()


def test_draws_are_those_of_numpy(z, tables):
    for key, x in tables.items():
        want = x[:, indices(key, x.shape[1])].mean(axis=2)
        got = {(r.arm, r.b): r.drawn for r in z.where(z.h == key).collect()}
        assert len(got) == want.size and all(np.isclose(got[f"c{i}", b + 1], want[i, b], atol=1e-12) for i in range(len(x)) for b in range(RESAMPLES))
        assert len({tuple(i) for i in indices(key, x.shape[1])}) == RESAMPLES  # every draw is another one


def test_superior_ability(z, tables):
    got = {r.h: r for r in resampling.superior_ability(z, ["h"], "arm").collect()}
    for key, x in tables.items():
        t, p, _ = plain(x, key, 0.05)
        assert got[key].best == f"c{t.argmax()}" and np.isclose(got[key].statistic, max(0, t.max()))
        assert np.allclose([got[key].p_lower, got[key].p_consistent, got[key].p_upper], p)
        assert got[key].candidates == len(x) and got[key].sessions == x.shape[1]
    assert got["good"].p_upper < 0.05 < got["poor"].p_lower


@pytest.mark.parametrize("alpha", [0.02, 0.05, 0.2, 0.5])
def test_step_down_is_the_loop(z, tables, alpha):
    got = resampling.stepwise(z, ["h"], "arm", alpha).collect()
    for key, x in tables.items():
        assert {int(r.arm[1:]) for r in got if r.h == key and r.better} == plain(x, key, alpha)[2]
    assert any(r.better for r in got)


def test_registered_draws_are_distinct(spark):
    """In the registered query hardly any two resamples share a mean."""
    drawn = resampling.gains(spark, "/root/testdata/sf0.01").groupBy("h", "arm").agg({"drawn": "approx_count_distinct"}).collect()
    assert drawn and all(r[2] > 0.6 * resampling.RESAMPLES for r in drawn)
