"""Openings against a plain computation on hand-made sessions: gaps, missing levels, unconfirmed bars, ties."""

import datetime as dt
import math
import random
import statistics

import pytest

from barline.operators import openings as op


@pytest.fixture(scope="module")
def tables(spark):
    rng, bars, levels = random.Random(5), [], []
    for inst in "ab":
        for d in range(30):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            last = 1380 if d % 9 else 1080  # some sessions end early: their newest bar is not confirmed
            for slot in range(0, last + 1, 60):
                if rng.random() < (0.03 if slot >= 960 else 0.2):
                    continue
                o, c = rng.randrange(90, 111), rng.randrange(90, 111)
                bars.append((inst, day, slot, float(o), float(max(o, c) + rng.randrange(4)), float(min(o, c) - rng.randrange(4)), float(c), rng.choice([0, 3, 10, 50])))
            on = (float(rng.randrange(108, 115)), float(rng.randrange(85, 92))) if d % 7 else (100.0, 100.0) if d % 2 else (None, None)
            levels.append((inst, day, None if d < 3 else 12.0 + d % 4, None if d % 11 == 5 else 100.0 + d % 5, *on))
    b = spark.createDataFrame(bars, "instrument string, trading_day date, slot int, open double, high double, low double, close double, volume int")
    lv = spark.createDataFrame(levels, "instrument string, trading_day date, atr double, prev_close double, on_high double, on_low double")
    return b, lv, bars, levels


def windows(bars):
    by = {}
    for r in bars:
        by.setdefault(r[:2], {})[r[2]] = r[3:]
    out, stops = {}, {}
    for key, own in by.items():
        got, slot = [], 960
        while len(got) < 6 and slot in own and max(own) > slot:
            got.append(own[slot])
            slot += 60
        out[key] = got
        stops[key] = (len(got), "complete" if len(got) == 6 else "awaiting_confirmation" if slot in own else "gap" if max(own) > slot else "not_stored", None if len(got) == 6 else slot)
    return by, out, stops


def plain(bars, levels):
    """features by (instrument, day, n) and paths."""
    by, own, _ = windows(bars)
    context = {r[:2]: r[2:] for r in levels}
    days = {i: sorted(d for j, d in own if j == i) for i in "ab"}
    feats, paths = {}, {}
    for (i, day), w in own.items():
        atr, prev, hi0, lo0 = context[i, day]
        night = [b for s, b in by[i, day].items() if s < 930]
        for n in range(1, len(w) + 1):
            if not atr:
                continue
            x = w[:n]
            c, o = x[-1][3], x[0][0]
            pull = max(max(b[1] for b in x[: k + 1]) - x[k][2] for k in range(n))
            back = max(x[k][1] - min(b[2] for b in x[: k + 1]) for k in range(n))
            pv, v = sum((b[1] + b[2] + b[3]) / 3 * b[4] for b in [*night, *x]), sum(b[4] for b in [*night, *x])
            k = days[i].index(day)
            past = [sum(b[4] for b in own[i, e][:n]) for e in days[i][max(0, k - 20) : k] if len(own[i, e]) >= n]
            usual, mine = (statistics.mean(past) if len(past) >= 10 else None), sum(b[4] for b in x)
            on = hi0 is not None
            feats[i, day, n] = {
                "path": (c - o) / atr, "net_move": (c - o) / atr, "range": (max(b[1] for b in x) - min(b[2] for b in x)) / atr, "deepest_pullback": max(0, pull) / atr, "largest_recovery": max(0, back) / atr,
                "vs_vwap": (c - pv / v) / atr if v else None, "in_overnight_range": min(2, max(-1, (c - lo0) / (hi0 - lo0))) if on and hi0 > lo0 else None, "vs_prev_close": None if prev is None else (c - prev) / atr,
                "relative_volume": math.log(mine / usual) if usual and mine else None, "gap": None if prev is None else (o - prev) / atr, "overnight_range": (hi0 - lo0) / atr if on else None,
            }
            paths[i, day, n] = [(b[3] - o) / atr for b in x]
    return feats, paths, days


def apart(feats, paths, a, b, n):
    out = {f: abs(feats[a][f] - feats[b][f]) if feats[a][f] is not None and feats[b][f] is not None else None for f in op.WEIGHTS}
    out["path"] = math.sqrt(sum((x - y) ** 2 for x, y in zip(paths[a], paths[b], strict=True)) / n)
    return out


def test_windows_and_why_they_stop(tables):
    b, _, bars, _ = tables
    got = {(r.instrument, r.trading_day): (r.n, r.state, r.next_slot) for r in op.confirmed_windows(b).collect()}
    assert got == windows(bars)[2]
    assert {s for _, s, _ in got.values()} == {"complete", "awaiting_confirmation", "gap"}


def test_a_feed_that_is_behind(spark):
    day = dt.date(2024, 1, 2)
    df = lambda slots: spark.createDataFrame([("a", day, s, 1.0, 1.0, 1.0, 1.0, 1) for s in slots], "instrument string, trading_day date, slot int, open double, high double, low double, close double, volume int")
    assert tuple(op.confirmed_windows(df([0, 60])).first())[2:] == (0, "not_stored", 960)
    assert tuple(op.confirmed_windows(df([960, 1020])).first())[2:] == (1, "awaiting_confirmation", 1020)


def test_features(tables):
    b, lv, bars, levels = tables
    feats, _, _ = plain(bars, levels)
    got = {(r.instrument, r.trading_day, r.n): r for r in op.opening_features(b, op.contexts(b, lv)).collect()}
    assert set(got) == set(feats)
    for k, want in feats.items():
        for f, x in want.items():
            assert (x is None and got[k][f] is None) or (x is not None and got[k][f] is not None and math.isclose(got[k][f], x, abs_tol=1e-9)), (k, f)
    for f in op.WEIGHTS:
        assert any(v[f] is not None for v in feats.values())
    assert any(v["vs_prev_close"] is None for v in feats.values()) and any(v["in_overnight_range"] is None and v["overnight_range"] is not None for v in feats.values())


@pytest.mark.parametrize("pool", [250, 7])
def test_ranks_and_tolerances(tables, monkeypatch, pool):
    b, lv, bars, levels = tables
    feats, paths, days = plain(bars, levels)
    x = op.differences(op.opening_features(b, op.contexts(b, lv)), pool)
    got = {}
    for r in op.ranked(x).orderBy("rank").collect():
        got.setdefault((r.instrument, r.trading_day, r.n), []).append((r.earlier, round(r.similarity, 6), r.comparable))
    want, spread = {}, {}
    for (i, day, n), _ in feats.items():
        k, found = days[i].index(day), []
        for ed in range(max(0, k - pool), k):
            other = (i, days[i][ed], n)
            if other in feats:
                diff = apart(feats, paths, (i, day, n), other, n)
                if n == op.CALIBRATED:
                    for f, v in diff.items():
                        spread.setdefault((i, f), []).extend([] if v is None else [v])
                comparable = sum(w for f, w in op.WEIGHTS.items() if diff[f] is not None)
                if comparable >= op.FLOOR:
                    tol = {f: t * (math.sqrt(n * 60 / 30) if f in op.SCALED else 1) for f, t in op.TOLERANCES.items()}
                    hit = sum(w * max(0, 1 - diff[f] / tol[f]) for f, w in op.WEIGHTS.items() if diff[f] is not None)
                    found.append((-round(100 * hit / comparable, 9), -comparable, -ed, (days[i][ed], round(100 * hit / comparable, 6), comparable)))
        if found:
            want[i, day, n] = [f[3] for f in sorted(found)[: op.TOP]]
    assert set(got) == set(want)
    assert all(len(got[k]) == len(want[k]) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 and a[2] == b[2] for a, b in zip(got[k], want[k], strict=True)) for k in want)
    for r in op.calibration(x).collect():
        own = spread[r.instrument, r.feature]
        assert r.pairs == len(own) and math.isclose(r.median, statistics.median(own), abs_tol=1e-12) and math.isclose(r.tolerance, float(f"{2 * r.median:.2g}"), rel_tol=1e-9)


def test_weights_sum_to_a_hundred_and_pairs_join_by_equality(tables):
    b, lv, _, _ = tables
    assert sum(op.WEIGHTS.values()) == 100 and set(op.WEIGHTS) == set(op.TOLERANCES)
    plan = op.differences(op.opening_features(b, op.contexts(b, lv)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
