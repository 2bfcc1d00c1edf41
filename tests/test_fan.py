"""The variance base against a plain computation, and what a spike or a release leaves in it."""

import datetime as dt

import numpy as np
import pytest

from barline import functions
from barline.operators import calendar, fan


def grid(spark, days, slots, seed=1, spikes=(), bursts=()):
    """Days of hourly slots with returns and volumes; spikes and bursts name (day, slot)."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for k in range(slots):
            r = None if k == 0 or (k + d) % 11 == 0 else float(rng.normal(0, 0.01 * (1 + k % 3)))
            rows.append(("a", dt.date(2024, 1, 1) + dt.timedelta(days=d), 60 * k, 40.0 if (d, k) in bursts else None if (k + d) % 13 == 0 else float(5 + k % 2), 5.0 if (d, k) in spikes else r))
    return spark.createDataFrame(rows, "instrument string, trading_day date, slot int, volume double, r double"), rows


def plain(rows, slots):
    days = sorted({r[1] for r in rows})
    at = {(days.index(r[1]), r[2] // 60): r for r in rows}
    n = len(days)
    r2 = np.full((n, slots), np.nan)
    for d in range(n):
        burst = []
        for k in range(slots):
            past = [at[e, k][3] for e in range(max(0, d - 20), d) if at[e, k][3] is not None]
            burst.append(len(past) >= 5 and at[d, k][3] is not None and at[d, k][3] >= 3 * np.mean(past))
        for k in range(slots):
            if at[d, k][4] is not None and not burst[k] and not (k and burst[k - 1]):
                r2[d, k] = at[d, k][4] ** 2
    names = [calendar.PHASES[max(i for i, (a, _) in enumerate(calendar.PHASES) if a <= 60 * k)][1] for k in range(slots)]
    out = {}
    for d in range(n):
        past = r2[max(0, d - 40) : d]
        raw, total = np.full(slots, np.nan), np.zeros(slots)
        for k in range(slots):
            around = past[:, max(0, k - 1) : k + 2].ravel()
            around = around[~np.isnan(around)]
            cap = 50 * np.median(around) if len(around) and np.median(around) > 0 else np.inf
            own = np.minimum(past[:, k][~np.isnan(past[:, k])], cap)
            total[k] = own.sum()
            if len(own) >= 10:
                raw[k] = own.mean()
        for k in range(slots):
            near = [raw[j] for j in (k - 1, k, k + 1) if 0 <= j < slots and names[j] == names[k] and not np.isnan(raw[j])]
            out[days[d], 60 * k] = None if d < 10 else 0.0 if total[k] == 0 else float(np.mean(near)) if near else 0.0
    return out


def variances(df):
    return {(r.trading_day, r.slot): r.s for r in fan.seasonal_variance(df).collect()}


def same(a, b):
    return a is None and b is None or a is not None and b is not None and np.isclose(a, b, rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("spikes,bursts", [((), ()), (((12, 5), (20, 9)), ((25, 7), (25, 8), (30, 20)))])
def test_against_plain(spark, spikes, bursts):
    df, rows = grid(spark, 50, 24, 1, spikes, bursts)
    got, want = variances(df), plain(rows, 24)
    assert set(got) == set(want) and all(same(got[k], want[k]) for k in want)
    assert sum(v is not None and v > 0 for v in want.values()) > 500


def test_a_spike_leaves_later_variances_alone(spark):
    """A return of five hundred times the usual enters as fifty times the usual square, not as 250,000 times."""
    before, after = (variances(grid(spark, 40, 24, 2, spikes)[0]) for spikes in ((), ((15, 6),)))
    changed = [(before[k], after[k]) for k in before if before[k] and not same(before[k], after[k])]
    assert changed and all(a < 8 * b for b, a in changed)


def test_a_release_is_left_out(spark):
    """What moves in a release and the hour after it does not count at all."""
    quiet, loud = (variances(grid(spark, 40, 24, 3, spikes, ((15, 6),))[0]) for spikes in ((), ((15, 6), (15, 7))))
    assert all(same(quiet[k], loud[k]) for k in quiet)


def test_trailing_quantiles_against_numpy_without_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, int(d), float(v)) for k, (d, v) in enumerate(zip(rng.integers(0, 60, 3000), rng.normal(0, 1, 3000), strict=True))]
    rows += [(0, 5, None), (7, 3, 1.0)]
    df = spark.createDataFrame(rows, "k int, d int, v double")
    targets = spark.createDataFrame([(k, d) for k in (0, 1, 2, 7) for d in range(0, 63)], "k int, d int")
    got = functions.trailing_quantiles(df, targets, ["k"], "d", "v", [0.05, 0.5, 0.9], 20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
    want = {}
    for k in (0, 1, 2, 7):
        for d in range(63):
            v = [x for a, e, x in rows if a == k and d - 20 <= e < d and x is not None]
            if v:
                want[k, d] = (len(v), np.quantile(v, [0.05, 0.5, 0.9]))
    found = {(r.k, r.d): (r.n, r.q) for r in got.collect()}
    assert set(found) == set(want) and all(found[x][0] == n and np.allclose(found[x][1], q) for x, (n, q) in want.items())
