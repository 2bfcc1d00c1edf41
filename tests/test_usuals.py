"""What is usual: the last full sessions with a value, whatever lies between them."""

import datetime as dt
import random

import numpy as np

from barline.operators import usuals


def test_usual_counts_full_sessions_only(spark):
    rng, rows = random.Random(4), []
    for inst in "ab":
        for d in range(60):
            full = rng.random() < 0.6
            rows += [(inst, dt.date(2024, 1, 1) + dt.timedelta(days=d), full, s, None if rng.random() < 0.2 else float(rng.randrange(100))) for s in (0, 60)]
    df = spark.createDataFrame(rows, "instrument string, trading_day date, full boolean, slot int, rv double")
    got = {(r.instrument, r.trading_day, r.slot): r.usual for r in usuals.with_usual(df, ["slot"], "rv", 8, 5).collect()}
    for inst, day, _, slot, _ in rows:
        own = sorted(r for r in rows if r[0] == inst and r[3] == slot and r[1] < day and r[2])[-8:]
        values = [r[4] for r in own if r[4] is not None]
        want = np.mean(values) if len(values) >= 5 else None
        assert (got[inst, day, slot] is None) == (want is None) and (want is None or abs(got[inst, day, slot] - want) < 1e-9)
    assert sum(v is not None for v in got.values()) > 100


def test_windows_need_every_return(spark):
    day = dt.date(2024, 1, 2)
    r = [None, 1.0, 2.0, None, 3.0, 1.0]
    grid = spark.createDataFrame([("a", day, 60 * k, 1.0, x) for k, x in enumerate(r)], "instrument string, trading_day date, slot int, close double, r double")
    got = {(x.slot, x.width): x.rv for x in usuals.variances(grid, (1, 2)).collect()}
    assert [got[60 * k, 1] for k in range(6)] == [None, 1, 4, None, 9, 1] and [got[60 * k, 2] for k in range(6)] == [None, None, 5, None, None, 10]
