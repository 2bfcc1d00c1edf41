"""Averages of a long session against the recursion, in one pass."""

import math

import pytest

from barline.operators import structure


@pytest.mark.parametrize("length", [3, 14, 100])
def test_a_session_of_minutes(spark, length):
    values = {d: [100 + 5 * math.sin(i / 37) + (i * 7919 % 13) / 10 for i in range(n)] for d, n in (("a", 1440), ("b", 1), ("c", 1380))}
    src = spark.createDataFrame([("x", d, i, v) for d, own in values.items() for i, v in enumerate(own)], "instrument string, trading_day string, i int, close double")
    out = spark.sql(structure.ema("{src}", "close", length), src=src)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.trading_day, r.i): r.e for r in out.collect()}
    a = 2 / (length + 1)
    for d, own in values.items():
        e = own[0]
        for i, v in enumerate(own):
            e = v if i == 0 else a * v + (1 - a) * e
            assert math.isclose(got[d, i], e, rel_tol=1e-9)
