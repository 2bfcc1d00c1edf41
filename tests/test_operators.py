"""Hand-made cases: label rules, gaps, as-of lookups, recursions and invariants."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from barline import functions as fn
from barline.operators import calendar, labels, scoring, store
from barline.sources import bars_from_events, with_sessions

T0 = dt.datetime(2024, 1, 9, 15, 0)  # 10:00 in New York, a Tuesday


def rth(spark, *ohlc):
    """Hourly bars from 10:00; None leaves the hour out."""
    rows = [("x", T0 + dt.timedelta(hours=k), *map(float, b), 1) for k, b in enumerate(ohlc) if b]
    return with_sessions(spark.createDataFrame(rows, "instrument string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long"))


def first_move(spark, *ohlc):
    r = labels.first_move(rth(spark, *ohlc), 5.0, 5).first()
    return r.label, r.reason


def test_first_move(spark):
    flat = (100, 101, 99, 100)
    assert first_move(spark, flat, (100, 105, 99, 104)) == ("up_first", None)
    assert first_move(spark, (100, 104, 95, 96)) == ("down_first", None)
    assert first_move(spark, flat, (100, 106, 94, 100)) == (None, "ambiguous_intrabar")
    assert first_move(spark, flat, None, (100, 106, 99, 105)) == (None, "missing_bars")
    assert first_move(spark, flat, (100, 106, 99, 105), None) == ("up_first", None)
    assert first_move(spark, flat, flat, flat, flat, flat) == ("neither", None)
    assert first_move(spark, flat, flat) == (None, "missing_bars")
    assert first_move(spark, None, (100, 106, 99, 105)) == (None, "missing_bars")


def test_session_columns(spark):
    stamps = [dt.datetime(2024, 1, 8, 14, 29), dt.datetime(2024, 1, 8, 14, 30), dt.datetime(2024, 1, 8, 21, 0), dt.datetime(2024, 1, 8, 23, 0), dt.datetime(2024, 1, 13, 23, 30), dt.datetime(2024, 1, 14, 23, 0), dt.datetime(2024, 7, 8, 13, 30)]
    b = with_sessions(spark.createDataFrame([("x", s) for s in stamps], "instrument string, bar_start timestamp_ntz"))
    got = [(r.session_scope, str(r.trading_day), r.slot) for r in b.orderBy("bar_start").collect()]
    assert got == [("ETH", "2024-01-08", 929), ("RTH", "2024-01-08", 930), ("ETH", "2024-01-08", 1320), ("ETH", "2024-01-09", 0), ("ETH", "2024-01-13", 30), ("ETH", "2024-01-15", 0), ("RTH", "2024-07-08", 930)]


def test_as_of_takes_equal_times_unless_strict(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, "five"), ("a", 3, "three"), ("c", 1, "c"), ("a", 4, None)], "k string, t int, v string").withColumnRenamed("t", "rt")
    got = {r.id: (r.rt, r.v) for r in fn.as_of(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {1: (5, "five"), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert {r.id: r.rt for r in fn.as_of(left, right, ["k"], "t", "rt", ["v"], strict=True).collect()}[1] == 4


def test_ema_and_wilder(spark):
    values = [3.0, 5.0, 4.0, 8.0, 6.0, 7.0]
    d = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "k string, t int, v double")
    got = [r.e for r in fn.ema(d, ["k"], "t", {"e": ("v", 3)}).orderBy("t").collect()]
    want = [values[0]]
    for v in values[1:]:
        want.append(0.5 * v + 0.5 * want[-1])
    assert got == want
    got = [r.w for r in d.select("t", fn.wilder("v", ["k"], "t", 3, 5).alias("w")).orderBy("t").collect()]
    seed = sum(values[1:4]) / 3
    assert got[:4] == [None] * 4 and abs(got[5] - ((seed * 2 + 6) / 3 * 2 + 7) / 3) < 1e-12


def test_islands(spark):
    d = spark.createDataFrame([("a", k) for k in (1, 2, 4, 5, 6, 9)], "k string, x int")
    got = sorted((r.a, r.b) for r in fn.islands(d, ["k"], "x", 1).groupBy("run").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect())
    assert got == [(1, 2), (4, 6), (9, 9)]


def test_replace_days_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([("x", "2024-01-01", 1), ("x", "2024-01-02", 2)], "instrument string, trading_day string, v int")
    two = spark.createDataFrame([("x", "2024-01-02", 3)], "instrument string, trading_day string, v int")
    for batch in (one, two, two):
        store.replace_days(batch, f"{tmp_path}/bars")
    assert sorted((str(r.trading_day), r.v) for r in spark.read.parquet(f"{tmp_path}/bars").collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]


def test_front_contract_rolls(spark):
    chain = spark.createDataFrame([("s", "H", dt.date(2024, 3, 15)), ("s", "M", dt.date(2024, 6, 21))], "symbol string, contract string, expiry date")
    days = spark.createDataFrame([("s", dt.date(2024, 3, 6)), ("s", dt.date(2024, 3, 7)), ("s", dt.date(2024, 6, 20))], "symbol string, day date")
    got = {str(r.day): r.contract for r in calendar.front_contracts(days, chain).collect()}
    assert got == {"2024-03-06": "H", "2024-03-07": "M"}  # no contract covers the last day


def test_bars_do_not_depend_on_partitions(spark):
    events = spark.createDataFrame([(k, dt.datetime(2024, 1, 9, 15, k % 60, k % 7), k % 5, "e", float(k % 11)) for k in range(500)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    rows = [sorted(map(tuple, bars_from_events(events.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_identical_candidates_differ_by_nothing(spark):
    d = spark.createDataFrame([("a", k, 0.0) for k in range(100)], "k string, t int, v double")
    r = scoring.block_bootstrap(d, ["k"], "t", "v", 10, 30).first()
    assert (r.mean, r.low, r.high) == (0.0, 0.0, 0.0)
    assert scoring.block_bootstrap(d.where("t < 15"), ["k"], "t", "v", 10, 30).first().low is None
    c = spark.createDataFrame([("a", k, float(k % 3)) for k in range(60)], "k string, t int, v double")
    r = scoring.block_bootstrap(c, ["k"], "t", "v", 6, 50, circular=True).first()
    assert abs(r.low - 1) < 1e-9 and abs(r.high - 1) < 1e-9  # whole periods: every block has the same mean


def test_averages_over_many_blocks_equal_the_recursion(spark):
    """Thousands of rows a key, in blocks of any size: one seed, no new one."""
    r = random.Random(3)
    rows = [(k, t, r.uniform(-5, 50)) for k in "ab" for t in range(2500)]
    for block in (7, 256):
        got = {(x.k, x.t): (x.slow, x.fast) for x in fn.ema(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", {"slow": ("v", 100), "fast": ("v", 3)}, block).collect()}
        for k in "ab":
            slow = fast = None
            for _, t, v in (x for x in rows if x[0] == k):
                slow, fast = (v, v) if slow is None else (2 / 101 * v + 99 / 101 * slow, 0.5 * v + 0.5 * fast)
                assert abs(got[k, t][0] - slow) < 1e-9 and abs(got[k, t][1] - fast) < 1e-9


def test_percentiles_equal_numpy(spark):
    """Ties, constants, single values, nulls, far outliers: the same as one sort of each key."""
    r = random.Random(5)
    data = {"ties": [r.randrange(4) * 1.5 for _ in range(900)], "same": [2.0] * 50, "one": [7.0], "outlier": [r.random() for _ in range(800)] + [1e12], "normal": [r.gauss(0, 3) for _ in range(1001)]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("ties", None), ("none", None)]
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.9, 1.0]
    for bins in (3, 1024):
        got = {x.k: x.q for x in fn.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", probs, bins).collect()}
        assert set(got) == set(data)
        for k, vs in data.items():
            assert np.allclose(got[k], np.quantile(vs, probs))


def test_percentiles_deal_no_rows_by_key(spark):
    """A key's rows stay where they are read, also where Spark would not broadcast by itself: every exchange has sums of its input only."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") % 70).cast("double").alias("v"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = fn.percentiles(rows, ["k"], "v", [0.01, 0.99])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
