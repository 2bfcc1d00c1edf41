"""Streams over a table of several part files, an empty table, and their state; fingerprints that see every price."""

import datetime as dt
import os

import oracle
import pytest
from pyspark.sql import functions as F

from barline import registry
from barline.operators import store
from barline.sources import bars_from_events, with_sessions
from barline.streaming import bars

NAMES = [q for q in registry.queries() if q.startswith("m")]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The event table as a folder of part files."""
    path = tmp_path_factory.mktemp("parts")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_several_part_files(spark, parts, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{parts}/events.parquet/*.parquet'")
    assert oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], parts) > 0


@pytest.fixture(scope="module")
def in_time(spark, tmp_path_factory):
    """The event table as files in order of time; days of one file overlap the next one's by less than the lateness, and hours are cut in two."""
    path = tmp_path_factory.mktemp("in_time")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    part = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod("event_id", F.lit(2)) * 86_400) / (7 * 86_400))
    numbers = [r[0] for r in events.select(part.alias("p")).distinct().orderBy("p").collect()]
    for k, p in enumerate(numbers):
        events.where(part == p).coalesce(1).write.parquet(f"{path}/made/{k}")
        (file,) = (path / "made" / str(k)).glob("part-*.parquet")
        (path / "events.parquet").mkdir(exist_ok=True)
        file.rename(path / "events.parquet" / f"{k:03}.parquet")
        os.utime(path / "events.parquet" / f"{k:03}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_a_file_a_trigger(spark, in_time, monkeypatch, name):
    """Many small batches, none of which holds a whole hour of all bars, give the rows of one."""
    import duckdb

    monkeypatch.setattr(bars, "FILES_PER_TRIGGER", 1)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{in_time}/events.parquet/*.parquet'")
    assert oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], in_time) > 0


def test_a_mark_waits_for_its_bar(spark, tmp_path, monkeypatch):
    """Two events of one hour in two files: the issue has the price of the finished bar, and comes once."""
    at = dt.datetime(2024, 1, 10, 16)
    rows = [(1, at, 1.0), (2, at + dt.timedelta(minutes=30), 9.0), (3, at + dt.timedelta(days=4), 5.0)]
    (tmp_path / "events.parquet").mkdir()
    for k, (i, t, v) in enumerate(rows):
        made = spark.createDataFrame([(i, t, 1, "view", v, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        made.coalesce(1).write.parquet(f"{tmp_path}/made/{k}")
        (file,) = (tmp_path / "made" / str(k)).glob("part-*.parquet")
        file.rename(tmp_path / "events.parquet" / f"{k}.parquet")
        os.utime(tmp_path / "events.parquet" / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    monkeypatch.setattr(bars, "FILES_PER_TRIGGER", 1)
    assert [tuple(r) for r in bars.m9(spark, str(tmp_path)).collect()] == [("view", "2024-01-10 16:00:00", 9.0, 1)]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, parts, tmp_path, name):
    spark.read.parquet(f"{parts}/events.parquet").where("false").write.parquet(f"{tmp_path}/events.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == 0


def events(spark, values):
    at = dt.datetime(2024, 1, 10, 15)
    return spark.createDataFrame([(k, at + dt.timedelta(hours=k), 1, "view", v, "{}") for k, v in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_a_changed_price_changes_the_fingerprint(spark):
    """With the same times and volumes, one changed price changes its day's fingerprint and lists the day as changed."""
    old, new = (with_sessions(bars_from_events(events(spark, v))) for v in ([1.0] * 30, [1.0] * 29 + [1.5]))
    a, b = ({r.trading_day: r.fingerprint for r in store.fingerprints(x).collect()} for x in (old, new))
    assert set(a) == set(b) and [d for d in a if a[d] != b[d]] == [max(a)]
    assert [r.trading_day for r in store.changed_days(new, old).collect()] == [max(a)] and store.changed_days(old, old).count() == 0


def test_m7_and_m4_keep_bounded_state(spark, parts):
    """Every stateful stream groups or deduplicates by a window of event time, which the watermark can drop."""
    s = bars.event_stream(spark, parts).select("event_type", F.window("at", "1 hour").alias("bar"), "value").dropDuplicates(["event_type", "bar", "value"])
    assert "Deduplicate [event_type" in s._jdf.queryExecution().analyzed().toString() and "bar" in s._jdf.queryExecution().analyzed().toString()
