"""Group D: collection plans, implausible days, day scores, coverage cells and gap runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import islands, r6
from ..plans import register
from ..sources import session_bars
from .store import LEDGER_SQL, day_ledger

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
EXPECTED = 23


def expected_days(ledger: DataFrame) -> DataFrame:
    """Every weekday between the first and last stored day of any instrument, for each instrument."""
    span = ledger.agg(F.min("trading_day").alias("a"), F.max("trading_day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("trading_day")).where(F.weekday("trading_day") < 5)
    return ledger.select("instrument").distinct().join(F.broadcast(days))  # a row a day is broadcast


EXPECTED_SQL = f"""{LEDGER_SQL}, xd AS (SELECT CAST(unnest(generate_series(min(trading_day), max(trading_day), INTERVAL 1 DAY)) AS DATE) AS trading_day FROM ledger),
expected AS (SELECT instrument, trading_day FROM (SELECT DISTINCT instrument FROM ledger), xd WHERE isodow(trading_day) <= 5)"""


def collection_plan(expected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fetch days that are not stored, refetch partial ones, leave complete ones."""
    joined = expected.join(ledger, ["instrument", "trading_day"], "left")
    action = F.when(F.col("status").isNull(), "fetch").when(F.col("status") == "PARTIAL", "refetch").otherwise("ok")
    return joined.withColumn("action", action).withColumn("reason", F.when(F.col("action") == "fetch", "not stored").when(F.col("action") == "refetch", F.concat(F.col("bar_count").cast("string"), F.lit(f" of {EXPECTED} bars"))).otherwise("complete"))


@query("d1_collection_plan", f"""WITH {EXPECTED_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN status IS NULL THEN 'fetch' WHEN status = 'PARTIAL' THEN 'refetch' ELSE 'ok' END AS action,
  CASE WHEN status IS NULL THEN 'not stored' WHEN status = 'PARTIAL' THEN bar_count || ' of 23 bars' ELSE 'complete' END AS reason FROM expected LEFT JOIN ledger USING (instrument, trading_day)""")
def d1(spark, sf_dir):
    ledger = day_ledger(session_bars(spark, sf_dir), EXPECTED)
    return collection_plan(expected_days(ledger), ledger).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "action", "reason")


@query("d2_implausible_days", f"WITH {LEDGER_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, round(median(close), 6) AS median_close FROM sb GROUP BY 1, 2 HAVING median(close) NOT BETWEEN 30 AND 70")
def d2(spark, sf_dir):
    """Days whose median close lies outside the instrument's plausible range."""
    d = session_bars(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.median("close").alias("m")).where("m NOT BETWEEN 30 AND 70")
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), r6("m").alias("median_close"))


@query("d5_day_scores", f"""WITH {LEDGER_SQL}, s AS (SELECT *, round(least(1.0, bar_count / 23.0), 6) AS score FROM ledger)
SELECT CAST(trading_day AS VARCHAR) AS trading_day, arg_max(instrument, (score, instrument)) AS best, max(score) AS score, count(*) AS instruments FROM s GROUP BY 1""")
def d5(spark, sf_dir):
    """The best judged instrument of each day."""
    s = day_ledger(session_bars(spark, sf_dir), EXPECTED).withColumn("score", F.round(F.least(F.lit(1.0), F.col("bar_count") / float(EXPECTED)), 6))
    return s.groupBy(F.col("trading_day").cast("string").alias("trading_day")).agg(F.max_by("instrument", F.struct("score", "instrument")).alias("best"), F.max("score").alias("score"), F.count("*").alias("instruments"))


@query("d6_coverage_weeks", f"""WITH {EXPECTED_SQL} SELECT instrument, CAST(date_trunc('week', trading_day)::DATE AS VARCHAR) AS week, count(*) AS days, count(*) FILTER (status = 'COMPLETE') AS complete, count(*) FILTER (status = 'PARTIAL') AS partial,
  count(*) FILTER (status IS NULL) AS missing FROM expected LEFT JOIN ledger USING (instrument, trading_day) GROUP BY 1, 2""")
def d6(spark, sf_dir):
    ledger = day_ledger(session_bars(spark, sf_dir), EXPECTED)
    cells = expected_days(ledger).join(ledger, ["instrument", "trading_day"], "left")
    return cells.groupBy("instrument", F.to_date(F.date_trunc("week", "trading_day")).cast("string").alias("week")).agg(
        F.count("*").alias("days"), F.count_if(F.col("status") == "COMPLETE").alias("complete"), F.count_if(F.col("status") == "PARTIAL").alias("partial"), F.count_if(F.col("status").isNull()).alias("missing"))


@query("d7_stored_share", f"""WITH {EXPECTED_SQL} SELECT instrument, CAST(min(ledger.trading_day) AS VARCHAR) AS first_day, round(avg(CASE WHEN status IS NULL THEN 0.0 ELSE 1.0 END), 6) AS stored_share, round(avg(CASE WHEN status = 'COMPLETE' THEN 1.0 ELSE 0.0 END), 6) AS complete_share
FROM expected LEFT JOIN ledger USING (instrument, trading_day) GROUP BY 1""")
def d7(spark, sf_dir):
    ledger = day_ledger(session_bars(spark, sf_dir), EXPECTED).withColumn("stored", F.col("trading_day"))
    cells = expected_days(ledger).join(ledger, ["instrument", "trading_day"], "left")
    return cells.groupBy("instrument").agg(F.min("stored").cast("string").alias("first_day"), r6(F.avg(F.when(F.col("status").isNull(), 0.0).otherwise(1.0))).alias("stored_share"), r6(F.avg(F.when(F.col("status") == "COMPLETE", 1.0).otherwise(0.0))).alias("complete_share"))


@query("d8_gap_runs", f"""WITH {LEDGER_SQL}, b AS (SELECT DISTINCT instrument, trading_day, slot // 60 AS hour FROM sb), f AS (SELECT *, hour - row_number() OVER (PARTITION BY instrument, trading_day ORDER BY hour) AS g FROM b)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, min(hour)::BIGINT AS first_hour, max(hour)::BIGINT AS last_hour, count(*) AS n FROM f GROUP BY instrument, trading_day, g""")
def d8(spark, sf_dir):
    """Runs of consecutive stored hours: the gaps lie between them."""
    b = session_bars(spark, sf_dir).select("instrument", "trading_day", F.floor(F.col("slot") / 60).alias("hour")).distinct()
    runs = islands(b, ["instrument", "trading_day"], "hour", 1)
    return runs.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day"), "run").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("n")).drop("run")


@query("d9_instrument_inventory", f"""WITH {LEDGER_SQL}, x AS (SELECT instrument, count(*) AS days, round(avg(bar_count), 6) AS mean_bars, round(median(bar_count), 6) AS median_bars, count(*) FILTER (status = 'COMPLETE') AS complete_days FROM ledger GROUP BY 1)
SELECT x.*, h.hours FROM x JOIN (SELECT instrument, count(DISTINCT minute) AS hours FROM sb GROUP BY 1) h USING (instrument)""")
def d9(spark, sf_dir):
    bars = session_bars(spark, sf_dir)
    days = day_ledger(bars, EXPECTED).groupBy("instrument").agg(F.count("*").alias("days"), r6(F.avg("bar_count")).alias("mean_bars"), r6(F.median("bar_count")).alias("median_bars"), F.count_if(F.col("status") == "COMPLETE").alias("complete_days"))
    return days.join(bars.groupBy("instrument").agg(F.countDistinct("minute").alias("hours")), "instrument")


@query("d12_split", f"""WITH {LEDGER_SQL}, d AS (SELECT DISTINCT trading_day FROM ledger), o AS (SELECT trading_day, row_number() OVER (ORDER BY trading_day) AS ordinal, count(*) OVER () AS n FROM d)
SELECT CAST(trading_day AS VARCHAR) AS trading_day, ordinal, CASE WHEN ordinal <= n * 0.6 THEN 'development' WHEN ordinal <= n * 0.8 THEN 'check' ELSE 'holdout' END AS part FROM o""")
def d12(spark, sf_dir):
    """Development, check and holdout by session ordinal."""
    days = session_bars(spark, sf_dir).select("trading_day").distinct()
    w = Window.orderBy("trading_day")  # a row a session
    o = days.select("trading_day", F.row_number().over(w).cast("long").alias("ordinal"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    part = F.when(F.col("ordinal") <= F.col("n") * 0.6, "development").when(F.col("ordinal") <= F.col("n") * 0.8, "check").otherwise("holdout")
    return o.select(F.col("trading_day").cast("string").alias("trading_day"), "ordinal", part.alias("part"))


@query("d3_open_bars", f"WITH {LEDGER_SQL}, n AS (SELECT max(bar_start) AS newest FROM sb) SELECT instrument, count(*) FILTER (bar_start + INTERVAL 3 HOUR > newest) AS open_bars, count(*) FILTER (bar_start + INTERVAL 3 HOUR <= newest) AS settled FROM sb, n GROUP BY 1")
def d3(spark, sf_dir):
    """Bars that ended less than two hours before the newest are still open."""
    b = session_bars(spark, sf_dir)
    n = b.agg(F.max("bar_start").alias("newest"))
    late = F.col("bar_start") + F.expr("INTERVAL 3 HOURS") > F.col("newest")
    return b.crossJoin(F.broadcast(n)).groupBy("instrument").agg(F.count_if(late).alias("open_bars"), F.count_if(~late).alias("settled"))  # one row is broadcast


@query("d4_catch_up_start", f"WITH {LEDGER_SQL} SELECT instrument, CAST(least(max(trading_day) + 1, DATE '2024-01-25') AS VARCHAR) AS start_day FROM ledger GROUP BY 1")
def d4(spark, sf_dir):
    d = day_ledger(session_bars(spark, sf_dir), EXPECTED)
    return d.groupBy("instrument").agg(F.least(F.date_add(F.max("trading_day"), 1), F.lit("2024-01-25").cast("date")).cast("string").alias("start_day"))


@query("d10_timeliness", """WITH r AS (SELECT event_type, CAST(ts AS DATE) AS day, max(ts) FILTER (extract(hour FROM ts) < 14) AS ready FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS days, count(*) FILTER (ready <= CAST(day AS TIMESTAMP) + INTERVAL 13 HOUR + INTERVAL 30 MINUTE) AS in_time, round(median(extract(hour FROM ready) * 60 + extract(minute FROM ready)), 6) AS median_minute FROM r WHERE ready IS NOT NULL GROUP BY 1""")
def d10(spark, sf_dir):
    """When each morning's data were complete, and how often before the deadline."""
    from ..sources import table

    r = table(spark, sf_dir, "events").where(F.hour("ts") < 14).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("ts").alias("ready"))
    r = r.withColumn("minute", F.hour("ready") * 60 + F.minute("ready"))
    return r.groupBy("event_type").agg(F.count("*").alias("days"), F.count_if(F.col("ready") <= F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL '13:30' HOUR TO MINUTE")).alias("in_time"), r6(F.median("minute")).alias("median_minute"))


@query("d15_freshness_at_marks", f"""WITH {LEDGER_SQL}, m AS (SELECT DISTINCT instrument, CAST(CAST(bar_start AS DATE) AS TIMESTAMP) + INTERVAL 14 HOUR AS mark FROM sb)
SELECT m.instrument, strftime(mark, '%Y-%m-%d %H:%M:%S') AS mark, CAST(date_diff('minute', b.bar_start, mark) AS BIGINT) AS age, b.close FROM m ASOF LEFT JOIN (SELECT instrument, bar_start, close FROM sb) b ON m.instrument = b.instrument AND b.bar_start <= mark""")
def d15(spark, sf_dir):
    """The last bar at each daily mark and its age."""
    from ..functions import as_of, stamp

    b = session_bars(spark, sf_dir).select("instrument", "bar_start", "close")
    marks = b.select("instrument", (F.to_date("bar_start").cast("timestamp_ntz") + F.expr("INTERVAL 14 HOURS")).alias("mark")).distinct()
    x = as_of(marks, b, ["instrument"], "mark", "bar_start", ["close"])
    return x.select("instrument", stamp("mark").alias("mark"), F.timestamp_diff("MINUTE", "bar_start", "mark").alias("age"), "close")


@query("d16_pending_reason", f"""WITH {LEDGER_SQL} SELECT CASE WHEN bar_count < 5 THEN 'too few bars' WHEN rth_bar_count = 0 THEN 'no regular session' WHEN status = 'PARTIAL' THEN 'partial day' ELSE 'ready' END AS reason, count(*) AS days FROM ledger GROUP BY 1""")
def d16(spark, sf_dir):
    d = day_ledger(session_bars(spark, sf_dir), EXPECTED)
    return d.groupBy(F.when(F.col("bar_count") < 5, "too few bars").when(F.col("rth_bar_count") == 0, "no regular session").when(F.col("status") == "PARTIAL", "partial day").otherwise("ready").alias("reason")).agg(F.count("*").alias("days"))
