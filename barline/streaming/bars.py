"""Group M: the live loop as Structured Streaming queries. The event table is read as a file stream with availableNow, so
that a streaming result can be held against the batch one; on a live source only the reader differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import r6, stamp
from ..operators.matching import OPEN_SQL, opening_paths
from ..plans import register
from ..sources import shared_path, table, with_sessions

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
LATENESS = "2 days"
#: Most files that a batch reads; none: all that is there.
FILES_PER_TRIGGER: int | None = None


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, a file or a folder of part files, as a stream of timestamps with the watermark that bounds the state."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if FILES_PER_TRIGGER:
        reader = reader.option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    events = reader.parquet(f"{sf_dir}/events.parque[t]")  # a pattern: as a plain path, a stream takes folders only
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATENESS)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream has emitted once all that is there has been read, from the files of its sink (no rows of an empty table)."""
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")  # a repeated batch replaces itself

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/rows/batch=-1")
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def last_emitted(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of updates of a key, that with the largest version: updates only grow."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("x")).select(*keys, "x.*")


@query("m1_minute_bars", """SELECT event_type AS instrument, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def m1(spark, sf_dir):
    """Events to tumbling minute bars; updates are kept, the last of each bar is its value."""
    at = F.struct("ts", "event_id")
    bars = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("instrument"), F.window("at", "1 minute").alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
    rows = drained(bars.select("instrument", stamp("w.start").alias("bar"), "open", "high", "low", "close", "volume"), "minute-bars", "update")
    return last_emitted(rows, ["instrument", "bar"], "volume").select("instrument", "bar", "open", "high", "low", "close", "volume")


@query("m2_sliding_statistics", """SELECT event_type AS instrument, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def m2(spark, sf_dir):
    """Trailing two-hour statistics that slide by an hour."""
    s = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("instrument"), F.window("at", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    rows = drained(s.select("instrument", stamp("w.start").alias("window_start"), "n", "mean"), "sliding", "update")
    return last_emitted(rows, ["instrument", "window_start"], "n").select("instrument", "window_start", "n", "mean")


@query("m3_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def m3(spark, sf_dir):
    """Runs of a user's events separated by gaps of six hours: appended once the watermark has passed their end."""
    s = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return drained(s.select("user_id", stamp("first").alias("first_at"), "n"), "sessions")


@query("m4_receipt_log", "SELECT event_type, count(*) AS receipts FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS bar, value FROM events) GROUP BY 1")
def m4(spark, sf_dir):
    """First sight of each version (value) of a bar. The bar's window is a key, so its state is dropped once the watermark has passed its end."""
    s = event_stream(spark, sf_dir).select("event_type", F.window("at", "1 hour").alias("bar"), "value").dropDuplicates(["event_type", "bar", "value"])
    return drained(s.select("event_type", "bar", "value"), "receipts").groupBy("event_type").agg(F.count("*").alias("receipts"))


@query("m6_settled_open", """WITH m AS (SELECT max(ts) AS newest FROM events), b AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar FROM events GROUP BY 1, 2)
SELECT instrument, CASE WHEN bar + INTERVAL 3 HOUR <= newest THEN 'settled' ELSE 'open' END AS state, count(*) AS bars FROM b, m GROUP BY 1, 2""")
def m6(spark, sf_dir):
    """Bars that ended two hours before the newest event are settled; later ones are still open."""
    s = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("instrument"), F.window("at", "1 hour").alias("w")).agg(F.max("at").alias("last"))
    rows = drained(s.select("instrument", F.col("w.start").alias("bar"), "last"), "open-bars", "update").groupBy("instrument", "bar").agg(F.max("last").alias("last"))
    newest = rows.agg(F.max("last").alias("newest"))
    settled = F.col("bar") + F.expr("INTERVAL 3 HOURS") <= F.col("newest")
    return rows.crossJoin(F.broadcast(newest)).groupBy("instrument", F.when(settled, "settled").otherwise("open").alias("state")).agg(F.count("*").alias("bars"))  # one row is broadcast


@query("m5_confirmation", """WITH b AS (SELECT event_type AS instrument, CAST(ts AS DATE) AS day, extract(hour FROM ts)::BIGINT AS hour FROM events GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY instrument, day ORDER BY hour) - 1 AS k FROM b)
SELECT instrument, CAST(day AS VARCHAR) AS day, count(*) FILTER (hour = k) AS confirmed, max(hour) AS newest FROM f GROUP BY 1, 2""")
def m5(spark, sf_dir):
    """Hours of a day that are final in an unbroken run from its start: keyed state of hours seen, updated with each batch."""
    s = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("instrument"), F.window("at", "1 day").alias("w")).agg(F.array_sort(F.collect_set(F.hour("at").cast("long"))).alias("hours"), F.count("*").alias("n"))
    rows = drained(s.select("instrument", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "hours", "n"), "confirmed", "update")
    last = last_emitted(rows, ["instrument", "day"], "n")  # a day has 24 hours at most
    run = F.size(F.filter(F.transform("hours", lambda x, i: x == i), lambda ok: ok)).cast("long")
    return last.select("instrument", "day", run.alias("confirmed"), F.array_max("hours").alias("newest"))


#: Minutes of the day at which feeds are judged.
CUTOFFS = [480, 840, 1200]


@query("m7_status_at_cutoffs", """WITH c AS (SELECT unnest([480, 840, 1200]) AS cutoff), d AS (SELECT user_id, CAST(ts AS DATE) AS day, cutoff, count(*) AS n, count(*) FILTER (extract(hour FROM ts) * 60 + extract(minute FROM ts) < cutoff) AS before FROM events, c GROUP BY ALL)
SELECT cutoff, CASE WHEN before = 0 THEN 'missing' WHEN before < n THEN 'delayed' ELSE 'observed' END AS status, count(*) AS feeds FROM d GROUP BY 1, 2""")
def m7(spark, sf_dir):
    """Whether a feed was seen on a day before each cutoff: the stream joined with the table of cutoffs, counts kept by day until the watermark passes."""
    cutoffs = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")
    minute = F.hour("ts") * 60 + F.minute("ts")
    s = event_stream(spark, sf_dir).join(F.broadcast(cutoffs), F.lit(True)).groupBy("user_id", F.window("at", "1 day").alias("w"), "cutoff").agg(F.count("*").alias("n"), F.count_if(minute < F.col("cutoff")).alias("before"))
    c = last_emitted(drained(s.select("user_id", F.col("w.start").alias("day"), "cutoff", "n", "before"), "status", "update"), ["user_id", "day", "cutoff"], "n")
    status = F.when(F.col("before") == 0, "missing").when(F.col("before") < F.col("n"), "delayed").otherwise("observed")
    return c.groupBy("cutoff", status.alias("status")).agg(F.count("*").alias("feeds"))


@query("m10_missed_windows", """WITH b AS (SELECT DISTINCT event_type AS instrument, date_trunc('hour', ts) AS bar FROM events), m AS (SELECT instrument, min(bar) AS a, max(bar) AS z FROM b GROUP BY 1), x AS (SELECT instrument, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS bar FROM m)
SELECT instrument, count(*) AS missed FROM x ANTI JOIN b USING (instrument, bar) GROUP BY 1""")
def m10(spark, sf_dir):
    """Windows the stream never emitted between its first and last."""
    s = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("instrument"), F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    bars = drained(s.select("instrument", F.col("w.start").alias("bar"), "n"), "windows", "update").select("instrument", "bar").distinct()
    span = bars.groupBy("instrument").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    want = span.select("instrument", F.explode(F.expr("sequence(a, z, interval 1 hour)")).alias("bar"))
    return want.join(bars, ["instrument", "bar"], "left_anti").groupBy("instrument").agg(F.count("*").alias("missed"))


def hourly(stream: DataFrame) -> DataFrame:
    """Hourly bars of the event stream, updated with every batch."""
    at = F.struct("ts", "event_id")
    bars = stream.groupBy(F.col("event_type").alias("instrument"), F.window("at", "1 hour").alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
    return bars.select("instrument", F.col("w.start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume")


def each_batch(stream: DataFrame, state: str, write, mode: str = "update") -> None:
    """Drains the stream through write(batch, number); a batch that is repeated after a failure has its number again."""
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()


#: What has been final at the end of the stream: bars whose hour ended before the watermark.
_FINAL = "bar_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"
#: Sessions before each that it is compared with, and the size of a set.
POOL, TOP = 20, 5


class Kept:
    """Rows written by numbered batches, partitioned by trading day: a repeated batch replaces its own, and readers see earlier batches only."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"{schema}, trading_day date"
        spark.createDataFrame([], self.schema).write.parquet(f"{path}/_empty")  # the folder is there before its first batch

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").partitionBy("trading_day").parquet(f"{self.path}/batch={number}")

    def before(self, number: int, since) -> DataFrame:
        """Rows of batches before this one, of days from `since` on: other days' files are not read."""
        rows = self.spark.read.schema(f"{self.schema}, batch int").parquet(self.path)
        return rows.where((F.col("batch") < number) & (F.col("trading_day") >= F.lit(since)))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


@query("m8_analogue_refresh", f"""
WITH {OPEN_SQL},
pf AS (SELECT pa.instrument, trading_day, pa.n, pa.net FROM pa JOIN wd USING (instrument, trading_day, slot) WHERE {_FINAL}),
pd AS (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM pf),
c AS (SELECT a.instrument, a.trading_day, b.trading_day AS earlier, a.n, sqrt(avg((a.net - b.net) ** 2) OVER w) AS rms, count(*) OVER w AS bars
  FROM pd a JOIN pd b ON a.instrument = b.instrument AND a.n = b.n AND b.d BETWEEN a.d - {POOL} AND a.d - 1
  WINDOW w AS (PARTITION BY a.instrument, a.trading_day, b.trading_day ORDER BY a.n ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day, n ORDER BY round(rms, 9), earlier DESC) AS rank FROM c WHERE bars = n AND n >= 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, CAST(earlier AS VARCHAR) AS earlier, round(rms, 6) AS rms, CAST(rank AS INT) AS rank
FROM r WHERE rank <= {TOP}""")
def m8(spark, sf_dir):
    """The most similar earlier sessions of every window, as each bar becomes final.

    Bars are appended once the watermark has passed them. What is carried from batch to batch is small and keyed: for each session
    its open and number of bars, for each pair of a session and one of the POOL before it the sum of squared differences so far. A
    batch reads its own bars, the pairs of the sessions it touches, and the paths of their pools; its cost follows its bars.
    """
    out = shared_path(spark, "refresh")
    points = Kept(spark, f"{out}/points", "instrument string, n int, net double, first double")
    pairs = Kept(spark, f"{out}/pairs", "instrument string, earlier date, bars int, total double")
    sets = Kept(spark, f"{out}/sets", "instrument string, n int, earlier date, rms double, rank int")
    day = ["instrument", "trading_day"]

    def refresh(batch: DataFrame, number: int) -> None:
        bars = with_sessions(batch).where((F.weekday("trading_day") < 5) & (F.col("session_scope") == "RTH"))
        since = bars.agg(F.min("trading_day")).first()[0]
        if since is None:
            return
        known = points.before(number, since).groupBy(*day).agg(F.max("n").alias("n0"), F.max("first").alias("first0"))
        w = Window.partitionBy(*day).orderBy("slot")
        new = bars.join(known, day, "left").withColumn("first", F.coalesce("first0", F.first("open").over(w)))
        new = new.select(*day, (F.coalesce("n0", F.lit(0)) + F.row_number().over(w)).cast("int").alias("n"), (F.col("close") - F.col("first")).alias("net"), "first")
        points.write(new, number)
        new = spark.read.schema(points.schema).parquet(f"{points.path}/batch={number}")
        past = points.before(number + 1, "1900-01-01").select(*day).distinct()  # a row a session
        ordinal = F.row_number().over(Window.partitionBy("instrument").orderBy("trading_day"))
        past = past.withColumn("d", ordinal)
        touched = past.join(new.select(*day).distinct(), day, "left_semi").withColumn("at", F.explode(F.sequence(F.col("d") - POOL, F.col("d") - 1)))
        pool = touched.join(past.select("instrument", F.col("trading_day").alias("earlier"), F.col("d").alias("at")), ["instrument", "at"]).select(*day, "earlier")
        oldest = pool.agg(F.min("earlier")).first()[0]
        if oldest is None:
            return
        other = points.before(number + 1, oldest).select("instrument", F.col("trading_day").alias("earlier"), "n", F.col("net").alias("past_net"))
        met = new.join(pool, day).join(other, ["instrument", "earlier", "n"])
        held = newest(pairs.before(number, since), [*day, "earlier"])
        so_far = Window.partitionBy(*day, "earlier").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        run = met.join(held, [*day, "earlier"], "left").select(
            *day, "earlier", "n", (F.coalesce("bars", F.lit(0)) + F.count("*").over(so_far)).cast("int").alias("bars"),
            (F.coalesce("total", F.lit(0.0)) + F.sum((F.col("net") - F.col("past_net")) ** 2).over(so_far)).alias("total"),
        )
        pairs.write(run.groupBy(*day, "earlier").agg(F.max("bars").alias("bars"), F.max_by("total", "n").alias("total")), number)
        scored = run.where("bars = n AND n >= 2").withColumn("rms", F.sqrt(F.col("total") / F.col("bars")))
        rank = F.row_number().over(Window.partitionBy(*day, "n").orderBy(F.round("rms", 9), F.desc("earlier")))
        sets.write(scored.withColumn("rank", rank).where(F.col("rank") <= TOP).select(*day, "n", "earlier", "rms", "rank"), number)

    each_batch(hourly(event_stream(spark, sf_dir)), f"{out}/state", refresh, "append")
    found = spark.read.schema(sets.schema).parquet(sets.path)
    return found.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "n", F.col("earlier").cast("string").alias("earlier"), r6("rms").alias("rms"), "rank")


@query("m9_issue_at_marks", f"""
SELECT event_type AS instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS mark, arg_max(value, (ts, event_id)) AS price, 1 AS issues
FROM (SELECT *, date_trunc('hour', ts) AS bar_start FROM events) WHERE extract(hour FROM ts) % 4 = 0 AND {_FINAL} GROUP BY 1, 2""")
def m9(spark, sf_dir):
    """One issue at every fourth hour's mark, from its finished bar: the bar is appended once the watermark has passed its end.

    A mark that has its issue gets no other, though the whole stream is delivered twice: a batch leaves out marks that another run
    has issued, and reads only the days of its own marks to know them.
    """
    out = shared_path(spark, "issues")
    columns = "instrument string, bar_start timestamp_ntz, price double"
    spark.createDataFrame([], columns).write.parquet(f"{out}/rows/_empty")

    def issue(run: int):
        def write(batch: DataFrame, number: int) -> None:
            marks = batch.where(F.hour("bar_start") % 4 == 0).select("instrument", "bar_start", F.col("close").alias("price"), F.to_date("bar_start").alias("day"))
            since, until = marks.agg(F.min("day"), F.max("day")).first()
            if since is None:
                return
            rows = spark.read.schema(f"{columns}, run int, batch int, day date").parquet(f"{out}/rows")
            others = rows.where(F.col("day").between(F.lit(since), F.lit(until)) & ((F.col("run") != run) | (F.col("batch") != number)))
            new = marks.join(others.select("instrument", "bar_start"), ["instrument", "bar_start"], "left_anti")
            new.write.mode("overwrite").partitionBy("day").parquet(f"{out}/rows/run={run}/batch={number}")

        return write

    for run in (1, 2):
        each_batch(hourly(event_stream(spark, sf_dir)), f"{out}/state{run}", issue(run), "append")
    rows = spark.read.schema(columns).parquet(f"{out}/rows")
    return rows.groupBy("instrument", stamp("bar_start").alias("mark")).agg(F.max("price").alias("price"), F.count("*").cast("int").alias("issues"))
