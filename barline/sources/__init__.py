"""Tables: reading, bars built from the event stream, and the session columns all operators use."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
#: Regular hours and the session's evening start, in minutes of the New York day.
RTH_OPEN, RTH_CLOSE, EVENING = 570, 960, 1080
EVERY = "hour"
#: A microsecond in an order by time, then by a 64-bit id: more than there are ids.
ID_STEP = Decimal(2 * 10**19)

#: The same bars for the SQL that checks the queries (January: New York is five hours behind).
BARS_SQL = """
bars AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
ny AS (SELECT *, bar_start - INTERVAL 5 HOUR AS ny_ts, CAST(extract(hour FROM bar_start - INTERVAL 5 HOUR) * 60 + extract(minute FROM bar_start - INTERVAL 5 HOUR) AS INT) AS minute,
  isodow(bar_start - INTERVAL 5 HOUR) AS dow FROM bars),
sb AS (SELECT instrument, bar_start, open, high, low, close, volume, minute, CAST((minute - 1080 + 1440) % 1440 AS INT) AS slot,
  CASE WHEN dow <= 5 AND minute >= 570 AND minute < 960 THEN 'RTH' ELSE 'ETH' END AS session_scope,
  CAST(ny_ts AS DATE) + CASE WHEN dow <> 6 AND minute >= 1080 THEN 1 ELSE 0 END AS trading_day FROM ny)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse where the session sets none.

    A warehouse on a machine's own disk is shared in local mode only: on a cluster that sets neither, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{warehouse}/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def bars_from_events(events: DataFrame, every: str = EVERY) -> DataFrame:
    """Bars of an event stream: an instrument for each event type, the price is the value, the volume the count.

    One shuffle with partial aggregates; open and close are the values of the first and last event (ties by event_id). Time and id
    are one number, so that aggregates stay in a hash table of bars: for an order by a struct each task would sort all events it reads.
    """
    # ids, null before all of them, lie within half a step of time to either side
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).cast("decimal(19,0)") * F.lit(ID_STEP) + F.coalesce(F.col("event_id").cast("decimal(20,0)"), F.lit(-ID_STEP / 2))
    return events.groupBy(F.col("event_type").alias("instrument"), F.date_trunc(every, "ts").cast("timestamp_ntz").alias("bar_start")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


def with_sessions(bars: DataFrame) -> DataFrame:
    """Adds minute (of the New York day), slot (minutes since 18:00), session_scope and trading_day.

    A bar at or after 18:00 belongs to the next day's session, except on Saturday.
    """
    ny = F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), F.col("bar_start"))
    out = bars.withColumn("__ny", ny).withColumn("minute", (F.hour("__ny") * 60 + F.minute("__ny")).cast("int")).withColumn("__dow", F.weekday("__ny"))
    return out.withColumns({
        "slot": F.pmod(F.col("minute") - EVENING, F.lit(1440)).cast("int"),
        "session_scope": F.when((F.col("__dow") < 5) & (F.col("minute") >= RTH_OPEN) & (F.col("minute") < RTH_CLOSE), "RTH").otherwise("ETH"),
        "trading_day": F.date_add(F.to_date("__ny"), F.when((F.col("__dow") != 5) & (F.col("minute") >= EVENING), 1).otherwise(0)),
    }).drop("__ny", "__dow")


def bars(spark: SparkSession, sf_dir: str, every: str = EVERY) -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"), every)


_stored: dict[tuple, tuple] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make, partition: str | None = None, tables: tuple = ("events",)) -> DataFrame:
    """make() written once for a state of the tables (sizes and times of their files) to the shared folder, and read from there by every query.

    Where the folder has been cleared meanwhile, it is written again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(_state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    path, schema = _stored.get(key, (None, None))
    if not path or not _status(spark, f"{path}/_SUCCESS"):
        df = make()
        path, schema = shared_path(spark, name), df.schema
        writer = (df.repartition(partition) if partition else df).write
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        _stored[key] = (path, schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _status(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(size, time) of a file, or of all files below a folder at any depth; none where there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getLen(), f.getModificationTime()))
    return found


def _state(spark: SparkSession, path: str) -> tuple:
    files = _status(spark, path)
    return len(files), sum(n for n, _ in files), max((t for _, t in files), default=0)


def session_bars(spark: SparkSession, sf_dir: str, every: str = EVERY) -> DataFrame:
    """Bars with their session columns, from a store partitioned by trading day: a filter on days reads those days only."""
    return stored(spark, sf_dir, f"bars-{every}", lambda: with_sessions(bars(spark, sf_dir, every)), "trading_day")
