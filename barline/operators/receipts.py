"""Groups A and D: what was known when. Bars have two times, that of their events and that of their receipt.

The receipt log has a row for each time that something of a bar arrived: the bar as it stood then. An event is received some minutes
after it happened; its property k says how many (none: at once). Nothing is ever changed in the log, so a read as of an instant is the
last row of each bar at or before it, and what a later reader finds can be held against what was known at the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stamp
from ..plans import register
from ..sources import BARS_SQL, stored, table, with_sessions

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Slot of the cutoff, minutes after it at which a snapshot is frozen, and minutes after it by which a live set has its inputs.
CUTOFF, FREEZE, LIVE_LAG = 900, 30, 20
#: Earlier sessions that a set reads; deadlines at which statuses are counted.
POOL, DEADLINES = 5, (480, 900)
#: The log began here: earlier receipts are unknown, and count as received then.
LOG_START = "2024-01-08 00:00:00"
DAY = ["instrument", "trading_day"]
BAR = [*DAY, "slot"]
VALUES = ["open", "high", "low", "close", "volume"]


def receipt_log(events: DataFrame) -> DataFrame:
    """instrument, bar_start, received, the bar's values by then, with session columns; sessions of weekdays."""
    delay = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    own = events.select(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar_start"), "ts", "event_id", "value", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), delay)).alias("received"))
    order = Window.partitionBy("instrument", "bar_start").orderBy("received", "event_id")
    so_far, at = order.rowsBetween(Window.unboundedPreceding, 0), F.struct("ts", "event_id")
    log = own.select(
        "instrument", "bar_start", "received", F.min_by("value", at).over(so_far).alias("open"), F.max("value").over(so_far).alias("high"), F.min("value").over(so_far).alias("low"),
        F.max_by("value", at).over(so_far).alias("close"), F.count("*").over(so_far).alias("volume"), F.lead("received").over(order).alias("next"),
    ).where("next IS NULL OR next <> received").drop("next")
    return with_sessions(log).where(F.weekday("trading_day") < 5)


def kept_log(spark, sf_dir) -> DataFrame:
    """The log, written once and partitioned by trading day."""
    return stored(spark, sf_dir, "receipt-log", lambda: receipt_log(table(spark, sf_dir, "events")), "trading_day")


LOG_SQL = f"""{BARS_SQL},
ev AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS bar_start, ts, event_id, value, ts + coalesce(CAST(json_extract(props, '$.k') AS INT), 0) * INTERVAL 1 MINUTE AS received FROM events),
lg AS (SELECT instrument, bar_start, received, arg_min(value, (ts, event_id)) OVER w AS open, max(value) OVER w AS high, min(value) OVER w AS low, arg_max(value, (ts, event_id)) OVER w AS close,
  count(*) OVER w AS volume, lead(received) OVER (PARTITION BY instrument, bar_start ORDER BY received, event_id) AS next FROM ev WINDOW w AS (PARTITION BY instrument, bar_start ORDER BY received, event_id ROWS UNBOUNDED PRECEDING)),
rl AS (SELECT lg.*, sb.trading_day, sb.slot, sb.session_scope, lg.bar_start - sb.slot * INTERVAL 1 MINUTE AS began FROM lg JOIN sb ON sb.instrument = lg.instrument AND sb.bar_start = lg.bar_start
  WHERE (next IS NULL OR next <> received) AND isodow(sb.trading_day) <= 5)"""


def began() -> Column:
    """The instant of a session's slot 0."""
    return F.col("bar_start") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("slot"))


def minutes(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def as_of(log: DataFrame, known: Column, suffix: str = "") -> list[Column]:
    """Aggregates of a bar's rows: values, and receipt, of the last one that is known (null: none is)."""
    at = F.when(known, F.struct("received", "volume"))
    return [F.max_by(F.when(known, F.struct(*VALUES)), at).alias(f"values{suffix}"), F.max(F.when(known, F.col("received"))).alias(f"received{suffix}")]


def sessions_received(log: DataFrame) -> DataFrame:
    """instrument, trading_day, began and the last receipt of a session."""
    return log.groupBy(*DAY).agg(F.min(began()).alias("began"), F.max("received").alias("last_received"))


def verified_inputs(log: DataFrame) -> DataFrame:
    """Whether a session's inputs, as they are read today, are what was known when its snapshot was frozen.

    Bars before the cutoff: missing (nothing received by then), differing (other values were known), received (equal). The POOL
    sessions before must have been received by the cutoff.
    """
    frozen = F.col("received") <= began() + minutes(CUTOFF + FREEZE)
    bars = log.where(F.col("slot") < CUTOFF).groupBy(*BAR).agg(*as_of(log, F.lit(True), "_now"), *as_of(log, frozen, "_then"))
    equal = F.col("values_then").eqNullSafe(F.col("values_now"))
    own = bars.groupBy(*DAY).agg(F.count("*").alias("used"), F.count_if(F.col("values_then").isNull()).alias("missing"), F.count_if(F.col("values_then").isNotNull() & ~equal).alias("differing"), F.max("received_then").alias("last_received"))
    before = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(-POOL, -1)
    pool = sessions_received(log).withColumn("cutoff", F.col("began") + minutes(CUTOFF)).withColumn("times", F.collect_list("last_received").over(before))
    late = pool.select(*DAY, F.size(F.filter("times", lambda t: t > F.col("cutoff"))).alias("sessions_late"))
    out = own.join(late, DAY)
    return out.withColumn("verified", (F.col("missing") == 0) & (F.col("differing") == 0) & (F.col("sessions_late") == 0))


@query("d13_verified_inputs", f"""
WITH {LOG_SQL},
b AS (SELECT instrument, trading_day, slot, arg_max((open, high, low, close, volume), (received, volume)) AS now, arg_max((open, high, low, close, volume), (received, volume)) FILTER (received <= began + INTERVAL {CUTOFF + FREEZE} MINUTE) AS known,
  max(received) FILTER (received <= began + INTERVAL {CUTOFF + FREEZE} MINUTE) AS at FROM rl WHERE slot < {CUTOFF} GROUP BY 1, 2, 3),
o AS (SELECT instrument, trading_day, count(*) AS used, count(*) FILTER (known IS NULL) AS missing, count(*) FILTER (known IS NOT NULL AND known <> now) AS differing, max(b.at) AS last_received FROM b GROUP BY 1, 2),
s AS (SELECT instrument, trading_day, min(began) + INTERVAL {CUTOFF} MINUTE AS cutoff, max(received) AS last_at, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM rl GROUP BY 1, 2),
l AS (SELECT s.instrument, s.trading_day, count(p.d) FILTER (p.last_at > s.cutoff) AS sessions_late FROM s LEFT JOIN s p ON p.instrument = s.instrument AND p.d BETWEEN s.d - {POOL} AND s.d - 1 GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, used, missing, differing, CAST(sessions_late AS INT) AS sessions_late, strftime(last_received, '%Y-%m-%d %H:%M:%S') AS last_received, missing = 0 AND differing = 0 AND sessions_late = 0 AS verified
FROM o JOIN l USING (instrument, trading_day)""")
def d13(spark, sf_dir):
    out = verified_inputs(kept_log(spark, sf_dir))
    return out.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "used", "missing", "differing", "sessions_late", stamp("last_received").alias("last_received"), "verified")


def receipt_bounds(log: DataFrame, start: str = LOG_START) -> DataFrame:
    """When the inputs of a session's set and of its pool had all been received; a receipt before the log's start is unknown and counts as `start`."""
    floor = F.lit(start).cast("timestamp_ntz")
    final = log.groupBy(*BAR).agg(F.min(began()).alias("began"), F.max("received").alias("received"))
    final = final.withColumn("known", F.when(F.col("received") >= floor, F.col("received")))
    own = final.where(F.col("slot") < CUTOFF).groupBy(*DAY).agg(F.count("*").alias("inputs"), F.count_if(F.col("known").isNull()).alias("unknown"), F.max(F.coalesce("known", floor)).alias("inputs_received_at"))
    whole = final.groupBy(*DAY).agg(F.min("began").alias("began"), F.max(F.coalesce("known", floor)).alias("whole_at"))
    before = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(-POOL, -1)
    whole = whole.withColumn("pool_received_at", F.max("whole_at").over(before))
    cutoff = F.col("began") + minutes(CUTOFF)
    verified = (F.col("pool_received_at") <= cutoff) & (F.col("inputs_received_at") <= cutoff + minutes(LIVE_LAG))
    return own.join(whole, DAY).withColumn("pit_status", F.when(verified, "verified").otherwise("unverified"))


@query("d14_receipt_bounds", f"""
WITH {LOG_SQL}, f AS (SELECT instrument, trading_day, slot, min(began) AS began, max(received) AS received, CASE WHEN max(received) >= TIMESTAMP '{LOG_START}' THEN max(received) END AS known FROM rl GROUP BY 1, 2, 3),
o AS (SELECT instrument, trading_day, count(*) AS inputs, count(*) - count(known) AS unknown, max(coalesce(known, TIMESTAMP '{LOG_START}')) AS inputs_at FROM f WHERE slot < {CUTOFF} GROUP BY 1, 2),
w AS (SELECT instrument, trading_day, min(began) + INTERVAL {CUTOFF} MINUTE AS cutoff, max(coalesce(known, TIMESTAMP '{LOG_START}')) AS whole_at, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM f GROUP BY 1, 2),
p AS (SELECT w.instrument, w.trading_day, w.cutoff, max(e.whole_at) AS pool_at FROM w LEFT JOIN w e ON e.instrument = w.instrument AND e.d BETWEEN w.d - {POOL} AND w.d - 1 GROUP BY 1, 2, 3)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, inputs, unknown, strftime(inputs_at, '%Y-%m-%d %H:%M:%S') AS inputs_received_at, strftime(pool_at, '%Y-%m-%d %H:%M:%S') AS pool_received_at,
  CASE WHEN pool_at <= cutoff AND inputs_at <= cutoff + INTERVAL {LIVE_LAG} MINUTE THEN 'verified' ELSE 'unverified' END AS pit_status FROM o JOIN p USING (instrument, trading_day)""")
def d14(spark, sf_dir):
    out = receipt_bounds(kept_log(spark, sf_dir))
    return out.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "inputs", "unknown", stamp("inputs_received_at").alias("inputs_received_at"), stamp("pool_received_at").alias("pool_received_at"), "pit_status")


def status(seen: str, deadline: Column) -> Column:
    return F.when(F.col(seen).isNull(), "missing").when(F.col(seen) == deadline - 60, "observed").when(F.col(seen) == deadline - 120, "delayed").otherwise("stale")


def deadline_counts(log: DataFrame, deadlines: tuple[int, ...] = DEADLINES) -> DataFrame:
    """Each instrument's status and last price at a deadline as they were known at it, against the complete history's, counted over sessions.

    One pass: a bar's rows serve every deadline after its end; versions received later count for the complete history only.
    """
    days = log.select(*DAY).distinct().withColumn("deadline", F.explode(F.array(*[F.lit(d) for d in deadlines])))
    ended = log.withColumn("deadline", F.explode(F.filter(F.array(*[F.lit(d) for d in deadlines]), lambda d: F.col("slot") + 60 <= d)))
    in_time = F.col("received") <= began() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("deadline"))
    at = F.struct("slot", "received", "volume")
    found = ended.groupBy(*DAY, "deadline").agg(F.max("slot").alias("seen"), F.max_by("close", at).alias("price"), F.max(F.when(in_time, F.col("slot"))).alias("seen_then"), F.max_by("close", F.when(in_time, at)).alias("price_then"))
    rows = days.join(found, [*DAY, "deadline"], "left")
    same = F.col("seen").eqNullSafe(F.col("seen_then")) & F.col("price").eqNullSafe(F.col("price_then"))
    return rows.groupBy("instrument", "deadline", status("seen_then", F.col("deadline")).alias("at_deadline"), status("seen", F.col("deadline")).alias("complete")).agg(F.count("*").alias("sessions"), F.count_if(same).alias("equal_rows"))


@query("d17_deadline_counts", f"""
WITH {LOG_SQL}, t AS (SELECT unnest({list(DEADLINES)}) AS deadline), d AS (SELECT DISTINCT instrument, trading_day FROM rl),
a AS (SELECT instrument, trading_day, deadline, arg_max(slot, (slot, received, volume)) AS seen, arg_max(close, (slot, received, volume)) AS price FROM rl, t WHERE slot + 60 <= deadline GROUP BY 1, 2, 3),
k AS (SELECT instrument, trading_day, deadline, arg_max(slot, (slot, received, volume)) AS seen, arg_max(close, (slot, received, volume)) AS price FROM rl, t WHERE slot + 60 <= deadline AND received <= began + deadline * INTERVAL 1 MINUTE GROUP BY 1, 2, 3),
j AS (SELECT d.instrument, t.deadline, a.seen AS s1, a.price AS p1, k.seen AS s0, k.price AS p0 FROM d CROSS JOIN t LEFT JOIN a USING (instrument, trading_day, deadline) LEFT JOIN k USING (instrument, trading_day, deadline))
SELECT instrument, deadline, CASE WHEN s0 IS NULL THEN 'missing' WHEN s0 = deadline - 60 THEN 'observed' WHEN s0 = deadline - 120 THEN 'delayed' ELSE 'stale' END AS at_deadline,
  CASE WHEN s1 IS NULL THEN 'missing' WHEN s1 = deadline - 60 THEN 'observed' WHEN s1 = deadline - 120 THEN 'delayed' ELSE 'stale' END AS complete, count(*) AS sessions, count(*) FILTER (s0 IS NOT DISTINCT FROM s1 AND p0 IS NOT DISTINCT FROM p1) AS equal_rows FROM j GROUP BY ALL""")
def d17(spark, sf_dir):
    return deadline_counts(kept_log(spark, sf_dir))


#: Slots at which an instrument's freshness is judged, and minutes after its end up to which a bar is fresh.
FRESH_MARKS, FRESH = (300, 480, 900, 1140), 60


def freshness(log: DataFrame, marks: tuple[int, ...] = FRESH_MARKS) -> DataFrame:
    """At each mark of a session the last bar that had ended and been received by then: its slot, age, price, receipt and how long that took, and its state."""
    days = log.select(*DAY).distinct().withColumn("mark", F.explode(F.array(*[F.lit(m) for m in marks])))
    ended = log.withColumn("mark", F.explode(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.col("slot") + 60 <= m)))
    known = ended.where(F.col("received") <= began() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("mark")))
    at = F.struct("slot", "received", "volume")
    last = known.groupBy(*DAY, "mark").agg(F.max("slot").alias("seen"), F.max_by("close", at).alias("price"), F.max_by("received", at).alias("receipt"), F.max_by("bar_start", at).alias("bar_start"))
    out = days.join(last, [*DAY, "mark"], "left").withColumn("age", F.col("mark") - F.col("seen") - 60)
    wait = F.floor((F.unix_seconds(F.col("receipt").cast("timestamp")) - F.unix_seconds((F.col("bar_start") + minutes(60)).cast("timestamp"))) / 60)
    return out.withColumns({"wait": F.when(F.col("seen").isNotNull(), F.greatest(wait, F.lit(0))), "state": F.when(F.col("seen").isNull(), "absent").when(F.col("age") <= FRESH, "fresh").otherwise("stale")})


@query("d15_receipt_freshness", f"""
WITH {LOG_SQL}, t AS (SELECT unnest({list(FRESH_MARKS)}) AS mark), d AS (SELECT DISTINCT instrument, trading_day FROM rl),
k AS (SELECT instrument, trading_day, mark, arg_max((slot, close, received, bar_start), (slot, received, volume)) AS b FROM rl, t WHERE slot + 60 <= mark AND received <= began + mark * INTERVAL 1 MINUTE GROUP BY 1, 2, 3)
SELECT d.instrument, CAST(d.trading_day AS VARCHAR) AS trading_day, t.mark, b[1] AS seen, t.mark - b[1] - 60 AS age, b[2] AS price, strftime(b[3], '%Y-%m-%d %H:%M:%S') AS receipt,
  CASE WHEN b IS NOT NULL THEN greatest(0, CAST(floor((epoch(date_trunc('second', b[3])) - epoch(b[4]) - 3600) / 60) AS BIGINT)) END AS wait,
  CASE WHEN b IS NULL THEN 'absent' WHEN t.mark - b[1] - 60 <= {FRESH} THEN 'fresh' ELSE 'stale' END AS state FROM d CROSS JOIN t LEFT JOIN k USING (instrument, trading_day, mark)""")
def d15(spark, sf_dir):
    out = freshness(kept_log(spark, sf_dir))
    return out.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "mark", "seen", "age", "price", stamp("receipt").alias("receipt"), F.col("wait").cast("bigint").alias("wait"), "state")


#: Minutes after a regular hour's bar at which sets are asked for, and minutes after which the newest one is no longer live.
ASK, LIVE = 30, 90


def issues(log: DataFrame) -> DataFrame:
    """The append-only record of a session's sets: window n is issued once each of its n regular bars has ended and been received for the first time."""
    ended = F.min(F.col("bar_start") + minutes(60))
    first = log.where("session_scope = 'RTH'").groupBy(*BAR).agg(F.greatest(F.min("received"), ended).alias("first_at"), F.min(began()).alias("began"))
    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return first.select(*DAY, "slot", "began", F.row_number().over(Window.partitionBy(*DAY).orderBy("slot")).alias("n"), F.max("first_at").over(w).alias("issued_at"))


def newest_sets(issued: DataFrame) -> DataFrame:
    """At each mark of a session the newest set issued by then, how many there were, and whether it is still live.

    A mark after every regular bar; issues and marks of a session meet in one window ordered by time, so a session's rows are read once.
    """
    asked = issued.select(*DAY, (F.col("began") + minutes(60 + ASK) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("slot"))).alias("at"), F.lit(1).alias("ask"), (F.col("slot") + 60 + ASK).alias("mark"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("timestamp_ntz").alias("issued_at"))
    made = issued.select(*DAY, F.col("issued_at").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("int").alias("mark"), "n", "issued_at")
    w = Window.partitionBy(*DAY).orderBy("at", "ask", "n").rowsBetween(Window.unboundedPreceding, 0)
    seen = made.unionByName(asked).withColumns({"newest": F.max_by("n", F.struct("issued_at", "n")).over(w), "newest_at": F.max("issued_at").over(w), "issued": F.count("n").over(w)})
    seen = seen.where("ask = 1").withColumn("newest", F.when(F.col("issued") > 0, F.col("newest")))
    return seen.select(*DAY, "mark", "newest", "issued", F.coalesce(F.col("newest_at") + minutes(LIVE) >= F.col("at"), F.lit(False)).alias("live"))


@query("a22_newest_set_at", f"""
WITH {LOG_SQL}, f AS (SELECT instrument, trading_day, slot, greatest(min(received), min(bar_start) + INTERVAL 1 HOUR) AS first_at, min(began) AS began FROM rl WHERE session_scope = 'RTH' GROUP BY 1, 2, 3),
i AS (SELECT instrument, trading_day, slot, began, CAST(row_number() OVER (PARTITION BY instrument, trading_day ORDER BY slot) AS INT) AS n, max(first_at) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS issued_at FROM f),
q AS (SELECT instrument, trading_day, slot + {60 + ASK} AS mark, began + (slot + {60 + ASK}) * INTERVAL 1 MINUTE AS moment FROM i)
SELECT q.instrument, CAST(q.trading_day AS VARCHAR) AS trading_day, q.mark, max(n) AS newest, count(n) AS issued, coalesce(max(issued_at) + INTERVAL {LIVE} MINUTE >= moment, false) AS live
FROM q LEFT JOIN i ON i.instrument = q.instrument AND i.trading_day = q.trading_day AND i.issued_at <= q.moment GROUP BY q.instrument, q.trading_day, q.mark, moment""")
def a22(spark, sf_dir):
    return newest_sets(issues(kept_log(spark, sf_dir))).withColumn("trading_day", F.col("trading_day").cast("string"))
