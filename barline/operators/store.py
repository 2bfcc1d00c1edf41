"""Group A: scans, day replacement, ledger, receipts, revisions and fingerprints of a bar store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import latest, r6, stamp
from ..plans import register
from ..sources import BARS_SQL, session_bars, shared_path, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: A day with fewer than this share of its expected bars is partial.
COMPLETE_RATIO = 0.9
TOLERANCE = 1e-9


def scan(bars: DataFrame, instruments: list[str] | None = None, scope: str | None = None, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """A1: bars by instrument, scope and day range; the predicates reach the scan of a stored table."""
    for given, condition in ((instruments, F.col("instrument").isin(instruments or [])), (scope, F.col("session_scope") == scope), (first_day, F.col("trading_day") >= F.lit(first_day).cast("date")), (last_day, F.col("trading_day") <= F.lit(last_day).cast("date"))):
        bars = bars.where(condition) if given else bars
    return bars


@query("a1_bar_scan", f"WITH {BARS_SQL} SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar, open, high, low, close, volume FROM sb WHERE instrument IN ('click', 'view', 'purchase') AND session_scope = 'RTH' AND trading_day BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'")
def a1(spark, sf_dir):
    found = scan(session_bars(spark, sf_dir), ["click", "view", "purchase"], "RTH", "2024-01-08", "2024-01-19")
    return found.select("instrument", stamp("bar_start").alias("bar"), "open", "high", "low", "close", "volume")


def replace_days(batch: DataFrame, path: str) -> None:
    """A2: idempotent whole-day replace: only the (instrument, trading_day) partitions in the batch are overwritten."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "trading_day").parquet(path)


@query("a2_whole_day_replace", f"WITH {BARS_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, count(*) AS bars, round(sum(close), 6) AS total FROM sb GROUP BY 1, 2")
def a2(spark, sf_dir):
    """A store of outdated days, replaced by the current ones twice: what is read back is the current state once."""
    b, path = session_bars(spark, sf_dir), shared_path(spark, "day-store")
    for state in (b.withColumn("close", F.lit(0.0)), b, b):
        replace_days(state.repartition("trading_day"), path)
    found = spark.read.schema(b.schema).parquet(path)
    return found.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.count("*").alias("bars"), r6(F.sum("close")).alias("total"))


def validate(raw: DataFrame, day: str, ts: str, keys: list[str], arrival: list) -> tuple[DataFrame, DataFrame]:
    """A3: rows whose stamp lies in [day - 1, day + 1), the last arrival of each key; and the rejected rows."""
    inside = (F.col(ts) >= F.date_sub(F.col(day), 1).cast("timestamp_ntz")) & (F.col(ts) < F.date_add(F.col(day), 1).cast("timestamp_ntz"))
    good = latest(raw.where(inside), keys, arrival)
    return good, raw.where(~F.coalesce(inside, F.lit(False)))


@query("a3_batch_validation", """
WITH r AS (SELECT *, CAST(ts AS DATE) - CAST(user_id % 3 AS INT) AS day FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts), day ORDER BY event_id DESC) AS k FROM r WHERE ts >= day - 1 AND ts < day + 1)
SELECT event_type, 'valid' AS outcome, count(*) AS n, round(sum(value), 6) AS total FROM g WHERE k = 1 GROUP BY 1
UNION ALL SELECT event_type, 'rejected', count(*), round(sum(value), 6) FROM r WHERE NOT (ts >= day - 1 AND ts < day + 1) GROUP BY 1""")
def a3(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumns({"day": F.date_sub(F.to_date("ts"), (F.col("user_id") % 3).cast("int")), "hour": F.date_trunc("hour", "ts")})
    good, bad = validate(raw, "day", "ts", ["event_type", "hour", "day"], [F.desc("event_id")])
    count = lambda d, name: d.groupBy("event_type").agg(F.lit(name).alias("outcome"), F.count("*").alias("n"), r6(F.sum("value")).alias("total"))
    return count(good, "valid").unionByName(count(bad, "rejected"))


def carry_receipts(new: DataFrame, old: DataFrame, keys: list[str], values: list[str], now: str = "received") -> DataFrame:
    """A4: first_stored_at is kept from the old row; version_stored_at is kept while all values agree within TOLERANCE."""
    o = old.select(*keys, *[F.col(v).alias(f"__{v}") for v in values], F.col("first_stored_at").alias("__first"), F.col("version_stored_at").alias("__version"))
    same = F.lit(True)
    for v in values:
        same = same & (F.abs(F.col(v) - F.col(f"__{v}")) <= TOLERANCE * F.greatest(F.abs(v), F.abs(F.col(f"__{v}")), F.lit(1.0)))
    joined = new.join(o, keys, "left")
    return joined.withColumns({"first_stored_at": F.coalesce("__first", now), "version_stored_at": F.when(F.coalesce(same, F.lit(False)), F.col("__version")).otherwise(F.col(now))}).drop(*[f"__{v}" for v in values], "__first", "__version")


@query("a4_receipt_carry", """
WITH o AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE event_id % 5 <> 0 OR CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1, 2),
n AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT n.event_type, CAST(n.day AS VARCHAR) AS day, CASE WHEN o.v IS NULL THEN 2 ELSE 1 END AS first_stored_at,
  CASE WHEN abs(n.v - o.v) <= 1e-9 * greatest(abs(n.v), abs(o.v), 1.0) THEN 1 ELSE 2 END AS version_stored_at
FROM n LEFT JOIN o USING (event_type, day)""")
def a4(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    old = e.where("event_id % 5 <> 0 OR day < DATE '2024-01-15'").groupBy("event_type", "day").agg(F.sum("value").alias("v"), F.lit(1).alias("first_stored_at"), F.lit(1).alias("version_stored_at"))
    new = e.groupBy("event_type", "day").agg(F.sum("value").alias("v"), F.lit(2).alias("received"))
    out = carry_receipts(new, old, ["event_type", "day"], ["v"])
    return out.select("event_type", F.col("day").cast("string").alias("day"), "first_stored_at", "version_stored_at")


def day_ledger(bars: DataFrame, expected: int, ratio: float = COMPLETE_RATIO) -> DataFrame:
    """A5: counts, first and last bar and status of every stored day. One shuffle, partial counts before it."""
    out = bars.groupBy("instrument", "trading_day").agg(
        F.count("*").alias("bar_count"), F.count_if(F.col("session_scope") == "RTH").alias("rth_bar_count"), F.min("bar_start").alias("first_bar"), F.max("bar_start").alias("last_bar")
    )
    return out.withColumn("status", F.when(F.col("bar_count") < expected * ratio, "PARTIAL").otherwise("COMPLETE"))


LEDGER_SQL = f"""{BARS_SQL}, ledger AS (SELECT instrument, trading_day, count(*) AS bar_count, count(*) FILTER (session_scope = 'RTH') AS rth_bar_count, min(bar_start) AS first_bar, max(bar_start) AS last_bar,
  CASE WHEN count(*) < 23 * 0.9 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM sb GROUP BY 1, 2)"""


@query("a5_day_ledger", f"WITH {LEDGER_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, bar_count, rth_bar_count, strftime(first_bar, '%Y-%m-%d %H:%M:%S') AS first_bar, strftime(last_bar, '%Y-%m-%d %H:%M:%S') AS last_bar, status FROM ledger")
def a5(spark, sf_dir):
    d = day_ledger(session_bars(spark, sf_dir), 23)
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "bar_count", "rth_bar_count", stamp("first_bar").alias("first_bar"), stamp("last_bar").alias("last_bar"), "status")


@query("a6_ledger_lists", f"WITH {LEDGER_SQL} SELECT CAST(trading_day AS VARCHAR) AS trading_day, count(*) AS instruments, max(instrument) AS last_instrument, sum(bar_count)::BIGINT AS bars FROM ledger WHERE bar_count > 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def a6(spark, sf_dir):
    """The ten newest days with what they hold."""
    d = day_ledger(session_bars(spark, sf_dir), 23).where("bar_count > 0")
    out = d.groupBy("trading_day").agg(F.count("*").alias("instruments"), F.max("instrument").alias("last_instrument"), F.sum("bar_count").alias("bars"))
    return out.orderBy(F.desc("trading_day")).limit(10).withColumn("trading_day", F.col("trading_day").cast("string"))


@query("a7_bar_bounds", f"WITH {BARS_SQL} SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start_at, strftime(bar_start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS bar_end_at FROM bars")
def a7(spark, sf_dir):
    return session_bars(spark, sf_dir).select("instrument", stamp("bar_start").alias("bar_start_at"), stamp(F.col("bar_start") + F.expr("INTERVAL 1 HOUR")).alias("bar_end_at"))


def revised(new: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of new whose values differ from the latest stored revision, with the next revision number."""
    last = latest(stored, keys, [F.desc("revision")]).select(*keys, *[F.col(v).alias(f"__{v}") for v in values], "revision")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    joined = new.join(last, keys, "left")
    return joined.where(F.col("revision").isNull() | ~same).withColumn("revision", F.coalesce("revision", F.lit(0)) + 1).drop(*[f"__{v}" for v in values])


@query("a12_revisioned_append", """
WITH s AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS revision, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY revision DESC) AS k FROM s) WHERE k = 1),
n AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS status, '1-URGENT' AS priority FROM customer)
SELECT n.o_custkey, n.status, n.priority, coalesce(l.revision, 0) + 1 AS revision FROM n LEFT JOIN l USING (o_custkey) WHERE l.revision IS NULL OR n.status IS DISTINCT FROM l.status OR n.priority IS DISTINCT FROM l.priority""")
def a12(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    stored = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).cast("long").alias("revision"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "O").otherwise("F").alias("status"), F.lit("1-URGENT").alias("priority"))
    return revised(new, stored, ["o_custkey"], ["status", "priority"]).select("o_custkey", "status", "priority", "revision")


@query("a13_insert_if_absent", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def a13(spark, sf_dir):
    """Candidates whose identity is not stored yet."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("a14_set_digest", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_linenumber || ':' || l_partkey)) AS digest FROM lineitem GROUP BY 1")
def a14(spark, sf_dir):
    """A digest of each set's members in order, the same in any partitioning."""
    member = F.struct("l_linenumber", F.concat_ws(":", "l_linenumber", "l_partkey").alias("m"))
    members = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("s"))
    return members.select("l_orderkey", F.sha2(F.concat_ws(";", "s.m"), 256).alias("digest"))


@query("a15_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def a15(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("o_orderkey"), F.max_by("o_orderstatus", at).alias("o_orderstatus"))


@query("a16_labels_long", "SELECT doc_id, 'quality' AS target, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def a16(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "stack(2, 'quality', quality, 'toxic', toxic) AS (target, label)")


@query("a17_prediction_join", """
SELECT c_mktsegment AS arm, o_orderpriority AS target, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def a17(spark, sf_dir):
    """Outcomes joined through their run to its snapshot, counted by arm and target."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    runs = o.select("o_orderkey", "o_custkey", "o_orderpriority").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("arm")), "o_custkey")
    per_run = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    return per_run.join(runs, "o_orderkey").groupBy("arm", F.col("o_orderpriority").alias("target")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


@query("a18_json_features", "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def a18(spark, sf_dir):
    """Typed columns from a JSON record, parsed once with a fixed schema."""
    e = table(spark, sf_dir, "events").withColumn("f", F.from_json("props", "k int"))
    return e.groupBy("event_type", F.col("f.k").alias("k")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


#: A bar as text for fingerprints: time, prices in millionths, volume.
_UNITS = lambda c: f"CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)"
FINGER_SQL = f"""{BARS_SQL}, fp AS (SELECT instrument, trading_day, count(*) AS n, md5(string_agg(concat_ws('|', strftime(bar_start, '%Y-%m-%d %H:%M:%S'), {', '.join(map(_UNITS, ('open', 'high', 'low', 'close')))}, volume), ';' ORDER BY bar_start)) AS fingerprint FROM sb GROUP BY 1, 2)"""


def fingerprints(bars: DataFrame) -> DataFrame:
    """A fingerprint of each stored day over time, prices and volume of its bars (a day holds a bounded number of them)."""
    units = [F.round(F.col(c) * 1000000).cast("bigint") for c in ("open", "high", "low", "close")]
    row = F.concat_ws("|", stamp("bar_start"), *units, "volume")
    return bars.groupBy("instrument", "trading_day").agg(F.count("*").alias("n"), F.md5(F.concat_ws(";", F.array_sort(F.collect_list(row)))).alias("fingerprint"))


@query("a20_store_fingerprint", f"""WITH {FINGER_SQL}, m AS (SELECT instrument, substr(CAST(trading_day AS VARCHAR), 1, 7) AS month, md5(string_agg(CAST(trading_day AS VARCHAR) || fingerprint, ';' ORDER BY trading_day)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM fp GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, n, fingerprint FROM fp UNION ALL SELECT instrument, month, n, fingerprint FROM m
UNION ALL SELECT instrument, 'all', CAST(sum(n) AS BIGINT), md5(string_agg(month || fingerprint, ';' ORDER BY month)) FROM m GROUP BY 1""")
def a20(spark, sf_dir):
    """Fingerprints of each day, of each month's days and of all months: any changed row changes all three."""
    days = fingerprints(session_bars(spark, sf_dir)).withColumn("trading_day", F.col("trading_day").cast("string"))
    folded = lambda d, key: d.groupBy("instrument", key.alias("of")).agg(F.sum("n").alias("n"), F.md5(F.concat_ws(";", F.array_sort(F.collect_list(F.concat("trading_day", "fingerprint"))))).alias("fingerprint")).withColumnRenamed("of", "trading_day")
    months = folded(days, F.substring("trading_day", 1, 7))
    return days.unionByName(months).unionByName(folded(months, F.lit("all")))


@query("a21_changed_days", f"""
WITH {FINGER_SQL}, t AS (SELECT max(bar_start) - INTERVAL 36 HOUR AS upto FROM sb),
old AS (SELECT instrument, trading_day, md5(string_agg(concat_ws('|', strftime(bar_start, '%Y-%m-%d %H:%M:%S'), {', '.join(map(_UNITS, ('open', 'high', 'low', 'close')))}, volume), ';' ORDER BY bar_start)) AS fingerprint FROM sb, t WHERE bar_start < upto GROUP BY 1, 2)
SELECT fp.instrument, CAST(fp.trading_day AS VARCHAR) AS trading_day, n FROM fp LEFT JOIN old ON old.instrument = fp.instrument AND old.trading_day = fp.trading_day AND old.fingerprint = fp.fingerprint WHERE old.fingerprint IS NULL""")
def a21(spark, sf_dir):
    """Days to load again: those whose fingerprint is not that of the store 36 hours before its newest bar."""
    b = session_bars(spark, sf_dir)
    newest = b.agg((F.max("bar_start") - F.expr("INTERVAL 36 HOURS")).alias("upto"))
    old = b.join(F.broadcast(newest), F.col("bar_start") < F.col("upto"))  # one row is broadcast
    return changed_days(b, old).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "n")


def changed_days(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Days of bars whose fingerprint is not among those of what is stored."""
    return fingerprints(bars).join(fingerprints(stored).select("instrument", "trading_day", "fingerprint"), ["instrument", "trading_day", "fingerprint"], "left_anti")


def normalise_vendor(raw: DataFrame, stamp_column: str, price: str, volume: str, sentinel: float = -1.0) -> DataFrame:
    """Epoch or formatted stamps to time, non-positive volume to 0, the sentinel price to null, unreadable rows dropped."""
    at = F.coalesce(F.timestamp_seconds(F.expr(f"try_cast({stamp_column} AS bigint)")), F.try_to_timestamp(stamp_column, F.lit("yyyyMMdd HH:mm:ss")))
    out = raw.withColumn("at", at).where("at IS NOT NULL")
    return out.withColumns({"price": F.nullif(F.expr(f"try_cast({price} AS double)"), F.lit(sentinel)), "size": F.greatest(F.coalesce(F.expr(f"try_cast({volume} AS bigint)"), F.lit(0)), F.lit(0))})


@query("a24_vendor_rows", """
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 <> 2 AND user_id % 4 <> 0) AS priced, CAST(sum(CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END) AS BIGINT) AS size
FROM events WHERE event_id % 5 <> 4 GROUP BY 1""")
def a24(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = e.select("event_type", F.when(F.col("event_id") % 5 == 4, "n/a").when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyyMMdd HH:mm:ss")).otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).alias("s"),
                   F.when(F.col("event_id") % 3 == 2, "x").when(F.col("user_id") % 4 == 0, "-1").otherwise(F.col("value").cast("string")).alias("p"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(-F.col("user_id")).cast("string").alias("v"))
    rows = normalise_vendor(raw, "s", "p", "v")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.sum("size").alias("size"))


@query("a10_exploded_filings", """SELECT o_custkey AS filer, l_shipdate::DATE::VARCHAR AS filed, l_linenumber AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'""")
def a10(spark, sf_dir):
    """Column arrays of a filer turned into one row a filing, filtered by flag and date."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.to_date("l_shipdate")).alias("filed"), F.collect_list("l_linenumber").alias("item"), F.collect_list("l_returnflag").alias("flag"))
    rows = l.select("l_orderkey", F.explode(F.arrays_zip("filed", "item", "flag")).alias("x")).where("x.flag = 'R' AND x.filed >= DATE '1998-01-01'")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return rows.join(o, "l_orderkey").select(F.col("o_custkey").alias("filer"), F.col("x.filed").cast("string").alias("filed"), F.col("x.item").alias("item"))


@query("a11_coverage_ranges", """WITH c AS (SELECT c_mktsegment AS source, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(day AS VARCHAR) AS day, string_agg(source, ',' ORDER BY source) AS sources FROM d JOIN c ON day BETWEEN a AND b GROUP BY 1""")
def a11(spark, sf_dir):
    """The sources whose range covers each day. Ranges open and close in one ordered pass per source: no range join."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    days = o.select(F.to_date("o_orderdate").alias("day")).distinct()
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day")).join(c.select("c_custkey", F.col("c_mktsegment").alias("source")), "c_custkey")
    covered = urgent.groupBy("source").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(covered, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("a19_definition_registry", "SELECT sha256(p_brand || '|' || p_type || '|' || p_size) AS content, count(*) AS uses, min(p_partkey) AS first_part FROM part GROUP BY 1")
def a19(spark, sf_dir):
    """Definitions keyed by a hash of their content."""
    return table(spark, sf_dir, "part").groupBy(F.sha2(F.concat_ws("|", "p_brand", "p_type", "p_size"), 256).alias("content")).agg(F.count("*").alias("uses"), F.min("p_partkey").alias("first_part"))


@query("a23_review_verdicts", """WITH v AS (SELECT l_partkey AS session, l_shipmode AS field, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS verdict, count(*) AS reviews FROM (SELECT *, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS l_shipmode FROM lineitem) GROUP BY 1, 2)
SELECT field, count(*) AS cells, count(*) FILTER (verdict = 'N') AS agreed, CAST(sum(reviews) AS BIGINT) AS reviews FROM v GROUP BY 1""")
def a23(spark, sf_dir):
    """The latest verdict of each session and field, and agreement by field."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("field")).agg(F.max_by("l_returnflag", at).alias("verdict"), F.count("*").alias("reviews"))
    return v.groupBy("field").agg(F.count("*").alias("cells"), F.count_if(F.col("verdict") == "N").alias("agreed"), F.sum("reviews").alias("reviews"))
