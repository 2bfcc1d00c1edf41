"""Group A, records: outcome documents as VARIANT with digests and revisions, typed matrices from them, and registered definitions.

A session's document is made again at each mark from the bars received by then (the receipt log), so a late receipt gives a document that
differs from the stored one, and only such a document is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import register
from ..sources import table
from .receipts import BAR, DAY, LOG_SQL, as_of, began, kept_log

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Slots at which a session's document is made, and the last time when all is known.
MARKS, FINAL = (720, 1140, 1380), 99_999
#: The fields of a document by part, with their types in a matrix.
LABELS = {"direction": "string", "side": "string", "size": "string"}
MEASUREMENTS = {"bars": "bigint", "open": "bigint", "high": "bigint", "low": "bigint", "close": "bigint", "volume": "bigint", "net": "bigint", "range": "bigint"}
PARTS = {"labels": LABELS, "measurements": MEASUREMENTS}


def documents(log: DataFrame, marks: tuple[int, ...] = (*MARKS, FINAL)) -> DataFrame:
    """instrument, trading_day, mark, doc: the document of a session at each mark at which something of it has been received. Prices are in hundredths."""
    at = F.explode(F.array(*[F.lit(m) for m in marks])).alias("mark")
    known = F.col("received") <= began() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("mark"))
    bars = log.select("*", at).where(known).groupBy(*BAR, "mark").agg(*as_of(log, F.lit(True)))
    cents = lambda c: F.round(c * 100).cast("bigint")
    first, last = (f(F.col(f"values.{v}"), F.col("slot")) for f, v in ((F.min_by, "open"), (F.max_by, "close")))
    d = bars.groupBy(*DAY, "mark").agg(F.count("*").alias("bars"), cents(first).alias("open"), cents(F.max("values.high")).alias("high"), cents(F.min("values.low")).alias("low"), cents(last).alias("close"), F.sum("values.volume").cast("bigint").alias("volume"))
    d = d.withColumns({"net": F.col("close") - F.col("open"), "range": F.col("high") - F.col("low")})
    d = d.withColumns({
        "direction": F.when(F.col("net") > 0, "up").when(F.col("net") < 0, "down").otherwise("flat"),
        "side": F.when(2 * F.col("close") >= F.col("high") + F.col("low"), "upper").otherwise("lower"),
        "size": F.when(F.abs("net") * 2 >= F.col("range"), "wide").otherwise("narrow"),
    })
    doc = F.to_json(F.struct(*[F.struct(*fields).alias(part) for part, fields in PARTS.items()]))
    return d.select(*DAY, "mark", F.parse_json(doc).alias("doc"))


def field(part: str, name: str, doc: str = "doc") -> Column:
    """A typed field of a document; null where it is missing or of another type."""
    return F.try_variant_get(F.col(doc), f"$.{part}.{name}", PARTS[part][name])


def digest(part: str, doc: str = "doc") -> Column:
    """A digest of a part's fields in their stated order, whatever the order in the document."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(field(part, n, doc).cast("string"), F.lit("")) for n in PARTS[part]]), 256)


def revisions(docs: DataFrame) -> DataFrame:
    """Of each session's documents in order of their marks those whose labels or measurements differ from the stored one, numbered, with what changed."""
    w = Window.partitionBy(*DAY).orderBy("mark")
    x = docs.withColumns({f"d_{p}": digest(p) for p in PARTS})
    moved = {p: ~F.lag(f"d_{p}").over(w).eqNullSafe(F.col(f"d_{p}")) for p in PARTS}
    x = x.withColumns({"first": F.row_number().over(w) == 1, **{f"m_{p}": m for p, m in moved.items()}})
    x = x.where("first OR m_labels OR m_measurements").withColumn("revision", F.row_number().over(w))
    changed = F.when(F.col("first"), "first").when(F.col("m_labels") & F.col("m_measurements"), "both").when(F.col("m_labels"), "labels").otherwise("measurements")
    return x.select(*DAY, "mark", "revision", changed.alias("changed"), F.sha2(F.concat("d_labels", "d_measurements"), 256).alias("digest"), "doc")


def matrix(stored: DataFrame) -> DataFrame:
    """A typed row a session from the newest revision of its document, with how many fields are missing."""
    last = stored.groupBy(*DAY).agg(F.max_by("doc", "revision").alias("doc"), F.max("revision").alias("revision"))
    out = last.select(*DAY, "revision", *[field(p, n).alias(n) for p, fields in PARTS.items() for n in fields])
    return out.withColumn("missing", sum((F.col(n).isNull().cast("int") for fields in PARTS.values() for n in fields), F.lit(0)))


def registered(rows: DataFrame, name: str, order: str, content: list[str]) -> DataFrame:
    """The registry after all registrations in order: a name keeps the content it was first registered with; the same content again is known, another is refused."""
    hashed = rows.select(F.col(name).alias("name"), F.col(order).alias("at"), F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256).alias("content"))
    firsts = hashed.groupBy("name").agg(F.min_by("content", "at").alias("registered"), F.min("at").alias("since"))
    same = F.col("content") == F.col("registered")
    return hashed.join(firsts, "name").groupBy("name", "registered", "since").agg((F.count_if(same) - 1).alias("known"), F.count_if(~same).alias("refused"), (F.countDistinct("content") - 1).alias("refused_contents"))


_MARKS = ", ".join(map(str, (*MARKS, FINAL)))
_DOCS = f"""{LOG_SQL},
kb AS (SELECT instrument, trading_day, mark, slot, arg_max((open, high, low, close, volume), (received, volume)) AS b FROM rl, (SELECT unnest([{_MARKS}]) AS mark) WHERE received <= began + mark * INTERVAL 1 MINUTE GROUP BY 1, 2, 3, 4),
dm AS (SELECT instrument, trading_day, mark, count(*) AS bars, CAST(round(arg_min(b[1], slot) * 100) AS BIGINT) AS open, CAST(round(max(b[2]) * 100) AS BIGINT) AS high, CAST(round(min(b[3]) * 100) AS BIGINT) AS low, CAST(round(arg_max(b[4], slot) * 100) AS BIGINT) AS close, CAST(sum(b[5]) AS BIGINT) AS volume FROM kb GROUP BY 1, 2, 3),
dc AS (SELECT *, close - open AS net, high - low AS range, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS direction, CASE WHEN 2 * close >= high + low THEN 'upper' ELSE 'lower' END AS side, CASE WHEN abs(close - open) * 2 >= high - low THEN 'wide' ELSE 'narrow' END AS size FROM dm),
dg AS (SELECT *, sha256(concat_ws('|', {", ".join(LABELS)})) AS dl, sha256(concat_ws('|', {", ".join(MEASUREMENTS)})) AS me FROM dc),
dr AS (SELECT *, row_number() OVER w AS k, lag(dl) OVER w IS DISTINCT FROM dl AS ml, lag(me) OVER w IS DISTINCT FROM me AS mm FROM dg WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY mark)),
rv AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day ORDER BY mark) AS revision FROM dr WHERE k = 1 OR ml OR mm)"""


@query("a12_document_revisions", f"WITH {_DOCS} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, mark, CAST(revision AS INT) AS revision, CASE WHEN k = 1 THEN 'first' WHEN ml AND mm THEN 'both' WHEN ml THEN 'labels' ELSE 'measurements' END AS changed, sha256(dl || me) AS digest FROM rv")
def a12(spark, sf_dir):
    """Revisions of every session's document."""
    return revisions(documents(kept_log(spark, sf_dir))).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "mark", "revision", "changed", "digest")


_NEWEST = "arg_max({c}, revision) AS {c}"


@query("a18_typed_matrix", f"WITH {_DOCS} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(max(revision) AS INT) AS revision, {', '.join(_NEWEST.format(c=c) for c in (*LABELS, *MEASUREMENTS))}, 0 AS missing FROM rv GROUP BY instrument, trading_day")
def a18(spark, sf_dir):
    """All fields of the newest documents, typed."""
    return matrix(revisions(documents(kept_log(spark, sf_dir)))).withColumn("trading_day", F.col("trading_day").cast("string"))


@query("a19_registry_state", """WITH h AS (SELECT p_brand AS name, p_partkey AS at, sha256(concat_ws('|', p_type, CAST(p_size AS VARCHAR))) AS content FROM part),
f AS (SELECT name, arg_min(content, h.at) AS registered, min(h.at) AS since FROM h GROUP BY 1)
SELECT h.name, registered, since, count(*) FILTER (content = registered) - 1 AS known, count(*) FILTER (content <> registered) AS refused, count(DISTINCT content) - 1 AS refused_contents FROM h JOIN f ON f.name = h.name GROUP BY 1, 2, 3""")
def a19(spark, sf_dir):
    """Parts register the definition of their brand in order of their keys."""
    return registered(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_type", "p_size"])
