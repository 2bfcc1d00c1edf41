"""Group H: class-distribution forecasts from counts: smoothing, ties, priors, quantisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from ..plans import register
from .indicators import REFS_SQL, overnight_references, weekday_bars
from .labels import FWD_SQL, forward_labels
from .matching import TOP_SQL, matches

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
CLASSES = ["bearish", "bullish", "neutral_band"]


def labelled(spark, sf_dir) -> DataFrame:
    """Every labelled forward window: instrument, trading_day, slot, label."""
    return forward_labels(weekday_bars(spark, sf_dir), 2, 10.0).where("label IS NOT NULL").select("instrument", "trading_day", "slot", "label", "move")


LAB_SQL = f"{FWD_SQL}, lab AS (SELECT instrument, trading_day, slot, label, move FROM fw WHERE label IS NOT NULL), cls AS (SELECT unnest(['bearish', 'bullish', 'neutral_band']) AS label)"


def with_classes(df: DataFrame) -> DataFrame:
    """df crossed with the class vocabulary (a fixed list): one row a class."""
    return df.withColumn("label", F.explode(F.array(*[F.lit(c) for c in CLASSES])))


def smoothed(rows: DataFrame, keys: list[str], k: float = 1.0) -> DataFrame:
    """H1: (count + k) / (n + classes * k) for every class of every key; counts are pre-aggregated before the shuffle."""
    counts = rows.groupBy(*keys, "label").agg(F.count("*").alias("c"))
    full = with_classes(counts.select(*keys).distinct()).join(counts, [*keys, "label"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return full.withColumn("n", F.sum("c").over(Window.partitionBy(*keys))).withColumn("p", (F.col("c") + k) / (F.col("n") + k * len(CLASSES)))


DIST_SQL = f"""{LAB_SQL}, ct AS (SELECT instrument, slot, label, count(*) AS c FROM lab GROUP BY 1, 2, 3), di AS (SELECT k.instrument, k.slot, cls.label, coalesce(c, 0) AS c, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY k.instrument, k.slot) AS BIGINT) AS n
  FROM (SELECT DISTINCT instrument, slot FROM ct) k CROSS JOIN cls LEFT JOIN ct ON ct.instrument = k.instrument AND ct.slot = k.slot AND ct.label = cls.label), ds AS (SELECT *, (c + 1) / (n + 3) AS p FROM di)"""


def distribution(spark, sf_dir) -> DataFrame:
    return smoothed(labelled(spark, sf_dir), ["instrument", "slot"])


@query("h1_smoothed_distribution", f"WITH {DIST_SQL} SELECT instrument, slot, label, c, n, round(p, 6) AS p FROM ds")
def h1(spark, sf_dir):
    return distribution(spark, sf_dir).select("instrument", "slot", "label", "c", "n", r6("p").alias("p"))


@query("h2_argmax_ties", f"WITH {DIST_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY instrument, slot ORDER BY c DESC) AS k FROM ds) SELECT instrument, slot, CASE WHEN count(*) = 1 THEN min(label) END AS predicted, CASE WHEN count(*) = 1 THEN 'predicted' ELSE 'ambiguous' END AS status FROM r WHERE k = 1 GROUP BY 1, 2")
def h2(spark, sf_dir):
    """The most likely class; exact ties of counts are ambiguous."""
    r = distribution(spark, sf_dir).withColumn("k", F.rank().over(Window.partitionBy("instrument", "slot").orderBy(F.desc("c")))).where("k = 1")
    return r.groupBy("instrument", "slot").agg(F.when(F.count("*") == 1, F.min("label")).alias("predicted"), F.when(F.count("*") == 1, "predicted").otherwise("ambiguous").alias("status"))


@query("h3_nearest_levels", f"""WITH {REFS_SQL}, l AS (SELECT instrument, trading_day, cutoff_price, unnest(['on_open', 'on_high', 'on_low']) AS name, unnest([on_open, on_high, on_low]) AS level FROM refs WHERE cutoff_price IS NOT NULL),
m AS (SELECT instrument, trading_day, cutoff_price, level, string_agg(name, '+' ORDER BY name) AS names FROM l GROUP BY 1, 2, 3, 4), r AS (SELECT *, CASE WHEN level >= cutoff_price THEN 'above' ELSE 'below' END AS side FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day, side ORDER BY abs(level - cutoff_price), level) AS k FROM r)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, side, CAST(k AS INT) AS k, names, level FROM q WHERE k <= 2""")
def h3(spark, sf_dir):
    """The two nearest levels on each side of the cutoff price; equal ones are merged."""
    names = ["on_open", "on_high", "on_low"]
    r = overnight_references(weekday_bars(spark, sf_dir)).where("cutoff_price IS NOT NULL")
    long = r.select("instrument", "trading_day", "cutoff_price", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("level")) for n in names])).alias("x"))
    merged = long.groupBy("instrument", "trading_day", "cutoff_price", F.col("x.level").alias("level")).agg(F.array_join(F.array_sort(F.collect_list("x.name")), "+").alias("names"))
    merged = merged.withColumn("side", F.when(F.col("level") >= F.col("cutoff_price"), "above").otherwise("below"))
    w = Window.partitionBy("instrument", "trading_day", "side").orderBy(F.abs(F.col("level") - F.col("cutoff_price")), "level")
    return merged.withColumn("k", F.row_number().over(w)).where("k <= 2").select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "side", "k", "names", "level")


@query("h4_eligibility", f"WITH {REFS_SQL} SELECT CASE WHEN on_bars = 0 THEN 'no overnight bars' WHEN cutoff_slot < 840 THEN 'stale cutoff' WHEN on_high = on_low THEN 'no range' ELSE 'eligible' END AS reason, count(*) AS n FROM refs GROUP BY 1")
def h4(spark, sf_dir):
    r = overnight_references(weekday_bars(spark, sf_dir))
    return r.groupBy(F.when(F.col("on_bars") == 0, "no overnight bars").when(F.col("cutoff_slot") < 840, "stale cutoff").when(F.col("on_high") == F.col("on_low"), "no range").otherwise("eligible").alias("reason")).agg(F.count("*").alias("n"))


@query("h5_frozen_evidence", f"""WITH {TOP_SQL}, mv AS (SELECT instrument, trading_day, CASE WHEN arg_max(close, slot) > arg_min(open, slot) THEN 'up' ELSE 'down' END AS label FROM wd WHERE session_scope = 'RTH' GROUP BY 1, 2),
s AS (SELECT tp.instrument, tp.trading_day, count(label) AS members, count(*) FILTER (label = 'up') AS up FROM tp LEFT JOIN mv ON mv.instrument = tp.instrument AND mv.trading_day = tp.earlier GROUP BY 1, 2),
p AS (SELECT s.*, count(mv.label) AS prior_n, count(*) FILTER (mv.label = 'up') AS prior_up FROM s LEFT JOIN mv ON mv.instrument = s.instrument AND mv.trading_day < s.trading_day GROUP BY ALL)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, members, up, prior_n, prior_up, round((up + 4 * (prior_up + 1) / (prior_n + 2)) / (members + 4), 6) AS p_up FROM p""")
def h5(spark, sf_dir):
    """Members' labels and the prior of all earlier sessions, blended with four pseudo-counts. The prior is a running sum, not a range join."""
    b = weekday_bars(spark, sf_dir)
    out = b.where("session_scope = 'RTH'").groupBy("instrument", "trading_day").agg(F.when(F.max_by("close", "slot") > F.min_by("open", "slot"), 1).otherwise(0).alias("up"))
    m = matches(spark, sf_dir).join(out.select("instrument", F.col("trading_day").alias("earlier"), "up"), ["instrument", "earlier"], "left")
    s = m.groupBy("instrument", "trading_day").agg(F.count("up").alias("members"), F.count_if(F.col("up") == 1).alias("up"))
    days = b.select("instrument", "trading_day").distinct().join(out.withColumnRenamed("up", "u"), ["instrument", "trading_day"], "left")
    w = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    prior = days.select("instrument", "trading_day", F.count("u").over(w).alias("prior_n"), F.coalesce(F.sum("u").over(w), F.lit(0)).alias("prior_up"))
    j = s.join(prior, ["instrument", "trading_day"])
    p = (F.col("up") + 4 * (F.col("prior_up") + 1) / (F.col("prior_n") + 2)) / (F.col("members") + 4)
    return j.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "members", "up", "prior_n", "prior_up", r6(p).alias("p_up"))


@query("h11_conditional_prior", f"""WITH {LAB_SQL}, g AS (SELECT instrument, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY instrument) AS n FROM lab GROUP BY 1, 2), k AS (SELECT instrument, slot, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY instrument, slot) AS n FROM lab GROUP BY 1, 2, 3)
SELECT k.instrument, k.slot, k.label, round((k.c + 20 * (g.c / g.n)) / (k.n + 20), 6) AS p FROM k JOIN g USING (instrument, label)""")
def h11(spark, sf_dir):
    """A prior by clock, shrunk to the instrument's own."""
    c = labelled(spark, sf_dir).groupBy("instrument", "slot", "label").agg(F.count("*").alias("c"))
    k = c.withColumn("n", F.sum("c").over(Window.partitionBy("instrument", "slot")))
    g = c.groupBy("instrument", "label").agg(F.sum("c").alias("gc")).withColumn("gn", F.sum("gc").over(Window.partitionBy("instrument")))
    return k.join(g, ["instrument", "label"]).select("instrument", "slot", "label", r6((F.col("c") + 20 * (F.col("gc") / F.col("gn"))) / (F.col("n") + 20)).alias("p"))


@query("h12_quantised", f"""WITH {DIST_SQL}, f AS (SELECT *, CAST(c + 1 AS BIGINT) * 1000000 // (n + 3) AS units, CAST(c + 1 AS BIGINT) * 1000000 % (n + 3) AS rest FROM ds), r AS (SELECT *, 1000000 - sum(units) OVER w AS missing, row_number() OVER (w ORDER BY rest DESC, label) AS k FROM f WINDOW w AS (PARTITION BY instrument, slot))
SELECT instrument, slot, label, CAST(units + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def h12(spark, sf_dir):
    """Probabilities in millionths that sum exactly: whole parts first, then the largest remainders. Integers throughout."""
    d = distribution(spark, sf_dir)
    num, den = (F.col("c") + 1) * 1_000_000, F.col("n") + 3
    d = d.withColumns({"units": F.expr("((c + 1) * 1000000) div (n + 3)"), "rest": num % den})
    w = Window.partitionBy("instrument", "slot")
    d = d.withColumns({"missing": 1_000_000 - F.sum("units").over(w), "k": F.row_number().over(w.orderBy(F.desc("rest"), "label"))})
    return d.select("instrument", "slot", "label", (F.col("units") + F.when(F.col("k") <= F.col("missing"), 1).otherwise(0)).cast("long").alias("units"))


@query("h13_temperature", f"WITH {DIST_SQL}, z AS (SELECT *, CASE WHEN label = 'neutral_band' AND slot >= 1200 THEN 0 ELSE p END AS q FROM ds) SELECT instrument, slot, label, round(pow(q, 0.8) / sum(pow(q, 0.8)) OVER (PARTITION BY instrument, slot), 6) AS p FROM z")
def h13(spark, sf_dir):
    """Structural zeros, then a temperature, then renormalised within each forecast."""
    q = F.when((F.col("label") == "neutral_band") & (F.col("slot") >= 1200), 0.0).otherwise(F.col("p"))
    z = distribution(spark, sf_dir).withColumn("q", F.pow(q, F.lit(0.8)))
    return z.select("instrument", "slot", "label", r6(F.col("q") / F.sum("q").over(Window.partitionBy("instrument", "slot"))).alias("p"))


@query("h17_contract_violations", f"WITH {DIST_SQL} SELECT count(*) AS forecasts, count(*) FILTER (classes <> 3) AS wrong_classes, count(*) FILTER (abs(total - 1) > 1e-9) AS wrong_sum FROM (SELECT instrument, slot, count(*) AS classes, sum(p) AS total FROM ds GROUP BY 1, 2)")
def h17(spark, sf_dir):
    """Forecasts that break the contract: the full vocabulary and a sum of one."""
    g = distribution(spark, sf_dir).groupBy("instrument", "slot").agg(F.count("*").alias("classes"), F.sum("p").alias("total"))
    return g.agg(F.count("*").alias("forecasts"), F.count_if(F.col("classes") != 3).alias("wrong_classes"), F.count_if(F.abs(F.col("total") - 1) > 1e-9).alias("wrong_sum"))


@query("h18_symmetrised", f"WITH {DIST_SQL} SELECT instrument, slot, label, round(avg(p) OVER (PARTITION BY instrument, slot, label = 'neutral_band'), 6) AS p FROM ds")
def h18(spark, sf_dir):
    w = Window.partitionBy("instrument", "slot", F.col("label") == "neutral_band")
    return distribution(spark, sf_dir).select("instrument", "slot", "label", r6(F.avg("p").over(w)).alias("p"))


@query("h21_expanding_prior", f"""WITH {LAB_SQL}, d AS (SELECT instrument, trading_day, count(*) AS n, count(*) FILTER (label = 'bullish') AS b FROM lab GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, round((coalesce(sum(b) OVER w, 0) + 1) / (coalesce(sum(n) OVER w, 0) + 3), 6) AS p FROM d WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)""")
def h21(spark, sf_dir):
    """The share of a class in all sessions up to an embargo of one before each: a running sum."""
    d = labelled(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "bullish").alias("b"))
    w = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -2)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), r6((total("b") + 1) / (total("n") + 3)).alias("p"))


@query("h6_missing_runs", f"""WITH {TOP_SQL}, w AS (SELECT instrument, trading_day, a AS algorithm FROM (SELECT DISTINCT instrument, trading_day FROM tp), (SELECT unnest(['frequency', 'matched', 'prior']) AS a)), s AS (SELECT DISTINCT instrument, trading_day, 'frequency' AS algorithm FROM tp WHERE trading_day < DATE '2024-01-15')
SELECT algorithm, count(*) AS missing FROM w ANTI JOIN s USING (instrument, trading_day, algorithm) GROUP BY 1""")
def h6(spark, sf_dir):
    """Every session with every algorithm, less the runs that are stored."""
    sets = matches(spark, sf_dir).select("instrument", "trading_day").distinct()
    want = sets.withColumn("algorithm", F.explode(F.array(*[F.lit(a) for a in ("frequency", "matched", "prior")])))
    stored = sets.where("trading_day < DATE '2024-01-15'").withColumn("algorithm", F.lit("frequency"))
    return want.join(stored, ["instrument", "trading_day", "algorithm"], "left_anti").groupBy("algorithm").agg(F.count("*").alias("missing"))


@query("h7_run_selection", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def h7(spark, sf_dir):
    """The run in force: by algorithm priority, then the latest."""
    from ..functions import latest
    from ..sources import table

    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return latest(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], [rank, F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


def outcomes(spark, sf_dir) -> DataFrame:
    """A row for each labelled window and class: p from the windows of earlier sessions at the same clock only, and whether the class was realised.

    The counts are running sums over one window a clock; a session never enters its own forecast.
    """
    before = Window.partitionBy("instrument", "slot").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    x = labelled(spark, sf_dir).withColumnRenamed("label", "realised").withColumn("n", F.count("*").over(before))
    counts = [F.coalesce(F.sum(F.when(F.col("realised") == c, 1).otherwise(0)).over(before), F.lit(0)).alias(f"c_{c}") for c in CLASSES]
    x = x.select("*", *counts)
    rows = x.withColumn("x", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"c_{c}").alias("c")) for c in CLASSES])))
    rows = rows.select("instrument", "trading_day", "slot", "realised", "x.label", "x.c", "n")
    return rows.withColumns({"p": (F.col("c") + 1) / (F.col("n") + len(CLASSES)), "hit": F.when(F.col("label") == F.col("realised"), 1.0).otherwise(0.0)})


OUT_SQL = f"""{DIST_SQL}, wf AS (SELECT lab.instrument, lab.trading_day, lab.slot, lab.label AS realised, cls.label, coalesce(sum(CASE WHEN lab.label = cls.label THEN 1 ELSE 0 END) OVER w, 0) AS c, count(*) OVER w AS n FROM lab CROSS JOIN cls
  WINDOW w AS (PARTITION BY lab.instrument, lab.slot, cls.label ORDER BY lab.trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ou AS (SELECT *, (c + 1) / (n + 3) AS p, CASE WHEN label = realised THEN 1.0 ELSE 0.0 END AS hit FROM wf)"""


@query("h8_grading", f"""WITH {OUT_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY instrument, trading_day, slot ORDER BY c DESC) AS k FROM ou), b AS (SELECT instrument, trading_day, slot, max(realised) AS realised, CASE WHEN count(*) = 1 THEN min(label) END AS predicted, max(p) AS top FROM r WHERE k = 1 GROUP BY 1, 2, 3)
SELECT instrument, count(*) AS cases, count(*) FILTER (predicted = realised) AS correct, count(*) FILTER (predicted IS NULL) AS ambiguous, round(count(*) FILTER (predicted = realised) / count(*) - 1 / 3.0, 6) AS above_chance FROM b GROUP BY 1""")
def h8(spark, sf_dir):
    """Predictions of earlier sessions graded against outcomes, and against chance."""
    r = outcomes(spark, sf_dir).withColumn("k", F.rank().over(Window.partitionBy("instrument", "trading_day", "slot").orderBy(F.desc("c")))).where("k = 1")
    b = r.groupBy("instrument", "trading_day", "slot").agg(F.max("realised").alias("realised"), F.when(F.count("*") == 1, F.min("label")).alias("predicted"))
    right = F.count_if(F.col("predicted") == F.col("realised"))
    return b.groupBy("instrument").agg(F.count("*").alias("cases"), right.alias("correct"), F.count_if(F.col("predicted").isNull()).alias("ambiguous"), r6(right / F.count("*") - 1 / 3.0).alias("above_chance"))


@query("h10_keyed_prior", f"""WITH {LAB_SQL}, k AS (SELECT slot, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY slot) AS n FROM lab GROUP BY 1, 2), g AS (SELECT label, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY 1)
SELECT s.slot, g.label, round(CASE WHEN n.n >= 50 THEN (coalesce(k.c, 0) + 1) / (n.n + 3) ELSE g.p END, 6) AS p FROM (SELECT DISTINCT slot FROM lab) s CROSS JOIN g LEFT JOIN k ON k.slot = s.slot AND k.label = g.label LEFT JOIN (SELECT slot, max(n) AS n FROM k GROUP BY 1) n ON n.slot = s.slot""")
def h10(spark, sf_dir):
    """The prior of a clock where it has enough cases, else the overall one."""
    rows = labelled(spark, sf_dir).groupBy("slot", "label").agg(F.count("*").alias("c"))
    overall = rows.groupBy("label").agg(F.sum("c").alias("gc")).withColumn("g", F.col("gc") / F.sum("gc").over(Window.partitionBy()))  # a row a class
    n = rows.groupBy("slot").agg(F.sum("c").alias("n"))
    full = n.crossJoin(F.broadcast(overall)).join(rows, ["slot", "label"], "left")
    return full.select("slot", "label", r6(F.when(F.col("n") >= 50, (F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + 3)).otherwise(F.col("g"))).alias("p"))


@query("h14_blend_weight", f"""WITH {OUT_SQL}, o AS (SELECT instrument, trading_day, sum((hit - 1 / 3.0) * (p - 1 / 3.0)) AS x, sum((p - 1 / 3.0) ** 2) AS xx FROM ou GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, round(least(1, greatest(0, coalesce(sum(x) OVER w / nullif(sum(xx) OVER w, 0), 0))), 6) AS weight FROM o WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def h14(spark, sf_dir):
    """The least-squares weight of a forecast against the uniform one, clipped: a ratio of two running sums over the sessions before (0 without any)."""
    third = 1 / 3.0
    o = outcomes(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.sum((F.col("hit") - third) * (F.col("p") - third)).alias("x"), F.sum((F.col("p") - third) ** 2).alias("xx"))
    w = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.coalesce(F.sum("x").over(w) / F.nullif(F.sum("xx").over(w), F.lit(0.0)), F.lit(0.0))
    return o.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))).alias("weight"))


@query("h16_evidence_consistency", f"WITH {TOP_SQL} SELECT count(*) FILTER (earlier >= trading_day) AS not_earlier, count(*) FILTER (rank > 5) AS too_many, count(*) AS members FROM tp")
def h16(spark, sf_dir):
    """Members of sets that are not strictly earlier, or too many: both must be 0."""
    m = matches(spark, sf_dir)
    return m.agg(F.count_if(F.col("earlier") >= F.col("trading_day")).alias("not_earlier"), F.count_if(F.col("rank") > 5).alias("too_many"), F.count("*").alias("members"))
