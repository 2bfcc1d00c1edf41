"""Group L: proper scores, tallies, reliability, block-bootstrap intervals and comparisons of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percentiles, r6, trailing_quantiles
from ..plans import register
from ..sources import table
from .fan import HOR_SQL, scored_origins, seasonal, short_level
from .features import TOTALS_SQL, daily_totals
from .forecasts import DIST_SQL, OUT_SQL, distribution, outcomes

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: The constants of the usual rational approximation of the error function (7.1.26 in the handbook of mathematical functions).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911

#: Differences of scores below it are rounding: neither side is better.
SAME = 1e-9


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1.0 - poly * F.exp(-a * a))


def crps_normal(y: Column, sigma: Column) -> Column:
    """L3: the CRPS of N(0, sigma squared) at y, in closed form."""
    z = y / sigma
    return sigma * (z * erf(z / 2.0**0.5) + 2.0 * F.exp(-0.5 * z * z) / (2.0 * 3.141592653589793) ** 0.5 - 1.0 / 3.141592653589793**0.5)


def erf_sql(z: str) -> str:
    """The error function of z over the root of two, for DuckDB."""
    t = f"(1.0 / (1.0 + {ERF_P} * abs({z}) / sqrt(2.0)))"
    poly = ""
    for c in reversed(ERF):
        poly = f"(({poly} + {c}) * {t})" if poly else f"({c} * {t})"
    return f"sign({z}) * (1.0 - {poly} * exp(-{z} * {z} / 2))"


_ERF_SQL = erf_sql("z")
SCORE_SQL = f"{HOR_SQL}, sc AS (SELECT *, sqrt(var) AS sigma, sqrt(var) * (z * ({_ERF_SQL}) + 2.0 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1.0 / sqrt(pi())) AS crps, abs(y) AS flat FROM hz)"


def scored(spark, sf_dir) -> DataFrame:
    """Origins with sigma, the normal forecast's CRPS, and the absolute error of a flat forecast."""
    return scored_origins(spark, sf_dir).withColumn("sigma", F.sqrt("var")).withColumns({"crps": crps_normal(F.col("y"), F.col("sigma")), "flat": F.abs("y")})


CASE_SQL = f"{OUT_SQL}, cs AS (SELECT instrument, trading_day, slot, sum((p - hit) ** 2) AS brier, -ln(max(p) FILTER (hit = 1)) AS log_loss FROM ou GROUP BY 1, 2, 3)"


def case_scores(spark, sf_dir) -> DataFrame:
    """L1: Brier (unhalved) and log loss of every case; a zero probability has an infinite loss."""
    p = F.max(F.when(F.col("hit") == 1, F.col("p")))
    return outcomes(spark, sf_dir).groupBy("instrument", "trading_day", "slot").agg(F.sum((F.col("p") - F.col("hit")) ** 2).alias("brier"), F.when(p == 0, float("inf")).otherwise(-F.log(p)).alias("log_loss"))


@query("l1_brier_log_loss", f"WITH {CASE_SQL} SELECT instrument, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss FROM cs GROUP BY 1")
def l1(spark, sf_dir):
    return case_scores(spark, sf_dir).groupBy("instrument").agg(F.count("*").alias("n"), r6(F.avg("brier")).alias("brier"), r6(F.avg("log_loss")).alias("log_loss"))


@query("l2_ranked_probability", f"""WITH {OUT_SQL}, o AS (SELECT *, CASE label WHEN 'bearish' THEN 1 WHEN 'neutral_band' THEN 2 ELSE 3 END AS k FROM ou), c AS (SELECT *, sum(p) OVER w AS cp, sum(hit) OVER w AS ch FROM o WINDOW w AS (PARTITION BY instrument, trading_day, slot ORDER BY k))
SELECT instrument, round(avg(s), 6) AS rps FROM (SELECT instrument, trading_day, slot, sum((cp - ch) ** 2) AS s FROM c GROUP BY 1, 2, 3) GROUP BY 1""")
def l2(spark, sf_dir):
    """The ranked probability score over the ordered classes."""
    k = F.when(F.col("label") == "bearish", 1).when(F.col("label") == "neutral_band", 2).otherwise(3)
    case = ["instrument", "trading_day", "slot"]
    g = outcomes(spark, sf_dir).groupBy(*case).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), "p", "hit"))).alias("c"))  # three classes a case
    total = lambda f, i: F.aggregate(F.slice(F.col("c"), 1, i), F.lit(0.0), lambda s, x: s + x[f])
    s = sum(((total("p", i) - total("hit", i)) ** 2 for i in (1, 2, 3)), F.lit(0.0))
    return g.select("instrument", s.alias("s")).groupBy("instrument").agg(r6(F.avg("s")).alias("rps"))


@query("l3_normal_crps", f"WITH {SCORE_SQL} SELECT instrument, h, count(*) AS n, round(avg(crps), 6) AS crps, round(1 - avg(crps) / avg(flat), 6) AS skill FROM sc GROUP BY 1, 2")
def l3(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("instrument", "h").agg(F.count("*").alias("n"), r6(F.avg("crps")).alias("crps"), r6(1 - F.avg("crps") / F.avg("flat")).alias("skill"))


#: Levels of the quantile-form score: (k - 0.5) / K.
K = 200
TAU = [(k + 0.5) / K for k in range(K)]
_HISTORY = "hs AS (SELECT *, dense_rank() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM hz)"


def earlier_quantiles(o: DataFrame, taus: list[float], sessions: int = 120, least: int = 40) -> DataFrame:
    """instrument, trading_day, d (session number), h, q: quantiles of z over the `sessions` sessions before each, from `least` values at least."""
    q = trailing_quantiles(o, o, ["instrument", "h"], "d", "z", taus, sessions).where(F.col("n") >= least)
    return o.select("instrument", "trading_day", "d").distinct().join(q.drop("n"), ["instrument", "d"])


def numbered(o: DataFrame) -> DataFrame:
    """Origins with d, the number of their session among those of the instrument."""
    days = o.select("instrument", "trading_day").distinct().withColumn("d", F.row_number().over(Window.partitionBy("instrument").orderBy("trading_day")))
    return o.join(days, ["instrument", "trading_day"])


@query("l4_quantile_crps", f"""WITH {HOR_SQL}, {_HISTORY}, dd AS (SELECT DISTINCT instrument, trading_day, d FROM hs), q AS (SELECT dd.instrument, dd.trading_day, hs.h, quantile_cont(hs.z, {TAU}) AS q FROM dd JOIN hs ON hs.instrument = dd.instrument AND hs.d BETWEEN dd.d - 120 AND dd.d - 1 GROUP BY 1, 2, 3 HAVING count(*) >= 40)
SELECT h, count(*) AS n, round(avg(2 * list_sum(list_transform(list_zip(q, {TAU}), lambda x: greatest(x[2] * (z - x[1]), (x[2] - 1) * (z - x[1])))) / {K}), 6) AS crps FROM hz JOIN q USING (instrument, trading_day, h) GROUP BY 1""")
def l4(spark, sf_dir):
    """Twice the mean pinball loss over K quantile levels of the sessions before."""
    o = numbered(scored_origins(spark, sf_dir).select("instrument", "trading_day", "h", "z"))
    q = earlier_quantiles(o, TAU)
    loss = F.aggregate(F.zip_with("q", F.array(*[F.lit(t) for t in TAU]), lambda x, t: F.greatest(t * (F.col("z") - x), (t - 1) * (F.col("z") - x))), F.lit(0.0), lambda s, x: s + x)
    return o.join(q, ["instrument", "trading_day", "d", "h"]).select("h", (2 * loss / K).alias("c")).groupBy("h").agg(F.count("*").alias("n"), r6(F.avg("c")).alias("crps"))


@query("l5_ensemble_crps", """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS y, list_transform(embedding[2:9], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings)
SELECT vec_id, round(list_avg(list_transform(m, lambda x: abs(x - y))) - (SELECT sum(abs(a - b)) FROM unnest(m) t(a), unnest(m) u(b)) / (2.0 * 8 * 7), 6) AS crps FROM v""")
def l5(spark, sf_dir):
    """The fair CRPS of an ensemble of eight members: sorted members weigh their pairwise spread in one pass."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("y"), F.array_sort(F.transform(F.slice("embedding", 2, 8), lambda x: x.cast("double"))).alias("m"))
    error = F.aggregate("m", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("y"))) / 8
    spread = F.aggregate(F.transform("m", lambda x, i: x * (2 * i - 7)), F.lit(0.0), lambda s, x: s + x) * 2
    return v.select("vec_id", r6(error - spread / (2.0 * 8 * 7)).alias("crps"))


@query("l6_tallies", f"""WITH {SCORE_SQL} SELECT h, phase, count(*) AS n, round(avg(crps), 6) AS crps, round(sqrt(avg(z * z)), 6) AS rms, count(*) FILTER (abs(z) <= 0.6744897501960817) AS in50, count(*) FILTER (abs(z) <= 1.6448536269514722) AS in90
FROM sc GROUP BY GROUPING SETS ((h), (h, phase))""")
def l6(spark, sf_dir):
    """Counts, scores and coverage by horizon, and by horizon and phase, from one pass."""
    s = scored(spark, sf_dir)
    s = s.groupingSets([[F.col("h")], [F.col("h"), F.col("phase")]], "h", "phase")
    inside = lambda q: F.count_if(F.abs("z") <= q)
    return s.agg(F.count("*").alias("n"), r6(F.avg("crps")).alias("crps"), r6(F.sqrt(F.avg(F.col("z") * F.col("z")))).alias("rms"), inside(0.6744897501960817).alias("in50"), inside(1.6448536269514722).alias("in90"))


@query("l8_recent_accuracy", f"""WITH {SCORE_SQL}, d AS (SELECT instrument, trading_day, h, sum(crps) AS c, sum(flat) AS f FROM sc GROUP BY 1, 2, 3)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, h, round(1 - sum(c) OVER w / nullif(sum(f) OVER w, 0), 6) AS skill FROM d WINDOW w AS (PARTITION BY instrument, h ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def l8(spark, sf_dir):
    """Skill over the five sessions before each."""
    d = scored(spark, sf_dir).groupBy("instrument", "trading_day", "h").agg(F.sum("crps").alias("c"), F.sum("flat").alias("f"))
    w = Window.partitionBy("instrument", "h").orderBy("trading_day").rowsBetween(-5, -1)
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "h", r6(1 - F.sum("c").over(w) / F.nullif(F.sum("f").over(w), F.lit(0.0))).alias("skill"))


@query("l10_paired_candidate", f"""WITH {SCORE_SQL}, cd AS (SELECT *, sqrt(var / level) AS sigma0 FROM sc JOIN (SELECT instrument, trading_day, slot, level FROM sl) USING (instrument, trading_day, slot)),
zz AS (SELECT *, y / sigma0 AS z0, sigma0 * 1.0 AS s0 FROM cd), ca AS (SELECT h, phase, trading_day, crps, s0 * (z0 * e + 2.0 * exp(-0.5 * z0 * z0) / sqrt(2 * pi()) - 1.0 / sqrt(pi())) AS cand FROM (SELECT *, {erf_sql('z0')} AS e FROM zz)),
d AS (SELECT h, phase, trading_day, avg(crps) AS base, avg(cand) AS cand, count(*) AS origins FROM ca GROUP BY 1, 2, 3)
SELECT h, phase, count(*) AS sessions, CAST(sum(origins) AS BIGINT) AS origins, round(avg(base), 6) AS base, round(avg(cand), 6) AS candidate, round(avg(cand - base), 6) AS difference, count(*) FILTER (cand < base) >= 0.6 * count(*) AND avg(cand - base) < 0 AS better FROM d GROUP BY 1, 2""")
def l10(spark, sf_dir):
    """A candidate (the variance without its level) against the baseline on the same origins, as means of session means, with a verdict."""
    level = short_level(seasonal(spark, sf_dir)).select("instrument", "trading_day", "slot", "level")
    x = scored(spark, sf_dir).join(level, ["instrument", "trading_day", "slot"])
    d = x.withColumn("cand", crps_normal(F.col("y"), F.sqrt(F.col("var") / F.col("level")))).groupBy("h", "phase", "trading_day").agg(F.avg("crps").alias("base"), F.avg("cand").alias("cand"), F.count("*").alias("origins"))
    diff = F.col("cand") - F.col("base")
    return d.groupBy("h", "phase").agg(F.count("*").alias("sessions"), F.sum("origins").alias("origins"), r6(F.avg("base")).alias("base"), r6(F.avg("cand")).alias("candidate"), r6(F.avg(diff)).alias("difference"), ((F.count_if(diff < 0) >= 0.6 * F.count("*")) & (F.avg(diff) < 0)).alias("better"))


def block_bootstrap(rows: DataFrame, keys: list[str], ordinal: str, value: str, block: int, resamples: int, circular: bool = False) -> DataFrame:
    """Percentile interval of the mean by moving (or circular) blocks; block starts come from md5, so any engine repeats them.

    Each resample takes ceil(n / block) starts; a block's sum is a window sum, so rows are joined once a block, not once a
    row. The last block is cut to keep n rows. Keys with fewer than two blocks get no interval.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * block)
    w = Window.partitionBy(*keys).orderBy(ordinal)
    k = rows.withColumn("i", F.row_number().over(w) - 1)
    prefix = k.withColumn("cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = prefix.groupBy(*keys).agg(F.max_by("cum", "i").alias("all"))
    draws = n.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {block}"))))
    span = F.col("n") if circular else F.col("n") - block + 1
    draws = draws.withColumn("start", (F.conv(F.substring(F.md5(F.concat_ws("-", *keys, "b", "j")), 1, 8), 16, 10).cast("long") % span).cast("int")).withColumn("len", F.least(F.lit(block), F.col("n") - F.col("j") * block))
    draws = draws.withColumn("stop", F.col("start") + F.col("len") - 1)
    at = lambda name: prefix.select(*keys, F.col("i").alias(name), F.col("cum").alias(f"cum_{name}"))
    draws = draws.withColumns({"before": (F.col("start") - 1), "last": F.when(F.col("stop") >= F.col("n"), F.col("stop") - F.col("n")).otherwise(F.col("stop"))}).withColumn("before", F.col("before").cast("int")).withColumn("last", F.col("last").cast("int"))
    joined = draws.join(at("last"), [*keys, "last"]).join(at("before"), [*keys, "before"], "left").join(total, keys)
    part = F.col("cum_last") - F.coalesce("cum_before", F.lit(0.0)) + F.when(F.col("stop") >= F.col("n"), F.col("all")).otherwise(0.0)
    means = joined.groupBy(*keys, "b").agg((F.sum(part) / F.max("n")).alias("mean"))
    out = means.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(out, keys, "left").select(*keys, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _bootstrap_sql(span: str) -> str:
    return f"""WITH {TOTALS_SQL}, k AS (SELECT instrument, v, row_number() OVER (PARTITION BY instrument ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM dt),
d AS (SELECT instrument, n, b, j, CAST(('0x' || substr(md5(instrument || '-' || b || '-' || j), 1, 8)) AS BIGINT) % ({span}) AS start FROM (SELECT DISTINCT instrument, n FROM k), (SELECT unnest(generate_series(1, 60)) AS b), LATERAL (SELECT unnest(generate_series(0, (n - 1) // 20)) AS j)),
s AS (SELECT d.instrument, b, avg(k.v) AS mean FROM d, LATERAL (SELECT unnest(generate_series(0, least(20, n - j * 20) - 1)) AS o) JOIN k ON k.instrument = d.instrument AND k.i = (d.start + o) % d.n GROUP BY 1, 2),
q AS (SELECT instrument, quantile_cont(mean, 0.05) AS low, quantile_cont(mean, 0.95) AS high FROM s GROUP BY 1)
SELECT instrument, a.n, round(a.mean, 2) AS mean, round(low, 2) AS low, round(high, 2) AS high FROM (SELECT instrument, count(*) AS n, avg(v) AS mean FROM dt GROUP BY 1) a LEFT JOIN q USING (instrument)"""


def _interval(spark, sf_dir, circular: bool) -> DataFrame:
    b = block_bootstrap(daily_totals(spark, sf_dir), ["instrument"], "day", "v", 20, 60, circular)
    return b.select("instrument", "n", *[F.round(c, 2).alias(c) for c in ("mean", "low", "high")])


@query("l12_block_bootstrap", _bootstrap_sql("n - 19"))
def l12(spark, sf_dir):
    return _interval(spark, sf_dir, False)


@query("l13_circular_bootstrap", _bootstrap_sql("n"))
def l13(spark, sf_dir):
    return _interval(spark, sf_dir, True)


@query("l14_paired_arms", f"""WITH {CASE_SQL}, g AS (SELECT instrument, trading_day, avg(brier) AS a, avg(2.0 / 3) AS b FROM cs GROUP BY 1, 2) SELECT instrument, count(*) AS sessions, round(avg(a - b), 6) AS difference, count(*) FILTER (a < b - {SAME}) AS improved FROM g GROUP BY 1""")
def l14(spark, sf_dir):
    """Two arms on their common sessions: here against the uniform forecast, whose Brier is 2/3."""
    g = case_scores(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.avg("brier").alias("a"), F.avg(F.lit(2.0 / 3)).alias("b"))
    return g.groupBy("instrument").agg(F.count("*").alias("sessions"), r6(F.avg(F.col("a") - F.col("b"))).alias("difference"), F.count_if(F.col("a") < F.col("b") - SAME).alias("improved"))


@query("l16_breakdown", f"""WITH {CASE_SQL}, g AS (SELECT instrument, slot, avg(brier) AS m, count(*) AS n FROM cs GROUP BY 1, 2), t AS (SELECT *, ntile(3) OVER (PARTITION BY instrument ORDER BY n, slot) AS third FROM g)
SELECT instrument, CAST(third AS INT) AS third, count(*) AS slots, round(avg(m), 6) AS brier FROM t GROUP BY 1, 2""")
def l16(spark, sf_dir):
    """Scores by thirds of an instrument's slots, ordered by how many cases they have."""
    g = case_scores(spark, sf_dir).groupBy("instrument", "slot").agg(F.avg("brier").alias("m"), F.count("*").alias("n"))
    t = g.withColumn("third", F.ntile(3).over(Window.partitionBy("instrument").orderBy("n", "slot")))
    return t.groupBy("instrument", "third").agg(F.count("*").alias("slots"), r6(F.avg("m")).alias("brier"))


@query("l17_reliability", f"WITH {OUT_SQL} SELECT label, CAST(least(floor(round(p, 9) * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS observed FROM ou GROUP BY 1, 2")
def l17(spark, sf_dir):
    """The issued probability in equal bins against the observed frequency."""
    bin_ = F.least(F.floor(F.round("p", 9) * 10), F.lit(9)).cast("int")
    return outcomes(spark, sf_dir).groupBy("label", bin_.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("hit")).alias("observed"))


@query("l21_concentration", f"""WITH {CASE_SQL}, g AS (SELECT trading_day, avg(brier) - 2.0 / 3 AS d FROM cs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), trading_day) AS k FROM g)
SELECT count(*) AS sessions, round(avg(CASE WHEN d < -{SAME} THEN 1.0 ELSE 0.0 END), 6) AS improved, round(sum(d) FILTER (k <= 5) / sum(d), 6) AS top5_share FROM r""")
def l21(spark, sf_dir):
    g = case_scores(spark, sf_dir).groupBy("trading_day").agg((F.avg("brier") - 2.0 / 3).alias("d"))
    r = g.withColumn("k", F.row_number().over(Window.orderBy(F.round("d", 9), "trading_day")))  # a row a session
    return r.agg(F.count("*").alias("sessions"), r6(F.avg(F.when(F.col("d") < -SAME, 1.0).otherwise(0.0))).alias("improved"), r6(F.sum(F.when(F.col("k") <= 5, F.col("d"))) / F.sum("d")).alias("top5_share"))


@query("l28_timing_quantiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS worst FROM events GROUP BY 1")
def l28(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("worst")).join(percentiles(e, ["event_type"], "value", [0.5, 0.9]), "event_type", "left")
    return g.select("event_type", "n", r6(F.col("q")[0]).alias("p50"), r6(F.col("q")[1]).alias("p90"), "worst")


@query("l36_distribution_distance", f"""WITH {DIST_SQL} SELECT a.instrument, a.slot, round(sum(abs(a.p - b.p)) / 2, 6) AS tv, round(sum(a.p * ln(a.p / b.p)), 6) AS kl FROM ds a JOIN ds b ON a.instrument = b.instrument AND a.label = b.label AND b.slot = 0 GROUP BY 1, 2""")
def l36(spark, sf_dir):
    """Total variation and Kullback-Leibler distance of each clock's forecast from that of the first slot."""
    d = distribution(spark, sf_dir)
    b = d.where("slot = 0").select("instrument", "label", F.col("p").alias("q"))
    return d.join(b, ["instrument", "label"]).groupBy("instrument", "slot").agg(r6(F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), r6(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).alias("kl"))


def replayed_values(bars: DataFrame) -> DataFrame:
    """instrument, trading_day, slot, name, value: true range, realised variance and its usual, seasonal variance and short level."""
    from .calendar import dense_grid, log_returns
    from .fan import seasonal_variance, short_level
    from .features import usual
    from .indicators import DAY, daily_ranges

    r = log_returns(dense_grid(bars))
    r = r.withColumn("rv", F.sum(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))).over(Window.partitionBy(*DAY).orderBy("slot").rowsBetween(-3, 0)))
    v = short_level(seasonal_variance(usual(r, "rv", ["instrument", "slot"])))
    slots = v.select(*DAY, "slot", F.explode(F.create_map(*[x for c in ("rv", "usual", "s", "level") for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    return slots.unionByName(daily_ranges(bars).select(*DAY, F.lit(-1).alias("slot"), F.lit("tr").alias("name"), F.col("tr").alias("value")))


def replay_mismatches(bars: DataFrame, values=replayed_values) -> DataFrame:
    """Rows that differ between the values of the whole history and those recomputed at each day from the bars up to it.

    Every as-of day's history is an instrument of its own, so one plan replays all; its size is days times history.
    """
    days = bars.select(F.col("trading_day").alias("as_of")).distinct()
    key = F.concat_ws("@", "instrument", "as_of").alias("instrument")
    history = bars.join(F.broadcast(days), F.col("trading_day") <= F.col("as_of")).select(key, *[c for c in bars.columns if c != "instrument"])  # a row a day
    batch = values(bars).join(F.broadcast(days), F.col("trading_day") <= F.col("as_of")).select(key, "trading_day", "slot", "name", F.col("value").alias("whole"), F.lit(1).alias("a"))
    # an as-of day on which an instrument has no bar still has its earlier ones: both sides hold it
    both = values(history).withColumn("b", F.lit(1)).join(batch, ["instrument", "trading_day", "slot", "name"], "full")
    near = F.col("value").eqNullSafe(F.col("whole")) | F.coalesce(F.abs(F.col("value") - F.col("whole")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("whole")), F.lit(False))
    return both.where(F.col("a").isNull() | F.col("b").isNull() | ~near)


@query("l38_replay_parity", "SELECT 0::BIGINT AS mismatches")
def l38(spark, sf_dir):
    """No look-ahead: features and variances recomputed as of every day equal those of the whole history."""
    from .indicators import weekday_bars

    return replay_mismatches(weekday_bars(spark, sf_dir)).agg(F.count("*").alias("mismatches"))


@query("l7_walk_forward_skips", f"WITH {SCORE_SQL}, d AS (SELECT DISTINCT instrument, trading_day FROM gd), s AS (SELECT instrument, trading_day, count(*) AS n FROM sc GROUP BY 1, 2) SELECT CASE WHEN n IS NULL THEN 'no fitted variance' WHEN n < 20 THEN 'few origins' ELSE 'scored' END AS reason, count(*) AS sessions FROM d LEFT JOIN s USING (instrument, trading_day) GROUP BY 1")
def l7(spark, sf_dir):
    """Sessions scored walk-forward, and why others are not."""
    from ..sources import session_bars

    days = session_bars(spark, sf_dir).where(F.weekday("trading_day") < 5).select("instrument", "trading_day").distinct()
    s = scored(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.count("*").alias("n"))
    return days.join(s, ["instrument", "trading_day"], "left").groupBy(F.when(F.col("n").isNull(), "no fitted variance").when(F.col("n") < 20, "few origins").otherwise("scored").alias("reason")).agg(F.count("*").alias("sessions"))


@query("l11_band_calibration", f"WITH {SCORE_SQL}, b AS (SELECT *, 1.6448536269514722 * sigma AS half FROM sc) SELECT h, count(*) AS n, count(*) FILTER (y < -half) AS below, count(*) FILTER (y > half) AS above, round(avg(2 * half + 20 * greatest(abs(y) - half, 0)), 6) AS interval_score FROM b GROUP BY 1")
def l11(spark, sf_dir):
    """Misses on either side of the 90 % band, and its interval score."""
    half = 1.6448536269514722 * F.col("sigma")
    return scored(spark, sf_dir).groupBy("h").agg(F.count("*").alias("n"), F.count_if(F.col("y") < -half).alias("below"), F.count_if(F.col("y") > half).alias("above"), r6(F.avg(2 * half + 20 * F.greatest(F.abs("y") - half, F.lit(0.0)))).alias("interval_score"))


@query("l15_arm_summary", f"""WITH {CASE_SQL} SELECT CASE WHEN slot < 930 THEN 'overnight' ELSE 'day' END AS arm, count(*) AS cases, count(DISTINCT trading_day) AS sessions, round(avg(brier), 6) AS brier, round(max(log_loss), 6) AS worst FROM cs GROUP BY 1""")
def l15(spark, sf_dir):
    return case_scores(spark, sf_dir).groupBy(F.when(F.col("slot") < 930, "overnight").otherwise("day").alias("arm")).agg(F.count("*").alias("cases"), F.countDistinct("trading_day").alias("sessions"), r6(F.avg("brier")).alias("brier"), r6(F.max("log_loss")).alias("worst"))


@query("l18_cases", f"""WITH {CASE_SQL}, gx AS (SELECT DISTINCT instrument, trading_day FROM wd), w AS (SELECT instrument, trading_day, s AS slot FROM gx, (SELECT unnest([0, 480, 960]) AS s))
SELECT w.slot, CASE WHEN cs.brier IS NOT NULL THEN 'scored' WHEN fw.close IS NULL THEN 'no bar' ELSE 'no outcome' END AS status, count(*) AS n FROM w LEFT JOIN cs USING (instrument, trading_day, slot) LEFT JOIN fw USING (instrument, trading_day, slot) GROUP BY 1, 2""")
def l18(spark, sf_dir):
    """Every scheduled case with its score or the reason it has none."""
    from .indicators import weekday_bars

    b = weekday_bars(spark, sf_dir).select("instrument", "trading_day", "slot", "close")
    want = b.select("instrument", "trading_day").distinct().withColumn("slot", F.explode(F.array(F.lit(0), F.lit(480), F.lit(960))))
    key = ["instrument", "trading_day", "slot"]
    j = want.join(case_scores(spark, sf_dir), key, "left").join(b, key, "left")
    return j.groupBy("slot", F.when(F.col("brier").isNotNull(), "scored").when(F.col("close").isNull(), "no bar").otherwise("no outcome").alias("status")).agg(F.count("*").alias("n"))


@query("l20_promotion", f"""WITH {CASE_SQL}, g AS (SELECT instrument, trading_day, avg(brier) - 2.0 / 3 AS d FROM cs GROUP BY 1, 2), s AS (SELECT instrument, avg(d) AS m, avg(CASE WHEN d < -{SAME} THEN 1.0 ELSE 0.0 END) AS share FROM g GROUP BY 1)
SELECT instrument, round(m, 6) AS difference, m < -0.005 AND share >= 0.6 AS promoted, row_number() OVER (ORDER BY m, instrument) AS rank FROM s""")
def l20(spark, sf_dir):
    """Candidates against the rule, in order."""
    g = case_scores(spark, sf_dir).groupBy("instrument", "trading_day").agg((F.avg("brier") - 2.0 / 3).alias("d"))
    s = g.groupBy("instrument").agg(F.avg("d").alias("m"), F.avg(F.when(F.col("d") < -SAME, 1.0).otherwise(0.0)).alias("share"))
    w = Window.orderBy("m", "instrument")  # a row a candidate
    return s.select("instrument", r6("m").alias("difference"), ((F.col("m") < -0.005) & (F.col("share") >= 0.6)).alias("promoted"), F.row_number().over(w).cast("long").alias("rank"))


@query("l35_latency", """WITH l AS (SELECT l_returnflag AS trigger_kind, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT trigger_kind, count(*) AS n, round(median(d), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, max(d) AS worst FROM l GROUP BY 1""")
def l35(spark, sf_dir):
    """How long after its mark an issue came, by trigger."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("mark"))
    d = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(F.col("l_returnflag").alias("trigger_kind"), F.datediff(F.to_date("l_shipdate"), "mark").cast("long").alias("d"))
    g = d.groupBy("trigger_kind").agg(F.count("*").alias("n"), F.max("d").alias("worst")).join(percentiles(d, ["trigger_kind"], "d", [0.5, 0.9]), "trigger_kind", "left")
    return g.select("trigger_kind", "n", r6(F.col("q")[0]).alias("p50"), r6(F.col("q")[1]).alias("p90"), "worst")


@query("l40_arm_decomposition", f"""WITH {OUT_SQL}, x AS (SELECT *, avg(p) OVER (PARTITION BY instrument, trading_day, slot, label = 'neutral_band') AS sp FROM ou) SELECT instrument, round(sum((p - hit) ** 2) / count(*) * 3, 6) AS full_brier, round(sum((sp - hit) ** 2) / count(*) * 3, 6) AS symmetric_brier FROM x GROUP BY 1""")
def l40(spark, sf_dir):
    """The score with and without the tilt between the two directions."""
    w = Window.partitionBy("instrument", "trading_day", "slot", F.col("label") == "neutral_band")
    x = outcomes(spark, sf_dir).withColumn("sp", F.avg("p").over(w))
    return x.groupBy("instrument").agg(r6(F.sum((F.col("p") - F.col("hit")) ** 2) / F.count("*") * 3).alias("full_brier"), r6(F.sum((F.col("sp") - F.col("hit")) ** 2) / F.count("*") * 3).alias("symmetric_brier"))
