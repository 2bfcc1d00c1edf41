"""Group L, multiple testing: many candidates against one baseline, with resampled sessions.

All candidates of a horizon are resampled together: a resample is a list of circular blocks of consecutive sessions that every
candidate shares, so their dependence is kept. Block starts come from md5, so any engine repeats them. A block's sum is a
difference of prefix sums: rows grow with candidates x resamples x blocks, never with candidates x resamples x sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from .judging import P as JUDGING

QUERIES: dict = {}
SQL: dict = {}
BLOCK, RESAMPLES, ALPHA = 3, 400, 0.05
#: A difference whose resampled means scatter less than this is constant, and tests nothing.
LEAST_SCATTER = 1e-12


def aligned(steps: DataFrame, keys: list[str], candidate: str, session: str, gain: str) -> DataFrame:
    """keys, candidate, i (0-based number of the session) and x (the gain) on the sessions that all candidates of a key have."""
    wanted = steps.groupBy(*keys).agg(F.countDistinct(candidate).alias("__want"))
    full = steps.groupBy(*keys, session).agg(F.countDistinct(candidate).alias("__has")).join(wanted, keys).where("__has = __want")
    number = full.select(*keys, session, (F.row_number().over(Window.partitionBy(*keys).orderBy(session)) - 1).alias("i"))  # a row a session
    return steps.join(number, [*keys, session]).select(*keys, candidate, "i", F.col(gain).alias("x"))


def drawn_means(rows: DataFrame, keys: list[str], candidate: str, block: int = BLOCK, resamples: int = RESAMPLES) -> DataFrame:
    """keys, candidate, b, drawn: each candidate's mean over each resample."""
    n = rows.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    own = Window.partitionBy(*keys, candidate).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    prefix = rows.withColumn("cum", F.sum("x").over(own))
    whole = rows.groupBy(*keys, candidate).agg(F.sum("x").alias("whole"))
    draws = n.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {block}").cast("int"))))
    start = F.conv(F.substring(F.md5(F.concat_ws("-", *keys, "b", "j")), 1, 8), 16, 10).cast("long") % F.col("n")
    draws = draws.withColumn("start", start).withColumn("stop", F.col("start") + F.least(F.lit(block), F.col("n") - F.col("j") * block) - 1)
    draws = draws.select(*keys, "n", "b", (F.col("start") - 1).alias("before"), F.when(F.col("stop") >= F.col("n"), F.col("stop") - F.col("n")).otherwise(F.col("stop")).alias("last"), (F.col("stop") >= F.col("n")).alias("wraps"))
    at = lambda name: prefix.select(*keys, candidate, F.col("i").cast("long").alias(name), F.col("cum").alias(f"cum_{name}"))
    met = draws.join(at("last"), [*keys, "last"]).join(at("before"), [*keys, candidate, "before"], "left").join(whole, [*keys, candidate])
    part = F.col("cum_last") - F.coalesce("cum_before", F.lit(0.0)) + F.when(F.col("wraps"), F.col("whole")).otherwise(0.0)
    return met.groupBy(*keys, candidate, "b").agg((F.sum(part) / F.max("n")).alias("drawn"))


def standardised(rows: DataFrame, keys: list[str], candidate: str, block: int = BLOCK, resamples: int = RESAMPLES) -> DataFrame:
    """keys, candidate, b, n, mean, omega (scatter of root n times the mean), t and drawn, for candidates whose gain is not constant."""
    means = drawn_means(rows, keys, candidate, block, resamples)
    base = rows.groupBy(*keys, candidate).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    scatter = means.groupBy(*keys, candidate).agg(F.stddev_pop("drawn").alias("scatter"))
    stat = base.join(scatter, [*keys, candidate]).where(F.col("scatter") > LEAST_SCATTER)
    stat = stat.withColumn("omega", F.sqrt("n") * F.col("scatter")).withColumn("t", F.sqrt("n") * F.col("mean") / F.col("omega"))
    return means.join(stat.drop("scatter"), [*keys, candidate])


def superior_ability(z: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """Whether the best candidate gains more than the best of so many would by chance.

    Three p-values by how a candidate is recentred in the resamples: at its own mean if above zero (lower), at its own mean unless it
    is far below the baseline (consistent), at its own mean always (upper).
    """
    n, mean, omega = (F.col(c) for c in ("n", "mean", "omega"))
    far = mean < -F.sqrt(omega * omega / n * 2 * F.log(F.log(n)))
    centres = {"lower": F.greatest(mean, F.lit(0.0)), "consistent": F.when(far, 0.0).otherwise(mean), "upper": mean}
    score = lambda c: F.sqrt(n) * (F.col("drawn") - c) / omega
    tops = z.groupBy(*keys, "b").agg(*[F.greatest(F.max(score(c)), F.lit(0.0)).alias(name) for name, c in centres.items()])
    best = z.groupBy(*keys).agg(F.greatest(F.max("t"), F.lit(0.0)).alias("statistic"), F.max_by(candidate, "t").alias("best"), F.countDistinct(candidate).alias("candidates"), F.max("n").alias("sessions"))
    # what differs in the last place only counts as reached
    reached = lambda name: F.avg((F.col(name) >= F.col("statistic") - 1e-9).cast("double"))
    return tops.join(best, keys).groupBy(*keys, "best", "candidates", "sessions", "statistic").agg(F.count("*").alias("resamples"), *[reached(name).alias(f"p_{name}") for name in centres])


def stepwise(z: DataFrame, keys: list[str], candidate: str, alpha: float = ALPHA) -> DataFrame:
    """The candidates that are better, the chance of any false one held at alpha.

    Rejected candidates leave the comparison, and the critical value is taken anew, until nothing more is rejected. What is left
    at any step is always the candidates of smallest t, so one pass suffices: the critical value of the k smallest falls as k does,
    and a candidate is rejected if and only if, for every set of smallest ones from its own on, the largest t exceeds the critical value.
    """
    order = [F.col("t"), F.col(candidate)]
    smaller = Window.partitionBy(*keys, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = z.withColumn("top", F.max(F.sqrt("n") * (F.col("drawn") - F.col("mean")) / F.col("omega")).over(smaller))
    critical = top.groupBy(*keys, candidate, "n", "t").agg(F.percentile("top", F.lit(1 - alpha)).alias("critical"))
    from_own_on = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)  # a row a candidate
    return critical.withColumn("better", F.min((F.col("t") > F.col("critical")).cast("int")).over(from_own_on) == 1)


def gains(spark, sf_dir) -> DataFrame:
    """The gain in CRPS of each variance over the seasonal one by horizon and session."""
    steps = JUDGING.frame("SELECT h, arm, trading_day, -diff AS gain FROM {steps} s", spark, sf_dir)
    return standardised(aligned(steps, ["h"], "arm", "trading_day", "gain"), ["h"], "arm")


_DRAWN = f"""o AS (SELECT h, arm, trading_day, -diff AS x FROM {{steps}} s),
f AS (SELECT h, trading_day FROM o GROUP BY h, trading_day HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM o p WHERE p.h = o.h)),
g AS (SELECT h, trading_day, row_number() OVER (PARTITION BY h ORDER BY trading_day) - 1 AS i, count(*) OVER (PARTITION BY h) AS n FROM f),
x AS MATERIALIZED (SELECT o.h, arm, i, n, x FROM o JOIN g ON g.h = o.h AND g.trading_day = o.trading_day),
d AS MATERIALIZED (SELECT h, b, (CAST(('0x' || substr(md5(h || '-' || b || '-' || (k // {BLOCK})), 1, 8)) AS BIGINT) + k % {BLOCK}) % n AS i FROM (SELECT DISTINCT h, n FROM x), range(1, {RESAMPLES + 1}) r(b), LATERAL (SELECT unnest(range(n)) AS k)),
m AS MATERIALIZED (SELECT d.h, arm, b, avg(x) AS drawn FROM d JOIN x ON x.h = d.h AND x.i = d.i GROUP BY 1, 2, 3),
s AS (SELECT h, arm, max(n) AS n, avg(x) AS mean, (SELECT stddev_pop(drawn) FROM m WHERE m.h = x.h AND m.arm = x.arm) AS scatter FROM x GROUP BY h, arm),
z AS MATERIALIZED (SELECT m.h, m.arm, b, n, mean, scatter, drawn, mean / scatter AS t FROM m JOIN s ON s.h = m.h AND s.arm = m.arm WHERE scatter > {LEAST_SCATTER})"""

SQL["l23_superior_ability"] = JUDGING.text(f"""{_DRAWN},
c AS (SELECT *, (drawn - greatest(mean, 0)) / scatter AS low, (drawn - CASE WHEN mean < -scatter * sqrt(2 * ln(ln(n))) THEN 0 ELSE mean END) / scatter AS middle, (drawn - mean) / scatter AS high FROM z),
t AS (SELECT h, b, greatest(max(low), 0) AS low, greatest(max(middle), 0) AS middle, greatest(max(high), 0) AS high FROM c GROUP BY 1, 2),
e AS (SELECT h, greatest(max(t), 0) AS statistic, arg_max(arm, t) AS best, count(DISTINCT arm) AS candidates, max(n) AS sessions FROM z GROUP BY 1)
SELECT e.h, best, candidates, sessions, round(statistic, 6) AS statistic, count(*) AS resamples, round(avg(CASE WHEN low >= statistic - 1e-9 THEN 1 ELSE 0 END), 6) AS p_lower,
  round(avg(CASE WHEN middle >= statistic - 1e-9 THEN 1 ELSE 0 END), 6) AS p_consistent, round(avg(CASE WHEN high >= statistic - 1e-9 THEN 1 ELSE 0 END), 6) AS p_upper FROM t JOIN e ON e.h = t.h GROUP BY e.h, best, candidates, sessions, statistic""")


def l23(spark, sf_dir):
    """The test over all candidates by horizon."""
    found = superior_ability(gains(spark, sf_dir), ["h"], "arm")
    return found.select("h", "best", "candidates", "sessions", r6("statistic").alias("statistic"), "resamples", *[r6(f"p_{c}").alias(f"p_{c}") for c in ("lower", "consistent", "upper")])


SQL["l24_stepwise"] = JUDGING.text(f"""{_DRAWN},
a AS (SELECT DISTINCT h, arm, t FROM z), q AS (SELECT h, arm, t, row_number() OVER (PARTITION BY h ORDER BY t, arm) AS k FROM a),
w AS (SELECT q.h, q.k, b, max((drawn - mean) / scatter) AS top FROM q JOIN q s ON s.h = q.h AND s.k <= q.k JOIN z ON z.h = s.h AND z.arm = s.arm GROUP BY 1, 2, 3),
c AS (SELECT h, k, quantile_cont(top, 1 - {ALPHA}) AS critical FROM w GROUP BY 1, 2)
SELECT q.h, arm, round(t, 6) AS statistic, round(critical, 6) AS critical,
  NOT EXISTS (SELECT 1 FROM q o JOIN c p ON p.h = o.h AND p.k = o.k WHERE o.h = q.h AND o.k >= q.k AND o.t <= p.critical) AS better FROM q JOIN c ON c.h = q.h AND c.k = q.k""")


def l24(spark, sf_dir):
    """The candidates better than the seasonal variance by horizon, with each one's critical value."""
    return stepwise(gains(spark, sf_dir), ["h"], "arm").select("h", "arm", r6("t").alias("statistic"), r6("critical").alias("critical"), "better")


QUERIES |= {"l23_superior_ability": l23, "l24_stepwise": l24}
