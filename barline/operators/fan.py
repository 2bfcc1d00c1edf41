"""Group I: the distribution of the price some slots ahead, scaled by seasonal and recent variance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from ..plans import register
from .calendar import GRID_SQL, PHASE_SQL, phase, returns

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Sessions of history and the least squared returns of a slot in it; slots on either side of a neighbourhood; the cap in medians of the neighbourhood.
SESSIONS, LEAST, REACH, CAP = 40, 10, 1, 50.0
#: A release: an hour of BURST times the slot's usual volume (mean of the bars of so many sessions before, from the least). It and HOLD slots after it are left out.
BURST, USUAL_SESSIONS, USUAL_LEAST, HOLD = 3.0, 20, 5, 1
#: A horizon in which nothing moves has no variance; what prefix sums leave of it is smaller.
LEAST_VARIANCE = 1e-12
LEVEL_PRIOR, LEVEL_BOUNDS = 4.0, (0.25, 4.0)


def released(grid: DataFrame) -> Column:
    """Whether a slot lies in a release's window: known from earlier sessions and the day so far only."""
    before = Window.partitionBy("instrument", "slot").orderBy("trading_day").rowsBetween(-USUAL_SESSIONS, -1)
    usual = F.when(F.count("volume").over(before) >= USUAL_LEAST, F.avg("volume").over(before))
    return F.coalesce(F.col("volume") >= BURST * usual, F.lit(False))


def seasonal_variance(r: DataFrame) -> DataFrame:
    """Mean squared return of each slot over the SESSIONS sessions before.

    Release windows are left out. A squared return counts CAP times the median of all those of the slots within REACH at most, so
    one spike does not enter the sessions after it. Slots with LEAST values are averaged within REACH, never across phases. A slot in
    which nothing moved is 0; with fewer sessions than LEAST there is no variance.
    """
    held = Window.partitionBy("instrument", "trading_day").orderBy("slot").rowsBetween(-HOLD, 0)
    out = r.withColumn("burst", released(r)).withColumn("r2", F.when(~F.max("burst").over(held), F.col("r") * F.col("r")))
    days = Window.partitionBy("instrument", "slot").orderBy("trading_day").rowsBetween(-SESSIONS, -1)
    out = out.withColumns({"past": F.collect_list("r2").over(days), "sessions": F.count(F.lit(1)).over(days), "phase": phase(F.col("slot"))})  # SESSIONS values at most
    beside = Window.partitionBy("instrument", "trading_day").orderBy("slot").rowsBetween(-REACH, REACH)
    out = out.withColumn("around", F.array_sort(F.flatten(F.collect_list("past").over(beside))))
    n = F.size("around")
    middle = (F.get("around", ((n - 1) / 2).cast("int")) + F.get("around", (n / 2).cast("int"))) / 2
    out = out.withColumn("cap", F.when((n > 0) & (middle > 0), CAP * middle))
    out = out.withColumn("total", F.aggregate("past", F.lit(0.0), lambda s, x: s + F.least(x, "cap")))  # no cap: all of x
    out = out.withColumn("raw", F.when(F.size("past") >= LEAST, F.col("total") / F.size("past")))
    near = Window.partitionBy("instrument", "trading_day", "phase").orderBy("slot").rangeBetween(-60 * REACH, 60 * REACH)
    moved = F.when(F.col("total") == 0, 0.0).otherwise(F.coalesce(F.avg("raw").over(near), F.lit(0.0)))
    return out.withColumn("s", F.when(F.col("sessions") >= LEAST, moved)).drop("burst", "r2", "past", "sessions", "around", "cap", "total", "raw")


SEASON_SQL = f"""{GRID_SQL},
rb AS (SELECT *, coalesce(volume >= 3.0 * CASE WHEN count(volume) OVER u >= 5 THEN avg(volume) OVER u END, false) AS burst FROM ret
  WINDOW u AS (PARTITION BY instrument, slot ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
rx AS (SELECT *, CASE WHEN NOT bool_or(burst) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS 1 PRECEDING) THEN r * r END AS r2 FROM rb),
rp AS (SELECT *, coalesce(list(r2) FILTER (r2 IS NOT NULL) OVER d, []) AS past, count(*) OVER d AS sessions, {PHASE_SQL} AS phase FROM rx
  WINDOW d AS (PARTITION BY instrument, slot ORDER BY trading_day ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
rn AS (SELECT *, list_median(flatten(list(past) OVER (PARTITION BY instrument, trading_day ORDER BY slot RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING))) AS middle FROM rp),
rc AS (SELECT *, coalesce(list_sum(list_transform(past, lambda x: CASE WHEN middle > 0 THEN least(x, 50 * middle) ELSE x END)), 0) AS total FROM rn),
rw AS (SELECT *, CASE WHEN len(past) >= 10 THEN total / len(past) END AS raw FROM rc),
sv AS (SELECT instrument, trading_day, slot, close, volume, last_price, r, phase, CASE WHEN sessions < 10 THEN NULL WHEN total = 0 THEN 0
  ELSE coalesce(avg(raw) OVER (PARTITION BY instrument, trading_day, phase ORDER BY slot RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING), 0) END AS s FROM rw)"""


def seasonal(spark, sf_dir) -> DataFrame:
    return seasonal_variance(returns(spark, sf_dir))


@query("i3_seasonal_variance", f"WITH {SEASON_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(s, 6) AS s FROM sv WHERE s IS NOT NULL")
def i3(spark, sf_dir):
    return seasonal(spark, sf_dir).where("s IS NOT NULL").select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", r6("s").alias("s"))


@query("i7_long_level", f"""WITH {SEASON_SQL}, d AS (SELECT instrument, trading_day, sum(r * r) FILTER (r IS NOT NULL AND s IS NOT NULL) AS real, sum(s) FILTER (r IS NOT NULL AND s IS NOT NULL) AS expected FROM sv GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, round(least(4.0, greatest(0.25, coalesce(sum(real) OVER w / nullif(sum(expected) OVER w, 0), 1.0))), 6) AS level FROM d WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def i7(spark, sf_dir):
    """Realised over expected variance of the five sessions before, within bounds."""
    both = F.col("r").isNotNull() & F.col("s").isNotNull()
    d = seasonal(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.sum(F.when(both, F.col("r") * F.col("r"))).alias("real"), F.sum(F.when(both, F.col("s"))).alias("expected"))
    w = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(-5, -1)
    level = F.coalesce(F.sum("real").over(w) / F.nullif(F.sum("expected").over(w), F.lit(0.0)), F.lit(1.0))
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), r6(F.least(F.lit(LEVEL_BOUNDS[1]), F.greatest(F.lit(LEVEL_BOUNDS[0]), level))).alias("level"))


def short_level(s: DataFrame) -> DataFrame:
    """I8: trailing realised over expected variance at every origin, with a prior worth LEVEL_PRIOR mean slots."""
    w = Window.partitionBy("instrument", "trading_day").orderBy("slot").rowsBetween(-3, 0)
    both = F.col("r").isNotNull() & F.col("s").isNotNull()
    real, expected = F.sum(F.when(both, F.col("r") * F.col("r")).otherwise(0.0)).over(w), F.sum(F.when(both, F.col("s")).otherwise(0.0)).over(w)
    prior = F.avg("s").over(Window.partitionBy("instrument", "trading_day")) * LEVEL_PRIOR
    level = (real + prior) / F.nullif(expected + prior, F.lit(0.0))
    return s.withColumn("level", level).withColumn("level", F.when(F.col("level").isNotNull(), F.least(F.lit(LEVEL_BOUNDS[1]), F.greatest(F.lit(LEVEL_BOUNDS[0]), F.col("level")))))


SHORT_SQL = f"""{SEASON_SQL}, sl0 AS (SELECT *, sum(CASE WHEN r IS NOT NULL AND s IS NOT NULL THEN r * r ELSE 0 END) OVER w AS real, sum(CASE WHEN r IS NOT NULL AND s IS NOT NULL THEN s ELSE 0 END) OVER w AS expected, 4.0 * avg(s) OVER (PARTITION BY instrument, trading_day) AS prior
  FROM sv WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot ROWS 3 PRECEDING)), sl AS (SELECT *, CASE WHEN expected + prior <> 0 THEN least(4.0, greatest(0.25, (real + prior) / (expected + prior))) END AS level FROM sl0)"""


@query("i8_short_level", f"WITH {SHORT_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(level, 6) AS level FROM sl WHERE level IS NOT NULL")
def i8(spark, sf_dir):
    return short_level(seasonal(spark, sf_dir)).where("level IS NOT NULL").select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", r6("level").alias("level"))


def horizons(s: DataFrame, ahead: list[int]) -> DataFrame:
    """The variance over the next h slots (prefix sums differenced, scaled by the level) and the standardised error."""
    w = Window.partitionBy("instrument", "trading_day").orderBy("slot")
    s = s.withColumn("cum", F.sum(F.coalesce("s", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lp", F.when(F.col("last_price") > 0, F.log("last_price")))
    made = s.select("instrument", "trading_day", "slot", "phase", F.array(*[F.struct(F.lit(h).alias("h"), ((F.lead("cum", h).over(w) - F.col("cum")) * F.col("level")).alias("var"), (F.lead("lp", h).over(w) - F.col("lp")).alias("y")) for h in ahead]).alias("xs"))
    return made.select("instrument", "trading_day", "slot", "phase", F.explode("xs").alias("x")).select("instrument", "trading_day", "slot", "phase", "x.h", "x.var", "x.y").where((F.col("var") > LEAST_VARIANCE) & F.col("y").isNotNull()).withColumn("z", F.col("y") / F.sqrt("var"))


HOR_SQL = f"""{SHORT_SQL}, pf AS (SELECT *, sum(coalesce(s, 0)) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cum, CASE WHEN last_price > 0 THEN ln(last_price) END AS lp FROM sl),
hz0 AS (SELECT instrument, trading_day, slot, phase, unnest([1, 4]) AS h, unnest([(lead(cum, 1) OVER w - cum) * level, (lead(cum, 4) OVER w - cum) * level]) AS var, unnest([lead(lp, 1) OVER w - lp, lead(lp, 4) OVER w - lp]) AS y FROM pf WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot)),
hz AS (SELECT *, y / sqrt(var) AS z FROM hz0 WHERE var > 1e-12 AND y IS NOT NULL)"""


def scored_origins(spark, sf_dir) -> DataFrame:
    return horizons(short_level(seasonal(spark, sf_dir)), [1, 4])


@query("i10_horizon_variance", f"WITH {HOR_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, h, round(var, 6) AS var FROM hz")
def i10(spark, sf_dir):
    return scored_origins(spark, sf_dir).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", "h", r6("var").alias("var"))


@query("i12_standardised_errors", f"WITH {HOR_SQL} SELECT instrument, h, count(*) AS n, round(avg(z), 6) AS mean_z, round(sqrt(avg(z * z)), 6) AS rms_z FROM hz GROUP BY 1, 2")
def i12(spark, sf_dir):
    return scored_origins(spark, sf_dir).groupBy("instrument", "h").agg(F.count("*").alias("n"), r6(F.avg("z")).alias("mean_z"), r6(F.sqrt(F.avg(F.col("z") * F.col("z")))).alias("rms_z"))


def release_days(spark, sf_dir) -> DataFrame:
    """Days on which purchases come in unusual number stand for releases: (trading_day, slot)."""
    from ..sources import session_bars

    b = session_bars(spark, sf_dir).where((F.col("instrument") == "purchase") & (F.weekday("trading_day") < 5))
    return b.where("volume >= 6").select("trading_day", "slot").distinct()


REL_SQL = f"{GRID_SQL}, rel AS (SELECT DISTINCT trading_day, slot FROM sb WHERE instrument = 'purchase' AND volume >= 6 AND isodow(trading_day) <= 5)"


@query("i2_release_windows", f"WITH {REL_SQL} SELECT CAST(trading_day AS VARCHAR) AS trading_day, slot, greatest(0, slot + lo) AS start_slot, least(1380, slot + hi) AS end_slot, bucket FROM rel, (SELECT unnest([-60, 0, 60]) AS lo, unnest([0, 60, 180]) AS hi, unnest(['before', 'at', 'after']) AS bucket)")
def i2(spark, sf_dir):
    """Windows around each release by bucket, clipped to the day; the bucket list is fixed."""
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(n).alias("bucket")) for a, b, n in ((-60, 0, "before"), (0, 60, "at"), (60, 180, "after"))])).alias("w")
    r = release_days(spark, sf_dir).select("trading_day", "slot", w)
    return r.select(F.col("trading_day").cast("string").alias("trading_day"), "slot", F.greatest(F.lit(0), F.col("slot") + F.col("w.lo")).alias("start_slot"), F.least(F.lit(1380), F.col("slot") + F.col("w.hi")).alias("end_slot"), "w.bucket")


@query("i4_release_multipliers", f"""WITH {SEASON_SQL}, rel AS (SELECT DISTINCT trading_day, slot FROM sb WHERE instrument = 'purchase' AND volume >= 6 AND isodow(trading_day) <= 5)
SELECT instrument, count(*) AS n, round((sum(r * r) + 5 * avg(s)) / (sum(s) + 5 * avg(s)), 6) AS multiplier FROM sv JOIN rel USING (trading_day, slot) WHERE r IS NOT NULL AND s > 0 GROUP BY 1""")
def i4(spark, sf_dir):
    """Realised over expected variance at releases, shrunk to 1 by five mean slots."""
    x = seasonal(spark, sf_dir).join(release_days(spark, sf_dir), ["trading_day", "slot"]).where("r IS NOT NULL AND s > 0")
    return x.groupBy("instrument").agg(F.count("*").alias("n"), r6((F.sum(F.col("r") * F.col("r")) + 5 * F.avg("s")) / (F.sum("s") + 5 * F.avg("s"))).alias("multiplier"))


@query("i11_fan_quantiles", f"""WITH {SHORT_SQL}, p AS (SELECT *, sum(coalesce(s, 0)) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cum FROM sl), o AS (SELECT instrument, trading_day, cum, last_price, level FROM p WHERE slot = 900 AND last_price > 0 AND level IS NOT NULL)
SELECT p.instrument, CAST(p.trading_day AS VARCHAR) AS trading_day, p.slot, q.name, round(o.last_price * exp(q.z * sqrt((p.cum - o.cum) * o.level)), 4) AS price FROM p JOIN o USING (instrument, trading_day), (SELECT unnest([-1.6448536269514722, 0.0, 1.6448536269514722]) AS z, unnest(['low', 'middle', 'high']) AS name) q WHERE p.slot > 900""")
def i11(spark, sf_dir):
    """A log-normal fan from the cutoff: cumulative variance after the origin times fixed normal quantiles."""
    w = Window.partitionBy("instrument", "trading_day").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    p = short_level(seasonal(spark, sf_dir)).withColumn("cum", F.sum(F.coalesce("s", F.lit(0.0))).over(w))
    at = lambda c: F.max(F.when(F.col("slot") == 900, F.col(c))).over(Window.partitionBy("instrument", "trading_day"))
    p = p.withColumns({"cum0": at("cum"), "price0": at("last_price"), "level0": at("level")}).where("slot > 900 AND price0 > 0 AND level0 IS NOT NULL")
    q = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(n).alias("name")) for z, n in ((-1.6448536269514722, "low"), (0.0, "middle"), (1.6448536269514722, "high"))])).alias("q")
    return p.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", q, "cum", "cum0", "price0", "level0").select("instrument", "trading_day", "slot", "q.name", F.round(F.col("price0") * F.exp(F.col("q.z") * F.sqrt((F.col("cum") - F.col("cum0")) * F.col("level0"))), 4).alias("price"))


@query("i16_sampled_origins", f"WITH {HOR_SQL} SELECT h, count(*) FILTER (slot % 120 = 0) AS sampled, count(*) FILTER (slot BETWEEN 660 AND 899) AS premarket FROM hz GROUP BY 1")
def i16(spark, sf_dir):
    """Origins of the pre-open slice, and every second slot (a stride is the operator's feature)."""
    return scored_origins(spark, sf_dir).groupBy("h").agg(F.count_if(F.col("slot") % 120 == 0).alias("sampled"), F.count_if(F.col("slot").between(660, 899)).alias("premarket"))
