"""Group E: resampling, VWAP, averages, ranges, as-of lookups, thresholds and swing points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_of, ema, islands, r6, stamp, wilder
from ..plans import register
from ..sources import BARS_SQL, session_bars, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
DAY = ["instrument", "trading_day"]


def weekday_bars(spark, sf_dir) -> DataFrame:
    return session_bars(spark, sf_dir).where(F.weekday("trading_day") < 5)


WD_SQL = f"{BARS_SQL}, wd AS (SELECT * FROM sb WHERE isodow(trading_day) <= 5)"


def resample(bars: DataFrame, slots: int, step: int = 60) -> DataFrame:
    """Clock buckets of `slots` minutes: first, max, min, last, sum, and whether every bar of the bucket is there."""
    at = F.col("bar_start")
    bucket = F.floor(F.col("slot") / slots).cast("int")
    out = bars.groupBy(*DAY, bucket.alias("bucket")).agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.countDistinct("slot").alias("bars"))
    return out.withColumn("complete", F.col("bars") == slots // step)


RESAMPLE_SQL = f"""{WD_SQL}, rs AS (SELECT instrument, trading_day, CAST(slot // 240 AS INT) AS bucket, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_start) AS close, CAST(sum(volume) AS BIGINT) AS volume,
  count(DISTINCT slot) AS bars, count(DISTINCT slot) = 4 AS complete FROM wd GROUP BY 1, 2, 3)"""


@query("e1_resample", f"WITH {RESAMPLE_SQL} SELECT * REPLACE (CAST(trading_day AS VARCHAR) AS trading_day) FROM rs")
def e1(spark, sf_dir):
    return resample(weekday_bars(spark, sf_dir), 240).withColumn("trading_day", F.col("trading_day").cast("string"))


@query("e2_run_continuity", f"""WITH {RESAMPLE_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, count(*) AS buckets, count(*) FILTER (complete) AS complete, CASE WHEN count(*) < 6 THEN 'missing bucket' WHEN count(*) FILTER (complete) < count(*) THEN 'incomplete bucket' ELSE 'ok' END AS reason FROM rs GROUP BY 1, 2""")
def e2(spark, sf_dir):
    b = resample(weekday_bars(spark, sf_dir), 240).groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.count("*").alias("buckets"), F.count_if("complete").alias("complete"))
    return b.withColumn("reason", F.when(F.col("buckets") < 6, "missing bucket").when(F.col("complete") < F.col("buckets"), "incomplete bucket").otherwise("ok"))


def session_vwap(bars: DataFrame) -> DataFrame:
    """Cumulative typical price by volume from the session's start; the close while nothing has traded."""
    w = Window.partitionBy(*DAY).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    ratio = F.sum(typical * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0))
    return bars.withColumn("vwap", F.coalesce(ratio, F.col("close")))


@query("e3_session_vwap", f"""WITH {BARS_SQL} SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar, round(coalesce(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), close), 6) AS vwap
FROM sb WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY bar_start ROWS UNBOUNDED PRECEDING)""")
def e3(spark, sf_dir):
    return session_vwap(session_bars(spark, sf_dir)).select("instrument", stamp("bar_start").alias("bar"), r6("vwap").alias("vwap"))


@query("e4_cutoff_vwap", f"""WITH {WD_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, count(*) AS bars, CASE WHEN count(*) = 15 THEN round(CAST(sum(CAST(close AS DECIMAL(18, 6)) * volume) AS DOUBLE) / sum(volume), 6) END AS vwap, CASE WHEN count(*) = 15 THEN 'ok' ELSE 'incomplete' END AS status
FROM wd WHERE slot < 900 GROUP BY 1, 2""")
def e4(spark, sf_dir):
    """VWAP to the cutoff from exact decimals, only over a complete window."""
    b = weekday_bars(spark, sf_dir).where("slot < 900").groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.count("*").alias("bars"), F.sum(F.col("close").cast("decimal(18,6)") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    return b.select("instrument", "trading_day", "bars", F.when(F.col("bars") == 15, r6(F.col("pv").cast("double") / F.col("v"))).alias("vwap"), F.when(F.col("bars") == 15, "ok").otherwise("incomplete").alias("status"))


@query("e5_moving_averages", f"""WITH RECURSIVE {BARS_SQL}, o AS (SELECT instrument, bar_start, close, row_number() OVER (PARTITION BY instrument ORDER BY bar_start) AS k FROM bars),
x AS (SELECT instrument, k, bar_start, close AS e14, close AS e100 FROM o WHERE k = 1 UNION ALL SELECT o.instrument, o.k, o.bar_start, 2.0 / 15 * o.close + (1 - 2.0 / 15) * x.e14, 2.0 / 101 * o.close + (1 - 2.0 / 101) * x.e100 FROM x JOIN o ON o.instrument = x.instrument AND o.k = x.k + 1)
SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar, round(e100, 6) AS ema_trend, round(avg(e14) OVER (PARTITION BY instrument ORDER BY k ROWS 2 PRECEDING), 6) AS ema_trigger FROM x""")
def e5(spark, sf_dir):
    """EMA(100) and SMA(3) of EMA(14), seeded once with a key's first close."""
    b = ema(session_bars(spark, sf_dir).select("instrument", "bar_start", "close"), ["instrument"], "bar_start", {"trend": ("close", 100), "fast": ("close", 14)})
    w = Window.partitionBy("instrument").orderBy("bar_start").rowsBetween(-2, 0)
    return b.select("instrument", stamp("bar_start").alias("bar"), r6("trend").alias("ema_trend"), r6(F.avg("fast").over(w)).alias("ema_trigger"))


def daily_ranges(bars: DataFrame) -> DataFrame:
    """High, low and close of each regular session, and the true range against the session before."""
    rth = bars.where("session_scope = 'RTH'").groupBy(*DAY).agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_start").alias("close"))
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("trading_day"))
    return rth.withColumn("tr", F.greatest("high", before) - F.least("low", before))


RTH_SQL = f"""{WD_SQL}, rd0 AS (SELECT instrument, trading_day, count(*) AS n, max(high) AS high, min(low) AS low, arg_max(close, bar_start) AS close FROM wd WHERE session_scope = 'RTH' GROUP BY 1, 2),
rd AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY trading_day) AS prev FROM rd0), tr AS (SELECT *, greatest(high, prev) - least(low, prev) AS tr FROM rd)"""


@query("e7_wilder_atr", f"""WITH RECURSIVE {RTH_SQL}, o AS (SELECT instrument, trading_day, tr, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS k FROM tr WHERE prev IS NOT NULL),
s AS (SELECT instrument, k AS e, trading_day FROM o WHERE k >= 15), f AS (SELECT s.instrument, s.e, avg(o.tr) AS a FROM s JOIN o ON o.instrument = s.instrument AND o.k BETWEEN s.e - 14 AND s.e - 1 GROUP BY 1, 2)
SELECT f.instrument, CAST(o.trading_day AS VARCHAR) AS trading_day, round((a * 13 + o.tr) / 14, 6) AS atr FROM f JOIN o ON o.instrument = f.instrument AND o.k = f.e""")
def e7(spark, sf_dir):
    """Wilder's ATR(14) from exactly 15 consecutive true ranges."""
    d = daily_ranges(weekday_bars(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("instrument").orderBy("trading_day"))
    d = d.withColumn("k", first).where("k > 1")
    d = d.select(*DAY, wilder("tr", ["instrument"], "trading_day", 14, 15).alias("atr")).where("atr IS NOT NULL")
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), r6("atr").alias("atr"))


@query("e9_rth_aggregates", f"WITH {RTH_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, n, high, low, close, round(CASE WHEN prev IS NULL THEN high - low ELSE tr END, 6) AS tr FROM tr")
def e9(spark, sf_dir):
    d = daily_ranges(weekday_bars(spark, sf_dir))
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "n", "high", "low", "close", r6("tr").alias("tr"))


@query("e10_prior_sessions", f"""WITH {RTH_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low, lag(close) OVER w AS prev_close, max(high) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS high5, min(low) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low5
FROM rd WINDOW w AS (PARTITION BY instrument ORDER BY trading_day)""")
def e10(spark, sf_dir):
    """The regular session before, and the extremes of the five before."""
    w = Window.partitionBy("instrument").orderBy("trading_day")
    d, five = daily_ranges(weekday_bars(spark, sf_dir)), w.rowsBetween(-5, -1)
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("high", "low", "close")], F.max("high").over(five).alias("high5"), F.min("low").over(five).alias("low5"))


@query("e11_as_of", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
vv AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM v GROUP BY 1, 2)
SELECT p.event_id, strftime(vv.ts, '%Y-%m-%d %H:%M:%S') AS seen_at, vv.value AS seen, CAST(epoch(date_trunc('second', p.ts)) - epoch(date_trunc('second', vv.ts)) AS BIGINT) AS age_s FROM p ASOF LEFT JOIN vv ON p.user_id = vv.user_id AND p.ts >= vv.ts""")
def e11(spark, sf_dir):
    """The last view of the same user at or before each purchase, and its age."""
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("seen_ts")).agg(F.max_by("value", "event_id").alias("seen"))
    out = as_of(p, v, ["user_id"], "ts", "seen_ts", ["seen"])
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", c))
    return out.select("event_id", stamp("seen_ts").alias("seen_at"), "seen", (seconds("ts") - seconds("seen_ts")).alias("age_s"))


@query("e12_window_extremes", f"""WITH {WD_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, max(high) AS high, min(low) AS low, CASE WHEN count(DISTINCT slot) = 4 THEN 'ok' ELSE 'provisional' END AS status FROM wd WHERE slot BETWEEN 660 AND 899 GROUP BY 1, 2""")
def e12(spark, sf_dir):
    """Premarket extremes; provisional unless every bar of the window is there."""
    b = weekday_bars(spark, sf_dir).where("slot BETWEEN 660 AND 899").groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day"))
    return b.agg(F.max("high").alias("high"), F.min("low").alias("low"), F.when(F.countDistinct("slot") == 4, "ok").otherwise("provisional").alias("status"))


def overnight_references(bars: DataFrame) -> DataFrame:
    """Open, extremes and last price before the cutoff of each session, in one grouped pass."""
    n = F.col("slot") < 900
    return bars.groupBy(*DAY).agg(F.min_by(F.when(n, F.col("open")), F.when(n, F.col("slot"))).alias("on_open"), F.max(F.when(n, F.col("high"))).alias("on_high"), F.min(F.when(n, F.col("low"))).alias("on_low"),
                                  F.max_by(F.when(n, F.col("close")), F.when(n, F.col("slot"))).alias("cutoff_price"), F.max(F.when(n, F.col("slot"))).alias("cutoff_slot"), F.count_if(n).alias("on_bars"))


REFS_STEP = """refs AS (SELECT instrument, trading_day, arg_min(open, slot) FILTER (slot < 900) AS on_open, max(high) FILTER (slot < 900) AS on_high, min(low) FILTER (slot < 900) AS on_low, arg_max(close, slot) FILTER (slot < 900) AS cutoff_price,
  max(slot) FILTER (slot < 900) AS cutoff_slot, count(*) FILTER (slot < 900) AS on_bars FROM wd GROUP BY 1, 2)"""
REFS_SQL = f"{RTH_SQL}, {REFS_STEP}"


@query("e13_overnight_references", f"WITH {REFS_SQL} SELECT * REPLACE (CAST(trading_day AS VARCHAR) AS trading_day) FROM refs")
def e13(spark, sf_dir):
    return overnight_references(weekday_bars(spark, sf_dir)).withColumn("trading_day", F.col("trading_day").cast("string"))


@query("e16_level_candidates", f"""WITH {REFS_SQL}, j AS (SELECT refs.*, rd.high AS prev_high, rd.low AS prev_low, rd.close AS prev_close FROM refs LEFT JOIN (SELECT instrument, lead(trading_day) OVER (PARTITION BY instrument ORDER BY trading_day) AS trading_day, high, low, close FROM rd) rd USING (instrument, trading_day))
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, name, value, CASE WHEN value IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (
  SELECT instrument, trading_day, unnest(['on_high', 'on_low', 'on_open', 'prev_high', 'prev_low', 'prev_close']) AS name, unnest([on_high, on_low, on_open, prev_high, prev_low, prev_close]) AS value FROM j)""")
def e16(spark, sf_dir):
    """The levels a session can test first, in long form."""
    b = weekday_bars(spark, sf_dir)
    d = daily_ranges(b)
    after = d.select("instrument", F.lead("trading_day").over(Window.partitionBy("instrument").orderBy("trading_day")).alias("trading_day"), *[F.col(c).alias(f"prev_{c}") for c in ("high", "low", "close")])
    j = overnight_references(b).join(after, DAY, "left")
    names = ["on_high", "on_low", "on_open", "prev_high", "prev_low", "prev_close"]
    long = j.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x"))
    return long.select("instrument", "trading_day", "x.name", "x.value", F.when(F.col("x.value").isNull(), "missing").otherwise("ok").alias("status"))


def up_to(x, step: float, least: float) -> F.Column:
    """A threshold: x rounded up to a multiple of step, `least` at least."""
    return F.greatest(F.lit(least), F.ceil(F.round(x / step, 9)) * step)


@query("e17_thresholds", f"WITH {RTH_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, greatest(1.0, ceil(round(0.25 * (high - low) / 0.25, 9)) * 0.25) AS t, greatest(2.0, ceil(round(0.5 * (high - low) / 0.25, 9)) * 0.25) AS b FROM rd")
def e17(spark, sf_dir):
    d = daily_ranges(weekday_bars(spark, sf_dir))
    span = F.col("high") - F.col("low")
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), up_to(0.25 * span, 0.25, 1.0).alias("t"), up_to(0.5 * span, 0.25, 2.0).alias("b"))


@query("e19_swing_points", f"""WITH {WD_SQL}, x AS (SELECT *, lag(high, 1) OVER w AS h1, lag(high, 2) OVER w AS h2, lead(high, 1) OVER w AS g1, lead(high, 2) OVER w AS g2, lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2, lead(low, 1) OVER w AS m1, lead(low, 2) OVER w AS m2, lead(bar_start, 2) OVER w AS c FROM wd WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY bar_start))
SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar, kind, price, strftime(c, '%Y-%m-%d %H:%M:%S') AS confirmed FROM (SELECT instrument, bar_start, 'high' AS kind, high AS price, c FROM x WHERE high > h1 AND high > h2 AND high > g1 AND high > g2 UNION ALL SELECT instrument, bar_start, 'low', low, c FROM x WHERE low < l1 AND low < l2 AND low < m1 AND low < m2)""")
def e19(spark, sf_dir):
    """Bars above (below) the two before and the two after, known when the second has closed."""
    w = Window.partitionBy(*DAY).orderBy("bar_start")
    b = weekday_bars(spark, sf_dir)
    around = lambda c: [F.lag(c, 1).over(w), F.lag(c, 2).over(w), F.lead(c, 1).over(w), F.lead(c, 2).over(w)]
    b = b.select("instrument", "bar_start", "high", "low", F.array(*around("high")).alias("hs"), F.array(*around("low")).alias("ls"), F.lead("bar_start", 2).over(w).alias("confirmed"))
    high, low = F.forall("hs", lambda x: F.col("high") > x), F.forall("ls", lambda x: F.col("low") < x)
    kinds = b.select("*", F.explode(F.array(F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"), high.alias("ok")), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"), low.alias("ok")))).alias("x"))
    return kinds.where("x.ok").select("instrument", stamp("bar_start").alias("bar"), "x.kind", "x.price", stamp("confirmed").alias("confirmed"))


@query("e26_price_location", f"WITH {REFS_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN cutoff_price > on_open THEN 'Above' WHEN cutoff_price < on_open THEN 'Below' WHEN cutoff_price = on_open THEN 'At' END AS vs_open, round((cutoff_price - on_low) / nullif(on_high - on_low, 0), 6) AS place FROM refs")
def e26(spark, sf_dir):
    r = overnight_references(weekday_bars(spark, sf_dir))
    side = F.when(F.col("cutoff_price") > F.col("on_open"), "Above").when(F.col("cutoff_price") < F.col("on_open"), "Below").when(F.col("cutoff_price") == F.col("on_open"), "At")
    return r.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), side.alias("vs_open"), r6((F.col("cutoff_price") - F.col("on_low")) / F.nullif(F.col("on_high") - F.col("on_low"), F.lit(0.0))).alias("place"))


@query("e30_percent_path", f"""WITH {WD_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(100 * (close / nullif(first_value(open) OVER (PARTITION BY instrument, trading_day ORDER BY slot), 0) - 1), 6) AS percent FROM wd""")
def e30(spark, sf_dir):
    """The session's path in percent of its first price."""
    w = Window.partitionBy(*DAY).orderBy("slot")
    return weekday_bars(spark, sf_dir).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", r6(100 * (F.col("close") / F.nullif(F.first("open").over(w), F.lit(0.0)) - 1)).alias("percent"))


@query("e31_muted_runs", f"""WITH {WD_SQL}, m AS (SELECT instrument, trading_day, slot // 60 AS hour FROM wd WHERE session_scope = 'ETH'), f AS (SELECT *, hour - row_number() OVER (PARTITION BY instrument, trading_day ORDER BY hour) AS g FROM m)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(min(hour) AS BIGINT) AS from_hour, CAST(max(hour) AS BIGINT) AS to_hour FROM f GROUP BY instrument, trading_day, g""")
def e31(spark, sf_dir):
    """Ranges of consecutive bars outside the regular session."""
    m = weekday_bars(spark, sf_dir).where("session_scope = 'ETH'").select(*DAY, F.floor(F.col("slot") / 60).alias("hour"))
    runs = islands(m, DAY, "hour", 1)
    return runs.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day"), "run").agg(F.min("hour").alias("from_hour"), F.max("hour").alias("to_hour")).drop("run")
