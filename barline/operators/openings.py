"""Group G, openings: a session's first regular bars compared with earlier sessions' by eleven features.

All windows of all sessions are made in one pass: running values over a session's bars, and the context that was frozen before
the open. Sessions meet only within POOL sessions of each other: each looks into its own block of POOL session numbers and the one
before, an equality on (instrument, window, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percentiles, r6
from ..plans import register
from .indicators import weekday_bars
from .session_labels import P as LABELS

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: The eleven features with their weights in percent, and the differences at which their scores are zero.
WEIGHTS = {"path": 25.0, "net_move": 15.0, "range": 10.0, "deepest_pullback": 7.5, "largest_recovery": 7.5, "vs_vwap": 10.0, "in_overnight_range": 5.0, "vs_prev_close": 5.0, "relative_volume": 5.0, "gap": 5.0, "overnight_range": 5.0}
TOLERANCES = {"path": 0.44, "net_move": 0.53, "range": 0.27, "deepest_pullback": 0.28, "largest_recovery": 0.26, "vs_vwap": 0.49, "in_overnight_range": 1.0, "vs_prev_close": 1.1, "relative_volume": 0.44, "gap": 0.94, "overnight_range": 0.55}
#: Features whose tolerance grows with the root of the window's minutes, and the minutes for which it is stated.
SCALED, SCALE_MINUTES = ("path", "net_move", "range", "deepest_pullback", "largest_recovery"), 30
#: Sessions of the volume's usual and the least of them; the least comparable weight; the size of a set; the sessions that are compared.
VOLUME_SESSIONS, VOLUME_LEAST, FLOOR, TOP, POOL = 20, 10, 75.0, 5, 250
#: The first regular slot, minutes of a bar, most bars of a window, and the window at which tolerances are calibrated.
OPEN_SLOT, STEP, LIMIT, CALIBRATED = 960, 60, 6, 2
DAY = ["instrument", "trading_day"]


def confirmed_windows(bars: DataFrame) -> DataFrame:
    """Instrument, trading_day, n (bars in an unbroken run from the open, each confirmed by a later bar of the session), state and next_slot.

    state: complete (LIMIT bars), awaiting_confirmation (the next bar is stored, and nothing after it), gap (it is missing, later ones are
    stored), not_stored (nothing is stored from it on).
    """
    own = confirmed_bars(bars).groupBy(*DAY).agg(F.max("n").alias("n"))
    days = bars.groupBy(*DAY).agg(F.max("slot").alias("newest"), F.collect_set(F.when(F.col("slot") >= OPEN_SLOT, F.col("slot"))).alias("slots"))  # a day's slots
    out = days.join(own, DAY, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("next_slot", F.col("n") * STEP + OPEN_SLOT)
    state = F.when(F.col("n") >= LIMIT, "complete").when(F.array_contains("slots", F.col("next_slot")), "awaiting_confirmation").when(F.col("newest") > F.col("next_slot"), "gap").otherwise("not_stored")
    return out.select(*DAY, "n", state.alias("state"), F.when(F.col("n") < LIMIT, F.col("next_slot")).alias("next_slot"))


def confirmed_bars(bars: DataFrame) -> DataFrame:
    """The bars of confirmed windows with n, their number from 1."""
    newest = bars.groupBy(*DAY).agg(F.max("slot").alias("newest"))
    own = bars.where(F.col("slot").between(OPEN_SLOT, OPEN_SLOT + STEP * LIMIT - 1)).withColumn("n", F.row_number().over(Window.partitionBy(*DAY).orderBy("slot")))
    return own.where(F.col("slot") == OPEN_SLOT + STEP * (F.col("n") - 1)).join(newest, DAY).where("slot < newest").drop("newest")


def contexts(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """levels (atr, prev_close, on_high, on_low of each session) with its number d and its overnight value and volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    night = bars.where(F.col("slot") < OPEN_SLOT - 30).groupBy(*DAY).agg(F.sum(typical * F.col("volume")).alias("night_value"), F.sum("volume").alias("night_volume"))
    days = bars.select(*DAY).distinct().withColumn("d", F.row_number().over(Window.partitionBy("instrument").orderBy("trading_day")))
    return days.join(levels, DAY, "left").join(night, DAY, "left").fillna({"night_value": 0.0, "night_volume": 0})


def volume_baseline(rows: DataFrame) -> Column:
    """The mean volume of the first n bars over the VOLUME_SESSIONS sessions before that hold them, from VOLUME_LEAST."""
    before = Window.partitionBy("instrument", "n").orderBy("d").rangeBetween(-VOLUME_SESSIONS, -1)
    return F.when(F.count("so_far").over(before) >= VOLUME_LEAST, F.avg("so_far").over(before))


def opening_features(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Instrument, trading_day, d, n and the eleven features; path is the end of the path, the others null where an input is missing. Sessions without a range scale have none."""
    w = Window.partitionBy(*DAY).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = confirmed_bars(bars).join(context, DAY)
    x = x.withColumns({"o": F.first("open").over(w), "hi": F.max("high").over(w), "lo": F.min("low").over(w), "so_far": F.sum("volume").over(w), "value": F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")).over(w)})
    x = x.withColumns({"pull": F.max(F.col("hi") - F.col("low")).over(w), "back": F.max(F.col("high") - F.col("lo")).over(w), "usual": volume_baseline(x)})
    atr, c, o, on = F.col("atr"), F.col("close"), F.col("o"), F.col("on_high") - F.col("on_low")
    volume = F.col("night_volume") + F.col("so_far")
    made = {
        "path": (c - o) / atr, "net_move": (c - o) / atr, "range": (F.col("hi") - F.col("lo")) / atr, "deepest_pullback": F.greatest(F.col("pull"), F.lit(0.0)) / atr, "largest_recovery": F.greatest(F.col("back"), F.lit(0.0)) / atr,
        "vs_vwap": F.when(volume > 0, (c - (F.col("night_value") + F.col("value")) / volume) / atr),
        "in_overnight_range": F.when(on > 0, F.least(F.lit(2.0), F.greatest(F.lit(-1.0), (c - F.col("on_low")) / on))), "vs_prev_close": (c - F.col("prev_close")) / atr,
        "relative_volume": F.when((F.col("usual") > 0) & (F.col("so_far") > 0), F.log(F.col("so_far") / F.col("usual"))), "gap": (o - F.col("prev_close")) / atr, "overnight_range": on / atr,
    }
    return x.where(atr > 0).select(*DAY, "d", "n", *[made[f].alias(f) for f in WEIGHTS])


def differences(features: DataFrame, pool: int = POOL) -> DataFrame:
    """Each session's window against those of the `pool` sessions before: earlier, ed, and the difference of each feature (null where one has no value).

    The difference of the path is the root mean square over its bars, a running mean over the pair's windows.
    """
    blocks = features.withColumn("block", F.floor(F.col("d") / pool))
    past = blocks.select("instrument", "n", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("trading_day").alias("earlier"), F.col("d").alias("ed"), *[F.col(f).alias(f"e_{f}") for f in WEIGHTS])
    pairs = blocks.join(past, ["instrument", "n", "block"]).where((F.col("ed") < F.col("d")) & (F.col("ed") >= F.col("d") - pool))
    so_far = Window.partitionBy(*DAY, "earlier").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    apart = {f: F.abs(F.col(f) - F.col(f"e_{f}")) for f in WEIGHTS} | {"path": F.sqrt(F.avg((F.col("path") - F.col("e_path")) ** 2).over(so_far))}
    return pairs.select(*DAY, "d", "n", "earlier", "ed", *[apart[f].alias(f) for f in WEIGHTS])


def tolerance(feature: str, n: Column) -> Column:
    return F.lit(TOLERANCES[feature]) * (F.sqrt(n * STEP / SCALE_MINUTES) if feature in SCALED else F.lit(1.0))


def ranked(apart: DataFrame, top: int = TOP) -> DataFrame:
    """Similarity in percent and comparable weight of each pair; of those from FLOOR on the `top` best: similarity, then weight, then the later session."""
    known = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in WEIGHTS.items()), F.lit(0.0))
    hit = sum((F.coalesce(w * F.greatest(F.lit(0.0), 1 - F.col(f) / tolerance(f, F.col("n"))), F.lit(0.0)) for f, w in WEIGHTS.items()), F.lit(0.0))
    x = apart.withColumns({"comparable": known, "similarity": 100 * hit / known}).where(F.col("comparable") >= FLOOR)
    rank = F.row_number().over(Window.partitionBy(*DAY, "n").orderBy(F.desc(F.round("similarity", 9)), F.desc("comparable"), F.desc("ed")))
    return x.withColumn("rank", rank).where(F.col("rank") <= top)


def calibration(apart: DataFrame, n: int = CALIBRATED) -> DataFrame:
    """Instrument, feature, pairs, median of the differences at one window, and twice that to two significant figures as tolerance."""
    own = apart.where(F.col("n") == n)
    rows = own.select("instrument", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("difference")) for f in WEIGHTS])).alias("x")).select("instrument", "x.feature", "x.difference").where("difference IS NOT NULL")
    key = ["instrument", "feature"]
    got = rows.groupBy(*key).agg(F.count("*").alias("pairs")).join(percentiles(rows, key, "difference", [0.5]), key).withColumn("median", F.col("q")[0])
    unit = F.pow(F.lit(10.0), F.floor(F.log10(2 * F.col("median"))) - 1)
    return got.select(*key, "pairs", "median", F.when(F.col("median") > 0, F.round(2 * F.col("median") / unit) * unit).alias("tolerance"))


_LEVELS = "SELECT t.instrument, t.trading_day, t.a AS atr, t.prev_close, r.on_high, r.on_low FROM {thr} t JOIN {refs} r ON r.instrument = t.instrument AND r.trading_day = t.trading_day"


def features_of(spark, sf_dir) -> DataFrame:
    bars = weekday_bars(spark, sf_dir)
    return opening_features(bars, contexts(bars, LABELS.frame(_LEVELS, spark, sf_dir)))


_F = ", ".join(WEIGHTS)
_TEXT = f"""lv AS ({_LEVELS}),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day ORDER BY slot) AS n, (SELECT max(slot) FROM {{wd}} m WHERE m.instrument = w.instrument AND m.trading_day = w.trading_day) AS newest
  FROM {{wd}} w WHERE slot BETWEEN {OPEN_SLOT} AND {OPEN_SLOT + STEP * LIMIT - 1}) k WHERE slot = {OPEN_SLOT} + {STEP} * (n - 1) AND slot < newest),
dn AS (SELECT instrument, trading_day, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM (SELECT DISTINCT instrument, trading_day FROM {{wd}}) k),
ng AS (SELECT instrument, trading_day, sum((high + low + close) / 3 * volume) AS night_value, sum(volume) AS night_volume FROM {{wd}} k WHERE slot < {OPEN_SLOT - 30} GROUP BY 1, 2),
wn AS (SELECT b.instrument, b.trading_day, dn.d, b.n, b.close AS c, lv.*, coalesce(night_value, 0) AS nv, coalesce(night_volume, 0) AS nq,
  (SELECT list((s.open, s.high, s.low, s.close, s.volume) ORDER BY s.n) FROM cb s WHERE s.instrument = b.instrument AND s.trading_day = b.trading_day AND s.n <= b.n) AS x
  FROM cb b JOIN dn ON dn.instrument = b.instrument AND dn.trading_day = b.trading_day JOIN lv ON lv.instrument = b.instrument AND lv.trading_day = b.trading_day LEFT JOIN ng ON ng.instrument = b.instrument AND ng.trading_day = b.trading_day),
wv AS (SELECT *, list_sum(list_transform(x, lambda b: b[5])) AS v, list_max(list_transform(x, lambda b: b[2])) AS hi, list_min(list_transform(x, lambda b: b[3])) AS lo, x[1][1] AS o FROM wn),
wu AS (SELECT a.*, (SELECT CASE WHEN count(*) >= {VOLUME_LEAST} THEN avg(e.v) END FROM wv e WHERE e.instrument = a.instrument AND e.n = a.n AND e.d BETWEEN a.d - {VOLUME_SESSIONS} AND a.d - 1) AS usual,
  list_max(list_transform(x, lambda b, i: list_max(list_transform(x[1:i], lambda e: e[2])) - b[3])) AS pull, list_max(list_transform(x, lambda b, i: b[2] - list_min(list_transform(x[1:i], lambda e: e[3])))) AS back,
  list_sum(list_transform(x, lambda b: (b[2] + b[3] + b[4]) / 3 * b[5])) AS pv FROM wv a),
ft AS MATERIALIZED (SELECT instrument, trading_day, d, n, (c - o) / atr AS path, (c - o) / atr AS net_move, (hi - lo) / atr AS range, greatest(pull, 0) / atr AS deepest_pullback, greatest(back, 0) / atr AS largest_recovery,
  (c - (nv + pv) / (nq + v)) / atr AS vs_vwap, CASE WHEN on_high > on_low THEN least(2, greatest(-1, (c - on_low) / (on_high - on_low))) END AS in_overnight_range, (c - prev_close) / atr AS vs_prev_close,
  CASE WHEN usual > 0 AND v > 0 THEN ln(v / usual) END AS relative_volume, (o - prev_close) / atr AS gap, (on_high - on_low) / atr AS overnight_range FROM wu WHERE atr > 0)"""
_PAIRS = f"""{_TEXT},
df AS MATERIALIZED (SELECT a.instrument, a.trading_day, a.d, a.n, e.trading_day AS earlier, e.d AS ed, (SELECT sqrt(avg((p.path - q.path) ** 2)) FROM ft p JOIN ft q ON q.n = p.n WHERE p.instrument = a.instrument AND p.d = a.d AND q.instrument = a.instrument AND q.d = e.d AND p.n <= a.n) AS path,
  {", ".join(f"abs(a.{f} - e.{f}) AS {f}" for f in WEIGHTS if f != "path")} FROM ft a JOIN ft e ON e.instrument = a.instrument AND e.n = a.n AND e.d BETWEEN a.d - {POOL} AND a.d - 1),
lf AS (UNPIVOT df ON {_F} INTO NAME feature VALUE difference),
wt AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {w}, {TOLERANCES[f]}, {f in SCALED})" for f, w in WEIGHTS.items())}) t(feature, weight, tolerance, scaled))"""


def _day(out: DataFrame) -> DataFrame:
    return out.withColumn("trading_day", F.col("trading_day").cast("string"))


@query("g7_window_stop", LABELS.text(f"""
{_TEXT}, k AS (SELECT instrument, trading_day, max(slot) AS newest, list(slot) AS slots FROM {{wd}} w GROUP BY 1, 2), r AS (SELECT k.*, coalesce(o.n, 0) AS n FROM k LEFT JOIN (SELECT instrument, trading_day, max(n) AS n FROM cb GROUP BY 1, 2) o ON o.instrument = k.instrument AND o.trading_day = k.trading_day)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, CASE WHEN n >= {LIMIT} THEN 'complete' WHEN list_contains(slots, {OPEN_SLOT} + {STEP} * n) THEN 'awaiting_confirmation' WHEN newest > {OPEN_SLOT} + {STEP} * n THEN 'gap' ELSE 'not_stored' END AS state,
  CASE WHEN n < {LIMIT} THEN CAST({OPEN_SLOT} + {STEP} * n AS INT) END AS next_slot FROM r"""))
def g7(spark, sf_dir):
    """How far each opening is confirmed, and why it stops there."""
    return _day(confirmed_windows(weekday_bars(spark, sf_dir)))


@query("g8_eleven_features", LABELS.text(f"{_TEXT} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, {', '.join(f'round({f}, 6) AS {f}' for f in WEIGHTS)} FROM ft"))
def g8(spark, sf_dir):
    """The eleven features of every window; relative_volume holds G9's usual of twenty sessions, ten at least."""
    return _day(features_of(spark, sf_dir)).select("instrument", "trading_day", "n", *[r6(f).alias(f) for f in WEIGHTS])


@query("g11_ranked_openings", LABELS.text(f"""
{_PAIRS}, s AS (SELECT instrument, trading_day, n, earlier, ed, sum(weight) AS comparable, 100 * sum(weight * greatest(0, 1 - difference / (tolerance * CASE WHEN scaled THEN sqrt(n * {STEP} / {SCALE_MINUTES}.0) ELSE 1 END))) / sum(weight) AS similarity
  FROM lf JOIN wt ON wt.feature = lf.feature GROUP BY 1, 2, 3, 4, 5), r AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day, n ORDER BY round(similarity, 9) DESC, comparable DESC, ed DESC) AS rank FROM s WHERE comparable >= {FLOOR})
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, CAST(earlier AS VARCHAR) AS earlier, CAST(comparable AS DOUBLE) AS comparable, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= {TOP}"""))
def g11(spark, sf_dir):
    """The most similar openings of every session and window."""
    out = ranked(differences(features_of(spark, sf_dir)))
    return _day(out).select("instrument", "trading_day", "n", F.col("earlier").cast("string").alias("earlier"), "comparable", r6("similarity").alias("similarity"), "rank")


@query("g12_feature_tolerances", LABELS.text(f"""
{_PAIRS}, m AS (SELECT instrument, feature, count(*) AS pairs, median(difference) AS median FROM lf WHERE n = {CALIBRATED} GROUP BY 1, 2)
SELECT instrument, feature, pairs, round(median, 6) AS median, CASE WHEN median > 0 THEN round(round(2 * median / pow(10, floor(log10(2 * median)) - 1)) * pow(10, floor(log10(2 * median)) - 1), 6) END AS tolerance FROM m"""))
def g12(spark, sf_dir):
    """The tolerance of each feature from the spread of its values over all pairs."""
    return calibration(differences(features_of(spark, sf_dir))).select("instrument", "feature", "pairs", r6("median").alias("median"), r6("tolerance").alias("tolerance"))
