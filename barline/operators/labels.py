"""Group F: what each session realised. A label is NULL with a reason where a bar or threshold is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import r6
from ..plans import register
from .indicators import DAY, RTH_SQL, WD_SQL, daily_ranges, overnight_references, weekday_bars

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Bars of the regular session counted from its first (with hourly bars the first whole hour).
FIRST = 600


def indexed(bars: DataFrame) -> DataFrame:
    """Regular bars with k: 0 for the first, and the session's opening price o."""
    rth = bars.where("session_scope = 'RTH'").withColumn("k", F.floor((F.col("minute") - FIRST) / 60).cast("int"))
    return rth


IX_SQL = f"{WD_SQL}, ix AS (SELECT *, CAST((minute - 600) // 60 AS INT) AS k FROM wd WHERE session_scope = 'RTH'), op AS (SELECT instrument, trading_day, max(open) FILTER (k = 0) AS o FROM ix GROUP BY 1, 2)"


def session_day(c: str = "trading_day") -> F.Column:
    return F.col(c).cast("string").alias("trading_day")


def first_move(bars: DataFrame, threshold: float, within: int) -> DataFrame:
    """which of o + T and o - T is touched first in the first `within` bars; both in one bar is ambiguous; a missing bar before a touch leaves it unknown."""
    ix = indexed(bars)
    o = ix.groupBy(*DAY).agg(F.max(F.when(F.col("k") == 0, F.col("open"))).alias("o"))
    hit = ix.where(F.col("k") < within).join(o, DAY).withColumns({"up": F.col("high") >= F.col("o") + threshold, "down": F.col("low") <= F.col("o") - threshold})
    g = hit.groupBy(*DAY).agg(F.max("o").alias("o"), F.min(F.when(F.col("up"), F.col("k"))).alias("u"), F.min(F.when(F.col("down"), F.col("k"))).alias("d"), F.array_sort(F.collect_set("k")).alias("ks"))
    g = o.select(*DAY).join(g, DAY, "left")
    touch = F.least("u", "d")
    upto = F.coalesce(touch, F.lit(within - 1))
    whole = F.size(F.filter("ks", lambda x: x <= upto)) == upto + 1
    label = F.when(~whole | F.col("o").isNull(), None).when(F.col("u") == F.col("d"), None).when(touch.isNull(), "neither").when(touch == F.col("u"), "up_first").otherwise("down_first")
    reason = F.when(F.col("o").isNull() | ~whole, "missing_bars").when(F.col("u") == F.col("d"), "ambiguous_intrabar")
    return g.select(*DAY, label.alias("label"), reason.alias("reason"))


@query("f1_first_move", f"""WITH {IX_SQL}, h AS (SELECT ix.instrument, ix.trading_day, max(o) AS o, min(k) FILTER (high >= o + 5) AS u, min(k) FILTER (low <= o - 5) AS d, list(DISTINCT k) AS ks FROM ix JOIN op USING (instrument, trading_day) WHERE k < 5 GROUP BY 1, 2),
x AS (SELECT op.instrument, op.trading_day, h.o, u, d, coalesce(least(u, d), 4) AS upto, ks FROM op LEFT JOIN h USING (instrument, trading_day)),
y AS (SELECT *, coalesce(len(list_filter(ks, lambda q: q <= upto)) = upto + 1, false) AS whole FROM x)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN o IS NULL OR NOT whole OR u = d THEN NULL WHEN u IS NULL AND d IS NULL THEN 'neither' WHEN d IS NULL OR u < d THEN 'up_first' ELSE 'down_first' END AS label,
  CASE WHEN o IS NULL OR NOT whole THEN 'missing_bars' WHEN u = d THEN 'ambiguous_intrabar' END AS reason FROM y""")
def f1(spark, sf_dir):
    return first_move(weekday_bars(spark, sf_dir), 5.0, 5).select("instrument", session_day(), "label", "reason")


def direction(move, band) -> F.Column:
    return F.when(move.isNull(), None).when(move > band, "bullish").when(move < -band, "bearish").otherwise("neutral_band")


def close_moves(bars: DataFrame) -> DataFrame:
    """Closes of chosen bars less the opening price: one grouped pass."""
    return indexed(bars).groupBy(*DAY).agg(F.max(F.when(F.col("k") == 0, F.col("open"))).alias("o"), *[F.max(F.when(F.col("k") == n, F.col("close"))).alias(f"c{n}") for n in (0, 1, 5)])


MOVES_SQL = f"{IX_SQL}, mv AS (SELECT instrument, trading_day, max(open) FILTER (k = 0) AS o, max(close) FILTER (k = 0) AS c0, max(close) FILTER (k = 1) AS c1, max(close) FILTER (k = 5) AS c5 FROM ix GROUP BY 1, 2)"
_dir = lambda c, b: f"CASE WHEN {c} - o > {b} THEN 'bullish' WHEN {c} - o < -{b} THEN 'bearish' WHEN {c} - o IS NOT NULL THEN 'neutral_band' END"


@query("f2_close_directions", f"""WITH {MOVES_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, {_dir('c0', 5)} AS first_bar, {_dir('c1', 5)} AS second_bar, {_dir('c5', 10)} AS session_close, CASE WHEN o IS NULL THEN 'no opening bar' WHEN c5 IS NULL THEN 'no closing bar' END AS reason FROM mv""")
def f2(spark, sf_dir):
    m = close_moves(weekday_bars(spark, sf_dir))
    at = lambda c, b: direction(F.col(c) - F.col("o"), b)
    return m.select("instrument", session_day(), at("c0", 5).alias("first_bar"), at("c1", 5).alias("second_bar"), at("c5", 10).alias("session_close"), F.when(F.col("o").isNull(), "no opening bar").when(F.col("c5").isNull(), "no closing bar").alias("reason"))


@query("f5_first_level_tested", f"""WITH {IX_SQL}, lv AS (SELECT instrument, trading_day, unnest(['on_high', 'on_low']) AS name, unnest([max(high) FILTER (slot < 900), min(low) FILTER (slot < 900)]) AS level FROM wd GROUP BY 1, 2),
t AS (SELECT ix.instrument, ix.trading_day, k, name, level, row_number() OVER (PARTITION BY ix.instrument, ix.trading_day ORDER BY k, abs(level - open), name) AS r FROM ix JOIN lv ON lv.instrument = ix.instrument AND lv.trading_day = ix.trading_day AND low <= level AND level <= high)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, k, name, level FROM t WHERE r = 1""")
def f5(spark, sf_dir):
    """The first overnight level a regular bar reaches; ties by distance from the bar's open, then by name."""
    b = weekday_bars(spark, sf_dir)
    lv = overnight_references(b).select(*DAY, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("level")) for n in ("on_high", "on_low")])).alias("x")).select(*DAY, "x.*")
    hit = indexed(b).join(lv, DAY).where("low <= level AND level <= high")
    best = hit.groupBy(*DAY).agg(F.min(F.struct("k", F.abs(F.col("level") - F.col("open")).alias("d"), "name", "level")).alias("x"))
    return best.select("instrument", session_day(), "x.k", "x.name", "x.level")


@query("f7_window_measures", f"""WITH {IX_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN count(*) FILTER (k < 2) = 2 THEN max(high) FILTER (k < 2) END AS high2, CASE WHEN count(*) FILTER (k < 2) = 2 THEN min(low) FILTER (k < 2) END AS low2,
  CASE WHEN count(*) = 6 THEN max(high) - min(low) END AS session_range, count(*) AS bars FROM ix GROUP BY 1, 2""")
def f7(spark, sf_dir):
    """Measures of windows, each only where the window is complete."""
    two = F.col("k") < 2
    g = indexed(weekday_bars(spark, sf_dir)).groupBy("instrument", "trading_day")
    g = g.agg(F.count_if(two).alias("n2"), F.max(F.when(two, F.col("high"))).alias("h2"), F.min(F.when(two, F.col("low"))).alias("l2"), (F.max("high") - F.min("low")).alias("range"), F.count("*").alias("bars"))
    return g.select("instrument", session_day(), F.when(F.col("n2") == 2, F.col("h2")).alias("high2"), F.when(F.col("n2") == 2, F.col("l2")).alias("low2"), F.when(F.col("bars") == 6, F.col("range")).alias("session_range"), "bars")


@query("f10_range_extension", f"""WITH {IX_SQL}, r AS (SELECT instrument, trading_day, max(high) FILTER (k < 2) AS h, min(low) FILTER (k < 2) AS l, max(high) FILTER (k >= 2) AS ah, min(low) FILTER (k >= 2) AS al FROM ix GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN h IS NULL OR ah IS NULL THEN NULL WHEN ah > h AND al < l THEN 'both' WHEN ah > h THEN 'up' WHEN al < l THEN 'down' ELSE 'none' END AS extension FROM r""")
def f10(spark, sf_dir):
    """Whether the session left its opening range, and on which side."""
    early = F.col("k") < 2
    r = indexed(weekday_bars(spark, sf_dir)).groupBy(*DAY).agg(F.max(F.when(early, F.col("high"))).alias("h"), F.min(F.when(early, F.col("low"))).alias("l"), F.max(F.when(~early, F.col("high"))).alias("ah"), F.min(F.when(~early, F.col("low"))).alias("al"))
    up, down = F.col("ah") > F.col("h"), F.col("al") < F.col("l")
    return r.select("instrument", session_day(), F.when(F.col("h").isNull() | F.col("ah").isNull(), None).when(up & down, "both").when(up, "up").when(down, "down").otherwise("none").alias("extension"))


@query("f11_gap_outcome", f"""WITH {RTH_SQL}, oo AS (SELECT instrument, trading_day, arg_min(open, bar_start) AS o FROM wd WHERE session_scope = 'RTH' GROUP BY 1, 2)
SELECT tr.instrument, CAST(tr.trading_day AS VARCHAR) AS trading_day, round(o - prev, 6) AS gap, CASE WHEN prev IS NULL THEN NULL WHEN abs(o - prev) <= 2 THEN 'no_gap' WHEN low <= prev AND prev <= high THEN 'filled' WHEN (tr.close - o) * (o - prev) > 0 THEN 'extended' ELSE 'held' END AS outcome
FROM tr JOIN oo USING (instrument, trading_day)""")
def f11(spark, sf_dir):
    """The opening gap against the close before, and what became of it."""
    b = weekday_bars(spark, sf_dir)
    from pyspark.sql import Window

    o = b.where("session_scope = 'RTH'").groupBy(*DAY).agg(F.min_by("open", "bar_start").alias("o"))
    d = daily_ranges(b).withColumn("prev", F.lag("close").over(Window.partitionBy("instrument").orderBy("trading_day"))).join(o, DAY)
    gap = F.col("o") - F.col("prev")
    out = F.when(F.col("prev").isNull(), None).when(F.abs(gap) <= 2, "no_gap").when((F.col("low") <= F.col("prev")) & (F.col("prev") <= F.col("high")), "filled").when((F.col("close") - F.col("o")) * gap > 0, "extended").otherwise("held")
    return d.select("instrument", session_day(), r6(gap).alias("gap"), out.alias("outcome"))


@query("f12_extreme_timing", f"WITH {IX_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, arg_min(k, (-high, k)) AS high_at, arg_min(k, (low, k)) AS low_at FROM ix GROUP BY 1, 2")
def f12(spark, sf_dir):
    """When the session's high and low were first made."""
    g = indexed(weekday_bars(spark, sf_dir)).groupBy("instrument", session_day())
    return g.agg(F.min_by("k", F.struct(-F.col("high"), "k")).alias("high_at"), F.min_by("k", F.struct("low", "k")).alias("low_at"))


@query("f15_matched_direction", f"""WITH {MOVES_SQL}, x AS (SELECT instrument, trading_day, {_dir('c0', 5)} AS early, {_dir('c5', 10)} AS late FROM mv)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN early IS NULL OR late IS NULL THEN NULL WHEN early = 'neutral_band' OR late = 'neutral_band' THEN 'no_direction' WHEN early = late THEN 'matched' ELSE 'opposite' END AS matched FROM x""")
def f15(spark, sf_dir):
    m = close_moves(weekday_bars(spark, sf_dir)).withColumns({"early": direction(F.col("c0") - F.col("o"), 5), "late": direction(F.col("c5") - F.col("o"), 10)})
    none = F.lit("neutral_band")
    return m.select("instrument", session_day(), F.when(F.col("early").isNull() | F.col("late").isNull(), None).when((F.col("early") == none) | (F.col("late") == none), "no_direction").when(F.col("early") == F.col("late"), "matched").otherwise("opposite").alias("matched"))


def forward_labels(bars: DataFrame, hours: int, band: float) -> DataFrame:
    """the move over the next `hours` bars from every bar, with its label; unknown unless the bar at the end is there."""
    ahead = bars.select(*DAY, (F.col("slot") - 60 * hours).alias("slot"), F.col("close").alias("later"))
    out = bars.join(ahead, [*DAY, "slot"], "left").withColumn("move", F.col("later") - F.col("close"))
    return out.withColumns({"label": direction(F.col("move"), band), "reason": F.when(F.col("move").isNull(), "missing_bars")})


FWD_SQL = f"""{WD_SQL}, fw AS (SELECT a.*, b.close - a.close AS move, CASE WHEN b.close - a.close > 10 THEN 'bullish' WHEN b.close - a.close < -10 THEN 'bearish' WHEN b.close IS NOT NULL THEN 'neutral_band' END AS label
  FROM wd a LEFT JOIN wd b ON b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot = a.slot + 120)"""


@query("f22_forward_labels", f"WITH {FWD_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(move, 6) AS move, label, CASE WHEN move IS NULL THEN 'missing_bars' END AS reason FROM fw")
def f22(spark, sf_dir):
    return forward_labels(weekday_bars(spark, sf_dir), 2, 10.0).select("instrument", session_day(), "slot", r6("move").alias("move"), "label", "reason")


@query("f23_wide_outcomes", f"""WITH {FWD_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, max(label) FILTER (slot = 60) AS s60, max(label) FILTER (slot = 480) AS s480, max(label) FILTER (slot = 960) AS s960,
  (count(label) FILTER (slot IN (60, 480, 960))) / 3.0 AS completeness FROM fw GROUP BY 1, 2""")
def f23(spark, sf_dir):
    """One wide row a session, with the share of outcomes known."""
    f = forward_labels(weekday_bars(spark, sf_dir), 2, 10.0)
    at = lambda s: F.max(F.when(F.col("slot") == s, F.col("label")))
    return f.groupBy("instrument", session_day()).agg(*[at(s).alias(f"s{s}") for s in (60, 480, 960)], (F.count(F.when(F.col("slot").isin(60, 480, 960), F.col("label"))) / 3.0).alias("completeness"))


@query("f25_label_disagreement", f"""WITH {FWD_SQL}, b AS (SELECT *, CASE WHEN move > 12 THEN 'bullish' WHEN move < -12 THEN 'bearish' WHEN move IS NOT NULL THEN 'neutral_band' END AS label2 FROM fw)
SELECT CASE WHEN label IS NULL AND label2 IS NULL THEN 'both unknown' WHEN label = label2 THEN 'agree' ELSE label || ' to ' || label2 END AS cause, count(*) AS n FROM b GROUP BY 1""")
def f25(spark, sf_dir):
    """Two versions of a label compared by cause."""
    b = weekday_bars(spark, sf_dir)
    key = [*DAY, "slot"]
    one, two = forward_labels(b, 2, 10.0).select(*key, F.col("label").alias("a")), forward_labels(b, 2, 12.0).select(*key, F.col("label").alias("b"))
    cause = F.when(F.col("a").isNull() & F.col("b").isNull(), "both unknown").when(F.col("a") == F.col("b"), "agree").otherwise(F.concat_ws(" to ", "a", "b"))
    return one.join(two, key, "full").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("f6_level_outcomes", f"""WITH {IX_SQL}, lv AS (SELECT instrument, trading_day, unnest(['on_high', 'on_low']) AS name, unnest([max(high) FILTER (slot < 900), min(low) FILTER (slot < 900)]) AS level FROM wd GROUP BY 1, 2),
g AS (SELECT ix.instrument, ix.trading_day, name, level, bool_or(low <= level AND level <= high) AS touched, arg_max(close, k) AS last, min(k) FILTER (low <= level AND level <= high) AS hit_k FROM ix JOIN lv USING (instrument, trading_day) GROUP BY 1, 2, 3, 4)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, name, CASE WHEN level IS NULL THEN NULL WHEN NOT touched THEN 'untouched' WHEN (name = 'on_high') = (last > level) THEN 'broken' ELSE 'rejected' END AS outcome, hit_k AS touched_at FROM g""")
def f6(spark, sf_dir):
    """What became of each overnight level: untouched, broken, or rejected by the last close."""
    b = weekday_bars(spark, sf_dir)
    lv = overnight_references(b).select(*DAY, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("level")) for n in ("on_high", "on_low")])).alias("x")).select(*DAY, "x.*")
    inside = F.col("low") <= F.col("level")
    inside = inside & (F.col("level") <= F.col("high"))
    g = indexed(b).join(lv, DAY).groupBy(*DAY, "name", "level").agg(F.bool_or(inside).alias("touched"), F.max_by("close", "k").alias("last"), F.min(F.when(inside, F.col("k"))).alias("at"))
    out = F.when(F.col("level").isNull(), None).when(~F.col("touched"), "untouched").when((F.col("name") == "on_high") == (F.col("last") > F.col("level")), "broken").otherwise("rejected")
    return g.select("instrument", session_day(), "name", out.alias("outcome"), F.col("at").alias("touched_at"))


@query("f13_pullback", f"""WITH {IX_SQL}, g AS (SELECT instrument, trading_day, max(open) FILTER (k = 0) AS o, arg_min(k, (-high, k)) AS hk, max(high) AS hi FROM ix WHERE k < 4 GROUP BY 1, 2), p AS (SELECT g.*, (SELECT min(low) FROM ix WHERE ix.instrument = g.instrument AND ix.trading_day = g.trading_day AND ix.k > g.hk AND ix.k < 4) AS after FROM g)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN o IS NULL OR hi - o < 5 THEN 'no leg' WHEN after IS NULL THEN 'none yet' WHEN (hi - after) / (hi - o) < 0.5 THEN 'shallow' WHEN (hi - after) / (hi - o) < 1 THEN 'deep' ELSE 'full' END AS pullback FROM p""")
def f13(spark, sf_dir):
    """How far the morning fell back from its high: suffix extremes by a reversed running window."""
    from pyspark.sql import Window

    later = Window.partitionBy(*DAY).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    b = indexed(weekday_bars(spark, sf_dir)).where("k < 4").withColumn("after", F.min("low").over(later))
    g = b.groupBy(*DAY).agg(F.max(F.when(F.col("k") == 0, F.col("open"))).alias("o"), F.max("high").alias("hi"), F.min_by(F.struct("after"), F.struct(-F.col("high"), "k")).alias("x"))
    part = (F.col("hi") - F.col("x.after")) / (F.col("hi") - F.col("o"))
    return g.select("instrument", session_day(), F.when(F.col("o").isNull() | (F.col("hi") - F.col("o") < 5), "no leg").when(F.col("x.after").isNull(), "none yet").when(part < 0.5, "shallow").when(part < 1, "deep").otherwise("full").alias("pullback"))


@query("f14_afternoon_continuation", f"""WITH {IX_SQL}, m AS (SELECT instrument, trading_day, max(open) FILTER (k = 0) AS o, max(close) FILTER (k = 2) AS mid, max(close) FILTER (k = 5) AS c FROM ix GROUP BY 1, 2)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CASE WHEN o IS NULL OR mid IS NULL OR c IS NULL THEN NULL WHEN abs(mid - o) <= 5 THEN 'no move' WHEN (c - mid) * (mid - o) > 0 THEN 'continued' ELSE 'reversed' END AS afternoon FROM m""")
def f14(spark, sf_dir):
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    m = indexed(weekday_bars(spark, sf_dir)).groupBy(*DAY).agg(at(0, "open").alias("o"), at(2, "close").alias("mid"), at(5, "close").alias("c"))
    known = F.col("o").isNull() | F.col("mid").isNull() | F.col("c").isNull()
    return m.select("instrument", session_day(), F.when(known, None).when(F.abs(F.col("mid") - F.col("o")) <= 5, "no move").when((F.col("c") - F.col("mid")) * (F.col("mid") - F.col("o")) > 0, "continued").otherwise("reversed").alias("afternoon"))


@query("f21_first_barrier", f"""WITH {WD_SQL}, j AS (SELECT a.instrument, a.trading_day, a.slot, min(b.slot) FILTER (b.high >= a.close + 15) AS u, min(b.slot) FILTER (b.low <= a.close - 15) AS d FROM wd a LEFT JOIN wd b ON b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot > a.slot AND b.slot <= a.slot + 240 GROUP BY 1, 2, 3)
SELECT instrument, CASE WHEN u = d THEN 'ambiguous' WHEN u IS NULL AND d IS NULL THEN 'neither' WHEN d IS NULL OR u < d THEN 'up' ELSE 'down' END AS hit, count(*) AS n FROM j GROUP BY 1, 2""")
def f21(spark, sf_dir):
    """Which barrier is hit first within four bars of every origin, by lead columns of the same window."""
    from pyspark.sql import Window

    w = Window.partitionBy(*DAY).orderBy("slot").rangeBetween(1, 240)
    b = weekday_bars(spark, sf_dir).withColumn("next", F.collect_list(F.struct("slot", "high", "low")).over(w))  # four bars at most
    first = lambda f: F.array_min(F.transform(F.filter("next", f), lambda x: x["slot"]))
    b = b.select("instrument", first(lambda x: x["high"] >= F.col("close") + 15).alias("u"), first(lambda x: x["low"] <= F.col("close") - 15).alias("d"))
    hit = F.when(F.col("u") == F.col("d"), "ambiguous").when(F.col("u").isNull() & F.col("d").isNull(), "neither").when(F.col("d").isNull() | (F.col("u") < F.col("d")), "up").otherwise("down")
    return b.groupBy("instrument", hit.alias("hit")).agg(F.count("*").alias("n"))
