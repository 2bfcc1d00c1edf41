"""Group G: earlier sessions that resemble one, by features and by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import islands, r6
from ..plans import register
from .calendar import calendar, front_contracts
from .indicators import DAY, REFS_SQL, WD_SQL, daily_ranges, overnight_references, weekday_bars
from .labels import close_moves, direction, first_move

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Weights of the compared features; they sum to 100.
WEIGHTS = {"trend": 40, "place": 25, "width": 20, "activity": 15}
FLOOR, TOP = 50, 5
PICKS = 25


def session_features(bars: DataFrame) -> DataFrame:
    """G1: categorical features of each session known at its cutoff."""
    r = overnight_references(bars).where("on_bars > 0")
    place = (F.col("cutoff_price") - F.col("on_low")) / F.nullif(F.col("on_high") - F.col("on_low"), F.lit(0.0))
    return r.select(*DAY, F.when(F.col("cutoff_price") > F.col("on_open"), "up").when(F.col("cutoff_price") < F.col("on_open"), "down").otherwise("flat").alias("trend"),
                    F.when(place > 2 / 3, "high").when(place < 1 / 3, "low").when(place.isNotNull(), "middle").alias("place"), F.when(F.col("on_high") - F.col("on_low") > 120, "wide").otherwise("narrow").alias("width"), F.when(F.col("on_bars") >= 15, "full").otherwise("thin").alias("activity"))


FEAT_SQL = f"""{REFS_SQL}, ft AS (SELECT instrument, trading_day, CASE WHEN cutoff_price > on_open THEN 'up' WHEN cutoff_price < on_open THEN 'down' ELSE 'flat' END AS trend,
  CASE WHEN (cutoff_price - on_low) / nullif(on_high - on_low, 0) > 2 / 3 THEN 'high' WHEN (cutoff_price - on_low) / nullif(on_high - on_low, 0) < 1 / 3 THEN 'low' WHEN on_high > on_low THEN 'middle' END AS place,
  CASE WHEN on_high - on_low > 120 THEN 'wide' ELSE 'narrow' END AS width, CASE WHEN on_bars >= 15 THEN 'full' ELSE 'thin' END AS activity FROM refs WHERE on_bars > 0),
pr AS (SELECT a.instrument, a.trading_day, b.trading_day AS earlier,
  (CASE WHEN a.trend = b.trend THEN 40 ELSE 0 END + CASE WHEN a.place = b.place THEN 25 ELSE 0 END + CASE WHEN a.width = b.width THEN 20 ELSE 0 END + CASE WHEN a.activity = b.activity THEN 15 ELSE 0 END) AS hit,
  (75 + CASE WHEN a.place IS NOT NULL AND b.place IS NOT NULL THEN 25 ELSE 0 END) AS comparable FROM ft a JOIN ft b ON a.instrument = b.instrument AND b.trading_day < a.trading_day)"""


def similar_pairs(features: DataFrame) -> DataFrame:
    """Every session against each earlier one of its instrument: weight that agrees, and weight that can be compared."""
    b = features.select("instrument", F.col("trading_day").alias("earlier"), *[F.col(c).alias(f"b_{c}") for c in WEIGHTS])
    hit = sum((F.when(F.col(c) == F.col(f"b_{c}"), w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    can = sum((F.when(F.col(c).isNotNull() & F.col(f"b_{c}").isNotNull(), w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    return features.join(b, "instrument").where("earlier < trading_day").select(*DAY, "earlier", hit.alias("hit"), can.alias("comparable"))


@query("g2_pair_similarity", f"WITH {FEAT_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(earlier AS VARCHAR) AS earlier, hit, comparable FROM pr")
def g2(spark, sf_dir):
    p = similar_pairs(session_features(weekday_bars(spark, sf_dir)))
    return p.withColumns({"trading_day": F.col("trading_day").cast("string"), "earlier": F.col("earlier").cast("string")})


def best_matches(pairs: DataFrame) -> DataFrame:
    """The TOP earlier sessions with enough comparable weight; integers decide, ties go to the later date."""
    w = Window.partitionBy(*DAY).orderBy(F.desc(F.round(100.0 * F.col("hit") / F.col("comparable"), 9)), F.desc("comparable"), F.desc("earlier"))
    return pairs.where(F.col("comparable") >= FLOOR).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


TOP_SQL = f"{FEAT_SQL}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day ORDER BY round(100.0 * hit / comparable, 9) DESC, comparable DESC, earlier DESC) AS rank FROM pr WHERE comparable >= 50) WHERE rank <= 5)"


def matches(spark, sf_dir) -> DataFrame:
    return best_matches(similar_pairs(session_features(weekday_bars(spark, sf_dir))))


@query("g3_best_matches", f"WITH {TOP_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(earlier AS VARCHAR) AS earlier, hit, CAST(rank AS INT) AS rank FROM tp")
def g3(spark, sf_dir):
    return matches(spark, sf_dir).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("earlier").cast("string").alias("earlier"), "hit", "rank")


@query("g4_exclusions", f"WITH {FEAT_SQL} SELECT instrument, CASE WHEN comparable < 80 THEN 'not comparable' WHEN hit < 40 THEN 'too different' ELSE 'eligible' END AS reason, count(*) AS n FROM pr GROUP BY 1, 2")
def g4(spark, sf_dir):
    """Pairs counted by the first reason that excludes them."""
    p = similar_pairs(session_features(weekday_bars(spark, sf_dir)))
    return p.groupBy("instrument", F.when(F.col("comparable") < 80, "not comparable").when(F.col("hit") < 40, "too different").otherwise("eligible").alias("reason")).agg(F.count("*").alias("n"))


@query("g6_member_frequencies", f"""WITH {TOP_SQL}, mv AS (SELECT instrument, trading_day, CASE WHEN arg_max(close, slot) > arg_min(open, slot) THEN 'up' ELSE 'down' END AS label FROM wd WHERE session_scope = 'RTH' GROUP BY 1, 2)
SELECT tp.instrument, CAST(tp.trading_day AS VARCHAR) AS trading_day, count(*) AS members, count(*) FILTER (label = 'up') AS up, round((count(*) FILTER (label = 'up') + 1) / (count(label) + 2), 6) AS smoothed
FROM tp LEFT JOIN mv ON mv.instrument = tp.instrument AND mv.trading_day = tp.earlier GROUP BY 1, 2""")
def g6(spark, sf_dir):
    """What the members of each set realised, and the smoothed share."""
    b = weekday_bars(spark, sf_dir)
    out = b.where("session_scope = 'RTH'").groupBy("instrument", F.col("trading_day").alias("earlier")).agg(F.when(F.max_by("close", "slot") > F.min_by("open", "slot"), "up").otherwise("down").alias("label"))
    m = matches(spark, sf_dir).join(out, ["instrument", "earlier"], "left")
    up = F.count_if(F.col("label") == "up")
    return m.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.count("*").alias("members"), up.alias("up"), r6((up + 1) / (F.count("label") + 2)).alias("smoothed"))


@query("g7_confirmed_window", f"""WITH {WD_SQL}, h AS (SELECT instrument, trading_day, slot // 60 AS hour FROM wd), f AS (SELECT *, hour - row_number() OVER (PARTITION BY instrument, trading_day ORDER BY hour) AS g, max(hour) OVER (PARTITION BY instrument, trading_day) AS newest FROM h)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(count(*) FILTER (g = -1) AS BIGINT) AS n, CASE WHEN count(*) FILTER (g = -1) = max(newest) + 1 THEN 'open' ELSE 'gap' END AS state FROM f GROUP BY 1, 2""")
def g7(spark, sf_dir):
    """The contiguous window from the session's start, and whether a gap stopped it."""
    h = weekday_bars(spark, sf_dir).select(*DAY, F.floor(F.col("slot") / 60).alias("hour"))
    w = Window.partitionBy(*DAY).orderBy("hour")
    h = h.withColumn("ok", F.col("hour") == F.row_number().over(w) - 1)
    return h.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.count_if("ok").alias("n"), F.when(F.count_if("ok") == F.max("hour") + 1, "open").otherwise("gap").alias("state"))


def opening_paths(bars: DataFrame) -> DataFrame:
    """At every bar of the regular session: net move, range so far, pullback from the extreme, all n at once."""
    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rth = bars.where("session_scope = 'RTH'").withColumns({"n": F.row_number().over(Window.partitionBy(*DAY).orderBy("slot")), "o": F.first("open").over(w), "hi": F.max("high").over(w), "lo": F.min("low").over(w), "cv": F.sum("volume").over(w)})
    return rth.withColumns({"net": F.col("close") - F.col("o"), "range": F.col("hi") - F.col("lo"), "pullback": F.when(F.col("close") >= F.col("o"), F.col("hi") - F.col("close")).otherwise(F.col("close") - F.col("lo"))})


OPEN_SQL = f"""{WD_SQL}, pa0 AS (SELECT instrument, trading_day, slot, close, row_number() OVER w AS n, first_value(open) OVER w AS o, max(high) OVER (w ROWS UNBOUNDED PRECEDING) AS hi, min(low) OVER (w ROWS UNBOUNDED PRECEDING) AS lo, sum(volume) OVER (w ROWS UNBOUNDED PRECEDING) AS cv
  FROM wd WHERE session_scope = 'RTH' WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot)), pa AS (SELECT *, close - o AS net, hi - lo AS range, CASE WHEN close >= o THEN hi - close ELSE close - lo END AS pullback FROM pa0)"""


@query("g8_opening_features", f"WITH {OPEN_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, round(net, 6) AS net, round(range, 6) AS range, round(pullback, 6) AS pullback FROM pa")
def g8(spark, sf_dir):
    p = opening_paths(weekday_bars(spark, sf_dir))
    return p.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "n", r6("net").alias("net"), r6("range").alias("range"), r6("pullback").alias("pullback"))


@query("g9_volume_baseline", f"""WITH {OPEN_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(n AS INT) AS n, CASE WHEN count(*) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 5 THEN round(avg(cv) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) END AS usual FROM pa WINDOW w AS (PARTITION BY instrument, n ORDER BY trading_day)""")
def g9(spark, sf_dir):
    """Mean cumulative volume at each n over the 20 sessions before, from 5 at least."""
    w = Window.partitionBy("instrument", "n").orderBy("trading_day").rowsBetween(-20, -1)
    p = opening_paths(weekday_bars(spark, sf_dir))
    return p.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "n", F.when(F.count("*").over(w) >= 5, r6(F.avg("cv").over(w))).alias("usual"))


def path_distances(paths: DataFrame) -> DataFrame:
    """RMS distance of net paths between sessions of an instrument, and over how many bars."""
    b = paths.select("instrument", F.col("trading_day").alias("earlier"), "n", F.col("net").alias("b_net"))
    pairs = paths.select(*DAY, "n", "net").join(b, ["instrument", "n"]).where("earlier < trading_day")
    return pairs.groupBy(*DAY, "earlier").agg(F.sqrt(F.avg((F.col("net") - F.col("b_net")) ** 2)).alias("rms"), F.count("*").alias("bars"))


DIST_SQL = f"{OPEN_SQL}, ds AS (SELECT a.instrument, a.trading_day, b.trading_day AS earlier, sqrt(avg((a.net - b.net) ** 2)) AS rms, count(*) AS bars FROM pa a JOIN pa b ON a.instrument = b.instrument AND a.n = b.n AND b.trading_day < a.trading_day GROUP BY 1, 2, 3)"


@query("g10_path_distance", f"WITH {DIST_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(earlier AS VARCHAR) AS earlier, round(rms, 6) AS rms, bars FROM ds")
def g10(spark, sf_dir):
    d = path_distances(opening_paths(weekday_bars(spark, sf_dir)))
    return d.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("earlier").cast("string").alias("earlier"), r6("rms").alias("rms"), "bars")


@query("g11_tolerance_ranks", f"""WITH {DIST_SQL}, s AS (SELECT *, round(greatest(0, 1 - rms / 60), 6) AS score FROM ds WHERE bars >= 4), r AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day ORDER BY score DESC, earlier DESC) AS rank FROM s)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, CAST(earlier AS VARCHAR) AS earlier, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def g11(spark, sf_dir):
    """Sessions ranked by similarity within a tolerance."""
    d = path_distances(opening_paths(weekday_bars(spark, sf_dir))).where("bars >= 4").withColumn("score", r6(F.greatest(F.lit(0.0), 1 - F.col("rms") / 60)))
    w = Window.partitionBy(*DAY).orderBy(F.desc("score"), F.desc("earlier"))
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("earlier").cast("string").alias("earlier"), "score", "rank")


@query("g12_tolerance_calibration", f"WITH {DIST_SQL} SELECT instrument, count(*) AS pairs, round(median(rms), 6) AS tolerance FROM ds GROUP BY 1")
def g12(spark, sf_dir):
    """The median pairwise distance of each instrument."""
    return path_distances(opening_paths(weekday_bars(spark, sf_dir))).groupBy("instrument").agg(F.count("*").alias("pairs"), r6(F.median("rms")).alias("tolerance"))


@query("g15_missed_windows", f"""WITH {WD_SQL}, x AS (SELECT instrument, trading_day, CAST(unnest(generate_series(0, 22)) AS BIGINT) AS hour FROM (SELECT DISTINCT instrument, trading_day FROM wd)),
m AS (SELECT x.* FROM x ANTI JOIN (SELECT instrument, trading_day, slot // 60 AS hour FROM wd) h USING (instrument, trading_day, hour)), f AS (SELECT *, hour - row_number() OVER (PARTITION BY instrument, trading_day ORDER BY hour) AS g FROM m)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, min(hour) AS first_hour, count(*) AS n FROM f GROUP BY instrument, trading_day, g""")
def g15(spark, sf_dir):
    """Windows that were expected and not emitted, as runs."""
    h = weekday_bars(spark, sf_dir).select(*DAY, F.floor(F.col("slot") / 60).alias("hour"))
    expected = h.select(*DAY).distinct().select(*DAY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(22).cast("long"))).alias("hour"))
    runs = islands(expected.join(h, [*DAY, "hour"], "left_anti"), DAY, "hour", 1)
    return runs.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day"), "run").agg(F.min("hour").alias("first_hour"), F.count("*").alias("n")).drop("run")


def session_items(bars: DataFrame) -> DataFrame:
    """What a session shows a reviewer: a label, or why it is unknown, for each target; a schedule that is not full; a contract roll; the quarter."""
    m = close_moves(bars)
    at = lambda c, b: direction(F.col(c) - F.col("o"), b)
    why = F.when(F.col("o").isNull(), "no opening bar").otherwise("no closing bar")
    closes = m.select(*DAY, F.inline(F.array(*[F.struct(F.lit(n).alias("target"), at(c, b).alias("label"), why.alias("reason")) for n, c, b in (("first_bar", "c0", 5), ("second_bar", "c1", 5), ("session_close", "c5", 10))])))
    labels = first_move(bars, 5.0, 5).select(*DAY, F.lit("first_move").alias("target"), "label", "reason").unionByName(closes)
    labels = labels.select(*DAY, F.when(F.col("label").isNotNull(), F.concat("target", F.lit("="), "label")).otherwise(F.concat("target", F.lit(":"), "reason")).alias("item"))
    days = m.select("instrument", F.col("trading_day").alias("day"))
    quarter = m.select(*DAY, F.concat(F.lit("quarter="), F.year("trading_day"), F.lit("Q"), F.quarter("trading_day")).alias("item"))
    odd = calendar(days).where("schedule <> 'full'").select(F.col("session_date").alias("trading_day"), F.concat(F.lit("schedule="), "schedule").alias("item"))
    bounds = days.groupBy(F.col("instrument").alias("symbol")).agg(F.trunc(F.min("day"), "quarter").alias("a"), F.max("day").alias("b"))
    months = bounds.select("symbol", F.explode(F.expr("sequence(a, add_months(b, 6), interval 3 months)")).alias("month"))
    chain = months.select("symbol", F.date_format("month", "yyyyMM").alias("contract"), F.date_add(F.next_day(F.date_sub(F.add_months("month", 2), 1), "Fri"), 14).alias("expiry"))
    front = front_contracts(days.withColumnRenamed("instrument", "symbol"), chain)
    rolled = front.withColumn("before", F.lag("contract").over(Window.partitionBy("symbol").orderBy("day"))).where("before <> contract").select(F.col("symbol").alias("instrument"), F.col("day").alias("trading_day"), F.lit("contract_roll").alias("item"))
    return labels.unionByName(quarter).unionByName(m.select(*DAY).join(odd, "trading_day")).unionByName(rolled)


def review_set(items: DataFrame, size: int = PICKS) -> DataFrame:
    """At most `size` sessions of each instrument, picked greedily: the most uncovered items, each weighing 1 / its sessions; then the widest gap to the picks; then the earlier date.

    Each pick is one pass over the items for all instruments; the driver holds only the picks and the items they cover.
    Weights are decimals of 30 places and their sums rounded to 20, so equal sums of fractions tie.
    """
    spark, items = items.sparkSession, items.select(*DAY, "item").distinct()
    seen = items.groupBy("instrument", "item").agg(F.count("*").alias("n"))
    weighed = items.join(seen, ["instrument", "item"]).select(*DAY, "item", (F.lit(1).cast("decimal(38,30)") / F.col("n")).alias("weight")).persist()
    picks, covered, days = [], {}, {}
    for k in range(1, size + 1):
        state = spark.createDataFrame([(i, days[i], sorted(covered[i])) for i in days], "instrument string, days array<date>, covered array<string>")
        left = weighed.join(F.broadcast(state), "instrument", "left").where(~F.coalesce(F.array_contains("days", F.col("trading_day")), F.lit(False)))  # a row an instrument
        fresh = ~F.coalesce(F.array_contains("covered", F.col("item")), F.lit(False))
        gains = left.groupBy(*DAY).agg(F.round(F.coalesce(F.sum(F.when(fresh, F.col("weight"))), F.lit(0).cast("decimal(38,30)")), 20).alias("gain"), F.array_sort(F.collect_set(F.when(fresh, F.col("item")))).alias("reasons"), F.first("days").alias("days"))
        gap = F.coalesce(F.array_min(F.transform("days", lambda d: F.abs(F.datediff("trading_day", d)))), F.lit(0))
        best = gains.groupBy("instrument").agg(F.max(F.struct("gain", gap.alias("gap"), (-F.unix_date("trading_day")).alias("early"), "trading_day", "reasons")).alias("x")).select("instrument", "x.trading_day", "x.reasons").collect()
        if not best:
            break
        for r in best:
            picks.append((r.instrument, k, r.trading_day, r.reasons))
            days.setdefault(r.instrument, []).append(r.trading_day)
            covered.setdefault(r.instrument, set()).update(r.reasons)
    weighed.unpersist()
    totals = spark.createDataFrame([(i, sorted(c)) for i, c in covered.items()], "instrument string, covered array<string>")
    totals = seen.groupBy("instrument").agg(F.collect_set("item").alias("every")).join(F.broadcast(totals), "instrument")  # a row an instrument
    totals = totals.select("instrument", F.size("every").alias("items"), F.size("covered").alias("covered"), F.array_sort(F.array_except("every", "covered")).alias("uncovered"))
    return spark.createDataFrame(picks, "instrument string, pick int, trading_day date, reasons array<string>").join(totals, "instrument")


@query("g17_review_set")
def g17(spark, sf_dir):
    """The sessions to review, what each covers first, and how many items are covered in the end."""
    return review_set(session_items(weekday_bars(spark, sf_dir))).withColumn("trading_day", F.col("trading_day").cast("string"))
