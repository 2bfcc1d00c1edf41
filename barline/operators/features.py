"""Groups J and K: minute-panel and session features, folds and audits, always from rows before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percentiles, r6
from ..plans import register
from ..sources import table
from .calendar import GRID_SQL, returns
from .coverage import EXPECTED
from .forecasts import LAB_SQL, labelled
from .indicators import DAY, RTH_SQL, daily_ranges, weekday_bars
from .store import day_ledger

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: The families of the feature table.
FAMILIES = ["rv", "ret", "age"]


def day_text() -> F.Column:
    return F.col("trading_day").cast("string").alias("trading_day")


def usual(df: DataFrame, value: str, keys: list[str], order: str = "trading_day", rows: int = 20, least: int = 5) -> DataFrame:
    """The mean of the `rows` rows before of each key, from `least` at least."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    return df.withColumn("usual", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def realised(spark, sf_dir, slots: int = 4) -> DataFrame:
    """The sum of squared returns of the last `slots` slots."""
    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(-(slots - 1), 0)
    return returns(spark, sf_dir).withColumn("rv", F.sum(F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))).over(w))


RV_SQL = f"""{GRID_SQL}, rv AS (SELECT *, sum(coalesce(r * r, 0)) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS 3 PRECEDING) AS rv FROM ret),
us AS (SELECT *, CASE WHEN count(rv) OVER w >= 5 THEN avg(rv) OVER w END AS usual FROM rv WINDOW w AS (PARTITION BY instrument, slot ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("j2_usual", f"WITH {RV_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(usual, 6) AS usual FROM us WHERE usual IS NOT NULL")
def j2(spark, sf_dir):
    return usual(realised(spark, sf_dir), "rv", ["instrument", "slot"]).where("usual IS NOT NULL").select("instrument", day_text(), "slot", r6("usual").alias("usual"))


@query("j3_realised_ratio", f"WITH {RV_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(ln(rv / usual), 6) AS ratio FROM us WHERE rv > 0 AND usual > 0")
def j3(spark, sf_dir):
    return usual(realised(spark, sf_dir), "rv", ["instrument", "slot"]).where("rv > 0 AND usual > 0").select("instrument", day_text(), "slot", r6(F.log(F.col("rv") / F.col("usual"))).alias("ratio"))


@query("j4_standardised_returns", f"""WITH {RV_SQL}, x AS (SELECT *, CASE WHEN last_price > 0 AND lag(last_price, 4) OVER w > 0 THEN ln(last_price) - ln(lag(last_price, 4) OVER w) END AS move FROM us WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot))
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(move / sqrt(usual), 6) AS z FROM x WHERE usual > 0 AND move IS NOT NULL""")
def j4(spark, sf_dir):
    before = F.lag("last_price", 4).over(Window.partitionBy(*DAY).orderBy("slot"))
    x = usual(realised(spark, sf_dir), "rv", ["instrument", "slot"]).withColumn("move", F.when((F.col("last_price") > 0) & (before > 0), F.log("last_price") - F.log(before)))
    return x.where("usual > 0 AND move IS NOT NULL").select("instrument", day_text(), "slot", r6(F.col("move") / F.sqrt("usual")).alias("z"))


@query("j5_change_since_close", f"""WITH {RTH_SQL}, pc AS (SELECT instrument, lead(trading_day) OVER (PARTITION BY instrument ORDER BY trading_day) AS trading_day, close AS prev_close FROM rd)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(wd.close - prev_close, 6) AS change FROM wd JOIN pc USING (instrument, trading_day)""")
def j5(spark, sf_dir):
    b = weekday_bars(spark, sf_dir)
    after = daily_ranges(b).select("instrument", F.lead("trading_day").over(Window.partitionBy("instrument").orderBy("trading_day")).alias("trading_day"), F.col("close").alias("prev_close"))
    return b.join(after, DAY).select("instrument", day_text(), "slot", r6(F.col("close") - F.col("prev_close")).alias("change"))


@query("j6_relative_volume", f"""WITH {GRID_SQL}, v AS (SELECT instrument, trading_day, slot, sum(volume) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS 3 PRECEDING) AS v FROM sb WHERE isodow(trading_day) <= 5),
u AS (SELECT *, CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END AS usual FROM v WINDOW w AS (PARTITION BY instrument, slot ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(ln((v + 1) / (usual + 1)), 6) AS volume FROM u WHERE usual IS NOT NULL""")
def j6(spark, sf_dir):
    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(-3, 0)
    v = weekday_bars(spark, sf_dir).withColumn("v", F.sum("volume").over(w))
    return usual(v, "v", ["instrument", "slot"]).where("usual IS NOT NULL").select("instrument", day_text(), "slot", r6(F.log((F.col("v") + 1) / (F.col("usual") + 1))).alias("volume"))


AUDIT_SQL = f"""{RV_SQL}, a AS (SELECT instrument, rv, abs(r) AS z FROM us WHERE r IS NOT NULL), k AS (SELECT instrument, (rank() OVER (PARTITION BY instrument ORDER BY rv) + (count(*) OVER (PARTITION BY instrument, rv) - 1) / 2.0) AS x,
  (rank() OVER (PARTITION BY instrument ORDER BY z) + (count(*) OVER (PARTITION BY instrument, z) - 1) / 2.0) AS y FROM a)"""


@query("j9_rank_correlation", f"WITH {AUDIT_SQL} SELECT instrument, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY 1")
def j9(spark, sf_dir):
    """Spearman's rho of a feature with the size of the move: average ranks, then their correlation."""
    a = realised(spark, sf_dir).where("r IS NOT NULL").select("instrument", "rv", F.abs("r").alias("z"))
    rank = lambda c: F.rank().over(Window.partitionBy("instrument").orderBy(c)) + (F.count("*").over(Window.partitionBy("instrument", c)) - 1) / 2.0
    return a.select("instrument", rank("rv").alias("x"), rank("z").alias("y")).groupBy("instrument").agg(F.count("*").alias("n"), r6(F.corr("x", "y")).alias("rho"))


@query("j12_peer_agreement", f"""WITH {GRID_SQL}, p AS (SELECT a.instrument, b.instrument AS peer, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.trading_day = b.trading_day AND a.slot = b.slot AND a.instrument < b.instrument WHERE a.r IS NOT NULL AND b.r IS NOT NULL)
SELECT instrument, peer, count(*) AS n, round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(corr(x, y), 6) AS correlation FROM p GROUP BY 1, 2""")
def j12(spark, sf_dir):
    """Co-movement of every pair of instruments on the same slots: an equi-join on (day, slot)."""
    r = returns(spark, sf_dir).where("r IS NOT NULL").select("instrument", "trading_day", "slot", "r")
    o = r.select(F.col("instrument").alias("peer"), "trading_day", "slot", F.col("r").alias("y"))
    p = r.join(o, ["trading_day", "slot"]).where("instrument < peer")
    return p.groupBy("instrument", "peer").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.signum("r") == F.signum("y"), 1.0).otherwise(0.0))).alias("agreement"), r6(F.corr("r", "y")).alias("correlation"))


@query("j13_rolling_beta", f"""WITH {GRID_SQL}, p AS (SELECT a.trading_day, sum(a.r * b.r) AS xy, sum(b.r * b.r) AS yy FROM ret a JOIN ret b ON a.trading_day = b.trading_day AND a.slot = b.slot WHERE a.instrument = 'click' AND b.instrument = 'view' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1)
SELECT CAST(trading_day AS VARCHAR) AS trading_day, round(sum(xy) OVER w / nullif(sum(yy) OVER w, 0), 6) AS beta FROM p WINDOW w AS (ORDER BY trading_day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def j13(spark, sf_dir):
    """The beta of one instrument to another over the ten sessions before."""
    r = returns(spark, sf_dir).where("r IS NOT NULL")
    one = lambda name, c: r.where(F.col("instrument") == name).select("trading_day", "slot", F.col("r").alias(c))
    s = one("click", "x").join(one("view", "y"), ["trading_day", "slot"]).groupBy("trading_day").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    w = Window.orderBy("trading_day").rowsBetween(-10, -1)  # a row a session
    return s.select(day_text(), r6(F.sum("xy").over(w) / F.nullif(F.sum("yy").over(w), F.lit(0.0))).alias("beta"))


@query("j14_tercile_buckets", f"""WITH {RV_SQL}, e AS (SELECT instrument, quantile_cont(rv, 1 / 3.0) AS a, quantile_cont(rv, 2 / 3.0) AS b FROM us GROUP BY 1)
SELECT instrument, CASE WHEN rv <= a THEN 'low' WHEN rv <= b THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM us JOIN e USING (instrument) GROUP BY 1, 2""")
def j14(spark, sf_dir):
    r = realised(spark, sf_dir).select("instrument", "rv")
    e = percentiles(r, ["instrument"], "rv", [1 / 3.0, 2 / 3.0])
    bucket = F.when(F.col("rv") <= F.col("q")[0], "low").when(F.col("rv") <= F.col("q")[1], "middle").otherwise("high")
    return r.join(e, "instrument").groupBy("instrument", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def daily_totals(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


TOTALS_SQL = "dt AS (SELECT o_orderpriority AS instrument, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"


@query("k3_prior_windows", f"""WITH {TOTALS_SQL}, x AS (SELECT *, count(*) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd, median(v) OVER w AS md FROM dt WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT instrument, CAST(day AS VARCHAR) AS day, round((v - m) / sd, 4) AS z, round(v / md, 4) AS ratio FROM x WHERE n = 60""")
def k3(spark, sf_dir):
    """A value against the mean, deviation and median of the 60 sessions before."""
    w = Window.partitionBy("instrument").orderBy("day").rowsBetween(-60, -1)
    x = daily_totals(spark, sf_dir).select("instrument", "day", "v", F.count("*").over(w).alias("n"), F.avg("v").over(w).alias("m"), F.stddev_samp("v").over(w).alias("sd"), F.percentile("v", F.lit(0.5)).over(w).alias("md")).where("n = 60")
    return x.select("instrument", F.col("day").cast("string").alias("day"), F.round((F.col("v") - F.col("m")) / F.col("sd"), 4).alias("z"), F.round(F.col("v") / F.col("md"), 4).alias("ratio"))


@query("k4_rolling_residual", f"""WITH {TOTALS_SQL}, p AS (SELECT a.day, a.v AS x, b.v AS y FROM dt a JOIN dt b ON a.day = b.day WHERE a.instrument = '1-URGENT' AND b.instrument = '2-HIGH'),
w AS (SELECT *, count(*) OVER q AS n, corr(x, y) OVER q AS c, covar_samp(x, y) OVER q / var_samp(y) OVER q AS beta FROM p WINDOW q AS (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, round(c, 4) AS correlation, round(beta, 4) AS beta FROM w WHERE n = 60""")
def k4(spark, sf_dir):
    d = daily_totals(spark, sf_dir)
    one = lambda name, c: d.where(F.col("instrument") == name).select("day", F.col("v").alias(c))
    w = Window.orderBy("day").rowsBetween(-60, -1)  # a row a day
    p = one("1-URGENT", "x").join(one("2-HIGH", "y"), "day").select("day", F.count("*").over(w).alias("n"), F.corr("x", "y").over(w).alias("c"), (F.covar_samp("x", "y").over(w) / F.var_samp("y").over(w)).alias("beta"))
    return p.where("n = 60").select(F.col("day").cast("string").alias("day"), F.round("c", 4).alias("correlation"), F.round("beta", 4).alias("beta"))


def walk_forward(days: DataFrame, folds: int, embargo: int) -> DataFrame:
    """Test blocks of equal length in order; each trains on all days before its block less the embargo. One row a (fold, day)."""
    w = Window.orderBy("day")  # a row a day
    o = days.distinct().select("day", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    o = o.withColumn("size", F.expr(f"n div {folds + 1}")).withColumn("block", F.least(F.expr("k div size"), F.lit(folds)))
    each = o.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    role = F.when(F.col("block") == F.col("fold"), "test").when(F.col("k") < F.col("fold") * F.col("size") - embargo, "train")
    return each.withColumn("role", role).where("role IS NOT NULL").select("fold", "role", "day")


FOLD_SQL = """fd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)), fb AS (SELECT *, n // 5 AS size, least(k // (n // 5), 4) AS block FROM fd),
ff AS (SELECT fold, day, CASE WHEN block = fold THEN 'test' WHEN k < fold * size - 2 THEN 'train' END AS role FROM fb, (SELECT unnest([1, 2, 3, 4]) AS fold))"""


@query("k13_walk_forward_folds", f"WITH {FOLD_SQL} SELECT fold, role, count(*) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM ff WHERE role IS NOT NULL GROUP BY 1, 2")
def k13(spark, sf_dir):
    f = walk_forward(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), 4, 2)
    return f.groupBy("fold", "role").agg(F.count("*").alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("k14_impute_standardise", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS x FROM documents), m AS (SELECT median(x) AS md FROM t WHERE doc_id % 2 = 0), f AS (SELECT avg(coalesce(x, md)) AS mu, stddev_samp(coalesce(x, md)) AS sd FROM t, m WHERE doc_id % 2 = 0)
SELECT doc_id, round((coalesce(x, md) - mu) / sd, 6) AS z FROM t, m, f WHERE doc_id % 2 = 1""")
def k14(spark, sf_dir):
    """Median and scale are fitted on the training rows and applied to the others; the fitted row is one row."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("x"))
    train = t.where("doc_id % 2 = 0")
    md = train.agg(F.median("x").alias("md"))
    fit = train.crossJoin(F.broadcast(md)).agg(F.first("md").alias("md"), F.avg(F.coalesce("x", "md")).alias("mu"), F.stddev_samp(F.coalesce("x", "md")).alias("sd"))
    return t.where("doc_id % 2 = 1").crossJoin(F.broadcast(fit)).select("doc_id", r6((F.coalesce("x", "md") - F.col("mu")) / F.col("sd")).alias("z"))


@query("k26_permuted_labels", f"""WITH {LAB_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS k, row_number() OVER (PARTITION BY instrument ORDER BY md5(instrument || trading_day), trading_day) AS j FROM (SELECT instrument, trading_day, min(label) AS label FROM lab GROUP BY 1, 2))
SELECT x.instrument, CAST(x.trading_day AS VARCHAR) AS trading_day, y.label FROM a x JOIN a y ON x.instrument = y.instrument AND x.k = y.j""")
def k26(spark, sf_dir):
    """Labels dealt anew among an instrument's sessions by a hash: a control with the same class shares."""
    s = labelled(spark, sf_dir).groupBy("instrument", "trading_day").agg(F.min("label").alias("label"))
    w = Window.partitionBy("instrument")
    a = s.select("*", F.row_number().over(w.orderBy("trading_day")).alias("k"), F.row_number().over(w.orderBy(F.md5(F.concat("instrument", F.col("trading_day").cast("string"))), "trading_day")).alias("j"))
    return a.select("instrument", "trading_day", "k").join(a.select("instrument", F.col("j").alias("k"), "label"), ["instrument", "k"]).select("instrument", day_text(), "label")


@query("k29_feature_profile", """SELECT name, count(*) AS n, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, round(quantile_cont(x, 0.01), 4) AS q01, round(quantile_cont(x, 0.99), 4) AS q99
FROM (SELECT unnest(['quantity', 'price', 'discount']) AS name, unnest([CAST(l_quantity AS DOUBLE), l_extendedprice, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_discount END]) AS x FROM lineitem) GROUP BY 1""")
def k29(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    long = l.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in (("quantity", F.col("l_quantity")), ("price", F.col("l_extendedprice")), ("discount", F.when(F.col("l_tax") <= 0.07, F.col("l_discount"))))])).alias("s")).select("s.*")
    q = percentiles(long, ["name"], "x", [0.01, 0.99])
    g = long.groupBy("name").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("x").isNull(), 1.0).otherwise(0.0))).alias("missing"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("sd")).join(q, "name", "left")
    return g.select("name", "n", "missing", "mean", "sd", F.round(F.col("q")[0], 4).alias("q01"), F.round(F.col("q")[1], 4).alias("q99"))


@query("k30_split_diagnostics", f"WITH {FOLD_SQL} SELECT a.fold, count(*) FILTER (b.day IS NOT NULL) AS shared_days, count(*) FILTER (a.day <= (SELECT max(day) FROM ff z WHERE z.fold = a.fold AND z.role = 'train')) AS order_violations FROM ff a LEFT JOIN ff b ON b.fold = a.fold AND b.day = a.day AND b.role = 'train' WHERE a.role = 'test' GROUP BY 1")
def k30(spark, sf_dir):
    """Test days that training shares or overtakes: both counts must be 0."""
    f = walk_forward(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), 4, 2)
    train = f.where("role = 'train'")
    last = train.groupBy("fold").agg(F.max("day").alias("last"))
    test = f.where("role = 'test'").join(train.select("fold", "day", F.lit(1).alias("s")), ["fold", "day"], "left").join(last, "fold", "left")
    return test.groupBy("fold").agg(F.count("s").alias("shared_days"), F.count_if(F.col("day") <= F.col("last")).alias("order_violations"))


@query("j1_point_in_time_panel", f"""WITH {GRID_SQL}, p AS (SELECT instrument, trading_day, slot, last_price, slot - last_value(CASE WHEN close IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS age FROM grid)
SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, last_price, CAST(age AS INT) AS age FROM p""")
def j1(spark, sf_dir):
    """The last value at each slot and how old it is."""
    from .calendar import dense_grid
    from ..sources import session_bars

    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    g = dense_grid(session_bars(spark, sf_dir))
    return g.select("instrument", day_text(), "slot", "last_price", (F.col("slot") - F.last(F.when(F.col("close").isNotNull(), F.col("slot")), ignorenulls=True).over(w)).alias("age"))


@query("j8_wide_features", f"""WITH {RV_SQL} SELECT CAST(trading_day AS VARCHAR) AS trading_day, slot, round(max(rv) FILTER (instrument = 'click'), 6) AS click, round(max(rv) FILTER (instrument = 'purchase'), 6) AS purchase, round(max(rv) FILTER (instrument = 'view'), 6) AS view FROM us GROUP BY 1, 2""")
def j8(spark, sf_dir):
    """Realised variance of three instruments as columns, as its SQL has them; j8_feature_table has all instruments and the mask."""
    p = realised(spark, sf_dir).where("slot IS NOT NULL").groupBy("trading_day", "slot").pivot("instrument", ["click", "purchase", "view"]).agg(F.max("rv"))
    return p.select(day_text(), "slot", *[r6(c).alias(c) for c in ("click", "purchase", "view")])


@query("k5_cross_agreement", f"""WITH {RTH_SQL}, m AS (SELECT trading_day, instrument, sign(close - prev) AS s, close - prev AS d FROM tr WHERE prev IS NOT NULL) SELECT CAST(trading_day AS VARCHAR) AS trading_day, count(*) AS n, round(abs(avg(s)), 6) AS agreement, round(stddev_pop(d), 6) AS dispersion, round(max(d) - min(d), 6) AS spread FROM m GROUP BY 1""")
def k5(spark, sf_dir):
    """How far the instruments of a day move together."""
    d = daily_ranges(weekday_bars(spark, sf_dir)).withColumn("d", F.col("close") - F.lag("close").over(Window.partitionBy("instrument").orderBy("trading_day"))).where("d IS NOT NULL")
    return d.groupBy(day_text()).agg(F.count("*").alias("n"), r6(F.abs(F.avg(F.signum("d")))).alias("agreement"), r6(F.stddev_pop("d")).alias("dispersion"), r6(F.max("d") - F.min("d")).alias("spread"))


@query("k7_missing_indicators", f"""WITH {RTH_SQL}, j AS (SELECT DISTINCT wd.instrument, wd.trading_day, tr.tr, tr.prev FROM wd LEFT JOIN tr USING (instrument, trading_day)) SELECT instrument, count(*) AS days, count(*) FILTER (tr IS NULL) AS range_missing, count(*) FILTER (prev IS NULL) AS prior_missing, count(*) FILTER (tr IS NULL OR prev IS NULL) AS abstained FROM j GROUP BY 1""")
def k7(spark, sf_dir):
    """Days that lack a feature, and days on which the model must abstain."""
    b = weekday_bars(spark, sf_dir)
    d = daily_ranges(b).withColumn("prev", F.lag("close").over(Window.partitionBy("instrument").orderBy("trading_day"))).select(*DAY, "tr", "prev")
    j = b.select(*DAY).distinct().join(d, DAY, "left")
    return j.groupBy("instrument").agg(F.count("*").alias("days"), F.count_if(F.col("tr").isNull()).alias("range_missing"), F.count_if(F.col("prev").isNull()).alias("prior_missing"), F.count_if(F.col("tr").isNull() | F.col("prev").isNull()).alias("abstained"))


@query("k11_label_coverage", f"WITH {LAB_SQL} SELECT instrument, label, count(*) AS n, round(avg(move / 10.0), 6) AS mean_move FROM lab GROUP BY 1, 2")
def k11(spark, sf_dir):
    """Moves in units of the threshold, and label counts."""
    return labelled(spark, sf_dir).groupBy("instrument", "label").agg(F.count("*").alias("n"), r6(F.avg(F.col("move") / 10.0)).alias("mean_move"))


def first_complete(bars: DataFrame) -> DataFrame:
    """The first session of each instrument that A5's ledger calls complete."""
    return day_ledger(bars, EXPECTED).where("status = 'COMPLETE' AND weekday(trading_day) < 5").groupBy("instrument").agg(F.min("trading_day").alias("start"))


def catalogue(instruments: list[str]) -> list[tuple[str, str, str]]:
    """(column, instrument, family) of the feature table, in the instruments' order."""
    return [(f"{i}.{f}", i, f) for i in sorted(instruments) for f in FAMILIES]


def feature_table(panel: DataFrame, start: DataFrame, instruments: list[str]) -> DataFrame:
    """A row a slot, a column for each catalogue entry; NULL before the instrument's first complete day, or where it has none."""
    masked = panel.join(F.broadcast(start), "instrument", "left")  # a row an instrument
    known = F.coalesce(F.col("trading_day") >= F.col("start"), F.lit(False))
    wide = masked.select("instrument", "trading_day", "slot", *[F.when(known, F.col(f)).alias(f) for f in FAMILIES])
    wide = wide.groupBy("trading_day", "slot").pivot("instrument", sorted(instruments)).agg(*[F.max(f).alias(f) for f in FAMILIES])
    return wide.select("trading_day", "slot", *[F.col(f"`{i}_{f}`").alias(name) for name, i, f in catalogue(instruments)])


def panel_features(spark, sf_dir) -> DataFrame:
    """The families of each instrument at each slot: J3's realised variance, B7's return, J1's age of the last price."""
    last = F.last(F.when(F.col("close").isNotNull(), F.col("slot")), ignorenulls=True).over(Window.partitionBy(*DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return realised(spark, sf_dir).select("instrument", "trading_day", "slot", "rv", F.col("r").alias("ret"), (F.col("slot") - last).alias("age"))


def instruments_of(spark, sf_dir) -> list[str]:
    """The few distinct instruments: the pivot's values, whatever their number."""
    return sorted(r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect() if r.event_type is not None)


TABLE_SQL = f"""{RV_SQL}, fc AS (SELECT instrument, min(trading_day) AS start FROM (SELECT instrument, trading_day FROM sb WHERE isodow(trading_day) <= 5 GROUP BY 1, 2 HAVING count(*) >= {EXPECTED} * 0.9) GROUP BY 1),
ag AS (SELECT rv.*, CAST(slot - last_value(CASE WHEN close IS NOT NULL THEN slot END IGNORE NULLS) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS INT) AS age FROM rv),
mk AS (SELECT ag.*, coalesce(trading_day >= start, false) AS ok FROM ag LEFT JOIN fc USING (instrument))"""
_WIDE = ", ".join(f"""round(max({v}) FILTER (ok AND instrument = '{i}'), 6) AS "{i}.{f}\"""" for i in ("click", "error", "purchase", "signup", "view") for f, v in zip(FAMILIES, ("rv", "r", "age"), strict=True))


@query("j8_feature_table", f"WITH {TABLE_SQL} SELECT CAST(trading_day AS VARCHAR) AS trading_day, slot, {_WIDE} FROM mk GROUP BY 1, 2")
def j8_table(spark, sf_dir):
    """All instruments' features as columns, masked before each one's first complete day."""
    from ..sources import session_bars

    names = instruments_of(spark, sf_dir)
    out = feature_table(panel_features(spark, sf_dir), first_complete(session_bars(spark, sf_dir)), names)
    return out.select(day_text(), "slot", *[F.round(F.col(f"`{name}`"), 6).alias(name) for name, _, _ in catalogue(names)])


@query("j8_catalogue", f"WITH {TABLE_SQL}, i AS (SELECT DISTINCT event_type AS instrument FROM events WHERE event_type IS NOT NULL) SELECT i.instrument || '.' || family AS name, i.instrument, family, CAST(start AS VARCHAR) AS first_complete FROM i CROSS JOIN (SELECT unnest(['rv', 'ret', 'age']) AS family) LEFT JOIN fc ON fc.instrument = i.instrument")
def j8_catalogue(spark, sf_dir):
    """A row for each column of the feature table, and from which day it is filled."""
    from ..sources import session_bars

    rows = spark.createDataFrame(catalogue(instruments_of(spark, sf_dir)), "name string, instrument string, family string")
    return rows.join(first_complete(session_bars(spark, sf_dir)), "instrument", "left").select("name", "instrument", "family", F.col("start").cast("string").alias("first_complete"))
