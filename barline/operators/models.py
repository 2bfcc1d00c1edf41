"""Group K, third part: models fitted by MLlib on earlier sessions, tuned on the last of them, and scored on later ones.

Sessions are numbered by instrument. Fold f tests the five sessions after number 5 f, learns from those before, less one session of
embargo, and tunes on the last three of these; there are as many folds as the sessions need, so each session after the first fold's
start is tested once. Imputation and scaling are fitted on training rows only. Linear models of all folds and penalties are fitted
together (fits.py); trees and the models made of several loop over folds and a small grid, never over rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import r6
from ..plans import Portable, register
from . import fits
from .judging import P as JUDGING
from .session_labels import DAY
from .structure import STORE

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
P = Portable(QUERIES, SQL, JUDGING)
#: The first fold that is tested; sessions of a fold, of the embargo before it, and of the tuning before that.
FIRST_FOLD, BLOCK, EMBARGO, INNER = 2, 5, 1, 3
FEATURES = ["log_level", "iv_rv", "last_z", "clock_sin", "clock_cos"]
CODE = {"bearish": 0.0, "bullish": 1.0, "neutral_band": 2.0}

P.view("model_rows", """u AS (SELECT instrument, trading_day, slot, CASE WHEN usual > 0 THEN r / sqrt(usual) END AS last_z FROM {us} x)
SELECT l.instrument, l.trading_day, t.d, l.slot, l.label, l.move, ln(x.level) AS log_level, x.iv_rv, u.last_z, sin(l.slot * pi() / 720) AS clock_sin, cos(l.slot * pi() / 720) AS clock_cos
FROM {lab} l JOIN {days} t ON t.instrument = l.instrument AND t.trading_day = l.trading_day LEFT JOIN {rel_level} x ON x.instrument = l.instrument AND x.trading_day = l.trading_day AND x.slot = l.slot LEFT JOIN u ON u.instrument = l.instrument AND u.trading_day = l.trading_day AND u.slot = l.slot""", STORE)
P.view("scale_rows", """SELECT f.instrument, f.trading_day, f.d, f.slot, f.h, f.y, f.z, f.var, ln(x.level) AS log_level, CASE WHEN f.phase = 'open' THEN 1e0 ELSE 0e0 END AS is_open, CASE WHEN f.phase = 'night' THEN 1e0 ELSE 0e0 END AS is_night, CASE WHEN release_ahead THEN 1e0 ELSE 0e0 END AS release
FROM {frames} f JOIN {rel_level} x ON x.instrument = f.instrument AND x.trading_day = f.trading_day AND x.slot = f.slot""", STORE)
SCALE = ["log_level", "is_open", "is_night", "release"]
P.query("k22_pooled_design", f"SELECT instrument, {DAY}, slot, log_level IS NULL OR iv_rv IS NULL AS has_missing, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}, CASE WHEN instrument = 'click' THEN round(0.5e0 * {c}, 6) + 0.0 ELSE 0e0 END AS own_{c}" for c in FEATURES[:3]) + " FROM {model_rows} m", "Pooled rows with the target instrument's own deviations as further, damped columns.")
P.query("k24_shrink_selection", """o AS (SELECT a.instrument, a.trading_day, a.d, a.h, m.shrink, avg(abs(abs(a.y) - 0.6744897501960817 * sqrt(a.var + m.shrink * (b.var - a.var)))) AS loss FROM {arms} a JOIN {arms} b ON b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot = a.slot AND b.h = a.h AND b.arm = 'short_run' CROSS JOIN (VALUES (0.0), (0.25), (0.5), (1.0)) m(shrink) WHERE a.arm = 'seasonal' GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT o.*, loss - max(CASE WHEN shrink = 0 THEN loss END) OVER (PARTITION BY instrument, trading_day, h) AS diff FROM o),
p AS (SELECT *, avg(diff) OVER w AS mean_diff, stddev_samp(diff) OVER w AS sd_diff, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY instrument, h, shrink ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, trading_day, h ORDER BY CASE WHEN shrink > 0 AND n >= 5 AND mean_diff + 1.645e0 * sd_diff / sqrt(n) < 0 THEN round(mean_diff, 9) ELSE 0e0 END, shrink) AS k FROM p)
SELECT instrument, CAST(trading_day AS STRING) AS trading_day, h, CAST(shrink AS DOUBLE) AS shrink, round(loss, 6) + 0.0 AS loss FROM r WHERE k = 1""", "How far to move towards the short level: the best option of earlier sessions, and none unless its interval lies below zero.")


def rows_of(spark, sf_dir: str, view: str) -> DataFrame:
    return P.relation(view, spark, sf_dir)


def folds(rows: DataFrame) -> list[int]:
    """The folds that cover all sessions from FIRST_FOLD's first test session on."""
    last = rows.agg(F.max("d")).first()[0] or 0
    return list(range(FIRST_FOLD, -(-int(last) // BLOCK)))


def windows(fold: int) -> dict[str, tuple[int, int]]:
    """The first and last session of each part of a fold."""
    last = fold * BLOCK - EMBARGO
    return {"train": (1, last), "inner": (1, last - INNER), "valid": (last - INNER + 1, last), "test": (fold * BLOCK + 1, (fold + 1) * BLOCK)}


def split(rows: DataFrame, fold: int) -> dict[str, DataFrame]:
    """Train, and of it inner and valid; test. Sessions of the embargo are in none."""
    return {name: rows.where(F.col("d").between(a, z)) for name, (a, z) in windows(fold).items()}


def fitted(estimator, features: list[str], rows: DataFrame):
    """Medians and scales of the training rows, then the estimator on column x. A feature without any value in these rows is left out."""
    seen = rows.agg(*[F.count(c).alias(c) for c in features]).first().asDict()
    used = [c for c in features if seen[c]]
    filled = [f"{c}_" for c in used]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=used, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), estimator]).fit(rows)


def coded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.when(F.col("label") == "bearish", 0.0).when(F.col("label") == "bullish", 1.0).otherwise(2.0))


def brier(scored: DataFrame) -> float | None:
    """The mean multiclass Brier of rows with p (array by code) and y; None without rows."""
    hit = [F.when(F.col("y") == k, 1.0).otherwise(0.0) for k in range(3)]
    return scored.agg(F.avg(reduce(lambda a, b: a + b, ((F.col("p")[k] - hit[k]) ** 2 for k in range(3))))).first()[0]


def logistic(reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=15, regParam=reg)


def probabilities(model, rows: DataFrame) -> DataFrame:
    """Rows with p, three probabilities; 0 for a class that was never seen in training."""
    p = vector_to_array("probability")
    return model.transform(rows).withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0))))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tuned(parts: dict, grid: list, make, predict, loss):
    """The grid value of least loss on the valid sessions (the first where there are none), and its model fitted on all of train; None without rows to learn from."""
    if parts["inner"].isEmpty() or parts["train"].select("label").distinct().count() < 2:
        return None, None, {}
    tried = {g: loss(predict(fitted(make(g), FEATURES, parts["inner"]), parts["valid"])) for g in grid}
    best = min(grid, key=lambda g: (tried[g] is None, tried[g]))
    return best, fitted(make(best), FEATURES, parts["train"]), tried


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


CLASS_SCHEMA = "fold int, instrument string, trading_day string, slot int, label string, penalty double, p_bearish double, p_bullish double, p_neutral double"


def least_loss(scored: DataFrame, loss, problems: list[tuple[int, float]], numbers: list[int], penalties: list[float]) -> dict[int, tuple[float, float | None]]:
    """By fold: the penalty of least mean loss on its tuning sessions (the first where there are none), and that loss. problems: (fold, penalty) of each model."""
    got = {r.model: r.loss for r in scored.groupBy("model").agg(F.avg(loss).alias("loss")).collect()}  # a row a model
    own = lambda f: {g: got.get(k) for k, (o, g) in enumerate(problems) if o == f}
    best = {f: min(penalties, key=lambda g: (own(f)[g] is None, own(f)[g])) for f in numbers}
    return {f: (g, own(f)[g]) for f, g in best.items()}


def walk_forward(rows: DataFrame, features: list[str], target: str, family: str, penalties: list[float], loss, classes: int = 1):
    """Tunes and fits all folds together: predictions of every fold's test sessions (column fold), the chosen penalties and losses, the weights."""
    numbers = folds(rows)
    part = {f: windows(f) for f in numbers}
    scales = fits.Scales(rows, features, [part[f][name][1] for f in numbers for name in ("inner", "train")])
    chosen = {f: (penalties[0], None) for f in numbers}
    if len(penalties) > 1 and numbers:
        tried = [(f, g) for f in numbers for g in penalties]
        inner = fits.fit(rows, features, target, [(part[f]["inner"][1], g) for f, g in tried], family, scales, classes)
        models = [(part[f]["inner"][1], *part[f]["valid"], w) for (f, _), w in zip(tried, inner, strict=True)]
        chosen = least_loss(fits.predict(rows.where(F.col(target).isNotNull()), features, models, family, scales), loss, tried, numbers, penalties)
    weights = fits.fit(rows, features, target, [(part[f]["train"][1], chosen[f][0]) for f in numbers], family, scales, classes)
    models = [(part[f]["train"][1], *part[f]["test"], w) for f, w in zip(numbers, weights, strict=True)]
    fold = F.element_at(F.array(*[F.lit(f) for f in numbers] or [F.lit(0)]), F.col("model") + 1)
    return fits.predict(rows, features, models, family, scales).withColumn("fold", fold).drop("model"), chosen, dict(zip(numbers, weights, strict=True)), scales


def brier_of(classes: int = 3):
    """The multiclass Brier of a row with p and y."""
    return reduce(lambda a, b: a + b, ((F.col("p")[k] - F.when(F.col("y") == k, 1.0).otherwise(0.0)) ** 2 for k in range(classes)))


def by_fold(values: dict[int, float]):
    """A number of each fold as a column."""
    return F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.lit(float(v)))])[F.col("fold")] if values else F.lit(None).cast("double")


@query("k15_multinomial_logistic")
def k15(spark, sf_dir):
    """Class probabilities of every session from the first fold on by multinomial logistic regression, its penalty tuned on the last training sessions."""
    rows = coded(rows_of(spark, sf_dir, "model_rows"))
    p, chosen, _, _ = walk_forward(rows, FEATURES, "y", "multinomial", [0.01, 0.1, 1.0], brier_of(), 3)
    return p.select("fold", "instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot"), "label", by_fold({f: g for f, (g, _) in chosen.items()}).alias("penalty"), *[r6(F.col("p")[k]).alias(n) for k, n in enumerate(("p_bearish", "p_bullish", "p_neutral"))])


@query("k16_boosted_classes")
def k16(spark, sf_dir):
    """Boosted trees, one class against the rest for every class, made to sum to one; the depth is tuned on the last training sessions."""
    rows, out = coded(rows_of(spark, sf_dir, "model_rows")), [empty(spark, CLASS_SCHEMA.replace("penalty double", "depth int"))]
    own = ["instrument", "trading_day", "slot"]

    def fit(part, depth):
        return [fitted(GBTClassifier(featuresCol="x", labelCol="t", maxIter=3, maxDepth=depth, seed=7), FEATURES, part.withColumn("t", F.when(F.col("y") == k, 1.0).otherwise(0.0))) for k in range(3)]

    def apply(models, part):
        for k, m in enumerate(models):
            part = m.transform(part).withColumn(f"q{k}", vector_to_array("probability")[1]).select(*part.columns, f"q{k}")
        total = F.col("q0") + F.col("q1") + F.col("q2")
        return part.withColumn("p", F.array(*[F.col(f"q{k}") / total for k in range(3)]))

    for f in folds(rows):
        parts = split(rows, f)
        if parts["inner"].isEmpty() or parts["train"].select("label").distinct().count() < 3:
            continue
        tried = {d: brier(apply(fit(parts["inner"], d), parts["valid"])) for d in (1, 3)}
        best = min(tried, key=lambda d: (tried[d] is None, tried[d]))
        p = apply(fit(parts["train"], best), parts["test"])
        out.append(p.select(F.lit(f).alias("fold"), *own[:1], F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot"), "label", F.lit(best).alias("depth"), *[r6(F.col("p")[k]).alias(n) for k, n in enumerate(("p_bearish", "p_bullish", "p_neutral"))]))
    return union(out)


@query("k17_poisson_scale")
def k17(spark, sf_dir):
    """A log-linear Poisson model of the squared error (at most 25) by horizon and fold: coefficients of the scaled features, and how far the test sessions' mean is met."""
    rows = rows_of(spark, sf_dir, "scale_rows").withColumn("z2", F.least(F.lit(25.0), F.col("z") * F.col("z")))
    found = []
    for h in (1, 4):
        p, _, weights, _ = walk_forward(rows.where(F.col("h") == h), SCALE, "z2", "poisson", [0.05], None)
        met = {r.fold: r.ratio for r in p.groupBy("fold").agg((F.avg("z2") / F.avg(F.col("p")[0])).alias("ratio")).collect()}  # a row a fold
        found += [(f, h, name, round(float(c), 6), None if met.get(f) is None else round(met[f], 6)) for f, w in weights.items() for name, c in zip(("intercept", *SCALE), w[0], strict=True)]
    return spark.createDataFrame(found, "fold int, h int, feature string, coefficient double, test_ratio double")


@query("k18_boosted_scale")
def k18(spark, sf_dir):
    """Boosted trees on the log of the squared error, normalised to mean one on the training rows, applied to the test sessions."""
    rows, out = rows_of(spark, sf_dir, "scale_rows").withColumn("t", F.log(F.col("z") * F.col("z") + 0.01)), [empty(spark, "h int, fold int, instrument string, trading_day string, slot int, scale double, z double")]
    for h, f in [(h, f) for h in (1, 4) for f in folds(rows)]:
        parts = split(rows.where(F.col("h") == h), f)
        if parts["train"].count() < 50:
            continue
        model = fitted(GBTRegressor(featuresCol="x", labelCol="t", maxIter=4, maxDepth=3, seed=7), SCALE, parts["train"])
        mean = model.transform(parts["train"]).agg(F.avg(F.exp("prediction"))).first()[0]
        out.append(model.transform(parts["test"]).select(F.lit(h).alias("h"), F.lit(f).alias("fold"), "instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot"), r6(F.sqrt(F.exp("prediction") / mean)).alias("scale"), r6("z").alias("z")))
    return union(out)


def mean_square(df: DataFrame, error) -> float | None:
    return df.agg(F.avg(error * error)).first()[0]


@query("k19_ridge_shift")
def k19(spark, sf_dir):
    """A ridge regression of the move by fold: the penalty is chosen on the valid sessions and the shift is used only where it beat no shift there."""
    rows = rows_of(spark, sf_dir, "model_rows").where("move IS NOT NULL")
    error = (F.col("p")[0] - F.col("move")) ** 2
    p, chosen, _, _ = walk_forward(rows, FEATURES, "move", "gaussian", [0.1, 1.0, 10.0], error)
    test = {r.fold: r for r in p.groupBy("fold").agg(F.avg(error).alias("shifted"), F.avg(F.col("move") ** 2).alias("plain")).collect()}  # a row a fold
    valid = rows.select("d", (F.col("move") ** 2).alias("m2")).groupBy("d").agg(F.sum("m2").alias("s"), F.count("*").alias("n")).collect()  # a row a session
    found = []
    for f, (penalty, tuned_loss) in chosen.items():
        a, z = windows(f)["valid"]
        own = [r for r in valid if a <= r.d <= z]
        if f in test and own and tuned_loss is not None:
            none = sum(r.s for r in own) / sum(r.n for r in own)
            used = tuned_loss < none
            found.append((f, penalty, used, round(tuned_loss, 4), round(none, 4), round(test[f].shifted if used else test[f].plain, 4), round(test[f].plain, 4)))
    return spark.createDataFrame(found, "fold int, alpha double, used boolean, valid_mse double, valid_plain double, test_mse double, test_plain double")


@query("k20_outside_and_side")
def k20(spark, sf_dir):
    """Outside the band or not, and on which side: two binary models whose product gives the classes, with the symmetric form beside it."""
    rows = rows_of(spark, sf_dir, "model_rows").withColumns({"outside": F.when(F.col("label") == "neutral_band", 0.0).otherwise(1.0), "up": F.when(F.col("label") == "bullish", 1.0).otherwise(0.0)})
    out = [empty(spark, "fold int, instrument string, trading_day string, slot int, label string, p_bullish double, p_bearish double, p_neutral double, p_symmetric double")]
    for f in folds(rows):
        parts = split(rows, f)
        moved = parts["train"].where("outside = 1")
        if parts["train"].select("outside").distinct().count() < 2 or moved.select("up").distinct().count() < 2:
            continue
        two = lambda y: LogisticRegression(featuresCol="x", labelCol=y, maxIter=15, regParam=0.1)
        a, b = fitted(two("outside"), FEATURES, parts["train"]), fitted(two("up"), FEATURES, moved)
        one = a.transform(parts["test"]).withColumn("o", vector_to_array("probability")[1]).select(*rows.columns, "o")
        both = b.transform(one).withColumn("u", vector_to_array("probability")[1])
        o, u = F.col("o"), F.col("u")
        out.append(both.select(F.lit(f).alias("fold"), "instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot"), "label", r6(o * u).alias("p_bullish"), r6(o * (1 - u)).alias("p_bearish"), r6(1 - o).alias("p_neutral"), r6(o / 2).alias("p_symmetric")))
    return union(out)


@query("k21_conditional_scale")
def k21(spark, sf_dir):
    """A ridge model of the log size of the move, and the share of its residuals beyond the band: tail masses on both sides."""
    rows, out = rows_of(spark, sf_dir, "model_rows").withColumn("t", F.log(F.abs("move") + 0.5)), [empty(spark, "fold int, instrument string, trading_day string, slot int, label string, scale double, p_bullish double, p_bearish double")]
    levels = [k / 100 for k in range(1, 100)]
    for f in folds(rows):
        parts = split(rows, f)
        if parts["train"].count() < 50:
            continue
        model = fitted(LinearRegression(featuresCol="x", labelCol="t", elasticNetParam=0.0, regParam=0.5, maxIter=10), FEATURES, parts["train"])
        e = model.transform(parts["train"]).select((F.col("move") / F.exp("prediction")).alias("e")).approxQuantile("e", levels, 0.001)  # 99 numbers
        s, table = F.exp("prediction"), F.array(*[F.lit(x) for x in e])
        mass = lambda test: F.size(F.filter(table, test)) / float(len(e))
        p = model.transform(parts["test"]).withColumn("bar", 10.0 / s)
        out.append(p.select(F.lit(f).alias("fold"), "instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot"), "label", r6(s).alias("scale"), r6(mass(lambda x: x > F.col("bar"))).alias("p_bullish"), r6(mass(lambda x: x < -F.col("bar"))).alias("p_bearish")))
    return union(out)


@query("k25_nested_selection")
def k25(spark, sf_dir):
    """Families and their settings by inner score within each fold, with a record of every trial and the chosen one's test score."""
    rows, found = coded(rows_of(spark, sf_dir, "model_rows")), []
    for f in folds(rows):
        parts = split(rows, f)
        if parts["inner"].isEmpty() or parts["valid"].isEmpty() or parts["train"].select("label").distinct().count() < 2:
            continue
        families = {"prior": None, **{f"logistic {g}": g for g in (0.01, 0.3)}}

        def predict(g, learn, apply):
            if g is None:
                c = {r.y: r["count"] for r in learn.groupBy("y").count().collect()}  # three classes
                n = sum(c.values())
                return apply.withColumn("p", F.array(*[F.lit((c.get(float(k), 0) + 1) / (n + 3)) for k in range(3)]))
            return probabilities(fitted(logistic(g), FEATURES, learn), apply)

        inner = {name: brier(predict(g, parts["inner"], parts["valid"])) for name, g in families.items()}
        best = min(inner, key=lambda name: (inner[name], name))
        test = brier(predict(families[best], parts["train"], parts["test"]))
        found += [(f, name, round(s, 6), name == best, round(test, 6) if name == best and test is not None else None) for name, s in inner.items()]
    return spark.createDataFrame(found, "fold int, family string, inner_brier double, chosen boolean, test_brier double")


@query("k27_batch_inference")
def k27(spark, sf_dir):
    """Every labelled window of the test sessions with each arm's probability, or the reason it abstains."""
    rows, out = coded(rows_of(spark, sf_dir, "model_rows")), [empty(spark, "arm string, fold int, instrument string, trading_day string, slot int, p_bullish double, reason string")]
    missing = F.when(F.col("log_level").isNull(), "no level").when(F.col("iv_rv").isNull(), "no variance ratio")
    for f in folds(rows):
        parts = split(rows, f)
        _, model, _ = tuned(parts, [0.1], logistic, probabilities, brier)
        own = [F.lit(f).alias("fold"), "instrument", F.col("trading_day").cast("string").alias("trading_day"), F.col("slot").cast("int").alias("slot")]
        if model:
            p = probabilities(model, parts["test"]).withColumn("reason", missing)
            out.append(p.select(F.lit("logistic").alias("arm"), *own, F.when(F.col("reason").isNull(), r6(F.col("p")[1])).alias("p_bullish"), "reason"))
        share = parts["train"].agg(((F.count_if(F.col("y") == 1) + 1) / (F.count("*") + 3)).alias("share"))
        out.append(parts["test"].join(F.broadcast(share)).select(F.lit("prior").alias("arm"), *own, r6("share").alias("p_bullish"), F.lit(None).cast("string").alias("reason")))  # one row is broadcast
    return union(out)


@query("k28_location_scale")
def k28(spark, sf_dir):
    """A log-variance regression calibrated to a mean of one on its training rows, and a ridge location chosen on the valid sessions, for every fold."""
    rows, found = rows_of(spark, sf_dir, "scale_rows").withColumn("t", F.log(F.col("y") * F.col("y") + 1e-6)), []
    key = ["instrument", "trading_day", "slot", "fold"]
    for h in (1, 4):
        own = rows.where(F.col("h") == h)
        place, chosen, _, _ = walk_forward(own, SCALE, "y", "gaussian", [0.1, 10.0], (F.col("p")[0] - F.col("y")) ** 2)
        size, _, weights, scales = walk_forward(own, SCALE, "t", "gaussian", [0.3], None)
        learnt = fits.predict(own, SCALE, [(windows(f)["train"][1], *windows(f)["train"], w) for f, w in weights.items()], "gaussian", scales)
        ratio = {r.model: r.ratio for r in learnt.groupBy("model").agg(F.avg(F.col("y") * F.col("y") / F.exp(F.col("p")[0])).alias("ratio")).collect()}  # a row a fold
        both = place.select(*key, "y", F.col("p")[0].alias("mu")).join(size.select(*key, F.col("p")[0].alias("lv")), key)
        met = both.groupBy("fold").agg(F.count("*").alias("n"), F.avg("mu").alias("mu"), F.avg((F.col("y") - F.col("mu")) ** 2 / F.exp("lv")).alias("z2")).collect()
        calibration = {f: ratio.get(k) for k, f in enumerate(weights)}
        found += [(r.fold, h, chosen[r.fold][0], round(calibration[r.fold], 6), r.n, round(r.mu, 6), round(r.z2 / calibration[r.fold], 6)) for r in met if calibration[r.fold]]
    return spark.createDataFrame(found, "fold int, h int, alpha double, calibration double, n long, mean_mu double, test_z2 double")


@query("k31_regularisation_path")
def k31(spark, sf_dir):
    """Score, spread of the probabilities and size of the coefficients for each penalty, on the last fold."""
    rows, found = coded(rows_of(spark, sf_dir, "model_rows")), []
    parts = split(rows, max(folds(rows), default=FIRST_FOLD))
    if parts["train"].select("label").distinct().count() > 1 and not parts["test"].isEmpty():
        for reg in (0.001, 0.03, 1.0):
            model = fitted(logistic(reg), FEATURES, parts["train"])
            p = probabilities(model, parts["test"])
            spread = p.agg(F.stddev_pop(F.col("p")[1])).first()[0]
            found.append((reg, round(brier(p), 6), round(spread, 6), round(float(abs(model.stages[-1].coefficientMatrix.toArray()).sum()), 6)))
    return spark.createDataFrame(found, "penalty double, brier double, spread double, coefficient_size double")
