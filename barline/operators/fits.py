"""Linear models of many walk-forward folds at once.

A problem is a pair (last session to learn from, penalty). All problems are fitted together: every pass over the rows gives each
problem's loss, gradient and curvature, summed within tasks and by Spark, and a damped Newton step is taken on the driver. What comes back
is a matrix of the number of features for each problem, whatever the rows; the number of passes does not grow with folds or penalties.

Features are filled with the median and scaled by the mean and deviation of a problem's own training rows: sums by session, added up to
the problem's last one, and medians of all sessions up to it. A feature without values, or that does not vary, has no weight.
The objective is the mean loss plus penalty / 2 times the squared weights of the scaled features; intercepts are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trailing_quantiles

PASSES, DONE = 40, 1e-8
EVER = 1_000_000


class Scales:
    """For each last session: median, mean and deviation of every feature (deviation 0: without weight)."""

    def __init__(self, rows: DataFrame, features: list[str], lasts: list[int], session: str = "d"):
        """The driver gets a row a session, and a row for each feature and last session."""
        sums = [x for c in features for x in (F.count(c), F.sum(c), F.sum(F.col(c) * F.col(c)))]
        got = np.array([[0.0 if v is None else float(v) for v in r] for r in rows.groupBy(session).agg(F.count("*"), *sums).collect()]).reshape(-1, 2 + 3 * len(features))
        values = rows.select(session, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("x")).select(session, "x.k", "x.v")
        asked = rows.sparkSession.createDataFrame([(i, int(a) + 1) for a in sorted(set(lasts)) for i in range(len(features))], f"k int, {session} int")
        medians = {(r.k, r[session] - 1): r.q[0] for r in trailing_quantiles(values.withColumn(session, F.col(session).cast("int")), asked, ["k"], session, "v", [0.5], EVER).collect()}
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for last in sorted(set(lasts)):
            n, *rest = got[got[:, 0] <= last][:, 1:].sum(axis=0)
            count, total, square = (np.array(rest[j::3]) for j in range(3))
            middle = np.array([medians.get((i, last), 0.0) for i in range(len(features))])
            mean = (total + (n - count) * middle) / max(n, 1)
            spread = np.sqrt(np.maximum(0, (square + (n - count) * middle**2) / max(n, 1) - mean**2))
            self.of[last] = middle, mean, np.where((count > 0) & (spread > 1e-9 * (1 + np.abs(mean))), spread, 0.0)

    def design(self, raw: np.ndarray, last: int) -> np.ndarray:
        """Rows of features (nan where missing) as a one and the scaled features."""
        middle, mean, spread = self.of[last]
        x = (np.where(np.isnan(raw), middle, raw) - mean) * np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        return np.concatenate([np.ones((len(raw), 1)), x], axis=1)


def softmax(eta: np.ndarray) -> np.ndarray:
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sums_of(family: str, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Count, loss, gradient and curvature of a problem's rows as one vector. weights: classes (or 1) by columns of x."""
    eta = x @ weights.T
    k, p = weights.shape
    if family == "gaussian":
        e = eta[:, 0] - y
        loss, gradient, curve = (e @ e) / 2, x.T @ e, x.T @ x
    elif family == "poisson":
        mu = np.exp(np.minimum(eta[:, 0], 30))
        loss, gradient, curve = (mu - y * eta[:, 0]).sum(), x.T @ (mu - y), x.T @ (mu[:, None] * x)
    else:
        q = softmax(eta)
        own = y.astype(int)
        loss = -np.log(np.maximum(q[np.arange(len(y)), own], 1e-300)).sum()
        miss = q - np.eye(k)[own]
        gradient = miss.T @ x
        curve = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(k):
                curve[a, :, b, :] = x.T @ ((q[:, a] * ((a == b) - q[:, b]))[:, None] * x)
    return np.concatenate([[len(y), loss], np.ravel(gradient), np.ravel(curve)])


def fit(rows: DataFrame, features: list[str], target: str, problems: list[tuple[int, float]], family: str, scales: Scales, classes: int = 1, session: str = "d") -> list[np.ndarray]:
    """The weights (classes by 1 + features) of each problem; rows without target are left out."""
    sc, shape = rows.sparkSession.sparkContext, (classes, 1 + len(features))
    size = shape[0] * shape[1]
    own = rows.where(F.col(target).isNotNull()).select(F.col(session).cast("int"), F.col(target).cast("double"), *[F.col(c).cast("double") for c in features])
    weights = [np.zeros(shape) for _ in problems]
    kept: list = [None] * len(problems)  # weights, loss and next step where the loss was least so far
    open_ = set(range(len(problems)))
    for _ in range(PASSES):
        shared = sc.broadcast([(k, problems[k][0], weights[k]) for k in sorted(open_)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                d, y, *raw = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(batch.num_columns))
                raw = np.stack(raw, axis=1)
                for last in {last for _, last, _ in shared.value}:
                    at = d <= last
                    x = scales.design(raw[at], last)
                    for k, other, w in shared.value:
                        if other == last:
                            total[k] = total.get(k, 0) + sums_of(family, x, y[at], w)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["problem", "sums"])

        parts = own.mapInArrow(run, "problem int, sums array<double>").select("problem", F.posexplode("sums").alias("i", "v")).groupBy("problem", "i").agg(F.sum("v").alias("v"))
        sums = {k: np.zeros(2 + size + size * size) for k in open_}
        for r in parts.collect():  # the numbers of a matrix for each problem
            sums[r.problem][r.i] = r.v
        for k in sorted(open_):
            n, penalty = max(sums[k][0], 1), problems[k][1]
            free = np.tile(np.r_[0.0, np.ones(shape[1] - 1)], shape[0])  # intercepts are not held back
            w = weights[k].ravel()
            loss = sums[k][1] / n + penalty / 2 * (free * w) @ w
            if kept[k] is None or loss <= kept[k][1] + 1e-13:
                gradient = sums[k][2 : 2 + size] / n + penalty * free * w
                curve = sums[k][2 + size :].reshape(size, size) / n + np.diag(penalty * free + 1e-10)
                kept[k] = w, loss, -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            else:
                kept[k] = kept[k][0], kept[k][1], kept[k][2] / 2
            weights[k] = (kept[k][0] + kept[k][2]).reshape(shape)
            if np.abs(kept[k][2]).max() < DONE:
                open_.discard(k)
        if not open_:
            break
    return weights


def predict(rows: DataFrame, features: list[str], models: list[tuple[int, int, int, np.ndarray]], family: str, scales: Scales, session: str = "d") -> DataFrame:
    """rows with model and p (the mean, or a probability for each class): each row once for every model whose sessions it lies in.

    models: (last session learnt from, first and last session to predict, weights).
    """
    shared, kept = rows.sparkSession.sparkContext.broadcast(models), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(batch.schema.get_field_index(session)).to_numpy(zero_copy_only=False).astype(float)
            raw = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            for k, (last, low, high, w) in enumerate(shared.value):
                at = np.flatnonzero((d >= low) & (d <= high))
                if len(at):
                    eta = scales.design(raw[at], last) @ w.T
                    p = softmax(eta) if family == "multinomial" else np.exp(np.minimum(eta, 30)) if family == "poisson" else eta
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([k] * len(at), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], names=[*kept, "model", "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, model int, p array<double>")
