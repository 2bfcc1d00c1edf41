"""Models of all folds at once against plain fits with numpy, and that every session is scored once."""

from collections import Counter

import numpy as np
import pytest

from barline import registry
from barline.operators import fits, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(1, 24):
        for _ in range(25):
            a, b = rng.normal(2, 3), rng.normal(0, 1)
            rows.append((d, None if rng.random() < 0.1 else float(a), float(b), None if d < 15 else 1.0 + d % 2, float(0.5 * a - b + rng.normal()), float(rng.poisson(np.exp(0.2 * b - 0.1 * (a - 2)))), float(rng.choice(3, p=np.exp([b, -b, 0]) / np.exp([b, -b, 0]).sum()))))
    return spark.createDataFrame(rows, "d int, a double, b double, late double, y double, n double, c double").repartition(5), rows


def scaled(rows, last):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows])
    own = np.array([r[0] for r in rows]) <= last
    out = np.ones((len(rows), 4))
    for k in range(3):
        there = x[own, k][~np.isnan(x[own, k])]
        filled = np.where(np.isnan(x[:, k]), np.median(there) if len(there) else 0, x[:, k])
        s = filled[own].std()
        out[:, k + 1] = (filled - filled[own].mean()) / s if len(there) and s > 1e-9 else 0
    return out, own


def descend(x, y, family, penalty, classes):
    """Plain gradient descent until the gradient vanishes."""
    w = np.zeros((classes, x.shape[1]))
    free = np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(60_000):
        eta = x @ w.T
        if family == "multinomial":
            e = np.exp(eta - eta.max(axis=1, keepdims=True))
            miss = e / e.sum(axis=1, keepdims=True) - np.eye(classes)[y.astype(int)]
        else:
            miss = (np.exp(eta) if family == "poisson" else eta) - y[:, None]
        g = miss.T @ x / len(x) + penalty * free * w
        w = w - 0.15 * g
        if np.abs(g).max() < 1e-10:
            break
    return w


@pytest.mark.parametrize("family,target,classes", [("gaussian", 4, 1), ("poisson", 5, 1), ("multinomial", 6, 3)])
def test_fits_equal_numpy(spark, table, family, target, classes):
    df, rows = table
    problems = [(last, g) for last in (9, 14, 19) for g in (0.05, 1.0)]
    scales = fits.Scales(df, ["a", "b", "late"], [last for last, _ in problems])
    got = fits.fit(df, ["a", "b", "late"], ("y", "n", "c")[target - 4], problems, family, scales, classes)
    y = np.array([r[target] for r in rows])
    for (last, g), w in zip(problems, got, strict=True):
        x, own = scaled(rows, last)
        want = descend(x[own], y[own], family, g, classes)
        if classes > 1:  # intercepts are free up to a common constant
            w, want = (v - np.r_[v[:, 0].mean(), np.zeros(3)] for v in (w, want))
        assert np.allclose(w, want, atol=2e-6)
    p = fits.predict(df, ["a", "b", "late"], [(14, 16, 20, got[2])], family, scales)
    assert p.count() == 125 and p.agg({"d": "min"}).first()[0] == 16


def test_folds_cover_all_sessions(spark):
    rows = spark.createDataFrame([(d,) for d in range(1, 48)], "d int")
    seen = Counter(r.d for f in models.folds(rows) for r in models.split(rows, f)["test"].collect())
    assert seen == Counter(range(11, 48))
    for f in models.folds(rows):
        w = models.windows(f)
        assert w["inner"][1] < w["valid"][0] <= w["valid"][1] == w["train"][1] < w["test"][0] - 1


def test_every_later_session_is_scored_once(spark):
    sf = "/root/testdata/sf0.001"
    rows = models.rows_of(spark, sf, "model_rows")
    want = Counter((r.instrument, str(r.trading_day), r.slot) for r in rows.where("d > 10").collect())
    got = registry.queries()["k15_multinomial_logistic"](spark, sf).collect()
    assert Counter((r.instrument, r.trading_day, r.slot) for r in got) == want and want
    assert all(abs(r.p_bearish + r.p_bullish + r.p_neutral - 1) < 1e-5 for r in got)
