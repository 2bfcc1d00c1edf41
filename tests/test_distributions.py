"""Closed forms against numerical integrals of (F(x) - 1[x >= y])^2, member scores against all pairs."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from barline.operators import distributions as ds


def cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def integral(f, y, low, high):
    x = np.linspace(low, high, 120_001)
    return float(np.trapezoid((f(x) - (x >= y)) ** 2, x))


def test_closed_forms(spark):
    cases = [(y, m, s) for y in (0.0, 0.4, 3.0, 9.0) for m in (-4.0, -0.3, 0.0, 2.0) for s in (0.2, 1.0, 5.0)]
    rows = spark.createDataFrame(cases, "y double, m double, s double")
    got = rows.select("y", "m", "s", ds.crps_gaussian(F.col("y"), F.col("m"), F.col("s")).alias("g"), ds.crps_folded(F.col("y"), F.col("m"), F.col("s")).alias("f")).collect()
    for r in got:
        span = abs(r.m) + 9 * r.s + r.y + 1
        assert math.isclose(r.g, integral(lambda x, r=r: cdf((x - r.m) / r.s), r.y, -span, span), abs_tol=2e-3)
        assert math.isclose(r.f, integral(lambda x, r=r: cdf((x - r.m) / r.s) - cdf((-x - r.m) / r.s), r.y, 0, span), abs_tol=2e-3)


def test_members(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(rng.normal()), rng.normal(0, 2, n).tolist()) for k, n in enumerate((2, 3, 7, 20))] + [(9, 1.0, [2.0, 2.0, 2.0])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, y double, m array<double>").select("k", ds.crps_members(F.col("y"), F.col("m")).alias("c")).collect()}
    for k, y, m in rows:
        pairs = sum(abs(a - b) for a, b in itertools.permutations(m, 2))
        assert math.isclose(got[k], np.mean(np.abs(np.array(m) - y)) - pairs / (2 * len(m) * (len(m) - 1)), abs_tol=1e-12)


def test_arms_are_scored_on_the_same_cases(spark):
    members = spark.createDataFrame([("x", d, a, e) for d in (5, 6, 7) for a in "pq" for e in range(4) if (d, a) != (7, "q")], "instrument string, trading_day int, arm string, earlier int")
    moves = spark.createDataFrame([("x", d, None if d == 6 else float(d * d % 5)) for d in range(8)], "instrument string, trading_day int, move double")
    assert sorted((r.trading_day, r.arm) for r in ds.member_rows(members, moves).collect()) == [(5, "p"), (5, "q")]
