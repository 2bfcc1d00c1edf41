"""The overnight structure by DataFrame code against its text, on sessions of every class, and what its plan holds at once."""

import datetime as dt
import random

import pytest

from barline.operators import judging, structure
from barline.plans import Portable

BAR = "instrument string, trading_day date, k int, open double, high double, low double, close double"


def sessions():
    """Trends, reversals, ranges and noise of 15 bars, some with missing bars, missing values or no movement at all."""
    r, rows = random.Random(3), []
    shapes = [lambda k: 0.0, lambda k: k, lambda k: -k, lambda k: abs(k - 6), lambda k: -abs(k - 6), lambda k: abs(k - 6) * (1.4 if k > 6 else 1), lambda k: 3 * (k % 4 in (1, 2)), lambda k: min(k, 7) - 0.9 * max(0, k - 7)]
    for n in range(480):
        shape, noise, scale = shapes[n % len(shapes)], r.choice([0.0, 0.6, 1.2, 3.0]), r.choice([1.0, 4.0])
        last = 100.0
        for k in range(15):
            close = round(100 + scale * shape(k) + r.gauss(0, noise), 1)
            high, low = max(last, close) + round(r.random() * noise, 1), min(last, close) - round(r.random() * noise, 1)
            if r.random() > (0.08 if n % 5 == 0 else 0):
                rows.append(("ab"[n % 2], dt.date(2024, 1, 1) + dt.timedelta(days=n), k, last, None if r.random() < 0.002 else high, low, close))
            last = close
    return rows + [(None, dt.date(2024, 1, 1), k, 1.0, 2.0, 0.5, 1.5) for k in range(15)]


@pytest.fixture(scope="module")
def chain(spark):
    """The view over hand-made bars; nothing of it is stored."""
    own = Portable({}, {}, structure.P)
    bars = spark.createDataFrame(sessions(), BAR)
    own.base("ob", lambda *_: bars)
    own.view("op", "SELECT instrument, trading_day, max(CASE WHEN k = 0 THEN open END) AS o, count(*) AS n, max(high) AS h, min(low) AS l, max(CASE WHEN k = 14 THEN close END) AS c, CAST(2.0 AS DECIMAL(32, 1)) AS t FROM {ob} x GROUP BY 1, 2")
    own.kept |= {"swings": (), "on_structure": ()}
    return own


def test_overnight_structure_equals_its_text(spark, chain):
    made = chain.relation("on_structure", spark, "none")
    text = chain.frame(chain.views["on_structure"], spark, "none")
    assert made.dtypes == text.dtypes
    rows = sorted(map(str, made.collect()))
    assert rows == sorted(map(str, text.collect())) and len(rows) == 480
    assert {x.label for x in made.select("label").distinct().collect()} == {"Uptrend", "Downtrend", "V-reversal", "Inverted-V", "Range", "Mixed", None}


def test_overnight_structure_is_one_grouping(spark, chain):
    """Beyond its inputs: no join, whose sides would each hold a buffer in the tasks of one stage, and one shuffle."""
    own = Portable({}, {}, chain)
    for name in ("op", "swings"):
        stored = chain.relation(name, spark, "none").localCheckpoint()
        own.base(name, lambda *_, rows=stored: rows)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = own.relation("on_structure", spark, "none")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Join" not in plan and plan.count("Exchange ") == 1


@pytest.mark.parametrize("later", [structure.P, judging.P], ids=["annotation", "similarity"])
def test_later_views_read_the_grouping(later):
    """What annotates sessions and compares them makes the structure by the one grouping too, also in a chain of its own."""
    assert Portable({}, {}, later, mark="own-").frames["on_structure"] is structure.on_structure


def test_averages_equal_their_text(spark, chain):
    """Also with missing bars and values, and at a first bar without a close."""
    own = Portable({}, {}, chain)
    own.kept |= {"lines": ()}
    bars = chain.relation("ob", spark, "none").unionByName(spark.createDataFrame([("c", dt.date(2024, 1, 1), k, 1.0, 2.0, 0.5, None if k in (0, 7) else 1.0 + k) for k in range(15)], BAR)).localCheckpoint()
    own.base("ob", lambda *_: bars)
    made, text = own.relation("lines", spark, "none"), own.frame(own.views["lines"], spark, "none")
    assert made.dtypes == text.dtypes
    rows = sorted(map(str, made.collect()))
    assert rows == sorted(map(str, text.collect())) and len(rows) > 480 * 14


def test_averages_are_one_sort(spark, chain):
    """No join of the bars to each of their averages: a task of one stage holds the buffer of a single sort."""
    own = Portable({}, {}, chain)
    own.kept |= {"lines": ()}
    bars = chain.relation("ob", spark, "none").localCheckpoint()
    own.base("ob", lambda *_: bars)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = own.relation("lines", spark, "none")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "Join" not in plan and plan.count("Exchange ") == 1 and plan.count(" Sort ") == 1
