"""Sessions joined to the twenty before them: the rows against brute force, and no plan that makes all pairs of sessions first."""

import datetime as dt
import random
import re

import pytest

from barline.operators import distributions, judging
from barline.plans import Portable

DAYS = 45


def rubric():
    """Sessions of two instruments, some fields missing or without a value."""
    r, rows = random.Random(11), []
    for name in "xy":
        for d in range(1, DAYS + 1):
            for field, weight in (("bias", 10), ("chop", 2), ("trend_bar", 8)):
                if r.random() > 0.1:
                    rows.append((name, dt.date(2024, 1, 1) + dt.timedelta(days=d), d, field, r.choice(["a", "b", None]), weight))
    return rows


@pytest.fixture(scope="module")
def chain(spark):
    own = Portable({}, {}, judging.P)
    fields = spark.createDataFrame(rubric(), "instrument string, trading_day date, d int, field string, value string, weight int").localCheckpoint()
    days = fields.select("instrument", "trading_day", "d").distinct().localCheckpoint()
    own.base("rubric", lambda *_: fields)
    own.base("days", lambda *_: days)
    own.base("paths", lambda *_: days.selectExpr("*", "explode(sequence(1, 6)) AS n").selectExpr("*", "CAST(d * n % 7 AS DOUBLE) AS net", "CAST(d % n AS DOUBLE) AS recent"))
    own.base("sets", lambda *_: days.selectExpr("instrument", "trading_day", "trading_day AS earlier"))
    own.base("batch", lambda *_: days.selectExpr("instrument", "trading_day", "trading_day AS earlier", "4 AS n"))
    own.base("stype", lambda *_: days.selectExpr("instrument", "trading_day", "'neutral_band' AS dir", "'range_day' AS label"))
    return own


@pytest.mark.parametrize("text", [judging.P.views["similar"], judging.P.views["apart"], distributions._MEMBERS], ids=["similar", "apart", "members"])
def test_offsets_are_part_of_the_join(spark, chain, text):
    """Every join of two sessions has the offset among its keys, so that its rows grow with the sessions, not with their square."""
    plan = chain.frame(text, spark, "none")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"\bJoin \w+, .*instrument", x)]
    assert joins and all("ahead" in x for x in joins), plan


def test_similarity_equals_brute_force(spark, chain):
    own = {}
    for name, day, d, field, value, weight in rubric():
        own.setdefault((name, d, day), {})[field] = (value, weight)
    wanted = []
    for (name, d, day), a in own.items():
        for (other, ed, earlier), e in own.items():
            if other == name and 1 <= d - ed <= 20 and (both := a.keys() & e.keys()):
                hit = sum(a[f][1] for f in both if a[f][0] is not None and a[f][0] == e[f][0])
                wanted.append((name, day, d, earlier, ed, hit, sum(a[f][1] for f in both if a[f][0] is not None and e[f][0] is not None)))
    assert sorted(map(tuple, chain.frame(chain.views["similar"], spark, "none").collect())) == sorted(wanted) and wanted
