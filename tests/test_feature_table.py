import datetime as dt

import oracle

from barline import registry
from barline.operators import features

SF = "/root/testdata/sf0.01"


def test_all_instruments_against_sql(spark):
    con = oracle.database(SF)
    for name in ("j8_feature_table", "j8_catalogue"):
        oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)
    types = {t for (t,) in con.execute("SELECT DISTINCT event_type FROM events").fetchall()}
    got = registry.queries()["j8_feature_table"](spark, SF)
    assert {c.split(".")[0] for c in got.columns[2:]} == types and len(types) == 5
    assert all(got.where(f"`{t}.rv` IS NOT NULL").count() for t in types)


def test_mask(spark):
    day = [dt.date(2024, 1, d) for d in (8, 9, 10)]
    panel = spark.createDataFrame([(i, d, s, 1.0, 2.0, 0) for i in ("a", "b", "new type") for d in day for s in (0, 60)], "instrument string, trading_day date, slot int, rv double, ret double, age int")
    start = spark.createDataFrame([("a", day[1]), ("new type", day[0])], "instrument string, start date")
    got = {(r.trading_day, r.slot): r for r in features.feature_table(panel, start, ["new type", "b", "a"]).collect()}
    assert len(got) == 6
    for (d, _), r in got.items():
        assert (r["a.rv"], r["a.age"]) == ((1.0, 0) if d >= day[1] else (None, None)) and r["b.ret"] is None and r["new type.ret"] == 2.0
