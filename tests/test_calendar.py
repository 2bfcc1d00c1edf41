"""The exchange's calendar by its rules against hand-checked years, expiries on holidays, and chains that lack contracts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.operators import calendar

#: Published full closures and early closes.
CLOSED = {
    1998: "01-01 01-19 02-16 04-10 05-25 07-03 09-07 11-26 12-25",
    2001: "01-01 01-15 02-19 04-13 05-28 07-04 09-03 09-11 09-12 09-13 09-14 11-22 12-25",
    2005: "01-17 02-21 03-25 05-30 07-04 09-05 11-24 12-26",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
    2025: "01-01 01-09 01-20 02-17 04-18 05-26 06-19 07-04 09-01 11-27 12-25",
    2026: "01-01 01-19 02-16 04-03 05-25 06-19 07-03 09-07 11-26 12-25",
    2027: "01-01 01-18 02-15 03-26 05-31 06-18 07-05 09-06 11-25 12-24",
}
EARLY = {2024: "07-03 11-29 12-24", 2025: "07-03 11-28 12-24", 2026: "11-27 12-24", 2027: "11-26"}


def year_of(spark, first, last):
    days = spark.createDataFrame([(dt.date.fromisoformat(first),), (dt.date.fromisoformat(last),)], "day date")
    return calendar.calendar(days)


@pytest.mark.parametrize("year", sorted(CLOSED))
def test_hand_checked_years(spark, year):
    rows = year_of(spark, f"{year}-01-01", f"{year}-12-31").collect()
    on = lambda s: " ".join(str(r.session_date)[5:] for r in sorted(rows) if r.schedule == s)
    assert on("closed") == CLOSED[year]
    if year in EARLY:
        assert on("early_close") == EARLY[year]
    assert [r.ordinal for r in sorted(rows) if r.schedule != "closed"] == list(range(1, sum(r.schedule != "closed" for r in rows) + 1))


def test_easter(spark):
    known = {1961: "04-02", 1981: "04-19", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2024: "03-31", 2038: "04-25", 2049: "04-18", 2076: "04-19"}
    got = spark.createDataFrame([(y,) for y in known], "y int").select("y", calendar.easter(F.col("y")).alias("d")).collect()
    assert {r.y: str(r.d)[5:] for r in got} == known


def test_times_follow_the_clock_of_new_york(spark):
    cal = calendar.with_times(year_of(spark, "2024-01-01", "2024-12-31"))
    got = {str(r.session_date): r for r in cal.where("session_date IN ('2024-03-08', '2024-03-11', '2024-07-03', '2024-12-25')").collect()}
    assert str(got["2024-03-08"].rth_open_at) == "2024-03-08 14:30:00" and str(got["2024-03-11"].rth_open_at) == "2024-03-11 13:30:00"
    assert str(got["2024-03-11"].overnight_start_at) == "2024-03-10 22:00:00" and str(got["2024-03-11"].cutoff_at) == "2024-03-11 13:29:00"
    assert str(got["2024-07-03"].scheduled_close_at) == "2024-07-03 17:00:00" and got["2024-12-25"].rth_open_at is None


def test_an_expiry_on_good_friday_is_a_day_earlier_and_rolls_by_sessions(spark):
    e = {str(r.month)[:7]: r for r in calendar.expiries(year_of(spark, "2008-01-01", "2008-12-31")).collect()}
    assert str(e["2008-03"].expiry) == "2008-03-20" and str(e["2008-03"].roll_date) == "2008-03-12"
    assert str(e["2008-06"].expiry) == "2008-06-20" and e["2008-05"].roll_date is None
    assert str(e["2008-09"].roll_date) == "2008-09-11"


def test_a_chain_that_lacks_the_predecessor_leaves_days_out(spark):
    """With June missing, a day in May is not filed under September; once June must have rolled off, September is taken."""
    made = lambda rows: spark.createDataFrame([("x", c, dt.date.fromisoformat(e)) for c, e in rows], "symbol string, contract string, expiry date")
    full = made([("x-03", "2024-03-15"), ("x-06", "2024-06-21"), ("x-09", "2024-09-20")])
    lacking = made([("x-03", "2024-03-15"), ("x-09", "2024-09-20")])
    days = spark.createDataFrame([("x", dt.date.fromisoformat(d)) for d in ("2024-01-15", "2024-03-06", "2024-03-07", "2024-05-10", "2024-06-18", "2024-06-19", "2024-09-11", "2024-09-12")], "symbol string, day date")
    front = lambda c: {str(r.day): r.contract for r in calendar.front_contracts(days, c).collect()}
    assert front(full) == {"2024-01-15": "x-03", "2024-03-06": "x-03", "2024-03-07": "x-06", "2024-05-10": "x-06", "2024-06-18": "x-09", "2024-06-19": "x-09", "2024-09-11": "x-09"}
    # June's expiry is taken as 2024-06-20 plus a week: it has rolled off from 2024-06-19 on
    assert front(lacking) == {"2024-01-15": "x-03", "2024-03-06": "x-03", "2024-06-19": "x-09", "2024-09-11": "x-09"}
    held, last = lacking.select("symbol", "contract"), lambda d: spark.createDataFrame([("x", dt.date.fromisoformat(d))], "symbol string, day date")
    assert [r.contract for r in calendar.missing_cycle_months(full, held, last("2024-05-01")).collect()] == ["x-06"]
    assert calendar.missing_cycle_months(full, held, last("2024-02-01")).count() == 0


def test_warm_up_is_counted_in_sessions(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 7, 8)), ("b", dt.date(2024, 1, 3))], "k string, first_day date")
    got = {r.k: (str(r.reference_day), r.warmup_from and str(r.warmup_from)) for r in calendar.with_warmup(rows, year_of(spark, "2024-01-01", "2024-12-31")).collect()}
    assert got == {"a": ("2024-07-05", "2024-06-28"), "b": ("2024-01-02", None)}  # July 4 is closed; the year has begun one session before
