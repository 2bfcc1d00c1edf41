"""A preview at the cutoff's minute is the chain; at an earlier one it is the chain over a store that lacks the later bars."""

import pytest
from pyspark.sql import functions as F

from barline.operators import preview
from barline.operators.judging import P as JUDGING

SF = "/root/testdata/sf0.01"


def rows(portable, text, spark, sf):
    return sorted(str(tuple(r)) for r in portable.frame(text, spark, sf).collect())


@pytest.mark.parametrize("text", ["SELECT instrument, trading_day, field, value, reason FROM {annotation} a", "SELECT instrument, trading_day, earlier, hit, comparable, rank, pool FROM {sets} s"])
def test_at_the_cutoff_it_is_the_chain(spark, text):
    own = rows(preview.chain_at(preview.CUTOFF), text, spark, SF)
    assert own and own == rows(JUDGING, text, spark, SF)


def test_an_earlier_minute_does_not_see_later_bars(spark, tmp_path):
    """One session's bars that end after the minute are taken out of the events: the chain then says what the preview said."""
    minute, day = 600, "2024-01-24"
    events = spark.read.parquet(f"{SF}/events.parquet")
    ny = F.col("ts") - F.expr("INTERVAL 5 HOURS")
    slot = F.pmod(F.hour(ny) * 60 - 1080, F.lit(1440))
    of_day = F.date_add(F.to_date(ny), F.when(F.hour(ny) >= 18, 1).otherwise(0)) == F.lit(day).cast("date")
    events.where(~(of_day & (slot < 900) & (slot + 60 > minute))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    # the class of event risk compares volumes with the mean of the whole table, which lacks these bars
    text = f"SELECT instrument, field, value, reason FROM {{annotation}} a WHERE trading_day = DATE '{day}' AND field <> 'event_risk'"
    own, without = rows(preview.chain_at(minute), text, spark, SF), rows(JUDGING, text, spark, str(tmp_path))
    assert own == without and own != rows(JUDGING, text, spark, SF)
