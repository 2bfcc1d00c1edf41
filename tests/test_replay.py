import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.operators import scoring
from barline.operators.indicators import weekday_bars


def test_replay_finds_a_look_ahead_on_one_day(spark):
    bars = weekday_bars(spark, "/root/testdata/sf0.001").persist()

    def leaky(b):
        """The next day's bar, read on one late day only, beside the true values."""
        ahead = F.lead("close").over(Window.partitionBy("instrument").orderBy("bar_start"))
        own = b.withColumn("value", ahead).where(F.col("trading_day") == dt.date(2024, 1, 24))
        return own.select("instrument", "trading_day", "slot", F.lit("leak").alias("name"), "value")

    assert scoring.replay_mismatches(bars, leaky).count() > 0
    names = {r.name for r in scoring.replayed_values(bars).select("name").distinct().collect()}
    assert names == {"tr", "rv", "usual", "s", "level"}
    assert scoring.replay_mismatches(bars).count() == 0
