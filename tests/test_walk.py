"""Walk-forward: what is said about a session does not change when a later session does; shapes against a plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline import registry
from barline.operators import fan, forecasts
from barline.operators.indicators import weekday_bars

SF = "/root/testdata/sf0.01"
LAST = "2024-01-29"
NAMES = ["i4_group_multipliers", "i5_name_multipliers", "i9_walk_forward_fit", "i10_four_variants", "i13_quantile_shape", "i14_shape_interpolated", "i17_phase_scale", "i19_constant_scale", "g3_rubric_sets", "g18_batch_sets", "h9_pool_tuning", "h14_blend_weight", "k3_own_features", "k24_shrink_selection", "f3_opening_type", "e29_annotation"]


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """The event table with other prices from the last session on."""
    path = tmp_path_factory.mktemp("changed")
    events = spark.read.parquet(f"{SF}/events.parquet")
    later = F.col("ts") >= F.lit(f"{LAST} 00:00:00").cast("timestamp_ntz")
    events.withColumn("value", F.when(later, F.col("value") * 3 + 7).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_earlier_sessions_stay(spark, changed, name):
    q = registry.queries()[name]
    before = lambda sf: sorted((str(tuple(r)) for r in q(spark, sf).where(F.col("trading_day") < LAST).collect()))
    rows = before(SF)
    assert rows and rows == before(changed)


def test_forecasts_of_earlier_cases_stay(spark, changed):
    """A class forecast counts the cases of earlier sessions at its clock, so later ones cannot move it."""
    own = lambda sf: {tuple(r) for r in forecasts.outcomes(spark, sf).where(F.col("trading_day") < LAST).select("instrument", "trading_day", "slot", "label", "p").collect()}
    assert own(SF) == own(changed)


def test_shape_is_of_the_sessions_before(spark):
    z = {}
    for r in fan.scored_origins(spark, SF).collect():
        z.setdefault((r.instrument, r.h), {}).setdefault(r.trading_day, []).append(r.z)
    days = {}
    for r in weekday_bars(spark, SF).select("instrument", "trading_day").distinct().collect():
        days.setdefault(r.instrument, []).append(r.trading_day)
    got = {(r.instrument, r.trading_day, r.h): (r.n, r.q75, r.q95) for r in registry.queries()["i13_quantile_shape"](spark, SF).collect()}
    want = {}
    for (instrument, h), by_day in z.items():
        own = sorted(days[instrument])
        for k, d in enumerate(own):
            v = [x for e in own[max(0, k - 120) : k] for x in by_day.get(e, [])]
            if len(v) >= 40:
                q = np.quantile(v, [0.05, 0.25, 0.75, 0.95])
                want[instrument, str(d), h] = (len(v), (q[2] - q[1]) / 2, (q[3] - q[0]) / 2)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], atol=2e-6) for k in want)
