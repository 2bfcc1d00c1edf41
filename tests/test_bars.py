"""Bars of events: the first and last event of a bar at any id, and what a task of the first stage holds."""

import datetime as dt
import random

from barline.sources import bars_from_events

EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"


def events():
    """Many events of one microsecond, extreme and missing ids, missing times, types and values."""
    r, ids = random.Random(5), [None, -(2**63), 2**63 - 1, -1, 0, 1]
    used, rows = set(), []
    for n in range(4000):
        ts = None if n % 50 == 0 else dt.datetime(1969, 12, 31, 22) + dt.timedelta(hours=r.randrange(6), microseconds=r.choice([0, 1, 2, 3_599_999_999]))
        own = (r.choice(ids) if n % 2 else r.randrange(-(2**40), 2**40), ts, r.choice(["a", "b", None]))
        if own not in used:
            rows.append((*own, r.choice([None, float(n)])))
        used.add(own)
    return rows


def test_first_and_last_event(spark):
    found = {(b.instrument, b.bar_start): tuple(b)[2:] for b in bars_from_events(spark.createDataFrame(events(), EVENTS)).collect()}
    bars = {}
    for i, ts, kind, value in events():
        bars.setdefault((kind, ts and ts.replace(minute=0, second=0, microsecond=0)), []).append((ts or dt.datetime.min, i is not None, i or 0, value))
    assert found.keys() == bars.keys()
    for key, rows in bars.items():
        rows.sort(key=lambda x: x[:3])
        known = [x[3] for x in rows if x[3] is not None]
        assert found[key] == (rows[0][3], max(known, default=None), min(known, default=None), rows[-1][3], len(rows)), key


def test_events_are_not_sorted(spark):
    """A sort before the partial aggregates holds every event that a task reads, however few the bars are."""
    plan = bars_from_events(spark.createDataFrame(events(), EVENTS))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
