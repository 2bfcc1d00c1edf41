"""Documents, their revisions, typed matrices and the registry on hand-made receipts."""

import datetime as dt

from pyspark.sql import functions as F

from barline.operators import archive, receipts


def log(spark, rows):
    made = spark.createDataFrame([(i, t, 1, e, v, f'{{"k": {k}}}') for i, (t, e, v, k) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    return receipts.receipt_log(made)


def at(h, m=0):
    return dt.datetime(2024, 1, 10, h, m)


def revisions(spark, rows):
    return [(r.mark, r.revision, r.changed) for r in archive.revisions(archive.documents(log(spark, rows))).orderBy("mark").collect()]


def test_only_changes_are_appended(spark):
    """Slot 720 is 11:00 UTC. What is received before it and never changes has one revision; a late event makes another."""
    early = [(at(8), "a", 10.0, 1), (at(9), "a", 12.0, 1)]
    assert revisions(spark, early) == [(720, 1, "first")]
    late_volume = [*early, (at(9, 5), "a", 12.0, 600)]  # received at 19:05: volume only
    assert revisions(spark, late_volume) == [(720, 1, "first"), (1380, 2, "measurements")]
    late_turn = [*early, (at(9, 5), "a", 9.0, 600)]  # the close falls below the open: direction and prices
    assert revisions(spark, late_turn) == [(720, 1, "first"), (1380, 2, "both")]
    very_late = [*early, (at(9, 5), "a", 9.0, 3000)]
    assert revisions(spark, very_late)[-1] == (archive.FINAL, 2, "both")


def test_many_fields_are_typed(spark):
    stored = archive.revisions(archive.documents(log(spark, [(at(8), "a", 10.25, 1), (at(9), "a", 12.5, 1), (at(10), "a", 11.0, 900)])))
    (r,) = archive.matrix(stored).collect()
    assert (r.bars, r.open, r.high, r.low, r.close, r.volume, r.net, r.range) == (3, 1025, 1250, 1025, 1100, 3, 75, 225)
    assert (r.direction, r.side, r.size, r.missing) == ("up", "lower", "narrow", 0)
    types = dict(archive.matrix(stored).dtypes)
    assert {types[n] for n in archive.MEASUREMENTS} == {"bigint"} and {types[n] for n in archive.LABELS} == {"string"}


def test_missing_and_mistyped_fields_are_null(spark):
    doc = F.parse_json(F.lit('{"measurements": {"bars": "many", "open": 5}, "labels": {"size": "wide"}}'))
    stored = spark.range(1).select(F.lit("a").alias("instrument"), F.lit(dt.date(2024, 1, 10)).alias("trading_day"), F.lit(1).alias("revision"), doc.alias("doc"))
    r = archive.matrix(stored).first()
    assert (r.bars, r.open, r.size, r.direction, r.missing) == (None, 5, "wide", None, 9)


def test_a_digest_does_not_follow_the_order_of_fields(spark):
    docs = spark.createDataFrame([('{"labels": {"direction": "up", "side": "upper", "size": "wide"}}',), ('{"labels": {"size": "wide", "direction": "up", "side": "upper"}}',)], "j string")
    assert docs.select(F.parse_json("j").alias("doc")).select(archive.digest("labels")).distinct().count() == 1


def test_registry(spark):
    rows = spark.createDataFrame([("n", 3, "b"), ("n", 1, "a"), ("n", 2, "a"), ("n", 4, "c"), ("n", 5, "b"), ("m", 9, None)], "name string, at int, content string")
    got = {r.name: (r.since, r.known, r.refused, r.refused_contents) for r in archive.registered(rows, "name", "at", ["content"]).collect()}
    assert got == {"n": (1, 1, 3, 2), "m": (9, 0, 0, 0)}
