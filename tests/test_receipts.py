"""What was known when: reads of the receipt log against a plain replay of arrivals, and what one late receipt changes."""

import datetime as dt
import random

import pytest

from barline.operators import receipts

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, e, v, "{}" if k is None else f'{{"k": {k}}}') for i, (t, e, v, k) in enumerate(rows)], SCHEMA)


def days(n=9, seed=3, longest=90):
    """Events of weekdays from Monday 2024-01-08, delays up to `longest` minutes, some without one."""
    rng, rows = random.Random(seed), []
    for d in range(n):
        at = dt.datetime(2024, 1, 8) + dt.timedelta(days=d)
        for h in range(24):
            for _ in range(rng.choice([0, 1, 2, 4])):
                rows.append((at + dt.timedelta(hours=h, seconds=rng.randrange(3600)), rng.choice("ab"), float(rng.randrange(1, 60)), rng.choice([None, rng.randrange(longest)])))
    return rows


def replay(rows, known):
    """Bars by (instrument, trading day, slot) from the events that known(received, start of the session) lets pass."""
    bars = {}
    for i, (t, e, v, k) in enumerate(rows):
        start = t.replace(minute=0, second=0)
        ny = start - dt.timedelta(hours=5)
        day = ny.date() + dt.timedelta(days=ny.hour >= 18 and ny.weekday() != 5)
        slot = (ny.hour * 60 - 1080) % 1440
        if day.weekday() < 5 and known(t + dt.timedelta(minutes=k or 0), start - dt.timedelta(minutes=slot), slot):
            bars.setdefault((e, day, slot), []).append((t, i, v))
    return {k: (min(x)[2], max(v for *_, v in x), min(v for *_, v in x), max(x)[2], len(x)) for k, x in bars.items()}


@pytest.mark.parametrize("longest", [90, 2000])
def test_verified_inputs_against_replay(spark, longest):
    rows = days(longest=longest)
    final = replay(rows, lambda r, b, s: True)
    then = replay(rows, lambda r, b, s: r <= b + dt.timedelta(minutes=930))
    got = {(r.instrument, r.trading_day): r for r in receipts.verified_inputs(receipts.receipt_log(made(spark, rows))).collect()}
    want = {}
    for (e, d, s), bar in final.items():
        if s < 900:
            n = want.setdefault((e, d), [0, 0, 0])
            n[0] += 1
            n[1] += (e, d, s) not in then
            n[2] += (e, d, s) in then and then[e, d, s] != bar
    assert {k: [r.used, r.missing, r.differing] for k, r in got.items()} == want
    assert any(r.verified for r in got.values()) == (longest == 90) and any(not r.verified for r in got.values())


def test_deadlines_against_replay(spark):
    rows = days(longest=400)
    log = receipts.receipt_log(made(spark, rows))
    got = {(r.instrument, r.deadline, r.at_deadline, r.complete): (r.sessions, r.equal_rows) for r in receipts.deadline_counts(log).collect()}
    final, want = replay(rows, lambda r, b, s: True), {}
    for deadline in receipts.DEADLINES:
        then = replay(rows, lambda r, b, s, deadline=deadline: r <= b + dt.timedelta(minutes=deadline))

        def last(bars, e, d, deadline=deadline):
            s = max((s for (i, j, s) in bars if (i, j) == (e, d) and s + 60 <= deadline), default=None)
            name = "missing" if s is None else {60: "observed", 120: "delayed"}.get(deadline - s, "stale")
            return name, s, s is not None and bars[e, d, s][3]

        for e, d in {k[:2] for k in final}:
            a, b = last(then, e, d), last(final, e, d)
            n = want.setdefault((e, deadline, a[0], b[0]), [0, 0])
            n[0] += 1
            n[1] += a[1:] == b[1:]
    assert got == {k: tuple(v) for k, v in want.items()} and any(n != m for n, m in want.values())


def test_freshness_against_replay(spark):
    rows = days(longest=300)
    got = {(r.instrument, r.trading_day, r.mark): (r.seen, r.price, r.state) for r in receipts.freshness(receipts.receipt_log(made(spark, rows))).collect()}
    final, want = replay(rows, lambda r, b, s: True), {}
    for mark in receipts.FRESH_MARKS:
        then = replay(rows, lambda r, b, s, mark=mark: r <= b + dt.timedelta(minutes=mark))
        for e, d in {k[:2] for k in final}:
            s = max((s for i, j, s in then if (i, j) == (e, d) and s + 60 <= mark), default=None)
            want[e, d, mark] = (s, None if s is None else then[e, d, s][3], "absent" if s is None else "fresh" if mark - s - 60 <= 60 else "stale")
    assert got == want and {v[2] for v in got.values()} == {"absent", "fresh", "stale"}


def test_one_late_receipt_changes_the_verdict(spark):
    """The same events: received at once all is verified; one of them an hour after the freeze, or a day late, is not."""
    base = [(dt.datetime(2024, 1, 8, 23) + dt.timedelta(days=d, hours=h, minutes=5), "a", 1.0 + h, 1) for d in range(4) for h in range(12)]
    at = base.index((dt.datetime(2024, 1, 11, 3, 5), "a", 5.0, 1))
    verdict = lambda rows: {str(r.trading_day): (r.verified, r.missing, r.sessions_late) for r in receipts.verified_inputs(receipts.receipt_log(made(spark, rows))).collect()}
    assert all(v == (True, 0, 0) for v in verdict(base).values())
    late = [*base]
    late[at] = (*base[at][:3], 720)
    assert verdict(late)["2024-01-11"] == (False, 1, 0) and verdict(late)["2024-01-12"] == (True, 0, 0)
    late[at] = (*base[at][:3], 3000)
    assert verdict(late)["2024-01-11"] == (False, 1, 0) and verdict(late)["2024-01-12"] == (False, 0, 1)


def test_bounds_and_the_log_that_began_later(spark):
    rows = days()
    log = receipts.receipt_log(made(spark, rows))
    start = "2024-01-10 12:00:00"
    got = {(r.instrument, r.trading_day): r for r in receipts.receipt_bounds(log, start).collect()}
    floor = dt.datetime(2024, 1, 10, 12)
    times, began = {}, {}
    for t, e, _, k in rows:
        h = t.replace(minute=0, second=0)
        ny = h - dt.timedelta(hours=5)
        day, slot = ny.date() + dt.timedelta(days=ny.hour >= 18 and ny.weekday() != 5), (ny.hour * 60 - 1080) % 1440
        if day.weekday() < 5:
            times.setdefault((e, day), {}).setdefault(slot, []).append(t + dt.timedelta(minutes=k or 0))
            began[e, day] = h - dt.timedelta(minutes=slot)
    for (e, day), own in times.items():
        last = {s: max(x) for s, x in own.items()}
        inputs = {s: x for s, x in last.items() if s < 900}
        if inputs:
            r = got[e, day]
            bound = max(max(x, floor) if x >= floor else floor for x in inputs.values())
            earlier = sorted(d for i, d in times if i == e and d < day)[-receipts.POOL :]
            pool = max((max(floor, max(max(x) for x in times[e, d].values())) for d in earlier), default=None)
            cutoff = began[e, day] + dt.timedelta(minutes=900)
            assert (r.inputs, r.unknown, r.inputs_received_at, r.pool_received_at) == (len(inputs), sum(x < floor for x in inputs.values()), bound, pool)
            assert r.pit_status == ("verified" if pool and pool <= cutoff and bound <= cutoff + dt.timedelta(minutes=20) else "unverified")
    assert {r.pit_status for r in got.values()} == {"verified", "unverified"}


def test_newest_set_waits_for_its_bars(spark):
    """A bar received late holds back its own window and all later ones."""
    at = lambda h, m: dt.datetime(2024, 1, 10, h, m)
    rows = [(at(15 + n, 10), "a", 1.0, 100 if n == 1 else 5) for n in range(4)]  # hours from slot 960 on
    got = {r.mark: (r.newest, r.issued, r.live) for r in receipts.newest_sets(receipts.issues(receipts.receipt_log(made(spark, rows)))).collect()}
    # marks are half an hour after each hour's end; the second bar, of 16:10, is received at 17:50
    assert got == {1050: (1, 1, True), 1110: (1, 1, True), 1170: (3, 3, True), 1230: (4, 4, True)}
