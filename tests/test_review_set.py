import datetime as dt
import random
from collections import Counter
from fractions import Fraction

from barline import registry
from barline.operators import matching
from barline.sources import with_sessions


def brute_force(sessions, size):
    """The picks of one instrument's {day: items} and what stays uncovered, in whole fractions."""
    seen = Counter(i for items in sessions.values() for i in items)
    pool, picks, covered = dict(sessions), [], set()
    while pool and len(picks) < size:
        day = max(pool, key=lambda d: (sum((Fraction(1, seen[i]) for i in pool[d] - covered), Fraction(0)), min((abs((d - p).days) for p, _ in picks), default=0), -d.toordinal()))
        picks.append((day, sorted(pool[day] - covered)))
        covered |= pool.pop(day)
    return picks, len(seen), len(covered), sorted(set(seen) - covered)


def test_picks_equal_brute_force(spark):
    r = random.Random(5)
    sets = {name: {dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(200)): {f"i{int(r.random() ** 3 * 40)}" for _ in range(r.randint(1, 6))} for _ in range(n)} for name, n in (("a", 60), ("b", 4), ("c", 40))}
    rows = [(name, day, i) for name, sessions in sets.items() for day, items in sessions.items() for i in items]
    got = matching.review_set(spark.createDataFrame(rows + rows[:20], "instrument string, trading_day date, item string"), 8).collect()
    for name, sessions in sets.items():
        picks, n, covered, uncovered = brute_force(sessions, 8)
        own = sorted((x for x in got if x.instrument == name), key=lambda x: x.pick)
        assert [(x.trading_day, x.reasons) for x in own] == picks and [x.pick for x in own] == list(range(1, len(picks) + 1))
        assert {(x.items, x.covered, tuple(x.uncovered)) for x in own} == {(n, covered, tuple(uncovered))}


def test_equal_sums_of_fractions_tie(spark):
    """1/3 + 1/6 weighs as much as 1/2: the earlier day decides."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]
    sets = {d: set() for d in days}
    for item, n, at in (("three", 3, 0), ("six", 6, 0), ("two", 2, 5)):
        for k in range(n):
            sets[days[at if k == 0 else 6 + k]].add(item)
    sets = {d: items for d, items in sets.items() if items}
    rows = [("a", d, i) for d, items in sets.items() for i in items]
    got = matching.review_set(spark.createDataFrame(rows, "instrument string, trading_day date, item string"), 3).orderBy("pick").collect()
    assert [(x.trading_day, x.reasons) for x in got] == brute_force(sets, 3)[0]


def test_items_of_the_smallest_tables(spark):
    items = matching.session_items(matching.weekday_bars(spark, "/root/testdata/sf0.001")).collect()
    sets = {}
    for x in items:
        sets.setdefault(x.instrument, {}).setdefault(x.trading_day, set()).add(x.item)
    assert all(len([i for i in own if i.startswith(("first_move", "first_bar", "second_bar", "session_close"))]) == 4 and "quarter=2024Q1" in own for s in sets.values() for own in s.values())
    got = registry.queries()["g17_review_set"](spark, "/root/testdata/sf0.001").collect()
    for name, sessions in sets.items():
        want = brute_force(sessions, matching.PICKS)
        assert [(x.trading_day, x.reasons) for x in sorted((x for x in got if x.instrument == name), key=lambda x: x.pick)] == [(str(d), r) for d, r in want[0]]


def test_rolls_and_odd_days(spark):
    stamps = [dt.datetime(2024, 3, 6, 15), dt.datetime(2024, 3, 7, 15), dt.datetime(2024, 12, 24, 15)]
    bars = with_sessions(spark.createDataFrame([("x", s, 1.0, 1.0, 1.0, 1.0, 1) for s in stamps], "instrument string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long"))
    got = {(str(x.trading_day), x.item) for x in matching.session_items(bars).collect()}
    assert {x for x in got if x[1] == "contract_roll"} == {("2024-03-07", "contract_roll"), ("2024-12-24", "contract_roll")}
    assert {x for x in got if x[1].startswith("schedule")} == {("2024-12-24", "schedule=early_close")}
