"""Opening type, session type, first level, level outcomes and opening pattern against brute force on hand-made and random sessions."""

import datetime as dt
import random

import pytest

from barline.operators import session_labels as sl

DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 16, 17, 18, 19, 22, 23, 24, 25, 26, 29, 30)]


def bars_of(day, prices):
    """{slot: (open, high, low, close)} of a session day as events: a bar is four events."""
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=1)  # 18:00 in New York the evening before, in UTC
    for slot, values in prices.items():
        for k, v in enumerate(values):
            yield start + dt.timedelta(minutes=slot + k), v


def walk(r, level=100.0, size=4.0, slots=range(0, 1380, 60)):
    out, price = {}, level
    for s in slots:
        o = price
        c = round(o + r.gauss(0, size), 2)
        out[s] = (o, round(max(o, c) + abs(r.gauss(0, size / 2)), 2), round(min(o, c) - abs(r.gauss(0, size / 2)), 2), c)
        price = c
    return out


@pytest.fixture(scope="module")
def sessions():
    """Random sessions of several kinds; some lack bars."""
    made = {}
    for k, d in enumerate(DAYS):
        r = random.Random(k)
        made[d] = walk(r, 100.0, (1.5, 4.0, 9.0)[k % 3])
        if k % 7 == 6:
            del made[d][60 * r.randrange(1, 14)]
    made[DAYS[8]] = {s: (100 + k, 101.5 + k, 99.8 + k, 101 + k) for k, s in enumerate(range(0, 1380, 60))}  # a drive
    dip = [100, 98, 96, 90, 84, 80, 78, 84, 90, 98, 104, 110, 114, 118, 120, 120, 120, 120, 120, 120, 120, 120, 120]
    made[DAYS[10]] = {60 * k: (a, max(a, b) + 0.5, min(a, b) - 0.5, b) for k, (a, b) in enumerate(zip(dip, [*dip[1:], 120], strict=True))}  # a V
    saw = [100.0 if k == 14 else 100 + (0.4 if k % 2 else -0.4) for k in range(23)]
    made[DAYS[12]] = {60 * k: (100.0 if k == 0 else saw[k - 1], max(100 if k == 0 else saw[k - 1], saw[k]) + 0.2, min(100 if k == 0 else saw[k - 1], saw[k]) - 0.2, saw[k]) for k in range(23)}  # chop
    return made


@pytest.fixture(scope="module")
def table(spark, sessions, tmp_path_factory):
    path = tmp_path_factory.mktemp("sessions")
    rows = [(at, v) for d, prices in sessions.items() for at, v in bars_of(d, prices)]
    spark.createDataFrame([(k, at, 1, "view", float(v), "{}") for k, (at, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def facts(sessions):
    """Per day: opening bars, regular bars, thresholds and references, computed plainly."""
    days, out, ranges, close = sorted(sessions), {}, [], None
    for d in days:
        p = sessions[d]
        ob = {s // 60: p[s] for s in p if s < 900}
        ix = {(s - 960) // 60: p[s] for s in p if 960 <= s < 1320}
        a = sum(ranges[-5:]) / len(ranges[-5:]) if len(ranges) >= 3 else None
        prev = out[days[days.index(d) - 1]] if d != days[0] else None
        out[d] = {"ob": ob, "ix": ix, "a": a, "t": None if a is None else max(1.0, -(-a * 0.05 // 1)), "b": None if a is None else max(2.0, -(-a * 0.10 // 1)),
                  "ph": prev and prev["hi"], "pl": prev and prev["lo"], "pc": prev and prev["last"], "poh": prev and prev["onh"], "pol": prev and prev["onl"],
                  "hi": max(x[1] for x in ix.values()), "lo": min(x[2] for x in ix.values()), "last": ix[max(ix)][3], "onh": max(x[1] for x in ob.values()), "onl": min(x[2] for x in ob.values()), "ono": ob[min(ob)][0], "cut": ob[max(ob)][3]}
        hi, lo = out[d]["hi"], out[d]["lo"]
        ranges.append(max(hi, close) - min(lo, close) if close is not None else hi - lo)
        close = out[d]["last"]
    return out


def opening_type(f):
    ob, t = f["ob"], f["t"]
    if t is None:
        return None, "missing_threshold"
    if len(ob) < 15 or 0 not in ob:
        return None, "missing_bars"
    o, c = ob[0][0], ob[14][3]
    h, low = max(x[1] for x in ob.values()), min(x[2] for x in ob.values())

    def sweep(v, below):
        if v is None:
            return 0 if (low >= o - t if below else h <= o + t) else 1
        if v >= o if below else v <= o:
            return 0
        hit = [k for k in range(15) if (ob[k][2] <= v - t if below else ob[k][1] >= v + t)]
        return 2 if hit and any((ob[k][3] > v if below else ob[k][3] < v) for k in range(hit[0] + 1, 15)) else 0

    refs = [f["poh"], f["pol"], f["ph"], f["pl"]]
    for good, below, name in ((c > o + t, True, "sweep_low_rebound"), (c < o - t, False, "sweep_high_reverse")):
        if good and (best := max(sweep(v, below) for v in refs)):
            return (name, None) if best == 2 else (None, "missing_reference")
    if h > low and abs(c - o) >= 0.6 * (h - low):
        if c > o + t and o - low <= t:
            return "opening_drive_up", None
        if c < o - t and h - o <= t:
            return "opening_drive_down", None
    return ("two_sided_whipsaw" if h >= o + t and low <= o - t else "range"), None


def session_type(f):
    ix = f["ix"]
    if f["a"] is None:
        return None, "missing_threshold"
    if len(ix) < 6:
        return None, "missing_bars"
    o, c, hi, lo, a = ix[0][0], ix[5][3], f["hi"], f["lo"], f["a"]
    r, side = hi - lo, "up" if c - o > f["b"] else "down" if c - o < -f["b"] else "flat"
    if r == 0:
        return "range_day", None
    if (side == "up" and min(ix[0][2], ix[1][2]) <= o - a / 4) or (side == "down" and max(ix[0][1], ix[1][1]) >= o + a / 4):
        return "reversal_day", None
    if side == "up" and abs(c - o) >= 0.6 * r and c - lo >= 0.8 * r:
        return "bull_trend_day", None
    if side == "down" and abs(c - o) >= 0.6 * r and c - lo <= 0.2 * r:
        return "bear_trend_day", None
    if abs(c - o) < 0.35 * r:
        return ("two_sided_volatile_day" if r >= a else "range_day"), None
    return None, "uncovered"


def pattern(f):
    kind, why = opening_type(f)
    if kind is None:
        return None, why
    if kind.startswith("opening_drive"):
        return "drive_continuation", None
    if kind.startswith("sweep"):
        return "v_shape_reversal", None
    ob, t = f["ob"], f["t"]
    hs, ls, cs = ([ob[k][j] for k in range(15)] for j in (1, 2, 3))
    o, h, low, c = ob[0][0], max(hs), min(ls), cs[-1]
    r, ih, il = h - low, hs.index(max(hs)), ls.index(min(ls))
    near_top, near_bottom = [k for k in range(15) if hs[k] >= h - 0.1 * r], [k for k in range(15) if ls[k] <= low + 0.1 * r]
    double = any(j - i >= 4 and h - min(ls[i + 1 : j]) >= 0.3 * r and c < min(ls[i + 1 : j]) for i in near_top for j in near_top) or any(j - i >= 4 and max(hs[i + 1 : j]) - low >= 0.3 * r and c > max(hs[i + 1 : j]) for i in near_bottom for j in near_bottom)
    turns = lambda signs: sum(a != b for a, b in zip(signs, signs[1:]))
    crossings, reversals = turns([x > (h + low) / 2 for x in cs if x != (h + low) / 2]), turns([b > a for a, b in zip(cs, cs[1:]) if a != b])
    flat = abs(c - o) <= 0.2 * r
    rotation = flat and r >= 2 * t and crossings >= 3
    fits = {
        "v_shape_reversal": (3 <= il <= 11 and o - low >= 0.4 * r and c - low >= 0.8 * r and c > o + t) or (3 <= ih <= 11 and o - low <= 0.6 * r and c - low <= 0.2 * r and c < o - t),
        "fade_reversal": (ih <= 2 and o - low <= 0.6 * r and c - low <= r / 3 and il > ih and not any(k >= ih + 4 for k in near_top)) or (il <= 2 and o - low >= 0.4 * r and c - low >= 2 * r / 3 and ih > il and not any(k >= il + 4 for k in near_bottom)),
        "double_top_bottom": double,
        "spike_and_channel": (o - low <= 0.2 * r and max(hs[:3]) - low >= 0.5 * r and ih >= 12 and c - low >= 0.8 * r) or (o - low >= 0.8 * r and h - min(ls[:3]) >= 0.5 * r and il >= 12 and c - low <= 0.2 * r),
        "balanced_rotation": rotation, "choppy": flat and reversals >= 8 and not rotation,
    }
    found = [n for n, ok in fits.items() if ok]
    return (found[0], None) if len(found) == 1 else (None, "ambiguous_pattern" if found else "uncovered")


def level_outcome(f, level):
    ix = f["ix"]
    if level is None:
        return None, "missing_reference"
    if 0 not in ix:
        return None, "missing_bars"
    o = ix[0][0]
    if level == o:
        return None, "approach_unresolved"
    down = o > level
    if any(x[2] < level if down else x[1] > level for x in ix.values()):
        if not all(k in ix for k in (3, 4, 5)):
            return None, "missing_bars"
        last = [ix[k][3] for k in (3, 4, 5)]
        if all(x < level if down else x > level for x in last):
            return "break_acceptance", None
        return ("break_reclaim_acceptance" if all(x > level if down else x < level for x in last) else "break_without_acceptance"), None
    if len(ix) < 6:
        return None, "missing_bars"
    hit = [k for k in range(6) if (ix[k][2] <= level if down else ix[k][1] >= level)]
    if not hit:
        return "not_tested", None
    return ("test_rejection", None) if any((ix[k][3] > level if down else ix[k][3] < level) for k in range(hit[0], 6)) else (None, "no_rejection")


@pytest.mark.parametrize("name,rule", [("f3_opening_type", opening_type), ("f4_session_type", session_type), ("f16_opening_pattern", pattern)])
def test_labels_equal_brute_force(spark, table, sessions, name, rule):
    got = {r.trading_day: (r.label, r.reason) for r in sl.QUERIES[name](spark, table).collect()}
    want = {str(d): rule(f) for d, f in facts(sessions).items()}
    assert got == want
    assert len({x for x in want.values()}) >= 4


def test_level_outcomes_equal_brute_force(spark, table, sessions):
    got = {(r.trading_day, r.name): (r.label, r.reason) for r in sl.QUERIES["f6_five_level_outcomes"](spark, table).collect() if r.name != "first_level"}
    f = facts(sessions)
    want = {(str(d), n): level_outcome(x, x[k]) for d, x in f.items() for n, k in (("on_high", "onh"), ("on_low", "onl"), ("prev_high", "ph"), ("prev_low", "pl"))}
    assert got == want and len(set(want.values())) >= 4


def test_first_level_by_hand(spark, table, sessions):
    """The level reached first is inside the first bar that reaches any, and no earlier bar reaches one."""
    f = facts(sessions)
    for r in sl.QUERIES["f5_first_of_ten_levels"](spark, table).collect():
        x = f[dt.date.fromisoformat(r.trading_day)]
        if r.label:
            levels = [x["pc"], x["ph"], x["pl"], x["onh"], x["onl"], x["ono"], (x["onh"] + x["onl"]) / 2, x["cut"], x["ix"][0][0] + x["t"], x["ix"][0][0] - x["t"]]
            inside = lambda k: [v for v in levels if x["ix"][k][2] <= v <= x["ix"][k][1]]  # noqa: B023,E731
            assert not any(inside(k) for k in range(r.bar))
            assert abs(r.level - x["ix"][r.bar][0]) == pytest.approx(min(abs(v - x["ix"][r.bar][0]) for v in inside(r.bar)), abs=1e-6)


def test_hand_made_sessions(spark, table):
    got = {r.trading_day: r.label for r in sl.QUERIES["f16_opening_pattern"](spark, table).collect()}
    assert got[str(DAYS[8])] == "drive_continuation" and got[str(DAYS[10])] == "v_shape_reversal" and got[str(DAYS[12])] == "choppy"
