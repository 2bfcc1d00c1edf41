"""Group E, second part: averages on the session's bars, the structure of a session before its cutoff, and what is assembled from it.

The window before the cutoff is the 15 bars of `session_labels`; swings, trends and averages are read from them. Averages are
closed-form weighted sums over the bars of one session, so no recursion is carried across rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Portable
from .calendar import GRID_SQL, returns
from .session_labels import DAY, KEY
from .session_labels import P as LABELS

QUERIES: dict = {}
SQL: dict = {}
P = Portable(QUERIES, SQL, LABELS)
P.base("grid", lambda spark, sf: returns(spark, sf), GRID_SQL, "ret")
STORE = ("events",)


#: Lengths of the long average, the triple average and its trigger, and of the event-clocked average, in bars of the window (hourly here).
LONG, TRIPLE, TRIGGER, EVENT = 10, 4, 6, 5
#: The middle of a day's slots: powers are taken from there, so that those of a 1,440-bar session stay within doubles for lengths from 3 on.
MIDDLE = 720


def ema(src: str, column: str, length: int) -> str:
    """A step for an exponential average of a column of src (instrument, trading_day, i counted from 0, column), seeded with the first value.

    A running sum of scaled values: linear in a session's bars.
    """
    return f"SELECT {KEY}, i, {average(column, length)} AS e FROM {src} x"


def average(column: str, length: int, order: str = "i") -> str:
    """The average's expression; order: any column that sorts a session's bars as i does."""
    a = 2.0 / (length + 1)
    scaled = f"{column} * CASE WHEN i = 0 THEN 1e0 ELSE {a!r} END * pow({1 - a!r}, {MIDDLE} - i)"
    return f"pow({1 - a!r}, i - {MIDDLE}) * sum({scaled}) OVER (PARTITION BY {KEY} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"


# Long average, triple average and its trigger over the bars before the cutoff
def lines(relation) -> DataFrame:
    """The view's rows with one shuffle and one sort: all averages run over the bars in the order of k, so none is joined to the bars again."""
    w = f"OVER (PARTITION BY {KEY} ORDER BY k"
    steps = [
        {"i": f"CAST(row_number() {w}) - 1 AS INT)"},
        {"long_ma": average("close", LONG, "k"), "e1": average("close", TRIPLE, "k"), "fast": average("close", TRIGGER, "k")},
        {"e2": average("e1", TRIPLE, "k")},
        {"e3": average("e2", TRIPLE, "k")},
        {"tema": "3 * e1 - 3 * e2 + e3"},
        {"trigger_line": f"avg(fast) {w} ROWS 2 PRECEDING)", "tema_line": f"avg(tema) {w} ROWS 2 PRECEDING)"},
    ]
    q = relation("ob").where("instrument IS NOT NULL AND trading_day IS NOT NULL")
    for made in steps:
        q = q.withColumns({name: F.expr(text) for name, text in made.items()})
    return q.select(*KEY.split(", "), "i", "k", "open", "high", "low", "close", "long_ma", "tema", "fast", "trigger_line", "tema_line")


P.view("lines", f"""b AS (SELECT {KEY}, k, open, high, low, close, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY k) - 1 AS INT) AS i FROM {{ob}} x),
lo AS ({ema('b', 'close', LONG)}), e1 AS ({ema('b', 'close', TRIPLE)}), e2 AS ({ema('e1', 'e', TRIPLE)}), e3 AS ({ema('e2', 'e', TRIPLE)}), t1 AS ({ema('b', 'close', TRIGGER)}),
m AS (SELECT b.*, lo.e AS long_ma, 3 * e1.e - 3 * e2.e + e3.e AS tema, t1.e AS fast FROM b JOIN lo USING ({KEY}, i) JOIN e1 USING ({KEY}, i) JOIN e2 USING ({KEY}, i) JOIN e3 USING ({KEY}, i) JOIN t1 USING ({KEY}, i))
SELECT *, avg(fast) OVER (PARTITION BY {KEY} ORDER BY i ROWS 2 PRECEDING) AS trigger_line, avg(tema) OVER (PARTITION BY {KEY} ORDER BY i ROWS 2 PRECEDING) AS tema_line FROM m""", STORE, lines)
P.query("e5_triple_average", f"SELECT instrument, {DAY}, k, round(long_ma, 6) + 0.0 AS long_ma, round(tema, 6) + 0.0 AS tema, round(tema_line, 6) + 0.0 AS tema_line, round(trigger_line, 6) + 0.0 AS trigger_line FROM {{lines}} x", "Long average, triple average and trigger with their three-bar means, bar by bar.")

# An average that moves only with new bars, carried over the grid
P.query("e6_event_clocked_average", f"""v AS (SELECT {KEY}, slot, close, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY slot) - 1 AS INT) AS i FROM {{grid}} g WHERE close IS NOT NULL), a AS ({ema('v', 'close', EVENT)}),
s AS (SELECT v.instrument, v.trading_day, v.slot, v.i, e FROM v JOIN a USING ({KEY}, i)),
g AS (SELECT {KEY}, slot, max(CASE WHEN close IS NOT NULL THEN slot END) OVER (PARTITION BY {KEY} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS seen FROM {{grid}} q)
SELECT g.instrument, CAST(g.trading_day AS STRING) AS trading_day, g.slot, CASE WHEN i >= 4 THEN round(e, 6) + 0.0 END AS average, g.slot - seen AS age FROM g LEFT JOIN s ON s.instrument = g.instrument AND s.trading_day = g.trading_day AND s.slot = g.seen""", "An exponential average that is updated by new bars only, masked during warm-up and carried between them.")

# Wilder's average of the last eleven two-bar ranges, if their buckets are complete and consecutive
P.query("e8_bucket_atr", f"""u AS (SELECT {KEY}, CAST(floor(slot / 120) AS INT) AS bucket, max(high) AS high, min(low) AS low, max_by(close, slot) AS close, count(*) AS bars FROM {{wd}} w WHERE slot < 840 GROUP BY 1, 2, 3),
r AS (SELECT *, lag(close) OVER v AS before, lag(bucket) OVER v AS bucket_before FROM u WINDOW v AS (PARTITION BY {KEY} ORDER BY bucket)),
q AS (SELECT *, greatest(high, before) - least(low, before) AS tr, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY bucket) AS INT) AS i FROM r WHERE before IS NOT NULL),
z AS (SELECT {KEY}, count(*) AS n, max(CASE WHEN bucket - bucket_before <> 1 OR bars < 2 THEN 1 ELSE 0 END) AS broken, sum(tr * CASE WHEN i <= 4 THEN 0.25 * pow(0.75, 2) ELSE 0.25 * pow(0.75, 6 - i) END) AS atr FROM q GROUP BY {KEY})
SELECT instrument, {DAY}, CASE WHEN n < 6 THEN NULL WHEN broken = 1 THEN NULL ELSE round(atr, 6) + 0.0 END AS atr, CASE WHEN n < 6 THEN 'insufficient_history' WHEN broken = 1 THEN 'incomplete_history' ELSE 'valid' END AS status FROM z""", "Wilder's average true range of two-bar buckets before the cutoff: period 4 over exactly six consecutive complete ranges.")

# Swing points of the window, with the bar that confirms them
P.view("swings", f"""w AS (SELECT {KEY}, k, high, low, lag(high, 1) OVER v AS h1, lag(high, 2) OVER v AS h2, lead(high, 1) OVER v AS g1, lead(high, 2) OVER v AS g2, lag(low, 1) OVER v AS l1, lag(low, 2) OVER v AS l2, lead(low, 1) OVER v AS m1, lead(low, 2) OVER v AS m2, lead(k, 2) OVER v AS confirmed
  FROM {{ob}} x WINDOW v AS (PARTITION BY {KEY} ORDER BY k))
SELECT {KEY}, k, 'high' AS kind, high AS price, confirmed FROM w WHERE high > greatest(h1, h2) AND high >= greatest(g1, g2) AND h2 IS NOT NULL AND g2 IS NOT NULL
UNION ALL SELECT {KEY}, k, 'low' AS kind, low AS price, confirmed FROM w WHERE low < least(l1, l2) AND low <= least(m1, m2) AND l2 IS NOT NULL AND m2 IS NOT NULL""", STORE)

# V-reversals need a swing before the extreme that is broken after it, then a confirming swing
def on_structure(relation) -> DataFrame:
    """The view's rows with one shuffle: a session's bars (its window's, 15 hourly ones) and swings become two short lists, from which all measures are read.

    The text joins and groups the same few rows a session ten times by the same keys; Spark puts all that into one stage, whose
    tasks hold a buffer for each join side, sort and grouping at once.
    """
    key = KEY.split(", ")
    parts = {"s": ("op", "o, c, h, l, t, n"), "x": ("ob", "k, high, low, close"), "w": ("swings", "k, kind, price")}
    rows = None
    for name, (source, columns) in parts.items():
        own = relation(source).select(*key, F.struct(*columns.split(", ")).alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    q = rows.where("instrument IS NOT NULL AND trading_day IS NOT NULL").groupBy(*key).agg(F.first("s", ignorenulls=True).alias("s"), F.array_sort(F.collect_list("x")).alias("x"), F.collect_list("w").alias("w"))
    q = q.where("s IS NOT NULL AND size(x) > 0").select(*key, "s.*", "x", "w")
    steps = [
        {"r": "h - l", "ih": _least("x", "x.high = h", "x.k"), "il": _least("x", "x.low = l", "x.k")},
        {"up_k": _most("w", "w.kind = 'high' AND w.k < il", "w.k"), "dn_k": _most("w", "w.kind = 'low' AND w.k < ih", "w.k"), "last_low_k": _most("w", "w.kind = 'low'", "w.k"), "last_high_k": _most("w", "w.kind = 'high'", "w.k")},
        {"up_level": _most("w", "w.kind = 'high' AND w.k = up_k", "w.price"), "dn_level": _most("w", "w.kind = 'low' AND w.k = dn_k", "w.price"), "last_low": _most("w", "w.kind = 'low' AND w.k = last_low_k", "w.price"), "last_high": _most("w", "w.kind = 'high' AND w.k = last_high_k", "w.price")},
        {"start_high": _most("x", "x.k <= il", "x.high"), "start_low": _least("x", "x.k <= ih", "x.low"), "up_break": _least("x", "x.k > il AND x.close > up_level", "x.k"), "dn_break": _least("x", "x.k > ih AND x.close < dn_level", "x.k")},
        {"up_confirmed": _most("w", "w.kind = 'low' AND w.k > up_break AND w.price > l", "1"), "dn_confirmed": _most("w", "w.kind = 'high' AND w.k > dn_break AND w.price < h", "1"),
         "zones": "filter(transform(x, x -> CASE WHEN x.high >= l + 0.75 * r AND NOT x.low <= l + 0.25 * r THEN 1 WHEN x.low <= l + 0.25 * r AND NOT x.high >= l + 0.75 * r THEN -1 END), z -> z IS NOT NULL)"},
        {"turns": "size(filter(zones, (z, i) -> i > 0 AND z <> get(zones, i - 1)))",
         "v_up": "il / 15.0 BETWEEN 0.15 AND 0.85 AND start_high - l >= 0.5 * r AND c - l >= 0.6 * (start_high - l) AND up_confirmed = 1",
         "v_down": "ih / 15.0 BETWEEN 0.15 AND 0.85 AND h - start_low >= 0.5 * r AND h - c >= 0.6 * (h - start_low) AND dn_confirmed = 1"},
        {"label": """CASE WHEN n < 15 THEN NULL WHEN r = 0 THEN 'Range' WHEN v_up AND v_down THEN 'Mixed' WHEN v_up THEN 'V-reversal' WHEN v_down THEN 'Inverted-V' WHEN c > o AND c - o >= 0.5 * r AND c - l >= 0.7 * r AND (last_low IS NULL OR c > last_low) THEN 'Uptrend'
          WHEN c < o AND o - c >= 0.5 * r AND c - l <= 0.3 * r AND (last_high IS NULL OR c < last_high) THEN 'Downtrend' WHEN abs(c - o) < 0.35 * r AND turns >= 2 THEN 'Range' ELSE 'Mixed' END""", "reason": "CASE WHEN n < 15 THEN 'incomplete' END"},
    ]
    for made in steps:
        q = q.withColumns({name: F.expr(text) for name, text in made.items()})
    return q.select(*key, "o", "c", "h", "l", "t", "n", "label", "reason")


def _most(rows: str, where: str, value: str) -> str:
    return f"array_max(transform({rows}, {rows} -> CASE WHEN {where} THEN {value} END))"


def _least(rows: str, where: str, value: str) -> str:
    return f"array_min(transform({rows}, {rows} -> CASE WHEN {where} THEN {value} END))"


P.view("on_structure", f"""e AS (SELECT {KEY}, o, c, h, l, t, n, h - l AS r, ih, il FROM (SELECT s.instrument, s.trading_day, s.o, s.c, s.h, s.l, s.t, s.n, min(CASE WHEN x.high = s.h THEN x.k END) AS ih, min(CASE WHEN x.low = s.l THEN x.k END) AS il FROM {{op}} s JOIN {{ob}} x ON x.instrument = s.instrument AND x.trading_day = s.trading_day GROUP BY 1, 2, 3, 4, 5, 6, 7, 8) q),
s1 AS (SELECT e.instrument, e.trading_day, max(CASE WHEN kind = 'high' AND k < il THEN k END) AS up_k, max(CASE WHEN kind = 'low' AND k < ih THEN k END) AS dn_k, max(CASE WHEN kind = 'low' THEN k END) AS last_low_k, max(CASE WHEN kind = 'high' THEN k END) AS last_high_k FROM e LEFT JOIN {{swings}} w ON w.instrument = e.instrument AND w.trading_day = e.trading_day GROUP BY 1, 2),
s2 AS (SELECT s1.instrument, s1.trading_day, up_k, dn_k, last_low_k, last_high_k, max(CASE WHEN kind = 'high' AND k = up_k THEN price END) AS up_level, max(CASE WHEN kind = 'low' AND k = dn_k THEN price END) AS dn_level, max(CASE WHEN kind = 'low' AND k = last_low_k THEN price END) AS last_low, max(CASE WHEN kind = 'high' AND k = last_high_k THEN price END) AS last_high FROM s1 LEFT JOIN {{swings}} w ON w.instrument = s1.instrument AND w.trading_day = s1.trading_day GROUP BY 1, 2, 3, 4, 5, 6),
b1 AS (SELECT e.instrument, e.trading_day, max(CASE WHEN x.k <= il THEN x.high END) AS start_high, min(CASE WHEN x.k <= ih THEN x.low END) AS start_low, min(CASE WHEN x.k > il AND x.close > up_level THEN x.k END) AS up_break, min(CASE WHEN x.k > ih AND x.close < dn_level THEN x.k END) AS dn_break
  FROM e JOIN s2 ON s2.instrument = e.instrument AND s2.trading_day = e.trading_day JOIN {{ob}} x ON x.instrument = e.instrument AND x.trading_day = e.trading_day GROUP BY 1, 2),
c1 AS (SELECT e.instrument, e.trading_day, max(CASE WHEN kind = 'low' AND k > up_break AND price > l THEN 1 ELSE 0 END) AS up_confirmed, max(CASE WHEN kind = 'high' AND k > dn_break AND price < h THEN 1 ELSE 0 END) AS dn_confirmed
  FROM e JOIN b1 ON b1.instrument = e.instrument AND b1.trading_day = e.trading_day LEFT JOIN {{swings}} w ON w.instrument = e.instrument AND w.trading_day = e.trading_day GROUP BY 1, 2),
z0 AS (SELECT x.instrument, x.trading_day, x.k, CASE WHEN x.high >= l + 0.75 * r AND NOT x.low <= l + 0.25 * r THEN 1 WHEN x.low <= l + 0.25 * r AND NOT x.high >= l + 0.75 * r THEN -1 END AS zone FROM e JOIN {{ob}} x ON x.instrument = e.instrument AND x.trading_day = e.trading_day),
z1 AS (SELECT *, lag(zone) OVER (PARTITION BY {KEY} ORDER BY k) AS before FROM z0 WHERE zone IS NOT NULL), z2 AS (SELECT {KEY}, count(CASE WHEN zone <> before THEN 1 END) AS turns FROM z1 GROUP BY {KEY}),
f AS (SELECT e.*, last_low, last_high, coalesce(turns, 0) AS turns, CASE WHEN il / 15.0 BETWEEN 0.15 AND 0.85 AND start_high - l >= 0.5 * r AND c - l >= 0.6 * (start_high - l) AND up_confirmed = 1 THEN 1 ELSE 0 END AS v_up,
  CASE WHEN ih / 15.0 BETWEEN 0.15 AND 0.85 AND h - start_low >= 0.5 * r AND h - c >= 0.6 * (h - start_low) AND dn_confirmed = 1 THEN 1 ELSE 0 END AS v_down
  FROM e JOIN s2 USING ({KEY}) JOIN b1 USING ({KEY}) JOIN c1 USING ({KEY}) LEFT JOIN z2 USING ({KEY}))
SELECT {KEY}, o, c, h, l, t, n, CASE WHEN n < 15 THEN NULL WHEN r = 0 THEN 'Range' WHEN v_up = 1 AND v_down = 1 THEN 'Mixed' WHEN v_up = 1 THEN 'V-reversal' WHEN v_down = 1 THEN 'Inverted-V' WHEN c > o AND c - o >= 0.5 * r AND c - l >= 0.7 * r AND (last_low IS NULL OR c > last_low) THEN 'Uptrend'
  WHEN c < o AND o - c >= 0.5 * r AND c - l <= 0.3 * r AND (last_high IS NULL OR c < last_high) THEN 'Downtrend' WHEN abs(c - o) < 0.35 * r AND turns >= 2 THEN 'Range' ELSE 'Mixed' END AS label, CASE WHEN n < 15 THEN 'incomplete' END AS reason FROM f""", STORE, on_structure)
P.query("e20_overnight_structure", f"SELECT instrument, {DAY}, label, reason FROM {{on_structure}} x", "Trend, range, V, inverted V or mixed, from extremes, swings and zones of the window before the cutoff.")

# E21 and E22
P.view("premarket", f"""g AS (SELECT {KEY}, max(CASE WHEN k = 12 THEN open END) AS ho, max(CASE WHEN k = 14 THEN close END) AS hc, max(CASE WHEN k >= 12 THEN high END) - min(CASE WHEN k >= 12 THEN low END) AS hr, max(CASE WHEN k = 6 THEN open END) AS co, max(CASE WHEN k = 11 THEN close END) AS cc,
  max(CASE WHEN k BETWEEN 6 AND 11 THEN high END) AS ch, min(CASE WHEN k BETWEEN 6 AND 11 THEN low END) AS cl, count(CASE WHEN k >= 4 THEN 1 END) AS bars FROM {{ob}} x GROUP BY {KEY}),
w AS (SELECT {KEY}, max_by(CASE WHEN kind = 'high' THEN price END, CASE WHEN kind = 'high' THEN k END) AS sh, max_by(CASE WHEN kind = 'low' THEN price END, CASE WHEN kind = 'low' THEN k END) AS sl FROM {{swings}} s WHERE k BETWEEN 6 AND 11 GROUP BY {KEY}),
d AS (SELECT g.*, s.t, s.label AS night, coalesce(sh, ch) AS top, coalesce(sl, cl) AS bottom, CASE WHEN abs(hc - ho) >= 2 * t AND abs(hc - ho) >= 0.5 * hr THEN sign(hc - ho) ELSE 0 END AS dh, CASE WHEN abs(cc - co) >= 2 * t AND abs(cc - co) >= 0.4 * (ch - cl) THEN sign(cc - co) ELSE 0 END AS dc FROM g JOIN {{on_structure}} s USING ({KEY}) LEFT JOIN w USING ({KEY})),
f AS (SELECT *, CASE WHEN dc <> 0 THEN dc WHEN night IN ('Uptrend', 'V-reversal') THEN 1 WHEN night IN ('Downtrend', 'Inverted-V') THEN -1 ELSE 0 END AS ctx FROM d)
SELECT {KEY}, CASE WHEN t IS NULL OR bars < 11 THEN NULL WHEN dh <> 0 AND ctx <> -dh THEN CASE WHEN dh > 0 THEN 'Bullish continuation' ELSE 'Bearish continuation' END WHEN dh > 0 THEN CASE WHEN hc > top THEN 'Bullish reversal' ELSE 'Mixed' END WHEN dh < 0 THEN CASE WHEN hc < bottom THEN 'Bearish reversal' ELSE 'Mixed' END
  WHEN abs(hc - ho) < 0.35 * hr OR abs(hc - ho) < 2 * t AND hr <= 4 * t THEN 'Range' ELSE 'Mixed' END AS label, CASE WHEN t IS NULL THEN 'missing_threshold' WHEN bars < 11 THEN 'incomplete' END AS reason FROM f""", STORE)
P.query("e21_premarket_pattern", f"SELECT instrument, {DAY}, label, reason FROM {{premarket}} x", "Continuation, reversal, range or mixed: the last three bars against the six before them and the overnight structure.")
P.view("short_term", f"""r AS (SELECT {KEY}, kind, price, row_number() OVER (PARTITION BY {KEY}, kind ORDER BY k DESC) AS q FROM {{swings}} s WHERE k >= 4),
p AS (SELECT {KEY}, max(CASE WHEN kind = 'high' AND q = 1 THEN price END) AS h1, max(CASE WHEN kind = 'high' AND q = 2 THEN price END) AS h2, max(CASE WHEN kind = 'low' AND q = 1 THEN price END) AS l1, max(CASE WHEN kind = 'low' AND q = 2 THEN price END) AS l2 FROM r GROUP BY {KEY})
SELECT s.instrument, s.trading_day, CASE WHEN n < 15 OR h2 IS NULL OR l2 IS NULL THEN NULL WHEN h1 > h2 AND l1 > l2 THEN 'Higher highs / Higher lows' WHEN h1 < h2 AND l1 < l2 THEN 'Lower highs / Lower lows' ELSE 'Mixed' END AS label,
  CASE WHEN n < 15 THEN 'incomplete' WHEN h2 IS NULL OR l2 IS NULL THEN 'too few swings' END AS reason FROM {{op}} s LEFT JOIN p ON p.instrument = s.instrument AND p.trading_day = s.trading_day""", STORE)
P.query("e22_short_term_structure", f"SELECT instrument, {DAY}, label, reason FROM {{short_term}} x", "The last two swing highs and lows.")

# Trend by efficiency over the last bars of two bar sizes
P.view("trends", f"""b AS (SELECT {KEY}, 'bar' AS size, k AS j, open, high, low, close, 1 AS full_bars, 1 AS bars FROM {{ob}} x WHERE k >= 3 UNION ALL
  SELECT {KEY}, 'triple' AS size, CAST(floor(k / 3) AS INT) AS j, min_by(open, k) AS open, max(high) AS high, min(low) AS low, max_by(close, k) AS close, 3 AS full_bars, CAST(count(*) AS INT) AS bars FROM {{ob}} y GROUP BY 1, 2, 3, CAST(floor(k / 3) AS INT)),
g AS (SELECT {KEY}, size, count(CASE WHEN bars = full_bars THEN 1 END) AS whole, max(CASE size WHEN 'bar' THEN 12 ELSE 5 END) AS wanted, max_by(close, j) - min_by(open, j) AS net, max(high) - min(low) AS r FROM b GROUP BY {KEY}, size)
SELECT {KEY}, size, CASE WHEN whole < wanted THEN NULL WHEN r = 0 OR abs(net) < 0.3 * r THEN 'Neutral' WHEN abs(net) >= 0.6 * r THEN CASE WHEN net > 0 THEN 'Bullish' ELSE 'Bearish' END ELSE CASE WHEN net > 0 THEN 'Neutral-bullish' ELSE 'Neutral-bearish' END END AS label, CASE WHEN whole < wanted THEN 'incomplete' END AS reason FROM g""", STORE)
P.query("e23_trends", f"SELECT instrument, {DAY}, size, label, reason FROM {{trends}} x", "Trend by efficiency over the last twelve bars and the last five buckets of three bars.")

# Price against the long average, its slope, alignment of the fast ones, chop
P.view("averages", f"""w AS (SELECT *, close - long_ma AS d1, tema - trigger_line AS d2, close - trigger_line AS d3, lag(high) OVER v AS ph, lag(low) OVER v AS pl FROM {{lines}} x WINDOW v AS (PARTITION BY {KEY} ORDER BY i)),
s AS (SELECT {KEY}, k, kind, CASE WHEN d > 0 THEN 1 ELSE -1 END AS side FROM (SELECT {KEY}, k, 'long' AS kind, d1 AS d FROM w WHERE k >= 8 UNION ALL SELECT {KEY}, k, 'fast' AS kind, d2 AS d FROM w WHERE k >= 8 UNION ALL SELECT {KEY}, k, 'trigger' AS kind, d3 AS d FROM w WHERE k >= 8) q WHERE d <> 0),
t AS (SELECT *, lag(side) OVER (PARTITION BY {KEY}, kind ORDER BY k) AS before FROM s),
c AS (SELECT {KEY}, count(CASE WHEN kind = 'long' AND side <> before THEN 1 END) AS long_x, count(CASE WHEN kind = 'fast' AND side <> before THEN 1 END) AS fast_x, max(CASE WHEN kind = 'fast' AND side <> before THEN k END) AS fast_last, count(CASE WHEN kind = 'trigger' AND side <> before THEN 1 END) AS trig_x FROM t GROUP BY {KEY}),
g AS (SELECT {KEY}, max(CASE WHEN k = 14 THEN d1 END) AS d, max(CASE WHEN k = 14 THEN d2 END) AS f, max(CASE WHEN k = 14 THEN long_ma END) - max(CASE WHEN k = 7 THEN long_ma END) AS slope, count(CASE WHEN k >= 7 THEN 1 END) AS bars,
  avg(CASE WHEN k >= 9 AND high > low THEN CASE WHEN greatest(0.0, least(high, ph) - greatest(low, pl)) >= 0.7 * (high - low) THEN 1.0 ELSE 0.0 END END) AS contained, avg(CASE WHEN k >= 8 AND high > low THEN CASE WHEN high - greatest(open, close) + least(open, close) - low >= 0.5 * (high - low) THEN 1.0 ELSE 0.0 END END) AS wicks FROM w GROUP BY {KEY})
SELECT g.instrument, g.trading_day, o.t, bars, CASE WHEN bars < 8 THEN NULL WHEN abs(d) <= 1 THEN 'At' WHEN coalesce(long_x, 0) >= 2 THEN 'Crossing' WHEN long_x = 1 THEN CASE WHEN d > 0 THEN 'Above/crossing' ELSE 'Crossing/below' END WHEN d > 0 THEN 'Above' ELSE 'Below' END AS price_vs_long,
  CASE WHEN bars < 8 OR o.t IS NULL THEN NULL WHEN abs(slope) < o.t THEN 'Flat' WHEN slope > 0 THEN 'Rising' ELSE 'Falling' END AS slope, CASE WHEN bars < 8 THEN NULL WHEN coalesce(fast_x, 0) >= 2 OR fast_last >= 12 OR f = 0 THEN 'Mixed' WHEN f > 0 THEN 'Bullish' ELSE 'Bearish' END AS alignment,
  CASE WHEN bars < 8 OR o.t IS NULL THEN NULL ELSE CASE WHEN abs(slope) < o.t THEN 1 ELSE 0 END + CASE WHEN coalesce(trig_x, 0) + coalesce(long_x, 0) >= 4 THEN 1 ELSE 0 END + CASE WHEN contained >= 0.45 AND wicks >= 0.55 THEN 1 ELSE 0 END END AS chop
FROM g LEFT JOIN c ON c.instrument = g.instrument AND c.trading_day = g.trading_day JOIN {{op}} o ON o.instrument = g.instrument AND o.trading_day = g.trading_day""", STORE)
P.query("e24_averages", f"SELECT instrument, {DAY}, price_vs_long, slope, alignment, chop FROM {{averages}} x", "Price against the long average, its slope in units of T, alignment of the fast lines, and a chop score of three points.")
P.query("e14_long_average_at_cutoff", f"SELECT instrument, {DAY}, CASE WHEN count(*) = 15 THEN round(max(CASE WHEN k = 14 THEN long_ma END), 6) + 0.0 END AS value, CASE WHEN count(*) = 15 THEN 'valid' ELSE 'incomplete_history' END AS status FROM {{lines}} x GROUP BY instrument, trading_day", "The long average at the cutoff, only over a complete window.")

# Place in the range of five sessions, and momentum in units of A
P.view("bias", f"""d AS (SELECT {KEY}, max(high) OVER w AS high5, min(low) OVER w AS low5, count(*) OVER w AS n5 FROM {{tr}} t WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s AS (SELECT {KEY}, o, a, cutoff_price, lag(o, 5) OVER (PARTITION BY instrument ORDER BY trading_day) AS open5 FROM {{rs}} r),
x AS (SELECT s.*, high5, low5, n5, (cutoff_price - open5) / a AS m, CASE WHEN high5 > low5 THEN (cutoff_price - low5) / (high5 - low5) ELSE 0.5 END AS p FROM s JOIN d USING ({KEY}))
SELECT {KEY}, CASE WHEN n5 < 5 OR m IS NULL THEN NULL WHEN cutoff_price > high5 THEN 'Bullish' WHEN cutoff_price < low5 THEN 'Bearish' WHEN p * 3 >= 2 AND m >= 0.5 THEN 'Bullish' WHEN p * 3 <= 1 AND m <= -0.5 THEN 'Bearish' WHEN p * 3 >= 2 AND m > 0.15 THEN 'Neutral-bullish' WHEN p * 3 <= 1 AND m < -0.15 THEN 'Neutral-bearish'
  WHEN (p * 3 > 1 AND p * 3 < 2) OR abs(m) <= 0.15 THEN 'Neutral' END AS label, CASE WHEN n5 < 5 OR m IS NULL THEN 'missing_history' WHEN p * 3 >= 2 AND m < -0.15 AND cutoff_price <= high5 OR p * 3 <= 1 AND m > 0.15 AND cutoff_price >= low5 THEN 'uncovered' END AS reason FROM x""", STORE)
P.query("e25_bias", f"SELECT instrument, {DAY}, label, reason FROM {{bias}} x", "Higher-timeframe bias: the cutoff price within five sessions' range and the momentum since five sessions back.")

# Releases are hours in which a source shows a burst; two sources, one of which is known by its cutoff only
def releases_text(bars: str, known: str = "true") -> str:
    """Releases from a relation of bars, of those that are known only once published the `known` ones."""
    return f"""x AS (SELECT instrument, trading_day, slot, volume, avg(volume) OVER (PARTITION BY instrument) AS usual FROM {{{bars}}} w WHERE instrument IN ('signup', 'error'))
SELECT instrument AS source, trading_day, slot, CASE WHEN volume >= 2.2 * usual THEN 'high' ELSE 'moderate' END AS tier, concat(instrument, ' ', CAST(slot AS STRING)) AS name
FROM x WHERE volume >= 1.6 * usual AND (instrument <> 'error' OR {known})"""


def covered_text(bars: str) -> str:
    return f"SELECT instrument AS source, trading_day FROM {{{bars}}} w WHERE instrument IN ('signup', 'error') GROUP BY 1, 2 HAVING count(*) >= 18"


P.view("releases", releases_text("wd"), STORE)
P.view("covered", covered_text("wd"))
P.query("e15_session_releases", "SELECT r.source, CAST(r.trading_day AS STRING) AS trading_day, slot, name, tier, slot < 900 AS before_cutoff, c.source IS NOT NULL AS source_covered FROM {releases} r LEFT JOIN {covered} c ON c.source = r.source AND c.trading_day = r.trading_day WHERE r.source <> 'error' OR slot < 900", "Releases of a session's window; those of a source that is known only once published are listed up to the cutoff only.")
P.view("risk", """d AS (SELECT DISTINCT trading_day FROM {wd} w), c AS (SELECT trading_day, count(*) AS sources FROM {covered} q GROUP BY 1),
r AS (SELECT trading_day, count(CASE WHEN tier = 'high' AND source = 'signup' THEN 1 END) AS high, count(CASE WHEN tier = 'moderate' AND source = 'signup' OR source = 'error' AND slot < 900 THEN 1 END) AS other FROM {releases} q WHERE slot < 1320 GROUP BY 1)
SELECT d.trading_day, CASE WHEN coalesce(sources, 0) < 2 THEN NULL WHEN high > 0 THEN 'High-risk' WHEN other > 0 THEN 'Reduced-confidence' ELSE 'Normal' END AS label, CASE WHEN coalesce(sources, 0) < 2 THEN 'no coverage' END AS reason FROM d LEFT JOIN c ON c.trading_day = d.trading_day LEFT JOIN r ON r.trading_day = d.trading_day""", STORE)
P.query("e27_event_risk", f"SELECT {DAY}, label, reason FROM {{risk}} x", "Risk class of a day's releases; unknown unless every source covers the day.")
P.query("e28_after_cutoff", f"""b AS (SELECT {KEY}, count(CASE WHEN slot >= 900 THEN 1 END) AS late_bars FROM {{wd}} w GROUP BY {KEY}), r AS (SELECT trading_day, count(CASE WHEN source = 'error' AND slot >= 900 THEN 1 END) AS late_releases FROM {{releases}} q GROUP BY 1)
SELECT instrument, CAST(b.trading_day AS STRING) AS trading_day, late_bars, coalesce(late_releases, 0) AS late_releases, CASE WHEN late_bars > 0 OR late_releases > 0 THEN 'contaminated' ELSE 'clean' END AS integrity FROM b LEFT JOIN r ON r.trading_day = b.trading_day""", "What of a stored day lies after its cutoff and must not enter a snapshot.")

# E29, E18, E33
P.view("annotation", f"""SELECT {KEY}, 'overnight_structure' AS field, label AS value, reason FROM {{on_structure}} a UNION ALL SELECT {KEY}, 'premarket_pattern' AS field, label AS value, reason FROM {{premarket}} b UNION ALL SELECT {KEY}, 'short_term_structure' AS field, label AS value, reason FROM {{short_term}} c
UNION ALL SELECT {KEY}, concat('trend_', size) AS field, label AS value, reason FROM {{trends}} d UNION ALL SELECT {KEY}, 'price_vs_long' AS field, price_vs_long AS value, CASE WHEN price_vs_long IS NULL THEN 'incomplete' END AS reason FROM {{averages}} e UNION ALL SELECT {KEY}, 'long_slope' AS field, slope AS value, CASE WHEN slope IS NULL THEN 'incomplete' END AS reason FROM {{averages}} f
UNION ALL SELECT {KEY}, 'fast_alignment' AS field, alignment AS value, CASE WHEN alignment IS NULL THEN 'incomplete' END AS reason FROM {{averages}} g UNION ALL SELECT {KEY}, 'chop' AS field, CAST(chop AS STRING) AS value, CASE WHEN chop IS NULL THEN 'incomplete' END AS reason FROM {{averages}} h UNION ALL SELECT {KEY}, 'bias' AS field, label AS value, reason FROM {{bias}} i
UNION ALL SELECT r.instrument, r.trading_day, 'event_risk' AS field, label AS value, reason FROM {{rs}} r JOIN {{risk}} k ON k.trading_day = r.trading_day
UNION ALL SELECT {KEY}, concat('vs_', name) AS field, CASE WHEN cutoff_price IS NULL OR level IS NULL THEN NULL WHEN abs(cutoff_price - level) <= 1 THEN 'At' WHEN cutoff_price > level THEN 'Above' ELSE 'Below' END AS value, CASE WHEN cutoff_price IS NULL OR level IS NULL THEN 'missing_reference' END AS reason
  FROM (SELECT l.instrument, l.trading_day, l.name, l.level, r.cutoff_price FROM {{levels}} l JOIN {{rs}} r ON r.instrument = l.instrument AND r.trading_day = l.trading_day WHERE l.name IN ('prev_close', 'prev_high', 'prev_low', 'on_high', 'on_low')) j""", STORE)
P.query("e29_annotation", f"SELECT instrument, {DAY}, field, value, reason FROM {{annotation}} x", "The annotation of a session in long form: every structure field with its value or the reason it has none.")
P.query("e26_price_locations", f"SELECT instrument, {DAY}, field, value FROM {{annotation}} x WHERE field LIKE 'vs_%'", "The cutoff price against five levels.")
P.query("e18_snapshot", f"""m AS (SELECT {KEY}, max(CASE WHEN k = 14 THEN long_ma END) AS long_ma, count(*) AS bars FROM {{lines}} x GROUP BY {KEY}), f AS (SELECT {KEY}, count(*) AS fields, count(value) AS known FROM {{annotation}} y GROUP BY {KEY}), e AS (SELECT trading_day, count(*) AS releases FROM {{releases}} z WHERE slot < 900 OR source <> 'error' GROUP BY 1)
SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, on_open, on_high, on_low, cutoff_price, prev_high, prev_low, prev_close, round(a, 6) + 0.0 AS a, t, b, CASE WHEN bars = 15 THEN round(long_ma, 6) + 0.0 END AS long_ma, coalesce(releases, 0) AS releases, fields, known,
  CASE WHEN cutoff_price IS NULL THEN 'no cutoff price' WHEN a IS NULL THEN 'no thresholds' WHEN bars < 15 THEN 'incomplete window' ELSE 'complete' END AS status FROM {{rs}} r LEFT JOIN m ON m.instrument = r.instrument AND m.trading_day = r.trading_day LEFT JOIN f ON f.instrument = r.instrument AND f.trading_day = r.trading_day LEFT JOIN e ON e.trading_day = r.trading_day""", "The snapshot of a session at its cutoff: references, thresholds, average, releases and how much of the annotation is known.")
P.query("e33_preview", f"""c AS (SELECT w.instrument, w.trading_day, minute_at, least(max(slot) + 60, 900) AS as_of FROM {{wd}} w CROSS JOIN (VALUES (300), (600), (840), (900)) m(minute_at) WHERE slot + 60 <= minute_at GROUP BY 1, 2, 3)
SELECT c.instrument, CAST(c.trading_day AS STRING) AS trading_day, c.minute_at AS minute, as_of, count(*) AS bars, min_by(w.open, w.slot) AS on_open, max(w.high) AS on_high, min(w.low) AS on_low, max_by(w.close, w.slot) AS price,
  CASE WHEN max_by(w.close, w.slot) > min_by(w.open, w.slot) THEN 'up' WHEN max_by(w.close, w.slot) < min_by(w.open, w.slot) THEN 'down' ELSE 'flat' END AS direction FROM c JOIN {{wd}} w ON w.instrument = c.instrument AND w.trading_day = c.trading_day AND w.slot + 60 <= c.as_of GROUP BY 1, 2, 3, 4""", "The same references as of any earlier minute: the end of the last stored bar, at the cutoff at most.")

# A curve from the slopes of six contiguous candles
P.query("e32_projection", f"""y AS (SELECT {KEY}, k, 0.5 * tema + 0.5 * trigger_line AS v FROM {{lines}} x), z AS (SELECT *, v - lag(v, 1) OVER w AS s0, lag(v, 1) OVER w - lag(v, 2) OVER w AS s1, lag(v, 2) OVER w - lag(v, 3) OVER w AS s2, lag(v, 3) OVER w - lag(v, 4) OVER w AS s3, lag(v, 4) OVER w - lag(v, 5) OVER w AS s4, k - lag(k, 5) OVER w AS span FROM y WINDOW w AS (PARTITION BY {KEY} ORDER BY k)),
a AS (SELECT *, (5 * s0 + 4 * s1 + 3 * s2 + 2 * s3 + s4) / 15 AS s FROM z WHERE span = 5)
SELECT instrument, {DAY}, k, round(v, 6) + 0.0 AS y0, round(v + s0 * 2, 6) + 0.0 AS y1, round(v + s * 4, 6) + 0.0 AS y2, round(v + s * 6, 6) + 0.0 AS end_price FROM a""", "Control points and end price of a trend projection six bars ahead, for every candle with six contiguous ones.")
