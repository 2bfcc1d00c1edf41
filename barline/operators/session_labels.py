"""Group F, second part: labels of the opening window and of the whole session, with thresholds of the session itself.

One bar stands for one step of a window: the opening window is the first 15 bars of the session day (slots 0 to 899 of
hourly bars), the regular session has six bars. T, B and A are a session's own thresholds, from the true ranges of the sessions
before it. A label is null with a reason where a bar, a threshold or a reference is missing.
"""

from __future__ import annotations

from ..plans import Portable
from .indicators import REFS_SQL, RTH_SQL, WD_SQL, daily_ranges, overnight_references, weekday_bars

QUERIES: dict = {}
SQL: dict = {}
P = Portable(QUERIES, SQL)
P.base("wd", weekday_bars, WD_SQL)
P.base("tr", lambda spark, sf: daily_ranges(weekday_bars(spark, sf)), RTH_SQL)
P.base("refs", lambda spark, sf: overnight_references(weekday_bars(spark, sf)), REFS_SQL)
KEY = "instrument, trading_day"
DAY = "CAST(trading_day AS STRING) AS trading_day"

# thresholds of each session: A is the mean true range of the five sessions before (three at least), T and B whole steps of it
P.view("thr", f"""a AS (SELECT {KEY}, CASE WHEN count(tr) OVER w >= 3 THEN avg(tr) OVER w END AS a, lag(high) OVER v AS prev_high, lag(low) OVER v AS prev_low, lag(close) OVER v AS prev_close
  FROM {{tr}} t WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY instrument ORDER BY trading_day))
SELECT {KEY}, a, greatest(1.0, ceil(a * 0.05)) * CASE WHEN a IS NULL THEN NULL ELSE 1 END AS t, greatest(2.0, ceil(a * 0.10)) * CASE WHEN a IS NULL THEN NULL ELSE 1 END AS b, prev_high, prev_low, prev_close FROM a""", ("events",))
# bars of the opening window, and one row a session with its measures, thresholds and references
P.view("ob", f"SELECT {KEY}, CAST(slot / 60 AS INT) AS k, open, high, low, close FROM {{wd}} w WHERE slot < 900")
P.view("op", f"""g AS (SELECT {KEY}, max(CASE WHEN k = 0 THEN open END) AS o, count(*) AS n, max(high) AS h, min(low) AS l, max(CASE WHEN k = 14 THEN close END) AS c FROM {{ob}} x GROUP BY {KEY}),
r AS (SELECT {KEY}, lag(on_high) OVER v AS on_high, lag(on_low) OVER v AS on_low FROM {{refs}} f WINDOW v AS (PARTITION BY instrument ORDER BY trading_day))
SELECT g.instrument, g.trading_day, o, n, h, l, c, a, t, b, prev_high, prev_low, prev_close, on_high, on_low FROM g LEFT JOIN {{thr}} t ON t.instrument = g.instrument AND t.trading_day = g.trading_day
LEFT JOIN r ON r.instrument = g.instrument AND r.trading_day = g.trading_day""", ("events",))
P.view("ix", f"SELECT {KEY}, CAST(floor((minute - 600) / 60) AS INT) AS k, open, high, low, close FROM {{wd}} w WHERE session_scope = 'RTH'")
P.view("rs", f"""g AS (SELECT {KEY}, max(CASE WHEN k = 0 THEN open END) AS o, count(*) AS n, max(high) AS hi, min(low) AS lo, max(CASE WHEN k = 5 THEN close END) AS c, count(CASE WHEN k < 2 THEN 1 END) AS n_ib,
  max(CASE WHEN k < 2 THEN high END) AS ib_high, min(CASE WHEN k < 2 THEN low END) AS ib_low, max(CASE WHEN k = 1 THEN close END) AS ib_close FROM {{ix}} x GROUP BY {KEY})
SELECT g.*, a, t, b, prev_high, prev_low, prev_close, on_open, on_high, on_low, cutoff_price FROM g LEFT JOIN {{thr}} t USING ({KEY}) LEFT JOIN {{refs}} f USING ({KEY})""", ("events",))

# F3. For each reference: was it swept from below or above (2 yes, 0 no, 1 unknown)
P.view("sweeps", f"""lv AS (SELECT s.instrument, s.trading_day, o, t, h, l, m.name, CASE m.name WHEN 'on_high' THEN on_high WHEN 'on_low' THEN on_low WHEN 'prev_high' THEN prev_high ELSE prev_low END AS v
  FROM {{op}} s CROSS JOIN (VALUES ('on_high'), ('on_low'), ('prev_high'), ('prev_low')) m(name)),
br AS (SELECT lv.instrument, lv.trading_day, lv.name, min(CASE WHEN x.low <= v - t THEN k END) AS down_at, min(CASE WHEN x.high >= v + t THEN k END) AS up_at
  FROM lv JOIN {{ob}} x ON x.instrument = lv.instrument AND x.trading_day = lv.trading_day GROUP BY 1, 2, 3),
bk AS (SELECT lv.instrument, lv.trading_day, lv.name, max(CASE WHEN x.k > down_at AND x.close > v THEN 2 ELSE 0 END) AS low_back, max(CASE WHEN x.k > up_at AND x.close < v THEN 2 ELSE 0 END) AS high_back
  FROM lv JOIN br ON br.instrument = lv.instrument AND br.trading_day = lv.trading_day AND br.name = lv.name JOIN {{ob}} x ON x.instrument = lv.instrument AND x.trading_day = lv.trading_day GROUP BY 1, 2, 3)
SELECT lv.instrument, lv.trading_day, max(CASE WHEN v IS NULL THEN CASE WHEN l >= o - t THEN 0 ELSE 1 END WHEN v >= o THEN 0 ELSE low_back END) AS low_sweep,
  max(CASE WHEN v IS NULL THEN CASE WHEN h <= o + t THEN 0 ELSE 1 END WHEN v <= o THEN 0 ELSE high_back END) AS high_sweep
FROM lv LEFT JOIN bk ON bk.instrument = lv.instrument AND bk.trading_day = lv.trading_day AND bk.name = lv.name GROUP BY 1, 2""")
P.view("opening", f"""x AS (SELECT s.*, low_sweep, high_sweep, CASE WHEN t IS NULL THEN 'missing_threshold' WHEN o IS NULL OR n < 15 THEN 'missing_bars' END AS gap FROM {{op}} s LEFT JOIN {{sweeps}} w USING ({KEY})),
y AS (SELECT *, CASE WHEN gap IS NOT NULL THEN NULL WHEN c > o + t AND low_sweep = 2 THEN 'sweep_low_rebound' WHEN c > o + t AND low_sweep = 1 THEN 'unknown' WHEN c < o - t AND high_sweep = 2 THEN 'sweep_high_reverse' WHEN c < o - t AND high_sweep = 1 THEN 'unknown'
  WHEN c > o + t AND h > l AND abs(c - o) >= 0.60 * (h - l) AND o - l <= t THEN 'opening_drive_up' WHEN c < o - t AND h > l AND abs(c - o) >= 0.60 * (h - l) AND h - o <= t THEN 'opening_drive_down'
  WHEN h >= o + t AND l <= o - t THEN 'two_sided_whipsaw' ELSE 'range' END AS kind FROM x)
SELECT {KEY}, o, n, h, l, c, a, t, b, prev_high, prev_low, prev_close, on_high, on_low, CASE WHEN kind <> 'unknown' THEN kind END AS label, CASE WHEN kind = 'unknown' THEN 'missing_reference' ELSE gap END AS reason FROM y""", ("events",))
P.query("f3_opening_type", f"SELECT instrument, {DAY}, label, reason FROM {{opening}} x", "Opening type: sweeps of a reference by T with a later close back, drives, whipsaw, range; a rule that a missing reference leaves open stops the chain.")

# F4
DIR = "CASE WHEN c - o > b THEN 'bullish' WHEN c - o < -b THEN 'bearish' WHEN c - o IS NOT NULL AND b IS NOT NULL THEN 'neutral_band' END"
P.view("stype", f"""x AS (SELECT *, {DIR} AS dir, hi - lo AS r, CASE WHEN a IS NULL THEN 'missing_threshold' WHEN o IS NULL OR n < 6 THEN 'missing_bars' END AS gap FROM {{rs}} s),
y AS (SELECT *, CASE WHEN gap IS NOT NULL THEN NULL WHEN r = 0 THEN 'range_day' WHEN (ib_low <= o - a / 4 AND dir = 'bullish') OR (ib_high >= o + a / 4 AND dir = 'bearish') THEN 'reversal_day'
  WHEN dir = 'bullish' AND abs(c - o) >= 0.60 * r AND c - lo >= 0.80 * r THEN 'bull_trend_day' WHEN dir = 'bearish' AND abs(c - o) >= 0.60 * r AND c - lo <= 0.20 * r THEN 'bear_trend_day'
  WHEN r >= a AND abs(c - o) < 0.35 * r THEN 'two_sided_volatile_day' WHEN r < a AND abs(c - o) < 0.35 * r THEN 'range_day' END AS label FROM x)
SELECT {KEY}, o, c, hi, lo, r, dir, gap, label, CASE WHEN label IS NULL THEN coalesce(gap, 'uncovered') END AS reason FROM y""", ("events",))
P.query("f4_session_type", f"SELECT instrument, {DAY}, dir AS close_direction, label, reason FROM {{stype}} x", "Session type of a complete regular session: reversal, trends, two-sided volatile, range, or uncovered.")

# F8: the first close beyond O + T or O - T on the side that was touched first, every bar before it being there
P.view("first_touch", f"""h AS (SELECT x.instrument, x.trading_day, o, t, min(CASE WHEN x.high >= o + t THEN k END) AS u, min(CASE WHEN x.low <= o - t THEN k END) AS d FROM {{ob}} x JOIN {{op}} s ON s.instrument = x.instrument AND s.trading_day = x.trading_day WHERE k < 5 GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN t IS NULL OR o IS NULL OR u = d THEN NULL WHEN u IS NULL AND d IS NULL THEN 'neither' WHEN d IS NULL OR u < d THEN 'up_first' ELSE 'down_first' END AS move FROM h""")
P.query("f8_confirmation_time", f"""c AS (SELECT f.instrument, f.trading_day, move, min(CASE WHEN move = 'up_first' AND x.close > o + t OR move = 'down_first' AND x.close < o - t THEN k END) AS confirmed FROM {{first_touch}} f JOIN {{ob}} x ON x.instrument = f.instrument AND x.trading_day = f.trading_day GROUP BY 1, 2, 3),
w AS (SELECT c.instrument, c.trading_day, move, confirmed, count(CASE WHEN x.k <= confirmed THEN 1 END) AS before FROM c JOIN {{ob}} x ON x.instrument = c.instrument AND x.trading_day = c.trading_day GROUP BY 1, 2, 3, 4)
SELECT instrument, {DAY}, move, CASE WHEN before = confirmed + 1 THEN confirmed + 1 END AS confirmed_after FROM w""", "Bars from the open to the first close that confirms the first move; null where it is not confirmed or a bar before it is missing.")

# F9
P.query("f9_drive_strength", f"""SELECT instrument, {DAY}, CASE WHEN label IN ('opening_drive_up', 'opening_drive_down') THEN CASE WHEN abs(c - o) >= 0.80 * (h - l) THEN 'strong' ELSE 'moderate' END END AS label,
  CASE WHEN label IS NULL THEN 'upstream_unavailable' WHEN label NOT IN ('opening_drive_up', 'opening_drive_down') THEN 'not_applicable' END AS reason FROM {{opening}} x""", "How strong an opening drive was.")

# F5 with all candidates, F6 with five levels
P.view("levels", f"""n AS (SELECT s.*, m.name, m.rank FROM {{rs}} s CROSS JOIN (VALUES ('prev_close', 1), ('prev_high', 2), ('prev_low', 3), ('on_high', 4), ('on_low', 5), ('on_open', 6), ('on_middle', 7), ('cutoff_price', 8), ('open_plus_t', 9), ('open_minus_t', 10)) m(name, rank))
SELECT {KEY}, o, name, rank, CASE name WHEN 'prev_close' THEN prev_close WHEN 'prev_high' THEN prev_high WHEN 'prev_low' THEN prev_low WHEN 'on_high' THEN on_high WHEN 'on_low' THEN on_low WHEN 'on_open' THEN on_open
  WHEN 'on_middle' THEN (on_high + on_low) / 2 WHEN 'cutoff_price' THEN cutoff_price WHEN 'open_plus_t' THEN o + t ELSE o - t END AS level FROM n""", ("events",))
P.query("e16_ten_candidates", f"SELECT instrument, {DAY}, name, rank, round(level, 6) + 0.0 AS value, CASE WHEN level IS NULL THEN 'missing' ELSE 'ok' END AS status FROM {{levels}} x", "All ten levels that a session can test first, with their precedence and status.")
P.view("first_level", f"""m AS (SELECT {KEY}, max(CASE WHEN level IS NULL THEN 1 ELSE 0 END) AS missing FROM {{levels}} l GROUP BY {KEY}),
hit AS (SELECT x.instrument, x.trading_day, k, x.open, name, rank, level, abs(level - x.open) AS away, CASE WHEN level > x.open THEN 1 ELSE 0 END AS above, CASE WHEN level < x.open THEN 1 ELSE 0 END AS below, CASE WHEN level = x.open THEN 1 ELSE 0 END AS at_open
  FROM {{ix}} x JOIN {{levels}} l ON l.instrument = x.instrument AND l.trading_day = x.trading_day AND x.low <= level AND level <= x.high WHERE k < 3),
f AS (SELECT {KEY}, min(k) AS k FROM hit GROUP BY {KEY}),
g AS (SELECT h.instrument, h.trading_day, h.k, max(above) AS above, max(below) AS below, max(at_open) AS at_open, min_by(name, away * 100 + rank / 1000.0) AS name, min_by(level, away * 100 + rank / 1000.0) AS level FROM hit h JOIN f ON f.instrument = h.instrument AND f.trading_day = h.trading_day AND f.k = h.k GROUP BY 1, 2, 3),
n AS (SELECT s.instrument, s.trading_day, o, g.k, count(CASE WHEN x.k <= coalesce(g.k, 2) THEN 1 END) AS bars FROM {{rs}} s JOIN {{ix}} x ON x.instrument = s.instrument AND x.trading_day = s.trading_day LEFT JOIN g ON g.instrument = s.instrument AND g.trading_day = s.trading_day GROUP BY 1, 2, 3, 4),
z AS (SELECT n.instrument, n.trading_day, o, n.k, g.name, g.level, CASE WHEN o IS NULL THEN 'missing_bars' WHEN missing = 1 THEN 'missing_reference' WHEN bars < coalesce(n.k, 2) + 1 THEN 'missing_bars' WHEN n.k IS NULL THEN 'none_tested' WHEN above = 1 AND below = 1 AND at_open = 0 THEN 'ambiguous_intrabar' END AS reason
  FROM n JOIN m ON m.instrument = n.instrument AND m.trading_day = n.trading_day LEFT JOIN g ON g.instrument = n.instrument AND g.trading_day = n.trading_day)
SELECT {KEY}, o, CASE WHEN reason IS NULL THEN name END AS label, reason, CASE WHEN reason IS NULL THEN level END AS level, CASE WHEN reason = 'ambiguous_intrabar' THEN name END AS estimate, k FROM z""", ("events",))
P.query("f5_first_of_ten_levels", f"SELECT instrument, {DAY}, label, reason, round(level, 6) + 0.0 AS level, estimate, k AS bar FROM {{first_level}} x", "The first of ten candidate levels that the first three regular bars reach: by bar, distance from its open and precedence; levels on both sides of a bar's open are ambiguous, with the nearest as an estimate.")
P.view("outcomes5", f"""c AS (SELECT {KEY}, o, name, level, 6 AS upto FROM {{levels}} l WHERE name IN ('on_high', 'on_low', 'prev_high', 'prev_low') UNION ALL SELECT {KEY}, o, 'first_level' AS name, level, 3 AS upto FROM {{first_level}} f),
g AS (SELECT c.instrument, c.trading_day, c.name, c.o, c.level, c.upto, count(x.k) AS bars, count(CASE WHEN x.k >= upto - 3 THEN 1 END) AS last3, max(CASE WHEN o > level AND x.low < level OR o < level AND x.high > level THEN 1 ELSE 0 END) AS breached,
    count(CASE WHEN x.k >= upto - 3 AND (o > level AND x.close < level OR o < level AND x.close > level) THEN 1 END) AS beyond, count(CASE WHEN x.k >= upto - 3 AND (o > level AND x.close > level OR o < level AND x.close < level) THEN 1 END) AS back,
    min(CASE WHEN o > level AND x.low <= level OR o < level AND x.high >= level THEN x.k END) AS touched_at, max(CASE WHEN o > level AND x.close > level OR o < level AND x.close < level THEN x.k END) AS last_back
  FROM c LEFT JOIN {{ix}} x ON x.instrument = c.instrument AND x.trading_day = c.trading_day AND x.k < c.upto GROUP BY 1, 2, 3, 4, 5, 6),
z AS (SELECT *, CASE WHEN level IS NULL THEN 'missing_reference' WHEN o IS NULL THEN 'missing_bars' WHEN level = o THEN 'approach_unresolved' WHEN breached = 1 THEN CASE WHEN last3 < 3 THEN 'missing_bars' WHEN beyond = 3 THEN 'break_acceptance' WHEN back = 3 THEN 'break_reclaim_acceptance' ELSE 'break_without_acceptance' END
  WHEN bars < upto THEN 'missing_bars' WHEN touched_at IS NULL THEN CASE WHEN name = 'first_level' THEN 'no_rejection' ELSE 'not_tested' END WHEN last_back >= touched_at THEN 'test_rejection' ELSE 'no_rejection' END AS what FROM g)
SELECT {KEY}, name, CASE WHEN what NOT IN ('missing_reference', 'missing_bars', 'approach_unresolved', 'no_rejection') THEN what END AS label, CASE WHEN what IN ('missing_reference', 'missing_bars', 'approach_unresolved', 'no_rejection') THEN what END AS reason FROM z""", ("events",))
P.query("f6_five_level_outcomes", f"SELECT instrument, {DAY}, name, label, reason FROM {{outcomes5}} x", "What became of the first level and of four references: a wick beyond is a breach, the last three closes decide acceptance, a touch needs a later close back.")

# F16: the shape of the opening window
P.view("shape", f"""b AS (SELECT x.instrument, x.trading_day, k, x.open, x.high, x.low, x.close, s.o, s.h, s.l, s.c, s.t, h - l AS r, s.label AS kind, s.reason AS gap FROM {{ob}} x JOIN {{opening}} s ON s.instrument = x.instrument AND s.trading_day = x.trading_day WHERE s.reason IS NULL),
e AS (SELECT {KEY}, o, h, l, c, t, r, kind, min(CASE WHEN high = h THEN k END) AS ih, min(CASE WHEN low = l THEN k END) AS il, max(CASE WHEN k < 3 THEN high END) AS h3, min(CASE WHEN k < 3 THEN low END) AS l3 FROM b GROUP BY {KEY}, o, h, l, c, t, r, kind),
p AS (SELECT b.instrument, b.trading_day, max(CASE WHEN high >= h - 0.1 * r AND k >= ih + 4 THEN 1 ELSE 0 END) AS top_again, max(CASE WHEN low <= l + 0.1 * r AND k >= il + 4 THEN 1 ELSE 0 END) AS bottom_again
  FROM (SELECT b.*, ih, il FROM b JOIN e USING ({KEY}, o, h, l, c, t, r, kind)) b GROUP BY 1, 2),
pair AS (SELECT a.instrument, a.trading_day, a.h, a.l, a.c, a.r, a.k AS i, z.k AS j, CASE WHEN a.high >= a.h - 0.1 * a.r AND z.high >= a.h - 0.1 * a.r THEN 1 ELSE 0 END AS tops, CASE WHEN a.low <= a.l + 0.1 * a.r AND z.low <= a.l + 0.1 * a.r THEN 1 ELSE 0 END AS bottoms
  FROM b a JOIN b z ON z.instrument = a.instrument AND z.trading_day = a.trading_day AND z.k - a.k >= 4),
mid AS (SELECT p.instrument, p.trading_day, i, j, tops, bottoms, p.h, p.l, p.c, p.r, min(m.low) AS trough, max(m.high) AS peak FROM pair p JOIN b m ON m.instrument = p.instrument AND m.trading_day = p.trading_day AND m.k > i AND m.k < j WHERE tops = 1 OR bottoms = 1 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
dbl AS (SELECT {KEY}, max(CASE WHEN tops = 1 AND h - trough >= 0.3 * r AND c < trough OR bottoms = 1 AND peak - l >= 0.3 * r AND c > peak THEN 1 ELSE 0 END) AS double FROM mid GROUP BY {KEY}),
sg AS (SELECT {KEY}, k, CASE WHEN close > (h + l) / 2 THEN 1 ELSE -1 END AS side FROM b WHERE close <> (h + l) / 2),
cr0 AS (SELECT *, lag(side) OVER (PARTITION BY {KEY} ORDER BY k) AS before FROM sg), cr AS (SELECT {KEY}, count(CASE WHEN side <> before THEN 1 END) AS crossings FROM cr0 GROUP BY {KEY}),
st0 AS (SELECT {KEY}, k, close - lag(close) OVER (PARTITION BY {KEY} ORDER BY k) AS step FROM b), st1 AS (SELECT {KEY}, k, CASE WHEN step > 0 THEN 1 ELSE -1 END AS side FROM st0 WHERE step <> 0),
st2 AS (SELECT *, lag(side) OVER (PARTITION BY {KEY} ORDER BY k) AS before FROM st1), rv AS (SELECT {KEY}, count(CASE WHEN side <> before THEN 1 END) AS reversals FROM st2 GROUP BY {KEY})
SELECT e.*, top_again, bottom_again, coalesce(double, 0) AS double, coalesce(crossings, 0) AS crossings, coalesce(reversals, 0) AS reversals FROM e JOIN p USING ({KEY}) LEFT JOIN dbl USING ({KEY}) LEFT JOIN cr USING ({KEY}) LEFT JOIN rv USING ({KEY})""")
P.view("pattern", f"""f AS (SELECT *, CASE WHEN (il BETWEEN 3 AND 11 AND o - l >= 0.4 * r AND c - l >= 0.8 * r AND c > o + t) OR (ih BETWEEN 3 AND 11 AND o - l <= 0.6 * r AND c - l <= 0.2 * r AND c < o - t) THEN 1 ELSE 0 END AS v_shape,
  CASE WHEN (ih <= 2 AND o - l <= 0.6 * r AND c - l <= r / 3 AND il > ih AND top_again = 0) OR (il <= 2 AND o - l >= 0.4 * r AND c - l >= 2 * r / 3 AND ih > il AND bottom_again = 0) THEN 1 ELSE 0 END AS fade,
  CASE WHEN (o - l <= 0.2 * r AND h3 - l >= 0.5 * r AND ih >= 12 AND c - l >= 0.8 * r) OR (o - l >= 0.8 * r AND h - l3 >= 0.5 * r AND il >= 12 AND c - l <= 0.2 * r) THEN 1 ELSE 0 END AS spike,
  CASE WHEN abs(c - o) <= 0.2 * r AND r >= 2 * t AND crossings >= 3 THEN 1 ELSE 0 END AS rotation, CASE WHEN abs(c - o) <= 0.2 * r AND reversals >= 8 AND NOT (r >= 2 * t AND crossings >= 3) THEN 1 ELSE 0 END AS choppy FROM {{shape}} s),
m AS (SELECT *, v_shape + fade + double + spike + rotation + choppy AS fits FROM f)
SELECT s.instrument, s.trading_day, CASE WHEN s.reason IS NOT NULL THEN NULL WHEN s.label IN ('opening_drive_up', 'opening_drive_down') THEN 'drive_continuation' WHEN s.label IN ('sweep_low_rebound', 'sweep_high_reverse') THEN 'v_shape_reversal' WHEN r > 0 AND fits = 1
    THEN CASE WHEN v_shape = 1 THEN 'v_shape_reversal' WHEN fade = 1 THEN 'fade_reversal' WHEN double = 1 THEN 'double_top_bottom' WHEN spike = 1 THEN 'spike_and_channel' WHEN rotation = 1 THEN 'balanced_rotation' ELSE 'choppy' END END AS label,
  CASE WHEN s.reason IS NOT NULL THEN s.reason WHEN s.label IN ('opening_drive_up', 'opening_drive_down', 'sweep_low_rebound', 'sweep_high_reverse') THEN NULL WHEN r = 0 OR fits = 0 THEN 'uncovered' WHEN fits > 1 THEN 'ambiguous_pattern' END AS reason
FROM {{opening}} s LEFT JOIN m ON m.instrument = s.instrument AND m.trading_day = s.trading_day""", ("events",))
P.query("f16_opening_pattern", f"SELECT instrument, {DAY}, label, reason FROM {{pattern}} x", "The shape of the opening window: drives and sweeps first, then exactly one of six shapes; several are ambiguous.")

# F17 to F20
P.query("f17_trend_persistence", f"""SELECT instrument, {DAY}, CASE WHEN o IS NULL OR n < 6 THEN NULL WHEN hi = lo THEN 'low' WHEN abs(c - o) >= 0.60 * (hi - lo) THEN 'high' WHEN abs(c - o) >= 0.35 * (hi - lo) THEN 'moderate' ELSE 'low' END AS label,
  CASE WHEN o IS NULL OR n < 6 THEN 'missing_bars' END AS reason FROM {{rs}} x""", "How much of the session's range its net move kept.")
P.view("moves", f"""SELECT {KEY}, 'ib_direction' AS target, CASE WHEN t IS NULL OR o IS NULL OR ib_close IS NULL THEN NULL WHEN ib_close - o > t THEN 'bullish' WHEN ib_close - o < -t THEN 'bearish' ELSE 'neutral_band' END AS label, CASE WHEN t IS NULL THEN 'missing_threshold' WHEN o IS NULL OR ib_close IS NULL THEN 'missing_bars' END AS reason FROM {{rs}} x
UNION ALL SELECT {KEY}, 'close_direction' AS target, {DIR} AS label, CASE WHEN b IS NULL THEN 'missing_threshold' WHEN o IS NULL OR c IS NULL THEN 'missing_bars' END AS reason FROM {{rs}} x
UNION ALL SELECT {KEY}, 'ib_extension' AS target, CASE WHEN n_ib < 2 THEN NULL WHEN hi > ib_high AND lo < ib_low THEN 'both_sides' WHEN n < 6 THEN NULL WHEN hi > ib_high THEN 'up' WHEN lo < ib_low THEN 'down' ELSE 'none' END AS label,
  CASE WHEN n_ib < 2 OR n < 6 AND NOT (hi > ib_high AND lo < ib_low) THEN 'missing_bars' END AS reason FROM {{rs}} x""")
P.view("assembled", f"""SELECT {KEY}, 'opening_type' AS target, label, reason FROM {{opening}} x UNION ALL SELECT {KEY}, 'session_type' AS target, label, reason FROM {{stype}} y UNION ALL SELECT {KEY}, 'opening_pattern' AS target, label, reason FROM {{pattern}} z
UNION ALL SELECT {KEY}, target, label, reason FROM {{moves}} m UNION ALL SELECT {KEY}, 'first_level' AS target, label, reason FROM {{first_level}} f UNION ALL SELECT {KEY}, name || '_outcome' AS target, label, reason FROM {{outcomes5}} o""")
P.query("f18_outcomes", f"SELECT instrument, {DAY}, target, label, reason, md5(concat(instrument, '|', CAST(trading_day AS STRING), '|', target, '|', coalesce(label, ''), '|', coalesce(reason, ''))) AS digest FROM {{assembled}} x", "All labels of a session in long form, each with a digest of what it says.")
P.query("f19_other_markets", f"""SELECT target, instrument, count(*) AS sessions, count(label) AS labelled, count(CASE WHEN reason = 'missing_bars' THEN 1 END) AS missing_bars, count(CASE WHEN reason = 'missing_threshold' THEN 1 END) AS missing_threshold FROM {{assembled}} x GROUP BY 1, 2""", "Every market is labelled from its own references and thresholds by the same job: label counts by market and target.")
P.query("f20_pooled_direction", f"""s AS (SELECT {KEY}, slot, close, lag(close) OVER v AS before FROM {{wd}} w WHERE slot < 900 WINDOW v AS (PARTITION BY {KEY} ORDER BY slot)),
a AS (SELECT {KEY}, avg(abs(close - before)) * sqrt(6) AS band, count(before) AS steps FROM s GROUP BY {KEY})
SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, CASE WHEN steps < 5 OR c IS NULL OR cutoff_price IS NULL THEN NULL WHEN c - cutoff_price > band THEN 'bullish' WHEN c - cutoff_price < -band THEN 'bearish' ELSE 'neutral_band' END AS label
FROM {{rs}} r LEFT JOIN a ON a.instrument = r.instrument AND a.trading_day = r.trading_day""", "Direction from the cutoff to the close against a band of the session's own overnight steps, the same rule for every instrument.")
P.query("f24_wide_preopen", f"""SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, round(a, 6) + 0.0 AS a, t, b, on_open, on_high, on_low, cutoff_price, prev_high, prev_low, prev_close, CASE WHEN cutoff_price > on_open THEN 'up' WHEN cutoff_price < on_open THEN 'down' WHEN on_open IS NOT NULL THEN 'flat' END AS overnight,
  (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN cutoff_price IS NULL THEN 0 ELSE 1 END + CASE WHEN prev_close IS NULL THEN 0 ELSE 1 END) / CAST(3 AS DOUBLE) AS known FROM {{rs}} r""", "One wide row a session of what is known before it opens.")
