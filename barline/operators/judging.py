"""Groups G, H and L, second part: similar sessions by the whole annotation, forecasts from them, and what their scores allow to claim."""

from __future__ import annotations

from ..plans import Portable
from .forecasts import LAB_SQL, OUT_SQL, labelled, outcomes
from .matching import OPEN_SQL, opening_paths
from .indicators import weekday_bars
from .scoring import _ERF_SQL, SCORE_SQL, scored
from .session_labels import DAY, KEY
from .structure import STORE
from .walk import OFFSETS
from .walk import P as WALK

QUERIES: dict = {}
SQL: dict = {}
P = Portable(QUERIES, SQL, WALK)
P.base("pa", lambda spark, sf: opening_paths(weekday_bars(spark, sf)), OPEN_SQL)
P.base("ou", outcomes, OUT_SQL)
P.base("lab", labelled, LAB_SQL)
P.base("sc", scored, SCORE_SQL)

#: Weights of the fourteen compared fields; they sum to 100.
RUBRIC = {"overnight_structure": 14, "premarket_pattern": 12, "short_term_structure": 8, "trend_bar": 8, "trend_triple": 6, "price_vs_long": 8, "long_slope": 6, "fast_alignment": 6, "bias": 10, "event_risk": 6, "vs_prev_close": 6, "vs_prev_high": 4, "vs_prev_low": 4, "chop": 2}
WEIGHTS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in RUBRIC.items()) + ") w(field, weight)"
FLOOR, TOP = 75, 5

P.view("rubric", f"SELECT a.instrument, a.trading_day, d, a.field, value, weight FROM {{annotation}} a JOIN {WEIGHTS} ON w.field = a.field JOIN {{days}} t ON t.instrument = a.instrument AND t.trading_day = a.trading_day", STORE)
P.query("g1_rubric_features", f"SELECT instrument, {DAY}, " + ", ".join(f"max(CASE WHEN field = '{k}' THEN value END) AS {k}" for k in RUBRIC) + " FROM {rubric} r GROUP BY instrument, trading_day", "The fourteen compared features of a session, one column each.")


def similar_text(earlier: str) -> str:
    """Each session of {rubric} against the twenty before it of another relation of features."""
    return f"""SELECT a.instrument, a.trading_day, a.d, e.trading_day AS earlier, e.d AS ed, CAST(sum(CASE WHEN a.value = e.value THEN a.weight ELSE 0 END) AS BIGINT) AS hit,
  CAST(sum(CASE WHEN a.value IS NOT NULL AND e.value IS NOT NULL THEN a.weight ELSE 0 END) AS BIGINT) AS comparable
FROM {{rubric}} a CROSS JOIN {OFFSETS} JOIN {{{earlier}}} e ON e.instrument = a.instrument AND e.field = a.field AND e.d = a.d - ahead GROUP BY 1, 2, 3, 4, 5"""


P.view("similar", similar_text("rubric"), STORE)
P.query("g2_rubric_similarity", f"SELECT instrument, {DAY}, CAST(earlier AS STRING) AS earlier, hit, comparable FROM {{similar}} s", "Every session against each of the twenty before it: weight that agrees and weight that can be compared, over all fourteen features.")
P.view("sets", f"""r AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY CAST(hit AS DOUBLE) / comparable DESC, comparable DESC, ed DESC) AS rank, count(*) OVER (PARTITION BY {KEY}) AS pool, sum(ed) OVER (PARTITION BY {KEY}) AS mark1, sum(ed * ed) OVER (PARTITION BY {KEY}) AS mark2 FROM {{similar}} s WHERE comparable >= {FLOOR})
SELECT {KEY}, d, earlier, ed, hit, comparable, CAST(rank AS INT) AS rank, pool, md5(concat(CAST(pool AS STRING), '|', CAST(mark1 AS STRING), '|', CAST(mark2 AS STRING))) AS pool_hash FROM r WHERE rank <= {TOP}""", STORE)
P.query("g3_rubric_sets", f"SELECT instrument, {DAY}, CAST(earlier AS STRING) AS earlier, hit, comparable, rank, pool, pool_hash FROM {{sets}} s", "The five most similar sessions of which at least 75 % can be compared, with the pool's size and hash.")
P.query("g4_exclusion_reasons", f"""SELECT instrument, CASE WHEN comparable = 0 THEN 'nothing comparable' WHEN comparable < {FLOOR} THEN 'below the floor' WHEN hit = 0 THEN 'nothing agrees' ELSE 'eligible' END AS reason, count(*) AS n FROM {{similar}} s GROUP BY 1, 2""", "Pairs counted by the first reason that excludes them.")
P.query("g5_prior_manifest", f"""k AS (SELECT s.instrument, s.trading_day, d, label, dir FROM {{stype}} s JOIN {{days}} t ON t.instrument = s.instrument AND t.trading_day = s.trading_day)
SELECT t.instrument, CAST(t.trading_day AS STRING) AS trading_day, count(*) AS earlier, count(label) AS labelled, count(dir) AS directed, min(CASE WHEN dir IS NOT NULL THEN k.d END) AS first_known, max(CASE WHEN dir IS NOT NULL THEN k.d END) AS last_known FROM {{days}} t CROSS JOIN {OFFSETS} JOIN k ON k.instrument = t.instrument AND k.d = t.d - ahead GROUP BY 1, 2""", "Earlier sessions whose outcome was known before each session's cutoff.")
P.query("g13_openings", f"""b AS (SELECT {KEY}, count(*) AS bars, CAST(sum(CAST(round(close * 100) AS BIGINT) * volume) AS BIGINT) AS exact_value, CAST(sum(volume) AS BIGINT) AS volume FROM {{wd}} w WHERE slot < 900 GROUP BY {KEY}), h AS (SELECT {KEY}, count(*) AS rth_bars, max(CASE WHEN n <= 2 THEN hi END) AS first_high, min(CASE WHEN n <= 2 THEN lo END) AS first_low, max(cv) AS rth_volume FROM {{pa}} p GROUP BY {KEY})
SELECT h.instrument, CAST(h.trading_day AS STRING) AS trading_day, rth_bars, first_high, first_low, CAST(rth_volume AS BIGINT) AS rth_volume, bars AS overnight_bars, exact_value AS overnight_value_cents, volume AS overnight_volume, round(a, 6) + 0.0 AS a FROM h LEFT JOIN b ON b.instrument = h.instrument AND b.trading_day = h.trading_day LEFT JOIN {{thr}} t ON t.instrument = h.instrument AND t.trading_day = h.trading_day""",
        "What an opening is compared by: first bars, overnight sums in exact cents, volume and the session's range scale.")

# path distances over the first n bars and over the last three of them
P.view("paths", f"SELECT p.instrument, p.trading_day, d, CAST(n AS INT) AS n, net, close - lag(close, 2) OVER (PARTITION BY p.instrument, p.trading_day ORDER BY n) AS recent FROM {{pa}} p JOIN {{days}} t ON t.instrument = p.instrument AND t.trading_day = p.trading_day", STORE)
P.view("apart", f"""j AS (SELECT a.instrument, a.trading_day, e.trading_day AS earlier, e.d AS ed, a.n, (a.net - e.net) * (a.net - e.net) AS d2, abs(a.recent - e.recent) AS dr FROM {{paths}} a CROSS JOIN {OFFSETS} JOIN {{paths}} e ON e.instrument = a.instrument AND e.n = a.n AND e.d = a.d - ahead)
SELECT {KEY}, earlier, ed, n, sqrt(avg(d2) OVER w) AS rms, count(*) OVER w AS bars, dr FROM j WINDOW w AS (PARTITION BY {KEY}, earlier ORDER BY n ROWS UNBOUNDED PRECEDING)""", STORE)
P.view("batch", f"""r AS (SELECT *, greatest(0.0, 1 - rms / 60) AS score, row_number() OVER (PARTITION BY {KEY}, n ORDER BY round(rms, 9), ed DESC) AS rank FROM {{apart}} a WHERE bars = n AND n >= 2) SELECT {KEY}, n, earlier, ed, score, rms, dr, CAST(rank AS INT) AS rank FROM r WHERE rank <= {TOP}""", STORE)
P.query("g18_batch_sets", f"SELECT instrument, {DAY}, n, CAST(earlier AS STRING) AS earlier, round(score, 6) + 0.0 AS score, rank FROM {{batch}} b", "Sets of every session at every window of two bars and more, all in one pass.")
P.query("g14_set_records", f"""SELECT instrument, {DAY}, n, count(*) AS members, round(avg(score), 6) + 0.0 AS mean_score, CASE WHEN count(*) < {TOP} THEN 'thin' WHEN min(score) = 0 THEN 'weak' ELSE 'full' END AS quality, md5(concat(CAST(sum(ed * rank) AS STRING), '|', CAST(count(*) AS STRING))) AS provenance FROM {{batch}} b GROUP BY instrument, trading_day, n""", "One record a set: members, quality and a digest of what it was made from.")
P.query("g16_recent_ranking", f"""r AS (SELECT {KEY}, n, earlier, ed, 0.5 * greatest(0.0, 1 - rms / 60) + 0.5 * greatest(0.0, 1 - dr / 40) AS score FROM {{apart}} a WHERE bars = n AND n = 4), k AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY round(score, 9) DESC, ed DESC) AS rank FROM r)
SELECT k.instrument, CAST(k.trading_day AS STRING) AS trading_day, count(*) AS members, count(s.dir) AS known, round((count(CASE WHEN s.dir = 'bullish' THEN 1 END) + 1) / CAST(count(s.dir) + 3 AS DOUBLE), 6) + 0.0 AS p_bullish, round((count(CASE WHEN s.dir = 'bearish' THEN 1 END) + 1) / CAST(count(s.dir) + 3 AS DOUBLE), 6) + 0.0 AS p_bearish
FROM k LEFT JOIN {{stype}} s ON s.instrument = k.instrument AND s.trading_day = k.earlier WHERE rank <= 10 GROUP BY 1, 2""", "Members ranked by the whole path and its last bars together, and the class frequencies they imply.")

# H9: the cell of a grid that was best on the sessions before
P.view("grid_scores", f"""y AS (SELECT {KEY}, CASE dir WHEN 'bullish' THEN 1e0 WHEN 'bearish' THEN 0e0 ELSE 0.5e0 END AS up FROM {{stype}} s WHERE dir IS NOT NULL),
m AS (SELECT s.instrument, s.trading_day, s.d, k.pool_size, sum(y.up) AS up, count(y.up) AS n FROM {{sets}} s CROSS JOIN (VALUES (1), (3), (5)) k(pool_size) LEFT JOIN y ON y.instrument = s.instrument AND y.trading_day = s.earlier WHERE s.rank <= k.pool_size GROUP BY 1, 2, 3, 4),
c AS (SELECT m.instrument, m.trading_day, m.d, pool_size, q.pseudo, (coalesce(m.up, 0) + 0.5 * q.pseudo) / (m.n + q.pseudo) AS p, y.up AS realised FROM m CROSS JOIN (VALUES (1), (4), (16)) q(pseudo) LEFT JOIN y ON y.instrument = m.instrument AND y.trading_day = m.trading_day),
b AS (SELECT *, (p - realised) * (p - realised) AS brier FROM c)
SELECT {KEY}, d, pool_size, pseudo, p, brier, avg(brier) OVER (PARTITION BY instrument, pool_size, pseudo ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b""")
P.query("h9_pool_tuning", f"""r AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY round(before, 9), pool_size, pseudo) AS k FROM {{grid_scores}} g WHERE before IS NOT NULL)
SELECT instrument, {DAY}, pool_size, pseudo, round(p, 6) + 0.0 AS p, round(brier, 6) + 0.0 AS brier FROM r WHERE k = 1""", "Pool size and pseudo-count of the least mean Brier on earlier sessions, used for the session itself.")
P.query("h15_session_summary", f"""a AS (SELECT {KEY}, max(CASE WHEN label = 'bullish' THEN p END) AS prior_up, max(CASE WHEN label = 'bearish' THEN p END) AS prior_down FROM {{ou}} o WHERE slot = 840 GROUP BY {KEY}),
b AS (SELECT s.instrument, s.trading_day, (count(CASE WHEN t.dir = 'bullish' THEN 1 END) + 1) / CAST(count(t.dir) + 3 AS DOUBLE) AS set_up FROM {{sets}} s LEFT JOIN {{stype}} t ON t.instrument = s.instrument AND t.trading_day = s.earlier GROUP BY 1, 2)
SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, round(prior_up, 6) + 0.0 AS prior_up, round(prior_down, 6) + 0.0 AS prior_down, round(set_up, 6) + 0.0 AS set_up, round(set_up - prior_up, 6) + 0.0 AS difference, round(on_high - cutoff_price, 6) + 0.0 AS to_high, round(cutoff_price - on_low, 6) + 0.0 AS to_low, round(cutoff_price - prev_close, 6) + 0.0 AS context_move
FROM {{rs}} r LEFT JOIN a ON a.instrument = r.instrument AND a.trading_day = r.trading_day LEFT JOIN b ON b.instrument = r.instrument AND b.trading_day = r.trading_day""", "Both arms of a session side by side, with levels and the move since the last close.")
P.query("h19_issue_timing", f"""i AS (SELECT {KEY}, min(slot) AS issued FROM {{wd}} w WHERE slot >= 840 GROUP BY {KEY}), x AS (SELECT i.instrument, i.trading_day, issued, count(CASE WHEN b.slot < issued THEN 1 END) AS seen FROM i LEFT JOIN {{wd}} b ON b.instrument = i.instrument AND b.trading_day = i.trading_day AND b.session_scope = 'RTH' GROUP BY 1, 2, 3)
SELECT instrument, {DAY}, issued - 840 AS after_cutoff, issued - 930 AS after_open, issued > 960 AS reconstructed, seen AS targets_observed FROM x""", "How late each forecast could first be issued, and which targets had been seen by then.")
P.query("h20_delivery_record", f"""r AS (SELECT {KEY}, slot, row_number() OVER (PARTITION BY {KEY} ORDER BY slot) AS first_k, row_number() OVER (PARTITION BY {KEY} ORDER BY CASE WHEN slot <= 930 THEN 0 ELSE 1 END, slot DESC) AS last_k FROM {{hd}} z WHERE h = 4)
SELECT instrument, {DAY}, max(CASE WHEN first_k = 1 THEN slot END) AS first_record, max(CASE WHEN last_k = 1 AND slot <= 930 THEN slot END) AS in_force, count(*) AS records FROM r GROUP BY instrument, trading_day""", "The forecast in force at the open and the first one that was recorded.")

# L: variants, tests, cases
P.view("arms", f"""x AS (SELECT f.instrument, f.trading_day, z.d, f.slot, z.phase, f.h, z.y, m.arm, CASE m.arm WHEN 'seasonal' THEN seasonal WHEN 'long_run' THEN long_run WHEN 'short_run' THEN short_run ELSE reverting END AS var FROM {{four}} f JOIN {{hd}} z ON z.instrument = f.instrument AND z.trading_day = f.trading_day AND z.slot = f.slot AND z.h = f.h CROSS JOIN (VALUES ('seasonal'), ('long_run'), ('short_run'), ('reverting')) m(arm)),
v AS (SELECT *, y / sqrt(var) AS z FROM x WHERE var > 0) SELECT {KEY}, d, slot, phase, h, arm, y, var, z, sqrt(var) * (z * ({_ERF_SQL}) + 2.0 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1.0 / sqrt(pi())) AS crps, 0.5 * (1 + {_ERF_SQL}) AS pit FROM v""", STORE)
P.view("sessions", f"SELECT trading_day, h, arm, avg(crps) AS crps, count(*) AS origins FROM {{arms}} a GROUP BY 1, 2, 3", STORE)
P.view("steps", f"""SELECT a.trading_day, a.h, a.arm, row_number() OVER (PARTITION BY a.h, a.arm ORDER BY a.trading_day) - 1 AS i, a.crps - b.crps AS diff FROM {{sessions}} a JOIN {{sessions}} b ON b.trading_day = a.trading_day AND b.h = a.h AND b.arm = 'seasonal' WHERE a.arm <> 'seasonal'""", STORE)
P.query("l9_horizon_summary", """SELECT a.h, a.arm, count(*) AS sessions, CAST(sum(a.origins) AS BIGINT) AS origins, round(avg(a.crps), 6) + 0.0 AS crps, round(avg(a.crps - b.crps), 6) + 0.0 AS step, count(CASE WHEN a.crps < b.crps THEN 1 END) AS improved FROM {sessions} a JOIN {sessions} b ON b.trading_day = a.trading_day AND b.h = a.h AND b.arm = 'seasonal' GROUP BY 1, 2""", "The variants by horizon, and each one's paired step from the seasonal one.")
P.query("l22_identical_origins", f"""a AS (SELECT {KEY}, slot, h, z FROM {{arms}} x WHERE arm = 'short_run'), b AS (SELECT {KEY}, slot, h, z FROM {{arms}} y WHERE arm = 'reverting')
SELECT coalesce(a.h, b.h) AS h, count(*) AS origins, count(CASE WHEN a.z IS NULL THEN 1 END) AS only_second, count(CASE WHEN b.z IS NULL THEN 1 END) AS only_first, count(CASE WHEN abs(a.z - b.z) > 0.5 THEN 1 END) AS far_apart, round(avg(abs(a.z - b.z)), 6) + 0.0 AS mean_apart FROM a FULL OUTER JOIN b ON b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot = a.slot AND b.h = a.h GROUP BY 1""", "Two runs on identical origins: those only one of them has, and how far they disagree.")
P.query("l37_design_effect", """b AS (SELECT h, arm, CAST(floor(i / 4) AS BIGINT) AS block, avg(diff) AS m, count(*) AS n FROM {steps} s GROUP BY 1, 2, 3), v AS (SELECT h, arm, var_samp(m) AS between_blocks, count(*) AS blocks FROM b WHERE n = 4 GROUP BY 1, 2), t AS (SELECT h, arm, var_samp(diff) AS overall FROM {steps} s GROUP BY 1, 2)
SELECT v.h, v.arm, blocks, round(between_blocks / (overall / 4), 6) + 0.0 AS ratio FROM v JOIN t ON t.h = v.h AND t.arm = v.arm WHERE overall > 0 AND blocks > 1""", "How much more block means vary than independent sessions would.")
P.query("l29_session_differences", """a AS (SELECT trading_day, h, phase, arm, avg(crps) AS crps FROM {arms} x GROUP BY 1, 2, 3, 4)
SELECT a.h, a.phase, a.arm, count(*) AS sessions, round(avg(a.crps - b.crps), 6) + 0.0 AS difference, CASE WHEN count(*) < 5 THEN 'too few' WHEN avg(a.crps - b.crps) < 0 AND count(CASE WHEN a.crps < b.crps THEN 1 END) >= 0.6 * count(*) THEN 'better' WHEN avg(a.crps - b.crps) > 0 AND count(CASE WHEN a.crps > b.crps THEN 1 END) >= 0.6 * count(*) THEN 'worse' ELSE 'undecided' END AS decision
FROM a JOIN a b ON b.trading_day = a.trading_day AND b.h = a.h AND b.phase = a.phase AND b.arm = 'seasonal' WHERE a.arm <> 'seasonal' GROUP BY 1, 2, 3""", "Session differences by horizon and phase, and what they decide.")
P.query("l31_conditional_arms", f"""x AS (SELECT a.trading_day, a.h, a.arm, f.release_ahead AS bucket, avg(a.crps) AS crps FROM {{arms}} a JOIN {{frames}} f ON f.instrument = a.instrument AND f.trading_day = a.trading_day AND f.slot = a.slot AND f.h = a.h GROUP BY 1, 2, 3, 4)
SELECT x.h, x.arm, x.bucket AS release_ahead, count(*) AS sessions, round(avg(x.crps), 6) + 0.0 AS crps, round(avg(x.crps - b.crps), 6) + 0.0 AS difference, avg(x.crps - b.crps) < 0 AS helps FROM x JOIN x b ON b.trading_day = x.trading_day AND b.h = x.h AND b.bucket = x.bucket AND b.arm = 'seasonal' WHERE x.arm <> 'seasonal' GROUP BY 1, 2, 3""", "Arms within buckets of a condition: with a release ahead, and without.")
P.query("l41_fold_scores", """f AS (SELECT CAST(floor((d - 1) / 5) AS BIGINT) AS fold, h, arm, avg(crps) AS crps, count(*) AS n FROM {arms} a GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY fold, h ORDER BY round(crps, 9), arm) AS k FROM f)
SELECT fold, h, arm, n, round(crps, 6) + 0.0 AS crps, k = 1 AS chosen FROM r""", "Every arm's score in each fold, and which one the fold would choose.")
P.query("l34_issue_scores", f"""m AS (SELECT {KEY}, slot, h, max(CASE WHEN arm = 'reverting' THEN crps END) AS issued, max(CASE WHEN arm = 'reverting' THEN pit END) AS pit, max(CASE WHEN arm = 'short_run' THEN crps END) AS revised, max(CASE WHEN arm = 'short_run' THEN pit END) AS revised_pit, max(y) AS y FROM {{arms}} a WHERE slot IN (240, 480, 720, 900, 1140) GROUP BY {KEY}, slot, h)
SELECT instrument, {DAY}, slot, h, round(y, 6) + 0.0 AS move, round(issued, 6) + 0.0 AS crps, round(pit, 6) + 0.0 AS pit, round(revised, 6) + 0.0 AS revised_crps, round(revised_pit, 6) + 0.0 AS revised_pit FROM m""", "Realised move, score and probability transform of every issue at its mark and of its revision.")
P.view("marks", f"""k AS (SELECT t.instrument, t.trading_day, t.d, m.mark FROM {{days}} t CROSS JOIN (VALUES (240), (480), (720), (900), (1140)) m(mark)), b AS (SELECT k.instrument, k.trading_day, k.d, k.mark, max(CASE WHEN w.slot <= k.mark THEN w.slot END) AS seen, min(CASE WHEN w.slot >= k.mark THEN w.slot END) AS next_bar FROM k LEFT JOIN {{wd}} w ON w.instrument = k.instrument AND w.trading_day = k.trading_day GROUP BY 1, 2, 3, 4)
SELECT b.instrument, b.trading_day, b.d, b.mark, seen, next_bar, z.var FROM b LEFT JOIN {{hd}} z ON z.instrument = b.instrument AND z.trading_day = b.trading_day AND z.slot = b.mark AND z.h = 4""", STORE)
P.query("l32_forward_marks", f"""SELECT instrument, mark, count(*) AS expected, count(seen) AS attempted, count(CASE WHEN seen = mark AND var IS NOT NULL THEN 1 END) AS issued, count(CASE WHEN seen < mark AND var IS NOT NULL THEN 1 END) AS stale, count(CASE WHEN var IS NULL THEN 1 END) AS missed FROM {{marks}} m GROUP BY 1, 2""", "Marks expected, attempted, issued, stale and missed.")
P.query("l33_horizon_class", f"""SELECT instrument, {DAY}, mark, q.h, CASE WHEN next_bar IS NULL THEN 'expired' WHEN next_bar = mark THEN 'live' WHEN next_bar - mark >= 60 * q.h THEN 'expired' WHEN 2 * (next_bar - mark) >= 60 * q.h THEN 'late' ELSE 'delayed' END AS class FROM {{marks}} m CROSS JOIN (VALUES (1), (4)) q(h)""", "What is left of each horizon by the time its mark's bar arrives.")
P.view("member_moves", f"""p AS (SELECT {KEY}, max(CASE WHEN slot = 960 THEN open END) AS a, max(CASE WHEN slot = 1140 THEN close END) AS z, count(CASE WHEN slot BETWEEN 960 AND 1140 THEN 1 END) AS bars, max(slot) AS newest FROM {{wd}} w GROUP BY {KEY}), q AS (SELECT instrument, max(trading_day) AS last_day FROM {{wd}} w GROUP BY 1)
SELECT p.instrument, p.trading_day, bars, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN z - a END AS move, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN 'complete' WHEN p.trading_day = last_day AND newest < 1140 THEN 'pending' ELSE 'missing' END AS state FROM p JOIN q ON q.instrument = p.instrument""", STORE)
P.query("l25_member_moves", f"""SELECT m.instrument, CAST(m.trading_day AS STRING) AS trading_day, bars, round(move, 6) + 0.0 AS move, round(move / a, 6) + 0.0 AS move_in_ranges, state FROM {{member_moves}} m LEFT JOIN {{thr}} t ON t.instrument = m.instrument AND t.trading_day = m.trading_day""", "A session's move over a clock window, complete, pending or missing.")
P.query("l26_analogue_arms", f"""s AS (SELECT x.instrument, x.trading_day, 'top5' AS arm, earlier, 1.0 / rank AS weight FROM {{sets}} x UNION ALL SELECT y.instrument, y.trading_day, 'top2' AS arm, earlier, 1.0 AS weight FROM {{sets}} y WHERE rank <= 2 UNION ALL SELECT b.instrument, b.trading_day, 'path4' AS arm, earlier, 1.0 AS weight FROM {{batch}} b WHERE n = 4 UNION ALL SELECT t.instrument, t.trading_day, 'same_clock' AS arm, e.trading_day AS earlier, 1.0 AS weight FROM {{days}} t CROSS JOIN {OFFSETS} JOIN {{days}} e ON e.instrument = t.instrument AND e.d = t.d - ahead)
SELECT s.instrument, CAST(s.trading_day AS STRING) AS trading_day, arm, count(*) AS members, count(move) AS known, round(sum(weight * move) / nullif(sum(CASE WHEN move IS NOT NULL THEN weight END), 0), 6) + 0.0 AS forecast FROM s LEFT JOIN {{member_moves}} m ON m.instrument = s.instrument AND m.trading_day = s.earlier GROUP BY 1, 2, 3""", "Analogue forecasts by arm: similar sessions, paths, and the same clock of the sessions before.")
P.query("l27_case_reasons", f"""w AS (SELECT t.instrument, t.trading_day, c.cutoff, q.h FROM {{days}} t CROSS JOIN (VALUES (480), (900), (1140)) c(cutoff) CROSS JOIN (VALUES (1), (4)) q(h)), b AS (SELECT {KEY}, slot FROM {{wd}} x)
SELECT w.cutoff, w.h, CASE WHEN b.slot IS NULL THEN 'no bar at cutoff' WHEN z.var IS NULL AND e.slot IS NULL THEN 'no closing bar' WHEN z.var IS NULL THEN 'no fitted variance' ELSE 'scored' END AS reason, count(*) AS cases, round(avg(z.z * z.z), 6) + 0.0 AS z2 FROM w LEFT JOIN b ON b.instrument = w.instrument AND b.trading_day = w.trading_day AND b.slot = w.cutoff
LEFT JOIN b e ON e.instrument = w.instrument AND e.trading_day = w.trading_day AND e.slot = w.cutoff + 60 * w.h LEFT JOIN {{hd}} z ON z.instrument = w.instrument AND z.trading_day = w.trading_day AND z.slot = w.cutoff AND z.h = w.h GROUP BY 1, 2, 3""", "Every session, cutoff and horizon with its score or the first reason it has none.")
P.query("l28_availability", f"""SELECT instrument, mark, count(*) AS n, round(count(CASE WHEN seen = mark THEN 1 END) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS on_time, round(count(var) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS available, percentile_cont(0.5) WITHIN GROUP (ORDER BY next_bar - mark) AS median_wait FROM {{marks}} m GROUP BY 1, 2""", "How often a mark's input was there on time, and how long it took.")
P.query("l30_first_hit_scores", f"""o AS (SELECT a.instrument, a.trading_day, a.slot, min(CASE WHEN b.high >= a.close + 15 THEN b.slot END) AS u, min(CASE WHEN b.low <= a.close - 15 THEN b.slot END) AS d FROM {{wd}} a LEFT JOIN {{wd}} b ON b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot > a.slot AND b.slot <= a.slot + 240 GROUP BY 1, 2, 3),
y AS (SELECT o.instrument, o.trading_day, o.slot, g.side, CASE WHEN u IS NULL AND d IS NULL THEN 'neither' WHEN u = d THEN g.side WHEN d IS NULL OR u < d THEN 'up' ELSE 'down' END AS hit FROM o CROSS JOIN (VALUES ('up'), ('down')) g(side)),
c AS (SELECT y.*, m.cls, count(*) OVER w AS n, sum(CASE WHEN hit = m.cls THEN 1 ELSE 0 END) OVER w AS k FROM y CROSS JOIN (VALUES ('up'), ('down'), ('neither')) m(cls) WINDOW w AS (PARTITION BY instrument, slot, side, m.cls ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (coalesce(k, 0) + 1) / CAST(n + 3 AS DOUBLE) AS p FROM c), q AS (SELECT *, avg(p) OVER (PARTITION BY instrument, trading_day, slot, side, cls = 'neither') AS sp FROM p)
SELECT instrument, side AS ambiguous_as, count(*) / 3 AS cases, round(sum((p - CASE WHEN hit = cls THEN 1 ELSE 0 END) * (p - CASE WHEN hit = cls THEN 1 ELSE 0 END)) / (count(*) / 3), 6) + 0.0 AS brier, round(sum((sp - CASE WHEN hit = cls THEN 1 ELSE 0 END) * (sp - CASE WHEN hit = cls THEN 1 ELSE 0 END)) / (count(*) / 3), 6) + 0.0 AS symmetric_brier FROM q GROUP BY 1, 2""", "First-hit forecasts from earlier sessions, scored with every ambiguous bar counted up and counted down.")
P.view("class_scores", f"""s AS (SELECT {KEY}, slot, sum((p - hit) * (p - hit)) AS brier, max(CASE WHEN hit = 1 THEN -ln(p) END) AS log_loss, max(p) AS top, max(CASE WHEN hit = 1 THEN p END) AS right_p FROM {{ou}} o GROUP BY {KEY}, slot) SELECT * FROM s""", STORE)
P.query("l19_experiment", f"""g AS (SELECT instrument, trading_day, avg(brier) AS brier, avg(log_loss) AS log_loss, avg(CASE WHEN right_p = top THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) AS cases FROM {{class_scores}} c GROUP BY 1, 2)
SELECT instrument, count(*) AS sessions, CAST(sum(cases) AS BIGINT) AS cases, round(avg(brier), 6) + 0.0 AS brier, round(avg(log_loss), 6) + 0.0 AS log_loss, round(avg(accuracy), 6) + 0.0 AS accuracy, round(avg(brier) - CAST(2 AS DOUBLE) / 3, 6) + 0.0 AS against_uniform, count(CASE WHEN brier < CAST(2 AS DOUBLE) / 3 - 0.000001 THEN 1 END) AS improved, avg(brier) < CAST(2 AS DOUBLE) / 3 - 0.005 AS claim FROM g GROUP BY 1""", "An experiment from cases to claim: session means, paired difference from the uniform forecast, and the decision.")
P.query("l42_multi_target", f"""t AS (SELECT instrument, trading_day, CASE WHEN slot < 360 THEN 'evening' WHEN slot < 840 THEN 'night' WHEN slot < 1320 THEN 'day' ELSE 'after' END AS target, avg(brier) AS model FROM {{class_scores}} c GROUP BY 1, 2, 3), b AS (SELECT instrument, trading_day, avg(brier) AS overall FROM {{class_scores}} c GROUP BY 1, 2)
SELECT t.instrument, target, count(*) AS sessions, round(avg(model), 6) + 0.0 AS brier, round(avg(model - overall), 6) + 0.0 AS against_overall, round(avg(model) - CAST(2 AS DOUBLE) / 3, 6) + 0.0 AS against_uniform, avg(model - overall) < 0 AND avg(model) < CAST(2 AS DOUBLE) / 3 AS claim FROM t JOIN b ON b.instrument = t.instrument AND b.trading_day = t.trading_day GROUP BY 1, 2""", "Targets side by side; a claim needs both baselines beaten.")
P.query("l17_calibration_error", """b AS (SELECT label, least(CAST(floor(round(p, 9) * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(hit) AS observed FROM {ou} o GROUP BY 1, 2) SELECT label, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_p - observed)) / sum(n), 6) + 0.0 AS ece FROM b GROUP BY 1""", "The expected calibration error of each class.")
P.query("l21_leave_one_week_out", """g AS (SELECT trading_day, date_trunc('week', trading_day) AS week, avg(brier) - CAST(2 AS DOUBLE) / 3 AS d FROM {class_scores} c GROUP BY 1, 2), w AS (SELECT week, sum(d) AS s, count(*) AS n FROM g GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM w)
SELECT substr(CAST(week AS STRING), 1, 10) AS week, w.n AS sessions, round((t.s - w.s) / nullif(t.n - w.n, 0), 6) + 0.0 AS without_it, round(w.s / t.s, 6) + 0.0 AS share FROM w CROSS JOIN t""", "The mean difference when each week is left out, and the week's share of the whole.")
P.query("k23_temperature", f"""b AS (SELECT {KEY}, slot, label, hit, pow(p, m.tau) AS q, m.tau FROM {{ou}} o CROSS JOIN (VALUES (0.5), (0.75), (1.0), (1.25), (1.5), (2.0)) m(tau)), s AS (SELECT *, q / sum(q) OVER (PARTITION BY {KEY}, slot, tau) AS p FROM b),
g AS (SELECT instrument, trading_day, tau, avg((p - hit) * (p - hit)) * 3 AS brier FROM s GROUP BY 1, 2, 3), d AS (SELECT g.instrument, g.trading_day, t.d, CAST(floor((t.d - 1) / 5) AS BIGINT) AS block, tau, brier FROM g JOIN {{days}} t ON t.instrument = g.instrument AND t.trading_day = g.trading_day),
e AS (SELECT instrument, block, tau, sum(brier) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3), o AS (SELECT instrument, tau, sum(s) AS s, sum(n) AS n FROM e GROUP BY 1, 2), x AS (SELECT e.instrument, e.block, e.tau, (o.s - e.s) / nullif(o.n - e.n, 0) AS others FROM e JOIN o ON o.instrument = e.instrument AND o.tau = e.tau), r AS (SELECT *, row_number() OVER (PARTITION BY instrument, block ORDER BY round(others, 9), tau) AS k FROM x)
SELECT instrument, block, CAST(tau AS DOUBLE) AS tau, round(others, 6) + 0.0 AS brier FROM r WHERE k = 1""", "The temperature of each block of sessions, chosen on all other blocks.")
