"""Groups I and J, second part: what a forecast of a session knows from the sessions before it, and features at every origin.

A value serves the sessions after it: history is joined to its targets by session number plus an offset (an equi-join), never by a
range over dates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import trailing_quantiles
from ..plans import Portable
from ..sources import stored
from .fan import HOR_SQL, SEASON_SQL, SHORT_SQL, scored_origins, seasonal, short_level
from .features import RV_SQL, realised, usual
from .session_labels import DAY, KEY
from .structure import P as STRUCTURE
from .structure import STORE, ema

QUERIES: dict = {}
SQL: dict = {}
P = Portable(QUERIES, SQL, STRUCTURE)
P.base("sv", seasonal, SEASON_SQL)
P.base("sl", lambda spark, sf: short_level(seasonal(spark, sf)), SHORT_SQL)
P.base("hz", scored_origins, HOR_SQL)
P.base("us", lambda spark, sf: usual(realised(spark, sf), "rv", ["instrument", "slot"]), RV_SQL)

#: Sessions of history of a shape.
HISTORY = 120
#: Sessions before each that pairs of sessions reach back.
OFFSETS = "(VALUES " + ", ".join(f"({k})" for k in range(1, 21)) + ") f(ahead)"


def days_text(bars: str) -> str:
    """The sessions of a relation of bars, numbered by instrument."""
    return f"SELECT {KEY}, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS d FROM (SELECT DISTINCT {KEY} FROM {{{bars}}} w) x"


P.view("days", days_text("wd"))
P.view("hd", f"SELECT z.instrument, z.trading_day, d, slot, phase, h, var, y, z FROM {{hz}} z JOIN {{days}} t ON t.instrument = z.instrument AND t.trading_day = z.trading_day", STORE)


def half_ranges(spark, sf_dir):
    """Half the distance between symmetric quantiles of the standardised errors of the HISTORY sessions before each, from 40 errors at least."""
    errors, days = P.relation("hd", spark, sf_dir), P.relation("days", spark, sf_dir)
    targets = days.join(errors.select("instrument", "h").distinct(), "instrument")
    q = trailing_quantiles(errors, targets, ["instrument", "h"], "d", "z", [0.05, 0.25, 0.75, 0.95], HISTORY).where("n >= 40")
    return q.join(days, ["instrument", "d"]).select("instrument", "trading_day", "d", "h", "n", ((F.col("q")[2] - F.col("q")[1]) / 2).alias("q75"), ((F.col("q")[3] - F.col("q")[0]) / 2).alias("q95"))


def phase_medians(spark, sf_dir):
    """The median absolute error of the HISTORY sessions before each by horizon (phase '') and by horizon and phase."""
    errors, days = P.relation("hd", spark, sf_dir), P.relation("days", spark, sf_dir)
    errors = errors.select("instrument", "d", "h", F.explode(F.array(F.lit(""), "phase")).alias("phase"), F.abs("z").alias("a"))
    targets = days.join(errors.select("instrument", "h", "phase").distinct(), "instrument")
    q = trailing_quantiles(errors, targets, ["instrument", "h", "phase"], "d", "a", [0.5], HISTORY)
    return q.join(days, ["instrument", "d"]).select("instrument", "trading_day", "h", "phase", "n", F.col("q")[0].alias("m"))


_BEFORE = f"{{hd}} z JOIN {{days}} t ON t.instrument = z.instrument AND z.d BETWEEN t.d - {HISTORY} AND t.d - 1"
P.base("half_ranges", lambda spark, sf: stored(spark, sf, "view-half-ranges", lambda: half_ranges(spark, sf)), f"""half_ranges AS (
SELECT t.instrument, t.trading_day, t.d, h, count(*) AS n, (quantile_cont(z.z, 0.75) - quantile_cont(z.z, 0.25)) / 2 AS q75, (quantile_cont(z.z, 0.95) - quantile_cont(z.z, 0.05)) / 2 AS q95
FROM {_BEFORE} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 40)""")
P.base("phase_medians", lambda spark, sf: stored(spark, sf, "view-phase-medians", lambda: phase_medians(spark, sf)), f"""phase_medians AS (
SELECT t.instrument, t.trading_day, h, '' AS phase, count(*) AS n, median(abs(z.z)) AS m FROM {_BEFORE} GROUP BY 1, 2, 3
UNION ALL SELECT t.instrument, t.trading_day, h, phase, count(*) AS n, median(abs(z.z)) AS m FROM {_BEFORE} GROUP BY 1, 2, 3, 4)""")
P.query("i13_quantile_shape", f"SELECT instrument, {DAY}, h, n, round(q75, 6) + 0.0 AS q75, round(q95, 6) + 0.0 AS q95 FROM {{half_ranges}} s", "Symmetric quantiles of the standardised errors of the HISTORY sessions before each.")
P.query("i14_shape_interpolated", f"""k AS (SELECT {KEY}, max(CASE WHEN h = 1 THEN q75 END) AS a75, max(CASE WHEN h = 4 THEN q75 END) AS b75, max(CASE WHEN h = 1 THEN q95 END) AS a95, max(CASE WHEN h = 4 THEN q95 END) AS b95 FROM {{half_ranges}} s GROUP BY {KEY})
SELECT instrument, {DAY}, m.h, round(a75 + (b75 - a75) * ln(m.h) / ln(4), 6) + 0.0 AS q75, round(a95 + (b95 - a95) * ln(m.h) / ln(4), 6) + 0.0 AS q95 FROM k CROSS JOIN (VALUES (1), (2), (3), (4)) m(h) WHERE a95 IS NOT NULL AND b95 IS NOT NULL""", "Any horizon's quantiles between two knots, linear in the logarithm of time, as of each session.")
P.query("i17_phase_scale", """
SELECT p.instrument, CAST(p.trading_day AS STRING) AS trading_day, p.h, p.phase, p.n, round(CASE WHEN p.n >= 10 THEN p.m ELSE g.m END / s.q75, 6) + 0.0 AS scale
FROM {phase_medians} p JOIN {phase_medians} g ON g.instrument = p.instrument AND g.trading_day = p.trading_day AND g.h = p.h AND g.phase = '' AND p.phase <> ''
JOIN {half_ranges} s ON s.instrument = p.instrument AND s.trading_day = p.trading_day AND s.h = p.h WHERE s.q75 > 0""",
        "Median absolute error over the shape's quartile by phase, from the sessions before; a phase with few values takes the horizon's.")
P.view("scales", f"""g AS (SELECT instrument, trading_day, d, h, m.m, sum(abs(abs(y) - m.m * sqrt(var))) AS loss, count(*) AS n FROM {{hd}} z CROSS JOIN (VALUES (0.25), (0.5), (0.75), (1.0), (1.5), (2.0)) m(m) GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT {KEY}, d, h, m, sum(loss) OVER w AS loss, sum(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY instrument, h, m ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {KEY}, h, CAST(min_by(m, loss) AS DOUBLE) AS scale, min(loss / n) AS loss FROM r WHERE n > 0 GROUP BY {KEY}, h""", STORE)
P.query("i19_constant_scale", f"SELECT instrument, {DAY}, h, scale, round(loss, 6) + 0.0 AS loss FROM {{scales}} s", "The best of a grid of multipliers on all sessions before each: running sums of each multiplier's loss.")

# Release multipliers by group and bucket, and by name, from the sessions before
P.view("windows", """SELECT source, name, tier, trading_day, slot, bucket, slot + moved AS at_slot FROM {releases} r CROSS JOIN (VALUES ('at', 0), ('after', 60), ('late', 120)) b(bucket, moved) WHERE slot + moved <= 1320""")
P.view("touched", f"""x AS (SELECT w.source, w.name, w.trading_day, bucket, sum(r * r) AS real, sum(s) AS expected, avg(s) AS mean_s FROM {{windows}} w JOIN {{sv}} v ON v.trading_day = w.trading_day AND v.slot = w.at_slot WHERE r IS NOT NULL AND s > 0 GROUP BY 1, 2, 3, 4) SELECT * FROM x""", STORE)
P.view("group_mult", """g AS (SELECT source, bucket, trading_day, sum(real) AS real, sum(expected) AS expected, avg(mean_s) AS m FROM {touched} t GROUP BY 1, 2, 3),
r AS (SELECT source, bucket, trading_day, sum(real) OVER w AS real, sum(expected) OVER w AS expected, avg(m) OVER w AS m FROM g WINDOW w AS (PARTITION BY source, bucket ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, bucket, trading_day, least(20.0, greatest(0.5, coalesce((real + 5 * m) / (expected + 5 * m), 1.0))) AS multiplier FROM r""")
P.query("i4_group_multipliers", f"SELECT source, bucket, {DAY}, round(multiplier, 6) + 0.0 AS multiplier FROM {{group_mult}} g", "Realised over expected variance after releases by group and bucket, shrunk to one, from the days before.")
P.view("name_mult", """n AS (SELECT source, name, bucket, trading_day, sum(real) OVER w AS real, sum(expected) OVER w AS expected, avg(mean_s) OVER w AS m, count(*) OVER w AS n FROM {touched} t WINDOW w AS (PARTITION BY source, name, bucket ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n.source, n.name, n.bucket, n.trading_day, n.n, CASE WHEN n.n = 0 THEN g.multiplier ELSE least(20.0, greatest(0.5, (n.real + 3 * n.m * g.multiplier) / (n.expected + 3 * n.m))) END AS multiplier FROM n JOIN {group_mult} g ON g.source = n.source AND g.bucket = n.bucket AND g.trading_day = n.trading_day""")
P.query("i5_name_multipliers", f"SELECT source, name, bucket, {DAY}, n, round(multiplier, 6) + 0.0 AS multiplier FROM {{name_mult}} m", "Multipliers of each release name, shrunk to its group's.")
P.view("profile", f"""m AS (SELECT w.trading_day, w.at_slot, max(multiplier) AS e FROM {{windows}} w JOIN {{name_mult}} n ON n.source = w.source AND n.name = w.name AND n.bucket = w.bucket AND n.trading_day = w.trading_day GROUP BY 1, 2)
SELECT g.instrument, g.trading_day, g.slot, coalesce(m.e, 1.0) AS e FROM {{grid}} g LEFT JOIN m ON m.trading_day = g.trading_day AND m.at_slot = g.slot""", STORE)
P.query("i6_event_profile", f"SELECT instrument, {DAY}, slot, round(e, 6) + 0.0 AS e FROM {{profile}} p", "The largest multiplier that covers a slot, one where none does.")
P.query("i1_releases_on_grid", f"""SELECT r.source, name, tier, CAST(r.trading_day AS STRING) AS trading_day, CASE WHEN r.source = 'error' THEN 1320 ELSE slot END AS slot, CASE WHEN r.source = 'error' THEN 'earnings' WHEN tier = 'high' THEN 'major' ELSE 'minor' END AS release_group, c.source IS NOT NULL AS coverage_known
FROM {{releases}} r LEFT JOIN {{covered}} c ON c.source = r.source AND c.trading_day = r.trading_day""", "Releases placed on the day's grid with their group; those without a time of day are anchored at the close.")

# I7, I9, I10
P.view("long_level", f"""e AS (SELECT {KEY}, sum(r * r) AS real, sum(s) AS expected FROM {{sv}} v WHERE r IS NOT NULL AND s IS NOT NULL GROUP BY {KEY}), d AS (SELECT t.instrument, t.trading_day, t.d, real, expected FROM {{days}} t LEFT JOIN e ON e.instrument = t.instrument AND e.trading_day = t.trading_day)
SELECT {KEY}, d, count(real) OVER w AS fitted, least(4.0, greatest(0.25, coalesce(sum(real) OVER w / nullif(sum(expected) OVER w, 0), 1.0))) AS long_level FROM d WINDOW w AS (PARTITION BY instrument ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", STORE)
P.query("i9_walk_forward_fit", f"""s AS (SELECT {KEY}, count(s) AS slots, avg(s) AS mean_s FROM {{sv}} v GROUP BY {KEY}), g AS (SELECT trading_day, avg(multiplier) AS multiplier FROM {{group_mult}} m GROUP BY 1)
SELECT l.instrument, CAST(l.trading_day AS STRING) AS trading_day, d - 1 AS history, slots, round(mean_s, 6) + 0.0 AS mean_s, round(long_level, 6) + 0.0 AS long_level, round(coalesce(multiplier, 1.0), 6) + 0.0 AS multiplier, CASE WHEN d <= 5 THEN 'too little history' WHEN slots = 0 THEN 'no fitted variance' ELSE 'fitted' END AS status
FROM {{long_level}} l LEFT JOIN s ON s.instrument = l.instrument AND s.trading_day = l.trading_day LEFT JOIN g ON g.trading_day = l.trading_day""", "The model of every session, fitted from earlier sessions only, all sessions in one pass.")
P.view("four", f"""p AS (SELECT v.instrument, v.trading_day, v.slot, v.s * e.e AS s, v.level, l.long_level FROM {{sl}} v JOIN {{profile}} e ON e.instrument = v.instrument AND e.trading_day = v.trading_day AND e.slot = v.slot JOIN {{long_level}} l ON l.instrument = v.instrument AND l.trading_day = v.trading_day),
a AS (SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(s, 3) OVER w AS s3, lead(s, 4) OVER w AS s4 FROM p WINDOW w AS (PARTITION BY {KEY} ORDER BY slot))
SELECT {KEY}, slot, m.h, CASE WHEN m.h = 1 THEN s1 ELSE s1 + s2 + s3 + s4 END AS seasonal, CASE WHEN m.h = 1 THEN s1 ELSE s1 + s2 + s3 + s4 END * long_level AS long_run, CASE WHEN m.h = 1 THEN s1 ELSE s1 + s2 + s3 + s4 END * level AS short_run,
  CASE WHEN m.h = 1 THEN s1 * (long_level + (level - long_level) * 0.9) ELSE s1 * (long_level + (level - long_level) * 0.9) + s2 * (long_level + (level - long_level) * 0.81) + s3 * (long_level + (level - long_level) * 0.729) + s4 * (long_level + (level - long_level) * 0.6561) END AS reverting FROM a CROSS JOIN (VALUES (1), (4)) m(h)""", STORE)
P.query("i10_four_variants", f"SELECT instrument, {DAY}, slot, h, round(seasonal, 6) + 0.0 AS seasonal, round(long_run, 6) + 0.0 AS long_run, round(short_run, 6) + 0.0 AS short_run, round(reverting, 6) + 0.0 AS reverting FROM {{four}} f WHERE reverting IS NOT NULL", "Horizon variances: seasonal with releases, scaled by the long level, by the short level, and reverting from the short to the long one.")

# I15, I18, I20 to I23
P.view("frames", f"""r AS (SELECT trading_day, slot, count(*) AS releases FROM {{releases}} q GROUP BY 1, 2),
g AS (SELECT g.instrument, g.trading_day, g.slot, coalesce(releases, 0) AS c FROM {{grid}} g LEFT JOIN r ON r.trading_day = g.trading_day AND r.slot = g.slot),
a AS (SELECT {KEY}, slot, lead(c, 1) OVER (PARTITION BY {KEY} ORDER BY slot) AS ahead1, max(c) OVER (PARTITION BY {KEY} ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead4 FROM g)
SELECT z.instrument, z.trading_day, z.d, z.slot, z.phase, z.h, z.var, z.y, z.z, s.q75, s.q95, CASE WHEN z.h = 1 THEN ahead1 ELSE ahead4 END > 0 AS release_ahead
FROM {{hd}} z JOIN a ON a.instrument = z.instrument AND a.trading_day = z.trading_day AND a.slot = z.slot
LEFT JOIN {{half_ranges}} s ON s.instrument = z.instrument AND s.trading_day = z.trading_day AND s.h = z.h""", STORE)
P.query("i15_baseline_frames", f"SELECT instrument, {DAY}, slot, h, round(var, 6) + 0.0 AS var, round(q75, 6) + 0.0 AS q75, round(q95, 6) + 0.0 AS q95, release_ahead FROM {{frames}} f", "Variance, shape and whether a release lies ahead, for every origin and horizon.")
P.view("scaled", f"""c AS (SELECT f.*, CASE WHEN f.phase = 'open' THEN 1.0 ELSE 0.0 END AS is_open, CASE WHEN release_ahead THEN 1.0 ELSE 0.0 END AS is_release, b0, b1, b2 FROM {{frames}} f JOIN (VALUES (1, 0.05, -0.10, 0.20), (4, 0.02, -0.05, 0.10)) b(h, b0, b1, b2) ON b.h = f.h)
SELECT {KEY}, d, slot, h, y, var, z, exp(least(1.5, greatest(-1.5, b0 + b1 * is_open + b2 * is_release))) AS mult FROM c""")
P.query("i18_scaled_fan", f"SELECT instrument, {DAY}, slot, h, round(mult, 6) + 0.0 AS mult, round(sqrt(var) * mult, 6) + 0.0 AS sigma FROM {{scaled}} s", "The fan scaled by stored linear coefficients: the exponential of a clipped sum of products.")
P.query("i20_residual_shape", """b AS (SELECT instrument, h, CAST(floor((d - 1) / 5) AS INT) AS block, z / mult AS e FROM {scaled} s) SELECT instrument, h, block + 1 AS block, count(*) AS n, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY e), 6) + 0.0 AS q25, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY e), 6) + 0.0 AS q75 FROM b GROUP BY 1, 2, 3""", "Residual quantiles of chronological blocks of five sessions; each block's shape serves the next.")
P.query("i21_display_columns", f"""s AS (SELECT {KEY}, d, h, sum(abs(y)) AS flat, sum(abs(abs(y) - 0.6744897501960817 * sqrt(var))) AS miss FROM {{hd}} z GROUP BY {KEY}, d, h), k AS (SELECT {KEY}, h, 1 - sum(miss) OVER w / nullif(sum(flat) OVER w, 0) AS skill FROM s WINDOW w AS (PARTITION BY instrument, h ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
p AS (SELECT {KEY}, max(CASE WHEN h = 1 THEN skill END) AS k1, max(CASE WHEN h = 4 THEN skill END) AS k4 FROM k GROUP BY {KEY}), o AS (SELECT {KEY}, max(CASE WHEN slot = 900 AND h = 1 THEN var END) AS v1, max(CASE WHEN slot = 900 AND h = 4 THEN var END) AS v4, max(CASE WHEN slot = 900 AND h = 4 THEN CASE WHEN release_ahead THEN 1 ELSE 0 END END) AS releases FROM {{frames}} f GROUP BY {KEY})
SELECT o.instrument, CAST(o.trading_day AS STRING) AS trading_day, m.n AS candle, round(sqrt(v1 + (v4 - v1) * (m.n - 1) / 3.0), 6) + 0.0 AS sigma, round(k1 + (k4 - k1) * ln(m.n) / ln(4), 6) + 0.0 AS confidence, releases FROM o JOIN p ON p.instrument = o.instrument AND p.trading_day = o.trading_day CROSS JOIN (VALUES (1), (2), (3), (4)) m(n) WHERE v4 >= v1""", "A column for each display candle after the cutoff: sigma and confidence interpolated between measured horizons.")
P.query("i22_recorded_or_computed", f"""m AS (SELECT instrument, max(trading_day) AS newest FROM {{hd}} x GROUP BY 1), r AS (SELECT z.instrument, z.trading_day, z.slot, z.h, z.var FROM {{hd}} z JOIN m ON m.instrument = z.instrument WHERE z.trading_day < newest AND z.slot IN (240, 480, 720, 900, 1140))
SELECT z.instrument, CAST(z.trading_day AS STRING) AS trading_day, z.slot, z.h, round(coalesce(r.var, z.var), 6) + 0.0 AS var, CASE WHEN r.var IS NULL THEN 'computed' ELSE 'recorded' END AS source FROM {{hd}} z LEFT JOIN r ON r.instrument = z.instrument AND r.trading_day = z.trading_day AND r.slot = z.slot AND r.h = z.h""", "The forecast recorded at a mark of a past session where there is one, else the computed one.")
P.query("i23_delayed_window", f"""p AS (SELECT {KEY}, slot, max(CASE WHEN h = 1 THEN var END) AS v1, max(CASE WHEN h = 4 THEN var END) AS v4 FROM {{hd}} z GROUP BY {KEY}, slot)
SELECT instrument, {DAY}, slot, CASE WHEN v4 > v1 THEN round(sqrt(v4 - v1), 6) + 0.0 END AS sigma, CASE WHEN v1 IS NULL THEN 'no near horizon' WHEN v4 IS NULL THEN 'no far horizon' WHEN v4 <= v1 THEN 'no variance' END AS skipped FROM p""", "Sigma of a window that starts one slot after the origin: the difference of two cumulative variances.")

# J7, J10, J11, J12, J15, J16
P.view("rel_level", f"""g AS (SELECT u.instrument, u.trading_day, u.slot, u.close, u.last_price, u.r, u.rv, u.usual, max(CASE WHEN u.close IS NOT NULL THEN u.slot END) OVER w AS seen, sum(coalesce(u.r * u.r, 0)) OVER w AS day_rv FROM {{us}} u WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING)),
t AS (SELECT {KEY}, max(day_rv) AS total FROM g GROUP BY {KEY}), f AS (SELECT {KEY}, CASE WHEN count(total) OVER w = 5 THEN sum(total) OVER w END AS rv5d FROM t WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT g.instrument, g.trading_day, g.slot, g.slot - seen AS age, day_rv, rv5d, l.level, CASE WHEN rv > 0 AND l.s > 0 THEN ln(rv / (4 * l.s)) END AS iv_rv FROM g JOIN f ON f.instrument = g.instrument AND f.trading_day = g.trading_day LEFT JOIN {{sl}} l ON l.instrument = g.instrument AND l.trading_day = g.trading_day AND l.slot = g.slot""")
P.query("j7_levels", f"SELECT instrument, {DAY}, slot, age, round(day_rv, 6) + 0.0 AS day_rv, round(rv5d, 6) + 0.0 AS rv5d, round(level, 6) + 0.0 AS level, round(iv_rv, 6) + 0.0 AS iv_rv FROM {{rel_level}} x", "Age of the last value, variance of the day so far and of five days, short level, and realised over expected variance.")
P.query("j10_direction_features", f"""v AS (SELECT {KEY}, slot, CAST(slot / 60 AS INT) AS k, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM {{wd}} b WINDOW w AS (PARTITION BY {KEY} ORDER BY slot ROWS UNBOUNDED PRECEDING)),
x AS (SELECT l.*, v.vwap, lag(long_ma, 3) OVER w AS ma3, lag(tema, 3) OVER w AS te3, lag(l.close, 1) OVER w AS c1, lag(l.close, 4) OVER w AS c4, stddev_samp(l.close) OVER (PARTITION BY l.instrument, l.trading_day ORDER BY l.k ROWS 5 PRECEDING) AS sd FROM {{lines}} l JOIN v ON v.instrument = l.instrument AND v.trading_day = l.trading_day AND v.k = l.k WINDOW w AS (PARTITION BY l.instrument, l.trading_day ORDER BY l.k))
SELECT instrument, {DAY}, k, round(long_ma - ma3, 6) + 0.0 AS long_slope, round(tema - te3, 6) + 0.0 AS fast_slope, round((close - long_ma) / nullif(sd, 0), 6) + 0.0 AS long_distance, round((tema - trigger_line) / nullif(sd, 0), 6) + 0.0 AS fast_distance, round(close - c1, 6) + 0.0 AS move1, round(close - c4, 6) + 0.0 AS move4, round((close - vwap) / nullif(sd, 0), 6) + 0.0 AS vwap_distance FROM x WHERE sd > 0""",
        "Slopes and distances of averages, moves, and the distance to the VWAP in trailing deviations.")
P.query("j11_conditional_averages", f"""b AS (SELECT {KEY}, k, close, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY k) - 1 AS INT) AS i FROM {{ob}} x), t AS (SELECT {KEY}, CAST(floor(k / 3) AS INT) AS j, max_by(close, k) AS close FROM {{ob}} y GROUP BY {KEY}, CAST(floor(k / 3) AS INT)), u AS (SELECT {KEY}, j, close, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY j) - 1 AS INT) AS i FROM t),
a1 AS ({ema('b', 'close', 4)}), a3 AS ({ema('u', 'close', 3)}), s1 AS (SELECT b.instrument, b.trading_day, k, close, e, e - lag(e) OVER (PARTITION BY b.instrument, b.trading_day ORDER BY k) AS step FROM b JOIN a1 USING ({KEY}, i)), s3 AS (SELECT u.instrument, u.trading_day, j, e, e - lag(e) OVER (PARTITION BY u.instrument, u.trading_day ORDER BY j) AS step FROM u JOIN a3 USING ({KEY}, i))
SELECT s1.instrument, CAST(s1.trading_day AS STRING) AS trading_day, k, round(s1.step, 6) + 0.0 AS step1, round(s3.step, 6) + 0.0 AS step3, round(s1.close - s1.e, 6) + 0.0 AS distance1, round(s1.close - s3.e, 6) + 0.0 AS distance3, CASE WHEN s1.step IS NULL OR s3.step IS NULL THEN NULL WHEN sign(s1.step) = sign(s3.step) THEN 1 ELSE 0 END AS agree
FROM s1 LEFT JOIN s3 ON s3.instrument = s1.instrument AND s3.trading_day = s1.trading_day AND s3.j = CAST(floor((s1.k + 1) / 3) AS INT) - 1""", "Averages of bars and of completed buckets of three, their steps, distances and whether they agree.")
P.query("j12_peer_relations", f"""r AS (SELECT a.instrument, a.trading_day, a.slot, a.r, b.r AS peer FROM {{grid}} a JOIN {{grid}} b ON b.instrument = 'click' AND b.trading_day = a.trading_day AND b.slot = a.slot WHERE a.instrument <> 'click' AND a.r IS NOT NULL AND b.r IS NOT NULL),
s AS (SELECT {KEY}, sum(r * peer) AS xy, sum(peer * peer) AS xx FROM r GROUP BY {KEY}), b AS (SELECT {KEY}, sum(xy) OVER w / nullif(sum(xx) OVER w, 0) AS beta FROM s WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, count(*) OVER w AS n, avg(r) OVER w AS mr, avg(peer) OVER w AS mp, avg(r * r) OVER w AS rr, avg(peer * peer) OVER w AS pp, avg(r * peer) OVER w AS rp FROM r WINDOW w AS (PARTITION BY {KEY} ORDER BY slot ROWS 5 PRECEDING)),
c AS (SELECT *, CASE WHEN rr - mr * mr > 1e-9 AND pp - mp * mp > 1e-9 THEN (rp - mr * mp) / sqrt((rr - mr * mr) * (pp - mp * mp)) END AS rho FROM m)
SELECT c.instrument, CAST(c.trading_day AS STRING) AS trading_day, slot, round(peer, 6) + 0.0 AS peer, round(r - beta * peer, 6) + 0.0 AS beyond_beta, sign(r) = sign(peer) AS together, CASE WHEN n = 6 THEN round(rho, 6) + 0.0 END AS rho FROM c JOIN b ON b.instrument = c.instrument AND b.trading_day = c.trading_day""", "A peer's return, what is left beyond the beta of earlier sessions, co-movement and the trailing correlation.")
P.query("j15_drift_shift", f"""x AS (SELECT {KEY}, k, long_ma - lag(long_ma) OVER (PARTITION BY {KEY} ORDER BY k) AS step FROM {{lines}} l) SELECT instrument, {DAY}, k, m.h, round(step * (1 - pow(0.8, m.h)) / 0.2, 6) + 0.0 AS mu FROM x CROSS JOIN (VALUES (1), (4)) m(h) WHERE step IS NOT NULL""", "The average's last step carried ahead with damping.")
P.query("j16_barrier_grids", f"SELECT instrument, {DAY}, slot, CASE WHEN high > 0 THEN round(ln(high), 6) + 0.0 END AS log_high, CASE WHEN low > 0 THEN round(ln(low), 6) + 0.0 END AS log_low FROM {{wd}} w WHERE slot < 1380", "Log highs and lows by session and slot, for barrier labels.")
