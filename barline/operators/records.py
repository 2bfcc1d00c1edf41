"""Groups A to D and K, second part: calendars and releases as records, what was received by when, and the rows that models are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Portable, register
from ..sources import shared_path, table
from .calendar import CALENDAR_SQL, order_calendar
from .judging import P as JUDGING
from .session_labels import DAY, KEY
from .structure import STORE
from .walk import OFFSETS

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
P = Portable(QUERIES, SQL, JUDGING)
P.base("cal", order_calendar, CALENDAR_SQL)
P.base("events", lambda spark, sf: table(spark, sf, "events"))
RELEASE_SCHEMA = "source string, event_key string, date string, time_et string, name string, tier string"


def merge_calendar(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded releases replace stored ones of the same source and key (a moved release keeps its key); others stay."""
    return stored.join(loaded.select("source", "event_key"), ["source", "event_key"], "left_anti").unionByName(loaded)


def read_calendar(spark, path: str) -> DataFrame:
    """A calendar CSV with local New York times, as UTC."""
    raw = spark.read.csv(path, header=True, schema=RELEASE_SCHEMA)
    at = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time_et"), F.lit("yyyy-MM-dd HH:mm"))
    return raw.select("source", "event_key", "name", "tier", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), at).alias("scheduled_at"))


# in these years New York is four hours behind from the first Sunday of April to the last of October
_DST = "CASE WHEN d >= m1 + CAST(7 - isodow(m1) AS INT) AND d < n1 - CAST(isodow(n1) % 7 AS INT) THEN 4 ELSE 5 END"


@query("a8_calendar_load", f"""WITH r AS (SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS event_key, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, o_orderkey % 5 AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
x AS (SELECT source, event_key, CASE WHEN k = 0 THEN d + 1 ELSE d END AS d, CASE WHEN k = 0 THEN 14 ELSE 8 END AS h, CASE WHEN s = 'F' THEN 'high' ELSE 'moderate' END AS tier, k = 0 AS moved FROM r), y AS (SELECT *, make_date(year(d), 4, 1) AS m1, make_date(year(d), 10, 31) AS n1 FROM x)
SELECT source, event_key, tier, strftime(CAST(d AS TIMESTAMP) + to_hours(h) + INTERVAL 30 MINUTE + to_hours({_DST}), '%Y-%m-%d %H:%M:%S') AS scheduled_at, moved FROM y""")
def a8(spark, sf_dir):
    """Releases written as a calendar CSV in local time and loaded to UTC over the stored ones; those that moved replace their old entry, known ones are kept."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    moved = F.col("o_orderkey") % 5 == 0
    day = F.to_date("o_orderdate")
    rows = lambda d, t: o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("string").alias("event_key"), d.cast("string").alias("date"), F.lit(t).alias("time_et"), F.lit("release").alias("name"), F.when(F.col("o_orderstatus") == "F", "high").otherwise("moderate").alias("tier"), moved.alias("moved"))
    old, new = shared_path(spark, "calendar"), shared_path(spark, "calendar")
    rows(day, "08:30").drop("moved").write.csv(old, header=True)
    rows(F.date_add(day, 1), "14:30").where("moved").drop("moved").write.csv(new, header=True)
    merged = merge_calendar(read_calendar(spark, old).withColumn("moved", F.lit(False)), read_calendar(spark, new).withColumn("moved", F.lit(True)))
    return merged.select("source", "event_key", "tier", F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss").alias("scheduled_at"), "moved")


P.query("a9_rule_made_releases", """m AS (SELECT session_date, substr(CAST(session_date AS STRING), 1, 7) AS month, row_number() OVER (PARTITION BY substr(CAST(session_date AS STRING), 1, 7) ORDER BY session_date) AS n FROM {cal} c WHERE schedule <> 'closed')
SELECT r.name, month, CAST(session_date AS STRING) AS session_date, 600 AS minute_et FROM m JOIN (VALUES ('orders survey', 1), ('services survey', 3), ('sentiment', 10)) r(name, n) ON r.n = m.n""", "Releases made by rule: the n-th exchange session of each month at ten o'clock local time.")
P.query("b3_session_distance", """o AS (SELECT session_date, ordinal FROM {cal} c WHERE schedule <> 'closed')
SELECT CAST(a.session_date AS STRING) AS session_date, CAST(b.session_date AS STRING) AS five_before, CAST(c.session_date AS STRING) AS three_after, c.ordinal - b.ordinal AS between_sessions FROM o a LEFT JOIN o b ON b.ordinal = a.ordinal - 5 LEFT JOIN o c ON c.ordinal = a.ordinal + 3""", "Sessions n before and after each session, and the distance between them.")
P.query("b5_day_ends", """t AS (SELECT CAST(session_date AS STRING) AS session_date, schedule, k.kind, CASE WHEN k.kind = 'future' THEN CASE schedule WHEN 'early_close' THEN 1155 WHEN 'full' THEN 1380 END WHEN k.kind = 'index' THEN CASE schedule WHEN 'early_close' THEN 1140 WHEN 'full' THEN 1320 END ELSE CASE schedule WHEN 'closed' THEN NULL ELSE 1440 END END AS end_slot FROM {cal} c CROSS JOIN (VALUES ('future'), ('index'), ('currency')) k(kind))
SELECT * FROM t""", "The slot at which a day ends, by kind of instrument and schedule.")
P.query("b9_display_window", f"SELECT instrument, {DAY}, slot, close, slot < 930 OR slot >= 1320 AS muted, slot BETWEEN 870 AND 1379 AS in_window FROM {{wd}} w", "Bars with whether they lie in the display window and whether they are muted there.")
P.query("c5_assignment_upsert", f"""s AS (SELECT {KEY}, concat(instrument, '-', substr(CAST(trading_day AS STRING), 1, 7)) AS contract FROM {{days}} t), m AS (SELECT instrument, max(trading_day) AS newest FROM {{days}} t GROUP BY 1),
n AS (SELECT s.instrument, s.trading_day, concat(contract, 'b') AS contract, w.bars FROM s JOIN m ON m.instrument = s.instrument JOIN (SELECT {KEY}, count(*) AS bars FROM {{wd}} w GROUP BY {KEY}) w ON w.instrument = s.instrument AND w.trading_day = s.trading_day WHERE s.trading_day = newest OR w.bars < 18)
SELECT s.instrument, CAST(s.trading_day AS STRING) AS trading_day, CASE WHEN n.contract IS NULL THEN s.contract WHEN n.bars < 18 THEN NULL ELSE n.contract END AS contract, CASE WHEN n.contract IS NULL THEN 'kept' WHEN n.bars < 18 THEN 'cleared' ELSE 'replaced' END AS action FROM s LEFT JOIN n ON n.instrument = s.instrument AND n.trading_day = s.trading_day""", "Contract assignments after an upsert of the newest day and the clearing of thin ones.")

# D: what is there, since when, and by when it was received
P.view("present", f"""b AS (SELECT {KEY}, count(*) AS bars, max(CASE WHEN slot < 900 THEN slot END) AS last_before, count(CASE WHEN slot >= 1320 THEN 1 END) AS late FROM {{wd}} w GROUP BY {KEY}), i AS (SELECT DISTINCT instrument FROM b), d AS (SELECT DISTINCT trading_day FROM b)
SELECT i.instrument, d.trading_day, coalesce(bars, 0) AS bars, last_before, late FROM i CROSS JOIN d LEFT JOIN b ON b.instrument = i.instrument AND b.trading_day = d.trading_day""", STORE)
P.query("d8_merged_gap_runs", f"""g AS (SELECT {KEY}, bars, row_number() OVER (PARTITION BY instrument ORDER BY trading_day) AS k, row_number() OVER (PARTITION BY instrument, CASE WHEN bars >= 20 THEN 1 ELSE 0 END ORDER BY trading_day) AS j FROM {{present}} p),
r AS (SELECT instrument, k - j AS run, min(trading_day) AS first_day, max(trading_day) AS last_day, count(*) AS days, min(bars) AS worst FROM g WHERE bars < 20 GROUP BY 1, 2)
SELECT CAST(first_day AS STRING) AS first_day, CAST(last_day AS STRING) AS last_day, max(days) AS days, count(*) AS instruments, min(instrument) AS first_instrument, max(instrument) AS last_instrument, min(worst) AS worst, row_number() OVER (ORDER BY max(days) DESC, last_day DESC, first_day) = 1 AS selected FROM r GROUP BY first_day, last_day""", "Runs of incomplete days, merged over the instruments that share them; the longest is selected.")
P.query("d11_panel_audit", f"""a AS (SELECT instrument, count(*) AS sessions, count(CASE WHEN bars = 0 THEN 1 END) AS without_bars, percentile_cont(0.5) WITHIN GROUP (ORDER BY bars) AS median_bars, percentile_cont(0.5) WITHIN GROUP (ORDER BY 900 - last_before) AS median_age FROM {{present}} p GROUP BY 1),
h AS (SELECT instrument, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS hours FROM (SELECT instrument, slot, count(*) AS n FROM {{wd}} w GROUP BY 1, 2) q WHERE n >= 10 GROUP BY 1)
SELECT a.instrument, sessions, without_bars, median_bars, median_age, first_slot, last_slot, hours FROM a LEFT JOIN h ON h.instrument = a.instrument""", "Sessions without bars, median bars and age at the cutoff, and the hours an instrument trades.")
P.view("at_cutoff", f"""SELECT instrument, trading_day, c.cutoff, bars, seen, CASE WHEN bars = 0 THEN 'closed' WHEN seen IS NULL THEN 'missing' WHEN seen = c.cutoff - 60 THEN CASE WHEN thin = 1 THEN 'reconstructed' ELSE 'observed' END WHEN seen = c.cutoff - 120 THEN 'delayed' ELSE 'stale' END AS status, price
FROM (SELECT p.instrument, p.trading_day, p.bars, c.cutoff, max(CASE WHEN w.slot < c.cutoff THEN w.slot END) AS seen, max_by(CASE WHEN w.slot < c.cutoff THEN w.close END, CASE WHEN w.slot < c.cutoff THEN w.slot END) AS price, max_by(CASE WHEN w.volume = 1 THEN 1 ELSE 0 END, CASE WHEN w.slot < c.cutoff THEN w.slot END) AS thin
  FROM {{present}} p CROSS JOIN (VALUES (480), (900), (1140)) c(cutoff) LEFT JOIN {{wd}} w ON w.instrument = p.instrument AND w.trading_day = p.trading_day GROUP BY 1, 2, 3, 4) c""", STORE)
P.query("k1_raw_at_cutoff", f"SELECT instrument, {DAY}, cutoff, price, seen, status FROM {{at_cutoff}} a", "The last value of every instrument at each cutoff, with whether it is observed, reconstructed, delayed, stale, missing or closed.")
P.query("d18_context_ready", """SELECT CAST(trading_day AS STRING) AS trading_day, cutoff, count(*) AS instruments, count(CASE WHEN status IN ('observed', 'reconstructed') THEN 1 END) AS received, bool_and(status IN ('observed', 'reconstructed', 'closed')) AS ready, bool_and(status IN ('observed', 'reconstructed', 'closed', 'delayed')) AS ready_after_wait FROM {at_cutoff} a GROUP BY 1, 2""", "Whether every instrument's last bar before a cutoff is there, at once or after the wait.")

# K: rows for models
P.query("k2_rth_range", f"SELECT instrument, {DAY}, round(hi - lo, 6) + 0.0 AS session_range, n AS bars FROM {{rs}} r WHERE hi IS NOT NULL", "The range of each regular session.")
P.view("own", f"""x AS (SELECT {KEY}, a, cutoff_price - on_open AS night_move, on_high - on_low AS night_range, cutoff_price - prev_close AS gap, cutoff_price AS level, hi - lo AS day_range, prev_high, prev_low FROM {{rs}} r),
y AS (SELECT *, CASE WHEN count(night_move) OVER w >= 5 THEN stddev_samp(night_move) OVER w END AS sd_move, CASE WHEN count(night_range) OVER w >= 5 THEN avg(night_range) OVER w END AS mean_range, CASE WHEN count(gap) OVER w >= 5 THEN stddev_samp(gap) OVER w END AS sd_gap, CASE WHEN count(level) OVER w >= 5 THEN avg(level) OVER w END AS mean_level,
  CASE WHEN count(level) OVER w >= 5 THEN stddev_samp(level) OVER w END AS sd_level, CASE WHEN count(day_range) OVER w >= 5 THEN avg(day_range) OVER w END AS mean_day FROM x WINDOW w AS (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT {KEY}, night_move / nullif(sd_move, 0) AS move_z, night_range / nullif(mean_range, 0) AS range_ratio, gap / nullif(sd_gap, 0) AS gap_z, (level - mean_level) / nullif(sd_level, 0) AS level_z, (level - prev_high) / nullif(a, 0) AS to_prev_high, (level - prev_low) / nullif(a, 0) AS to_prev_low, mean_day / nullif(a, 0) AS day_to_a, abs(night_move) / nullif(night_range, 0) AS efficiency, night_move / nullif(a, 0) AS move_a FROM y""", STORE)
OWN = ["move_z", "range_ratio", "gap_z", "level_z", "to_prev_high", "to_prev_low", "day_to_a", "efficiency", "move_a"]
P.query("k3_own_features", f"SELECT instrument, {DAY}, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in OWN) + " FROM {own} x", "Nine features of a session against its own earlier sessions.")
P.view("flags", """d AS (SELECT DISTINCT trading_day FROM {wd} w), r AS (SELECT trading_day, max(CASE WHEN slot < 900 THEN 1 ELSE 0 END) AS before, max(CASE WHEN slot >= 900 AND source <> 'error' THEN 1 ELSE 0 END) AS after FROM {releases} x GROUP BY 1) SELECT d.trading_day, coalesce(before, 0) AS event_before, coalesce(after, 0) AS event_after FROM d LEFT JOIN r ON r.trading_day = d.trading_day""")
P.query("k6_event_flags", f"SELECT {DAY}, event_before, event_after FROM {{flags}} f", "Whether a release lies before, and whether one is scheduled after, the cutoff of a day.")
P.view("peers", f"""SELECT {KEY}, move_a - avg(move_a) OVER w AS against_mean, stddev_samp(move_a) OVER w AS dispersion, avg(sign(move_a)) OVER w AS agreement FROM {{own}} o WINDOW w AS (PARTITION BY trading_day)""")
P.query("k8_matrices", f"""m AS (SELECT o.instrument, o.trading_day, {', '.join('o.' + c for c in OWN)}, p.against_mean, p.dispersion, p.agreement, f.event_before, f.event_after FROM {{own}} o JOIN {{peers}} p ON p.instrument = o.instrument AND p.trading_day = o.trading_day JOIN {{flags}} f ON f.trading_day = o.trading_day)
SELECT 'own' AS matrix, instrument, {DAY}, round(move_z, 6) + 0.0 AS f1, round(range_ratio, 6) + 0.0 AS f2, round(gap_z, 6) + 0.0 AS f3, NULL AS f4, NULL AS target_click, NULL AS target_view FROM m UNION ALL SELECT 'context' AS matrix, instrument, {DAY}, round(move_a, 6) + 0.0 AS f1, round(against_mean, 6) + 0.0 AS f2, round(dispersion, 6) + 0.0 AS f3, event_after AS f4, NULL AS target_click, NULL AS target_view FROM m
UNION ALL SELECT 'pooled' AS matrix, instrument, {DAY}, round(move_z, 6) + 0.0 AS f1, round(gap_z, 6) + 0.0 AS f2, round(agreement, 6) + 0.0 AS f3, event_before AS f4, CASE WHEN instrument = 'click' THEN 1 ELSE 0 END AS target_click, CASE WHEN instrument = 'view' THEN 1 ELSE 0 END AS target_view FROM m""", "Rows of configured matrices: own features, context, and pooled rows that carry the instrument.")
P.view("path", f"""s AS (SELECT {KEY}, k, close, high, low, open, close - lag(close) OVER w AS step, lag(close - open) OVER w AS before FROM {{ob}} x WINDOW w AS (PARTITION BY {KEY} ORDER BY k))
SELECT {KEY}, sum(abs(step)) AS travelled, max_by(close, k) - min_by(open, k) AS net, count(CASE WHEN before * (close - open) < 0 THEN 1 END) AS reversals, max(CASE WHEN high - low > 0 THEN high - low END) AS widest, max_by(close, k) - min(low) AS off_low, max(high) - max_by(close, k) AS off_high, count(*) AS bars FROM s GROUP BY {KEY}""")
P.query("k9_snapshot_features", f"""SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, round((on_high - cutoff_price) / a, 6) + 0.0 AS to_high, round((cutoff_price - on_low) / a, 6) + 0.0 AS to_low, round((cutoff_price - prev_close) / a, 6) + 0.0 AS from_close, round((on_high - on_low) / a, 6) + 0.0 AS night_in_ranges, round(abs(net) / nullif(travelled, 0), 6) + 0.0 AS efficiency, reversals, round(widest / a, 6) + 0.0 AS widest, round(off_low / nullif(off_low + off_high, 0), 6) + 0.0 AS place,
  event_before, event_after FROM {{rs}} r JOIN {{path}} p ON p.instrument = r.instrument AND p.trading_day = r.trading_day JOIN {{flags}} f ON f.trading_day = r.trading_day WHERE a > 0""", "Level geometry in ranges, path efficiency, reversals and event flags of a snapshot.")
P.query("k10_candidate_levels", f"""x AS (SELECT l.instrument, l.trading_day, l.name, level, cutoff_price, a, CASE WHEN level > cutoff_price THEN 'above' WHEN level < cutoff_price THEN 'below' ELSE 'at' END AS side, abs(level - cutoff_price) AS away FROM {{levels}} l JOIN {{rs}} r ON r.instrument = l.instrument AND r.trading_day = l.trading_day WHERE l.name NOT IN ('open_plus_t', 'open_minus_t', 'cutoff_price') AND level IS NOT NULL AND cutoff_price IS NOT NULL)
SELECT instrument, {DAY}, name, side, round(away, 6) + 0.0 AS away, round(away / a, 6) + 0.0 AS away_in_ranges, dense_rank() OVER (PARTITION BY {KEY}, side ORDER BY round(away, 9)) AS rank, count(*) OVER (PARTITION BY {KEY}, round(level, 9)) > 1 AS coincident, min(away) OVER (PARTITION BY {KEY}) = away AS nearest, away <= a AS possible FROM x""", "Every candidate level with its side, distance, rank, and whether it is nearest, coincident and within reach.")
P.query("k12_cutoff_features", f"""c AS (SELECT {KEY}, slot, close, high, low, volume, lag(close, 1) OVER w AS c1, lag(close, 4) OVER w AS c4, stddev_samp(close) OVER v AS sd, max(high) OVER v - min(low) OVER v AS range6, sum(volume) OVER (PARTITION BY {KEY} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS cv, sum(close * volume) OVER (PARTITION BY {KEY} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS pv
  FROM {{wd}} b WINDOW w AS (PARTITION BY {KEY} ORDER BY slot), v AS (PARTITION BY {KEY} ORDER BY slot ROWS 5 PRECEDING)),
u AS (SELECT *, avg(cv) OVER z AS usual_volume, count(*) OVER z AS history FROM c WHERE slot IN (480, 900, 1140) WINDOW z AS (PARTITION BY instrument, slot ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), p AS (SELECT trading_day, slot, sum(close - c4) AS total, count(close - c4) AS n FROM u GROUP BY 1, 2)
SELECT u.instrument, CAST(u.trading_day AS STRING) AS trading_day, u.slot, round(close - c1, 6) + 0.0 AS move1, round(close - c4, 6) + 0.0 AS move4, round(sd, 6) + 0.0 AS sd, round(abs(close - c4) / nullif(range6, 0), 6) + 0.0 AS efficiency, round(close - pv / cv, 6) + 0.0 AS from_vwap, round(range6, 6) + 0.0 AS range6, CASE WHEN history >= 5 THEN round(ln(cv / usual_volume), 6) + 0.0 END AS relative_volume, CASE WHEN n > 1 AND c4 IS NOT NULL THEN round((total - (close - c4)) / (n - 1), 6) + 0.0 END AS peers
FROM u JOIN p ON p.trading_day = u.trading_day AND p.slot = u.slot""", "Features at intraday cutoffs: moves, spread, efficiency, distance to the VWAP, relative volume and peers.")
