"""What the whole chain would have said at an earlier minute before the cutoff.

A preview is the same chain over other bars: of every session those before the cutoff count only if they had ended by the minute, and
releases that are known once published only if they had been. Snapshot, annotation, similar sessions and forecast follow as views of the
same texts; a session is compared with the finished annotations of earlier sessions, whose outcomes are known. At the cutoff's own
minute a preview is the chain itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import Portable
from ..sources import BARS_SQL
from .indicators import REFS_STEP, WD_SQL, overnight_references, weekday_bars
from .judging import P as JUDGING
from .judging import similar_text
from .session_labels import KEY
from .structure import STORE, covered_text, releases_text
from .walk import days_text

QUERIES: dict = {}
SQL: dict = {}
CUTOFF, STEP = 900, 60
#: The minutes of the session day that the registered query previews.
MINUTES = (600, CUTOFF)


def bars_at(bars, minute: int):
    """Bars without those before the cutoff that had not ended by the minute."""
    return bars.where(~((F.col("slot") < CUTOFF) & (F.col("slot") + STEP > minute)))


def chain_at(minute: int) -> Portable:
    """The chain's relations as of a minute of each session."""
    p = Portable({}, {}, JUDGING, mark=f"at-{minute}-")
    own = f"{BARS_SQL}, wd AS (SELECT * FROM sb WHERE isodow(trading_day) <= 5 AND NOT (slot < {CUTOFF} AND slot + {STEP} > {minute}))"
    p.base("wd", lambda spark, sf: bars_at(weekday_bars(spark, sf), minute), own)
    p.base("refs", lambda spark, sf: overnight_references(bars_at(weekday_bars(spark, sf), minute)), f"{own}, {REFS_STEP}")
    p.base("wd_full", weekday_bars, WD_SQL, "wd")
    p.view("days", days_text("wd_full"))
    p.view("releases", releases_text("wd_full", f"slot + {STEP} <= {minute} OR slot >= {CUTOFF}"), STORE)
    p.view("covered", covered_text("wd_full"))
    for name in ("rubric", "stype"):
        p.base(f"full_{name}", lambda spark, sf, name=name: JUDGING.relation(name, spark, sf), f"full_{name} AS ({JUDGING.text(f'SELECT * FROM {{{name}}} q')})")
    p.view("similar", similar_text("full_rubric"), STORE)
    return p


def preview_text(minute: int) -> str:
    return f"""n AS (SELECT {KEY}, count(value) AS known_fields FROM {{annotation}} a GROUP BY {KEY}),
f AS (SELECT s.instrument, s.trading_day, count(*) AS members, count(t.dir) AS known, min(earlier) AS first_member, (count(CASE WHEN t.dir = 'bullish' THEN 1 END) + 1) / CAST(count(t.dir) + 3 AS DOUBLE) AS p_bullish,
  (count(CASE WHEN t.dir = 'bearish' THEN 1 END) + 1) / CAST(count(t.dir) + 3 AS DOUBLE) AS p_bearish FROM {{sets}} s LEFT JOIN {{full_stype}} t ON t.instrument = s.instrument AND t.trading_day = s.earlier GROUP BY 1, 2)
SELECT r.instrument, CAST(r.trading_day AS STRING) AS trading_day, CAST({minute} AS INT) AS minute, CAST(r.cutoff_slot + {STEP} AS INT) AS as_of, r.cutoff_price AS price, r.on_high, r.on_low, n.known_fields, f.members, f.known,
  CAST(f.first_member AS STRING) AS first_member, round(f.p_bullish, 6) + 0.0 AS p_bullish, round(f.p_bearish, 6) + 0.0 AS p_bearish, CASE WHEN r.cutoff_price IS NULL THEN 'no bar yet' WHEN f.members IS NULL THEN 'no set' ELSE 'made' END AS status
FROM {{refs}} r LEFT JOIN n ON n.instrument = r.instrument AND n.trading_day = r.trading_day LEFT JOIN f ON f.instrument = r.instrument AND f.trading_day = r.trading_day"""


def preview(spark, sf_dir, minute: int):
    """instrument, trading_day, minute, what is known of the session, its set and the forecast from it."""
    return chain_at(minute).frame(preview_text(minute), spark, sf_dir)


def e33(spark, sf_dir):
    """Every session as of each of MINUTES, through the whole chain."""
    out = None
    for minute in MINUTES:
        own = preview(spark, sf_dir, minute)
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["e33_preview_chain"] = e33
SQL["e33_preview_chain"] = " UNION ALL ".join(f"SELECT * FROM ({chain_at(m).text(preview_text(m))})" for m in MINUTES)
