"""Group J: realised variances and returns of several windows against what is usual at their slot.

Usual is the mean over the last HISTORY full sessions that have a value at the slot. Sessions are ordered by the number of full ones
before them, so a range of that number is the last full sessions whatever lies between, in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from ..plans import register
from .calendar import GRID_SQL, returns

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
DAY = ["instrument", "trading_day"]
#: Slots of the windows of variances and of returns; full sessions of history, the least values in it, and bars of a full session.
VARIANCES, MOVES = (1, 2, 4, 8), (2, 4)
HISTORY, LEAST, FULL_BARS = 20, 10, 18


def with_usual(rows: DataFrame, keys: list[str], value: str, history: int = HISTORY, least: int = LEAST) -> DataFrame:
    """Rows (instrument, trading_day, full, keys, value) with usual: the mean of value over the last `history` full sessions before, null with fewer than `least` values in them."""
    days = rows.select(*DAY, "full").distinct()
    before = Window.partitionBy("instrument").orderBy("trading_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("passed", F.coalesce(F.sum(F.col("full").cast("int")).over(before), F.lit(0))).drop("full")  # a row a session
    past = Window.partitionBy("instrument", *keys).orderBy("passed").rangeBetween(-history, -1)
    own = F.when(F.col("full"), F.col(value))
    return rows.join(days, DAY).withColumn("usual", F.when(F.count(own).over(past) >= least, F.avg(own).over(past))).drop("passed")


def full_sessions(grid: DataFrame) -> DataFrame:
    """Adds full: whether a session has FULL_BARS bars."""
    return grid.withColumn("full", F.count("close").over(Window.partitionBy(*DAY)) >= FULL_BARS)


def variances(grid: DataFrame, windows: tuple[int, ...] = VARIANCES) -> DataFrame:
    """instrument, trading_day, full, slot, width, rv: the sum of squared returns of the last `width` slots, null where one of them has none."""
    w = lambda k: Window.partitionBy(*DAY).orderBy("slot").rowsBetween(-(k - 1), 0)
    made = [F.struct(F.lit(k).alias("width"), F.when(F.count("r").over(w(k)) == k, F.sum(F.col("r") * F.col("r")).over(w(k))).alias("rv")) for k in windows]
    x = full_sessions(grid).select(*DAY, "full", "slot", F.array(*made).alias("xs"))
    return x.select(*DAY, "full", "slot", F.explode("xs").alias("x")).select(*DAY, "full", "slot", "x.width", "x.rv")


_G = f"""{GRID_SQL}, fl AS (SELECT instrument, trading_day, count(close) >= {FULL_BARS} AS whole FROM grid GROUP BY 1, 2),
pd AS (SELECT *, coalesce(count(*) FILTER (whole) OVER (PARTITION BY instrument ORDER BY trading_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM fl),
wv AS (SELECT instrument, trading_day, slot, width, (SELECT CASE WHEN count(p.r) = width THEN sum(p.r * p.r) END FROM ret p WHERE p.instrument = a.instrument AND p.trading_day = a.trading_day AND p.slot BETWEEN a.slot - 60 * (width - 1) AND a.slot) AS rv
  FROM ret a, (SELECT unnest({list(VARIANCES)}) AS width)),
wu AS MATERIALIZED (SELECT a.instrument, a.trading_day, a.slot, a.width, a.rv, avg(e.rv) AS usual FROM wv a JOIN pd t ON t.instrument = a.instrument AND t.trading_day = a.trading_day
  JOIN pd s ON s.instrument = a.instrument AND s.whole AND s.passed BETWEEN t.passed - {HISTORY} AND t.passed - 1 JOIN wv e ON e.instrument = a.instrument AND e.trading_day = s.trading_day AND e.slot = a.slot AND e.width = a.width AND e.rv IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= {LEAST})"""


@query("j3_four_windows", f"WITH {_G} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, CAST(width AS INT) AS width, round(usual, 6) AS usual, round(ln(rv / usual), 6) AS ratio FROM wu WHERE rv > 1e-12 AND usual > 1e-12")
def j3(spark, sf_dir):
    """The log ratio of each window's variance to its usual."""
    x = with_usual(variances(returns(spark, sf_dir)), ["slot", "width"], "rv").where("rv > 1e-12 AND usual > 1e-12")
    return x.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", "width", r6("usual").alias("usual"), r6(F.log(F.col("rv") / F.col("usual"))).alias("ratio"))


def moves(grid: DataFrame, windows: tuple[int, ...] = MOVES) -> DataFrame:
    """Log returns over the windows, with the usual variance of the same window."""
    w = Window.partitionBy(*DAY).orderBy("slot")
    made = [F.struct(F.lit(k).alias("width"), F.when((F.col("last_price") > 0) & (F.lag("last_price", k).over(w) > 0), F.log("last_price") - F.log(F.lag("last_price", k).over(w))).alias("move")) for k in windows]
    x = grid.select(*DAY, "slot", F.array(*made).alias("xs")).select(*DAY, "slot", F.explode("xs").alias("x")).select(*DAY, "slot", "x.width", "x.move")
    return x.join(with_usual(variances(grid, windows), ["slot", "width"], "rv"), [*DAY, "slot", "width"])


@query("j4_two_returns", f"""WITH {_G}, mv AS (SELECT a.instrument, a.trading_day, a.slot, width, ln(a.last_price) - ln(b.last_price) AS move FROM ret a, (SELECT unnest({list(MOVES)}) AS width), ret b WHERE b.instrument = a.instrument AND b.trading_day = a.trading_day AND b.slot = a.slot - 60 * width AND a.last_price > 0 AND b.last_price > 0)
SELECT m.instrument, CAST(m.trading_day AS VARCHAR) AS trading_day, m.slot, CAST(m.width AS INT) AS width, round(move / sqrt(usual), 6) AS z FROM mv m JOIN wu ON wu.instrument = m.instrument AND wu.trading_day = m.trading_day AND wu.slot = m.slot AND wu.width = m.width WHERE usual > 1e-12""")
def j4(spark, sf_dir):
    """Returns over two and four slots in units of the root of the usual variance."""
    x = moves(returns(spark, sf_dir)).where("usual > 1e-12 AND move IS NOT NULL")
    return x.select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", "width", r6(F.col("move") / F.sqrt("usual")).alias("z"))
