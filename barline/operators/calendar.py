"""Groups B and C: the session calendar, minute grids, contract chains and rolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import as_of, r6, stamp
from ..plans import register
from ..sources import BARS_SQL, RTH_CLOSE, RTH_OPEN, session_bars, table

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)
#: Slots of the session day at which phases begin (18:00 is slot 0).
PHASES = [(0, "evening"), (360, "night"), (840, "premarket"), (930, "open"), (990, "midday"), (1200, "close"), (1320, "after")]


#: Closures of the exchange outside its rules.
SPECIAL_CLOSURES = ["1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
EARLY_CLOSE, CUTOFF_MINUTE = 780, 569


def easter(y: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the golden number and the epact."""
    century = F.floor(y / 100)
    epact = F.pmod(19 * F.pmod(y, F.lit(19)) + century - F.floor(century / 4) - F.floor((century - F.floor((century + 8) / 25) + 1) / 3) + 15, F.lit(30))
    weekday = F.pmod(32 + 2 * F.pmod(century, F.lit(4)) + 2 * F.floor(F.pmod(y, F.lit(100)) / 4) - epact - F.pmod(y, F.lit(4)), F.lit(7))
    back = F.floor((F.pmod(y, F.lit(19)) + 11 * epact + 22 * weekday) / 451)
    return F.date_add(F.make_date(y, F.lit(3), F.lit(22)), (epact + weekday - 7 * back).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """years (y) -> day, schedule: the exchange's closures and early closes by its present rules; a row a holiday.

    A fixed date on a Saturday is kept on the Friday before, on a Sunday on the Monday after; a New Year's Day on a Saturday is not kept.
    """
    y = F.col("y")
    on = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    nth = lambda m, name, n: F.date_add(F.next_day(F.date_sub(on(m, 1), 1), name), 7 * (n - 1))
    kept = lambda d: F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)
    new_year, thanksgiving = on(1, 1), nth(11, "Thu", 4)
    closed = [
        F.when(F.weekday(new_year) != 5, kept(new_year)), F.when(y >= 1998, nth(1, "Mon", 3)), nth(2, "Mon", 3), F.date_sub(easter(y), 2), F.next_day(on(5, 24), "Mon"),
        F.when(y >= 2022, kept(on(6, 19))), kept(on(7, 4)), nth(9, "Mon", 1), thanksgiving, kept(on(12, 25)),
    ]
    early = [F.when((F.weekday(on(7, 3)) < 5) & (F.weekday(on(7, 4)) < 5), on(7, 3)), F.date_add(thanksgiving, 1), F.when((F.weekday(on(12, 24)) < 5) & (F.weekday(on(12, 25)) != 5), on(12, 24))]
    named = [F.struct(d.alias("day"), F.lit(kind).alias("schedule")) for days, kind in ((closed, "closed"), (early, "early_close")) for d in days]
    special = F.filter(F.array(*[F.lit(d).cast("date") for d in SPECIAL_CLOSURES]), lambda d: F.year(d) == y)
    every = years.select(F.explode(F.concat(F.array(*named), F.transform(special, lambda d: F.struct(d.alias("day"), F.lit("closed").alias("schedule"))))).alias("h"))
    return every.select("h.day", "h.schedule").where("day IS NOT NULL").groupBy("day").agg(F.min("schedule").alias("schedule"))  # closed comes before early_close


def calendar(days: DataFrame, whole_months: bool = False) -> DataFrame:
    """B2: weekdays between the first and last day of `days` (column day), or of their months, with an ordinal of open ones, schedule and closing minute.

    The bounds are two values, the calendar a row a day.
    """
    low, high = F.min("day"), F.max("day")
    bounds = days.agg(*([F.trunc(low, "month").alias("a"), F.last_day(high).alias("b")] if whole_months else [low.alias("a"), high.alias("b")]))
    every = bounds.select(F.explode(F.sequence("a", "b")).alias("session_date")).where(F.weekday("session_date") < 5)
    closures = holidays(bounds.select(F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y")))
    out = every.join(closures, F.col("session_date") == F.col("day"), "left").select("session_date", F.coalesce("schedule", F.lit("full")).alias("schedule"))
    out = out.withColumn("close_minute", F.when(F.col("schedule") == "early_close", EARLY_CLOSE).when(F.col("schedule") == "full", RTH_CLOSE))
    # one window over one row a calendar day
    return out.withColumn("ordinal", F.when(F.col("schedule") != "closed", F.sum(F.when(F.col("schedule") != "closed", 1).otherwise(0)).over(Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0))))


def with_times(cal: DataFrame) -> DataFrame:
    """Adds the instants of a session in UTC: the evening before, the cutoff, the open and the scheduled close (none on a closed day)."""
    at = lambda minute, day=0: F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.timestamp_add("MINUTE", minute + F.lit(1440 * day), F.col("session_date").cast("timestamp_ntz")))
    open_ = F.col("schedule") != "closed"
    return cal.withColumns({"overnight_start_at": at(F.lit(1080), -1), "cutoff_at": at(F.lit(CUTOFF_MINUTE)), "rth_open_at": F.when(open_, at(F.lit(RTH_OPEN))), "scheduled_close_at": F.when(open_, at(F.col("close_minute")))})


def calendar_sql(low: str = "min(CAST(o_orderdate AS DATE))", high: str = "max(CAST(o_orderdate AS DATE))") -> str:
    """The calendar for DuckDB, with Easter by another rule (valid from 1900 to 2099)."""
    special = ", ".join(f"DATE '{d}'" for d in SPECIAL_CLOSURES)
    kept = lambda d: f"CASE isodow({d}) WHEN 6 THEN {d} - 1 WHEN 7 THEN {d} + 1 ELSE {d} END"
    nth = lambda m, dow, n: f"make_date(y, {m}, 1) + CAST(({dow} - isodow(make_date(y, {m}, 1)) + 7) % 7 + {7 * (n - 1)} AS INT)"
    return f"""
days AS (SELECT {low} AS a, {high} AS b FROM orders),
every AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS session_date FROM days),
yr AS (SELECT CAST(y AS INT) AS y, (19 * (y % 19) + 24) % 30 AS p FROM (SELECT unnest(generate_series(year(a), year(b))) AS y FROM days)),
es AS (SELECT y, make_date(y, 3, 22) + CAST(p + q - CASE WHEN q = 6 AND (p = 29 OR p = 28 AND y % 19 > 10) THEN 7 ELSE 0 END AS INT) AS sunday FROM (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * p + 5) % 7 AS q FROM yr)),
hol AS (SELECT CAST(day AS DATE) AS day, 'closed' AS schedule FROM (SELECT unnest([CASE WHEN isodow(make_date(y, 1, 1)) <> 6 THEN {kept('make_date(y, 1, 1)')} END, CASE WHEN y >= 1998 THEN {nth(1, 1, 3)} END, {nth(2, 1, 3)}, sunday - 2,
    make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT), CASE WHEN y >= 2022 THEN {kept('make_date(y, 6, 19)')} END, {kept('make_date(y, 7, 4)')}, {nth(9, 1, 1)}, {nth(11, 4, 4)}, {kept('make_date(y, 12, 25)')}]) AS day FROM es) WHERE day IS NOT NULL
  UNION SELECT unnest([{special}]), 'closed'),
erl AS (SELECT CAST(day AS DATE) AS day FROM (SELECT unnest([make_date(y, 7, 3), {nth(11, 4, 4)} + 1, make_date(y, 12, 24)]) AS day FROM yr) WHERE isodow(day) <= 5 AND NOT (strftime(day, '%m-%d') = '07-03' AND isodow(day) = 5)),
cal0 AS (SELECT session_date, CASE WHEN session_date IN (SELECT day FROM hol) THEN 'closed' WHEN session_date IN (SELECT day FROM erl) THEN 'early_close' ELSE 'full' END AS schedule FROM every WHERE isodow(session_date) <= 5),
cal AS (SELECT *, CASE schedule WHEN 'early_close' THEN 780 WHEN 'full' THEN 960 END AS close_minute,
  CASE WHEN schedule <> 'closed' THEN CAST(sum(CASE WHEN schedule <> 'closed' THEN 1 ELSE 0 END) OVER (ORDER BY session_date) AS BIGINT) END AS ordinal FROM cal0)
"""


CALENDAR_SQL = calendar_sql()


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("b1_session_columns", f"WITH {BARS_SQL} SELECT instrument, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar, minute, session_scope, CAST(trading_day AS VARCHAR) AS trading_day FROM sb")
def b1(spark, sf_dir):
    return session_bars(spark, sf_dir).select("instrument", stamp("bar_start").alias("bar"), "minute", "session_scope", F.col("trading_day").cast("string").alias("trading_day"))


_INSTANT = "strftime(timezone('UTC', timezone('America/New_York', CAST(session_date AS TIMESTAMP) + {} * INTERVAL 1 MINUTE)), '%Y-%m-%d %H:%M:%S')"


@query("b2_calendar", f"""
WITH {CALENDAR_SQL} SELECT CAST(session_date AS VARCHAR) AS session_date, schedule, close_minute, ordinal, {_INSTANT.format(-360)} AS overnight_start_at, {_INSTANT.format(CUTOFF_MINUTE)} AS cutoff_at,
  CASE WHEN schedule <> 'closed' THEN {_INSTANT.format(RTH_OPEN)} END AS rth_open_at, {_INSTANT.format("close_minute")} AS scheduled_close_at FROM cal""")
def b2(spark, sf_dir):
    out = with_times(order_calendar(spark, sf_dir))
    return out.select(F.col("session_date").cast("string").alias("session_date"), "schedule", "close_minute", "ordinal", *[stamp(c).alias(c) for c in ("overnight_start_at", "cutoff_at", "rth_open_at", "scheduled_close_at")])


@query("b3_session_neighbours", f"""WITH {CALENDAR_SQL} SELECT CAST(session_date AS VARCHAR) AS session_date, CAST(lag(session_date) OVER w AS VARCHAR) AS previous, CAST(lead(session_date) OVER w AS VARCHAR) AS next,
  CAST(lag(session_date, 5) OVER w AS VARCHAR) AS five_before FROM cal WHERE schedule <> 'closed' WINDOW w AS (ORDER BY ordinal)""")
def b3(spark, sf_dir):
    """Previous and next sessions, and the fifth before, by ordinal: equi-joins on shifted ordinals, no global sort."""
    c = order_calendar(spark, sf_dir).where("schedule <> 'closed'").select("session_date", "ordinal")
    at = lambda name, by: c.select((F.col("ordinal") + by).alias("ordinal"), F.col("session_date").cast("string").alias(name))
    out = c.join(at("previous", 1), "ordinal", "left").join(at("next", -1), "ordinal", "left").join(at("five_before", 5), "ordinal", "left")
    return out.select(F.col("session_date").cast("string").alias("session_date"), "previous", "next", "five_before")


#: Days before its expiry at which a future stops being the front one; months of its cycle; sessions on either side of a roll.
ROLL_DAYS, CYCLE, EITHER_SIDE = 8, (3, 6, 9, 12), 2


def third_friday(month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(month, 1), "Fri"), 14)


def expiries(cal: DataFrame) -> DataFrame:
    """Month, expiry (third Friday, or the session before it on a holiday), and for months of the cycle the roll date (first session from ROLL_DAYS before) and its ordinal."""
    open_ = cal.where("schedule <> 'closed'").withColumn("month", F.trunc("session_date", "month"))
    e = open_.groupBy("month").agg(F.max(F.when(F.col("session_date") <= third_friday(F.col("month")), F.col("session_date"))).alias("expiry"))
    rolled = open_.join(e, "month").where((F.month("month").isin(list(CYCLE))) & (F.col("session_date") >= F.date_sub("expiry", ROLL_DAYS)))
    r = rolled.groupBy("month").agg(F.min("session_date").alias("roll_date"), F.min("ordinal").alias("roll_ordinal"))
    return e.join(r, "month", "left")


@query("b4_expiries", f"""
WITH {calendar_sql("date_trunc('month', min(o_orderdate))::DATE", "last_day(max(CAST(o_orderdate AS DATE)))")},
op AS (SELECT *, date_trunc('month', session_date)::DATE AS month FROM cal WHERE schedule <> 'closed'),
tf AS (SELECT DISTINCT month, CAST(month + CAST((5 - isodow(month) + 7) % 7 + 14 AS INT) AS DATE) AS friday FROM op),
ex AS (SELECT op.month, max(session_date) AS expiry FROM op JOIN tf ON tf.month = op.month AND session_date <= friday GROUP BY 1),
ro AS (SELECT op.month, min(session_date) AS roll_date, min(ordinal) AS o FROM op JOIN ex ON ex.month = op.month WHERE month(op.month) % 3 = 0 AND session_date >= expiry - {ROLL_DAYS} GROUP BY 1)
SELECT CAST(session_date AS VARCHAR) AS session_date, CAST(expiry AS VARCHAR) AS expiry, session_date = expiry AS is_expiry, date_trunc('week', session_date) = date_trunc('week', expiry) AS expiry_week,
  EXISTS (SELECT 1 FROM ro WHERE abs(ro.o - op.ordinal) <= {EITHER_SIDE}) AS roll_transition FROM op JOIN ex ON ex.month = op.month
WHERE session_date BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""")
def b4(spark, sf_dir):
    """Monthly expiry and its week, and sessions around a roll: ordinals near a roll's are listed and joined by equality."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    cal = calendar(days, whole_months=True)
    e = expiries(cal)
    near = e.where("roll_ordinal IS NOT NULL").select(F.explode(F.sequence(F.col("roll_ordinal") - EITHER_SIDE, F.col("roll_ordinal") + EITHER_SIDE)).alias("ordinal"), F.lit(True).alias("near")).distinct()
    c = cal.where("schedule <> 'closed'").join(F.broadcast(days.agg(F.min("day").alias("a"), F.max("day").alias("z"))), F.col("session_date").between(F.col("a"), F.col("z")))  # one row
    c = c.withColumn("month", F.trunc("session_date", "month")).join(e, "month").join(near, "ordinal", "left")
    return c.select(F.col("session_date").cast("string").alias("session_date"), F.col("expiry").cast("string").alias("expiry"), (F.col("session_date") == F.col("expiry")).alias("is_expiry"), (F.date_trunc("week", "session_date") == F.date_trunc("week", "expiry")).alias("expiry_week"), F.coalesce("near", F.lit(False)).alias("roll_transition"))


@query("b5_minute_slot", f"WITH {BARS_SQL} SELECT slot, session_scope, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM sb GROUP BY 1, 2")
def b5(spark, sf_dir):
    return session_bars(spark, sf_dir).groupBy("slot", "session_scope").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def dense_grid(bars: DataFrame, step: int = 60, slots: int = 1440) -> DataFrame:
    """Every slot of each stored day with the last price at or before it; never filled across days."""
    bars = bars.where(F.weekday("trading_day") < 5)  # on weekends two evenings share a date
    days = bars.select("instrument", "trading_day").distinct()
    grid = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - step), F.lit(step))).alias("slot"))
    joined = grid.join(bars.select("instrument", "trading_day", "slot", "close", "volume"), ["instrument", "trading_day", "slot"], "left")
    w = Window.partitionBy("instrument", "trading_day").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("last_price", F.last("close", ignorenulls=True).over(w))


GRID_SQL = f"""{BARS_SQL}, gd AS (SELECT DISTINCT instrument, trading_day FROM sb WHERE isodow(trading_day) <= 5), gs AS (SELECT *, CAST(unnest(generate_series(0, 1380, 60)) AS INT) AS slot FROM gd),
gj AS (SELECT gs.*, sb.close, sb.volume FROM gs LEFT JOIN sb USING (instrument, trading_day, slot)),
grid AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument, trading_day ORDER BY slot ROWS UNBOUNDED PRECEDING) AS last_price FROM gj),
ret AS (SELECT *, CASE WHEN slot < 1380 AND last_price > 0 AND lag(last_price) OVER w > 0 THEN ln(last_price) - ln(lag(last_price) OVER w) END AS r FROM grid WINDOW w AS (PARTITION BY instrument, trading_day ORDER BY slot))"""


def log_returns(grid: DataFrame, end_slot: int = 1380) -> DataFrame:
    """Log returns of the last price on the grid; none for the first slot, before the first price, from the day's end or at prices of 0."""
    before = F.lag("last_price").over(Window.partitionBy("instrument", "trading_day").orderBy("slot"))
    return grid.withColumn("r", F.when((F.col("slot") < end_slot) & (F.col("last_price") > 0) & (before > 0), F.log("last_price") - F.log(before)))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_returns(dense_grid(session_bars(spark, sf_dir)))


@query("b6_dense_grid", f"WITH {GRID_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, close, last_price FROM grid")
def b6(spark, sf_dir):
    return dense_grid(session_bars(spark, sf_dir)).select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", "close", "last_price")


@query("b7_log_returns", f"WITH {GRID_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, slot, round(r, 6) AS r FROM ret WHERE r IS NOT NULL")
def b7(spark, sf_dir):
    return returns(spark, sf_dir).where("r IS NOT NULL").select("instrument", F.col("trading_day").cast("string").alias("trading_day"), "slot", r6("r").alias("r"))


def phase(slot) -> F.Column:
    """The phase a slot lies in."""
    out = F.lit(PHASES[0][1])
    for at, name in PHASES[1:]:
        out = F.when(slot >= at, name).otherwise(out)
    return out


PHASE_SQL = "CASE WHEN slot >= 1320 THEN 'after' WHEN slot >= 1200 THEN 'close' WHEN slot >= 990 THEN 'midday' WHEN slot >= 930 THEN 'open' WHEN slot >= 840 THEN 'premarket' WHEN slot >= 360 THEN 'night' ELSE 'evening' END"


@query("b8_origin_phases", f"WITH {BARS_SQL} SELECT instrument, {PHASE_SQL} AS phase, count(*) AS n, round(avg(close), 6) AS mean_close FROM sb GROUP BY 1, 2")
def b8(spark, sf_dir):
    return session_bars(spark, sf_dir).groupBy("instrument", phase(F.col("slot")).alias("phase")).agg(F.count("*").alias("n"), r6(F.avg("close")).alias("mean_close"))


@query("b10_opening_range", f"WITH {BARS_SQL} SELECT instrument, CAST(trading_day AS VARCHAR) AS trading_day, max(high) AS range_high, min(low) AS range_low FROM sb WHERE session_scope = 'RTH' AND minute < 690 GROUP BY 1, 2")
def b10(spark, sf_dir):
    """High and low of the first two hours of the regular session."""
    first = session_bars(spark, sf_dir).where((F.col("session_scope") == "RTH") & (F.col("minute") < RTH_OPEN + 120))
    return first.groupBy("instrument", F.col("trading_day").cast("string").alias("trading_day")).agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"))


@query("b12_expected_bars", f"WITH {CALENDAR_SQL} SELECT schedule, count(*) AS days, CAST(sum(CASE schedule WHEN 'full' THEN 1380 WHEN 'early_close' THEN 1140 ELSE 0 END) AS BIGINT) AS bars, CAST(sum(coalesce(close_minute - 570, 0)) AS BIGINT) AS rth_bars FROM cal GROUP BY 1")
def b12(spark, sf_dir):
    c = order_calendar(spark, sf_dir)
    n = F.when(F.col("schedule") == "full", 1380).when(F.col("schedule") == "early_close", 1140).otherwise(0)
    return c.groupBy("schedule").agg(F.count("*").alias("days"), F.sum(n).cast("long").alias("bars"), F.sum(F.coalesce(F.col("close_minute") - RTH_OPEN, F.lit(0))).cast("long").alias("rth_bars"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly contracts of each market segment over the dates that the orders cover; an expiry on a holiday is a day earlier."""
    days = table(spark, sf_dir, "orders").agg(F.trunc(F.min(F.to_date("o_orderdate")), "quarter").alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    months = days.select(F.explode(F.expr("sequence(a, add_months(b, 6), interval 3 months)")).alias("month")).withColumn("friday", third_friday(F.add_months("month", 2)))
    closed = holidays(months.select(F.year("friday").alias("y")).distinct()).where("schedule = 'closed'").select(F.col("day").alias("friday"), F.lit(1).alias("shift"))
    months = months.join(closed, "friday", "left").select("month", F.date_sub("friday", F.coalesce("shift", F.lit(0))).alias("expiry"))
    symbols = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("symbol")).distinct()
    return symbols.join(F.broadcast(months)).select("symbol", F.concat_ws("-", "symbol", F.date_format("month", "yyyyMM")).alias("contract"), "expiry")  # a row a quarter is broadcast


CHAIN_SQL = f"""{calendar_sql("date_trunc('quarter', min(o_orderdate))::DATE", "CAST(max(CAST(o_orderdate AS DATE)) + INTERVAL 12 MONTH AS DATE)")},
qd AS (SELECT date_trunc('quarter', min(o_orderdate))::DATE AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
qm AS (SELECT CAST(unnest(generate_series(a, b + INTERVAL 6 MONTH, INTERVAL 3 MONTH)) AS DATE) AS month FROM qd),
qf AS (SELECT month, CAST(CAST(month + INTERVAL 2 MONTH AS DATE) + CAST((5 - isodow(month + INTERVAL 2 MONTH) + 7) % 7 + 14 AS INT) AS DATE) AS friday FROM qm),
chain AS (SELECT symbol, symbol || '-' || strftime(month, '%Y%m') AS contract, friday - CASE WHEN friday IN (SELECT day FROM hol) THEN 1 ELSE 0 END AS expiry FROM (SELECT DISTINCT c_mktsegment AS symbol FROM customer), qf),
traded AS (SELECT DISTINCT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON c_custkey = o_custkey),
front AS (SELECT t.symbol, t.day, arg_min(contract, expiry) AS contract, min(expiry) AS expiry FROM traded t JOIN chain c ON c.symbol = t.symbol AND c.expiry - 8 > t.day GROUP BY 1, 2)
"""


def traded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.select("o_custkey", F.to_date("o_orderdate").alias("day")).join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol")), "o_custkey")
    return joined.select("symbol", "day").distinct()


#: A week of slack on the expiry of a contract that the chain lacks, estimated from its successor's.
EXPIRY_SLACK, CYCLE_MONTHS = 7, 3


def front_contracts(days: DataFrame, contracts: DataFrame, roll_days: int = ROLL_DAYS) -> DataFrame:
    """The contract of the nearest expiry more than roll_days away, for each symbol and day.

    An as-of lookup from the right: contracts and days share one window ordered from the latest, so the join does not
    multiply rows by the length of the chain. A chain may lack contracts: where it lacks the one before the nearest in the cycle, and
    that one may not have rolled off by the day, the day is left out rather than filed under the wrong contract.
    """
    before = Window.partitionBy("symbol").orderBy("expiry")
    gap = F.months_between(F.trunc("expiry", "month"), F.trunc(F.lag("expiry").over(before), "month"))
    lacking = F.coalesce(gap != CYCLE_MONTHS, F.lit(True))
    since = F.when(lacking, F.date_add(F.add_months("expiry", -CYCLE_MONTHS), EXPIRY_SLACK - roll_days))
    c = contracts.withColumn("since", since).select("symbol", F.date_sub("expiry", roll_days).alias("day"), F.lit(1).alias("side"), F.struct("contract", "expiry", "since").alias("c"))
    d = days.select("symbol", "day", F.lit(0).alias("side"), F.lit(None).cast(c.schema["c"].dataType).alias("c"))
    w = Window.partitionBy("symbol").orderBy(F.desc("day"), "side").rowsBetween(Window.unboundedPreceding, -1)
    found = c.unionAll(d).withColumn("found", F.last("c", ignorenulls=True).over(w)).where("side = 0 AND found IS NOT NULL AND coalesce(found.since <= day, true)")
    return found.select("symbol", "day", "found.contract", "found.expiry")


@query("c1_front_contract", f"WITH {CHAIN_SQL} SELECT symbol, CAST(day AS VARCHAR) AS day, contract, CAST(expiry AS VARCHAR) AS expiry FROM front")
def c1(spark, sf_dir):
    f = front_contracts(traded_days(spark, sf_dir), chain(spark, sf_dir))
    return f.select("symbol", F.col("day").cast("string").alias("day"), "contract", F.col("expiry").cast("string").alias("expiry"))


def segments(assigned: DataFrame) -> DataFrame:
    """Contiguous runs of days on one contract."""
    w = Window.partitionBy("symbol").orderBy("day")
    new = F.when(F.lag("contract").over(w) == F.col("contract"), 0).otherwise(1)
    runs = assigned.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "run", "contract").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


#: Sessions before a contract's first active day that are stored from it.
WARMUP = 5


def with_warmup(rows: DataFrame, cal: DataFrame, first: str = "first_day") -> DataFrame:
    """Adds reference_day, the session before a contract's first day, and warmup_from, the WARMUP-th before it. Both tables have a row a roll or a day."""
    open_ = cal.where("schedule <> 'closed'").select(F.lit(1).alias("one"), "session_date", "ordinal")
    at = as_of(rows.withColumn("one", F.lit(1)), open_, ["one"], first, "session_date", ["ordinal"], strict=True).drop("one").withColumnRenamed("session_date", "reference_day")
    return at.join(open_.select(F.col("session_date").alias("warmup_from"), (F.col("ordinal") + WARMUP - 1).alias("ordinal")), "ordinal", "left").drop("ordinal")


_WARM = f"""(SELECT max(session_date) FROM cal WHERE schedule <> 'closed' AND session_date < {{first}}) AS reference_day,
  (SELECT min(session_date) FROM (SELECT session_date FROM cal WHERE schedule <> 'closed' AND session_date < {{first}} ORDER BY session_date DESC LIMIT {WARMUP}) HAVING count(*) = {WARMUP}) AS warmup_from"""


def chain_calendar(spark, sf_dir) -> DataFrame:
    """The calendar from the first quarter of the chain on."""
    o = table(spark, sf_dir, "orders").agg(F.trunc(F.min(F.to_date("o_orderdate")), "quarter").alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return calendar(o.select(F.explode(F.array("a", "b")).alias("day")))


@query("c3_contract_segments", f"""WITH {CHAIN_SQL}, n AS (SELECT *, CASE WHEN lag(contract) OVER (PARTITION BY symbol ORDER BY day) = contract THEN 0 ELSE 1 END AS new FROM front),
s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY day) AS run FROM n),
g AS (SELECT symbol, CAST(run AS BIGINT) AS run, contract, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM s GROUP BY symbol, run, contract), f AS (SELECT first_day, {_WARM.format(first="x.first_day")} FROM (SELECT DISTINCT first_day FROM g) x)
SELECT symbol, run, contract, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, days, CAST(reference_day AS VARCHAR) AS reference_day, CAST(warmup_from AS VARCHAR) AS warmup_from FROM g JOIN f USING (first_day)""")
def c3(spark, sf_dir):
    s = with_warmup(segments(front_contracts(traded_days(spark, sf_dir), chain(spark, sf_dir))), chain_calendar(spark, sf_dir))
    day = lambda c: F.col(c).cast("string").alias(c)
    return s.select("symbol", F.col("run").cast("long").alias("run"), "contract", day("first_day"), day("last_day"), "days", day("reference_day"), day("warmup_from"))


@query("c7_active_contract_volume", f"""WITH {CHAIN_SQL} SELECT f.contract, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey JOIN front f ON f.symbol = c_mktsegment AND f.day = CAST(o_orderdate AS DATE) GROUP BY 1""")
def c7(spark, sf_dir):
    """Rows on each day's active contract only: an equi-join on (symbol, day)."""
    front = front_contracts(traded_days(spark, sf_dir), chain(spark, sf_dir))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day")).join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol")), "o_custkey")
    daily = rows.groupBy("symbol", "day").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return daily.join(front, ["symbol", "day"]).groupBy("contract").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


@query("b11_targets_observed", f"""WITH {CALENDAR_SQL} SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS observed FROM cal, (SELECT unnest([15, 30, 60, 390]) AS m) WHERE schedule <> 'closed' AND least(570 + m, close_minute) <= 780 GROUP BY 1""")
def b11(spark, sf_dir):
    """How many targets' windows have ended by 13:00; early closes cut them."""
    c = order_calendar(spark, sf_dir).where("schedule <> 'closed'").withColumn("m", F.explode(F.array(*[F.lit(m) for m in (15, 30, 60, 390)])))
    return c.where(F.least(RTH_OPEN + F.col("m"), F.col("close_minute")) <= 780).groupBy(F.col("session_date").cast("string").alias("session_date")).agg(F.count("*").alias("observed"))


@query("b13_finalised_gate", f"WITH {CALENDAR_SQL} SELECT schedule, count(*) FILTER (CAST(session_date AS TIMESTAMP) + (close_minute + 120) * INTERVAL 1 MINUTE <= TIMESTAMP '1997-06-30 18:00:00') AS finalised, count(*) AS days FROM cal WHERE schedule <> 'closed' GROUP BY 1")
def b13(spark, sf_dir):
    """Sessions whose close lies two hours back at a given instant."""
    end = F.timestamp_add("MINUTE", F.col("close_minute") + 120, F.col("session_date").cast("timestamp_ntz"))
    c = order_calendar(spark, sf_dir).where("schedule <> 'closed'")
    return c.groupBy("schedule").agg(F.count_if(end <= F.lit("1997-06-30 18:00:00").cast("timestamp_ntz")).alias("finalised"), F.count("*").alias("days"))


def missing_cycle_months(cycle: DataFrame, held: DataFrame, last_day: DataFrame) -> DataFrame:
    """Contracts of the cycle that a symbol does not hold, up to the newest it holds, or to the first held one that expires on or after its last day.

    cycle: symbol, contract, expiry; held: symbol, contract; last_day: symbol, day.
    """
    rows = cycle.join(held.select("symbol", "contract", F.lit(True).alias("held")).distinct(), ["symbol", "contract"], "left").join(last_day, "symbol")
    own = F.when(F.col("held"), F.col("expiry"))
    ends = rows.groupBy("symbol").agg(F.coalesce(F.min(F.when(own >= F.col("day"), own)), F.max(own)).alias("newest"))
    return rows.join(ends, "symbol").where("held IS NULL AND expiry < newest").select("symbol", "contract", "expiry")


@query("c2_missing_cycle_months", f"""
WITH {CHAIN_SQL}, h AS (SELECT symbol, contract, expiry FROM chain SEMI JOIN traded ON traded.symbol = chain.symbol AND traded.day = chain.expiry), z AS (SELECT symbol, max(day) AS day FROM traded GROUP BY 1),
n AS (SELECT h.symbol, coalesce(min(expiry) FILTER (expiry >= day), max(expiry)) AS newest FROM h JOIN z USING (symbol) GROUP BY 1)
SELECT c.symbol, c.contract, CAST(c.expiry AS VARCHAR) AS expiry FROM chain c JOIN n ON n.symbol = c.symbol AND c.expiry < n.newest ANTI JOIN h ON h.symbol = c.symbol AND h.contract = c.contract""")
def c2(spark, sf_dir):
    """Contracts that a segment did not trade on their last day count as not held."""
    cycle, days = chain(spark, sf_dir), traded_days(spark, sf_dir)
    held = cycle.join(days.select("symbol", F.col("day").alias("expiry")), ["symbol", "expiry"], "left_semi")
    out = missing_cycle_months(cycle, held, days.groupBy("symbol").agg(F.max("day").alias("day")))
    return out.withColumn("expiry", F.col("expiry").cast("string"))


@query("c4_next_roll", f"""WITH {CHAIN_SQL}, n AS (SELECT *, lead(contract) OVER w AS nc, lead(day) OVER w AS nd FROM front WINDOW w AS (PARTITION BY symbol ORDER BY day)),
f AS (SELECT nd, {_WARM.format(first="x.nd")} FROM (SELECT DISTINCT nd FROM n WHERE nc <> contract) x)
SELECT symbol, CAST(day AS VARCHAR) AS last_day, CAST(n.nd AS VARCHAR) AS first_day, contract, nc AS next_contract, CAST(warmup_from AS VARCHAR) AS warmup_from, day >= warmup_from AS begun FROM n JOIN f ON f.nd = n.nd WHERE nc <> contract""")
def c4(spark, sf_dir):
    """Every roll: the last day on a contract, the first on the next, since when the next one's warm-up is stored, and whether that has begun on the last day."""
    w = Window.partitionBy("symbol").orderBy("day")
    f = front_contracts(traded_days(spark, sf_dir), chain(spark, sf_dir))
    n = f.select("symbol", "day", "contract", F.lead("contract").over(w).alias("next_contract"), F.lead("day").over(w).alias("first_day")).where("next_contract <> contract")
    n = with_warmup(n, chain_calendar(spark, sf_dir))
    return n.select("symbol", F.col("day").cast("string").alias("last_day"), F.col("first_day").cast("string").alias("first_day"), "contract", "next_contract", F.col("warmup_from").cast("string").alias("warmup_from"), (F.col("day") >= F.col("warmup_from")).alias("begun"))


@query("c6_best_contract", f"""WITH {CHAIN_SQL}, r AS (SELECT symbol, contract, expiry, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN expiry >= DATE '1997-01-10' THEN 0 ELSE 1 END, CASE WHEN expiry >= DATE '1997-01-10' THEN expiry - DATE '1997-01-10' ELSE DATE '1997-01-10' - expiry END) AS rank FROM chain)
SELECT symbol, contract, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4""")
def c6(spark, sf_dir):
    """Contracts for a day: later expiries nearest first, then earlier ones."""
    day = F.lit("1997-01-10").cast("date")
    w = Window.partitionBy("symbol").orderBy(F.when(F.col("expiry") >= day, 0).otherwise(1), F.abs(F.datediff("expiry", day)))
    return chain(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 4").select("symbol", "contract", "rank")
