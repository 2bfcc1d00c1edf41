"""Group L, scores of whole distributions on identical rows: the normal, the folded normal and the members they are made from.

E|X - a| of a normal X is A(a) = s (2 phi(w) + w (2 Phi(w) - 1)), w = (a - m) / s. For y >= 0, ||x| - y| = |x - y| + |x + y| - |x| - y;
and for two draws, with S their sum and D their difference, E||X| - |X'|| = E|S| + E|D| - 2 E|X|. So the folded normal's score is closed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from .judging import P as JUDGING
from .scoring import ERF, ERF_P, erf
from .walk import OFFSETS

QUERIES: dict = {}
SQL: dict = {}
ROOT_PI = 1.7724538509055159
#: Least members of a forecast.
LEAST = 3


def distance(a: Column, mean: Column, deviation: Column) -> Column:
    """E|X - a| of a normal."""
    w = (a - mean) / deviation
    return deviation * (2.0 / (ROOT_PI * 2.0**0.5) * F.exp(-0.5 * w * w) + w * erf(w / 2.0**0.5))


def crps_gaussian(y: Column, mean: Column, deviation: Column) -> Column:
    return distance(y, mean, deviation) - deviation / ROOT_PI


def crps_folded(y: Column, mean: Column, deviation: Column) -> Column:
    """The score of |X| at y >= 0."""
    zero = F.lit(0.0)
    size = distance(zero, mean, deviation)
    apart = distance(y, mean, deviation) + distance(-y, mean, deviation) - size - y
    spread = distance(zero, 2 * mean, 2.0**0.5 * deviation) + 2 * deviation / ROOT_PI - 2 * size
    return apart - spread / 2


def crps_members(y: Column, members: Column) -> Column:
    """The fair score of an ensemble, an array of two members at least: sorted members weigh their pairwise distances in one pass."""
    n, own = F.size(members), F.array_sort(members)
    error = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.abs(x - y)) / n
    spread = F.aggregate(F.transform(own, lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda s, x: s + x)
    return error - spread / (n * (n - 1))


_MEMBERS = f"""SELECT instrument, trading_day, 'top5' AS arm, earlier FROM {{sets}} x UNION ALL SELECT instrument, trading_day, 'path4' AS arm, earlier FROM {{batch}} b WHERE n = 4
UNION ALL SELECT t.instrument, t.trading_day, 'same_clock' AS arm, e.trading_day AS earlier FROM {{days}} t CROSS JOIN {OFFSETS} JOIN {{days}} e ON e.instrument = t.instrument AND e.d = t.d - ahead"""


def member_rows(members: DataFrame, moves: DataFrame) -> DataFrame:
    """Forecasts of each arm from its members' moves, on the cases for which every arm has LEAST members that moved: y, members, mean, deviation."""
    key = ["instrument", "trading_day"]
    known = moves.where("move IS NOT NULL")
    own = members.join(known.select("instrument", F.col("trading_day").alias("earlier"), F.col("move").alias("m")), ["instrument", "earlier"])
    made = own.groupBy(*key, "arm").agg(F.collect_list("m").alias("members"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"))  # a set's members
    made = made.where((F.size("members") >= LEAST) & (F.col("deviation") > 0)).join(known.select(*key, F.col("move").alias("y")), key)
    arms = members.select("arm").distinct().count()
    return made.withColumn("arms", F.count("*").over(Window.partitionBy(*key))).where(F.col("arms") == arms)


def l39(spark, sf_dir) -> DataFrame:
    """Mean scores of every arm: its normal at the move, its folded normal and its members at the move's size, its members at the move."""
    rows = member_rows(JUDGING.frame(_MEMBERS, spark, sf_dir), JUDGING.frame("SELECT instrument, trading_day, move FROM {member_moves} m", spark, sf_dir))
    y, m, s = F.col("y"), F.col("mean"), F.col("deviation")
    sizes = F.transform("members", lambda x: F.abs(x))
    scores = {"gaussian": crps_gaussian(y, m, s), "folded": crps_folded(F.abs(y), m, s), "member": crps_members(y, F.col("members")), "member_size": crps_members(F.abs(y), sizes)}
    return rows.groupBy("arm").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(name) for name, c in scores.items()])


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    return f"(sign({x}) * (1 - ({' + '.join(f'{c} * pow({t}, {k + 1})' for k, c in enumerate(ERF))}) * exp(-({x}) * ({x}))))"


def _distance_sql(a: str, m: str, s: str) -> str:
    return f"({s} * (2 / sqrt(2 * pi()) * exp(-0.5 * pow((({a}) - ({m})) / ({s}), 2)) + (({a}) - ({m})) / ({s}) * {_erf_sql(f'((({a}) - ({m})) / ({s}) / sqrt(2))')}))"


_MEMBER_SQL = "(SELECT avg(abs(x - {y})) FROM unnest({l}) u(x)) - (SELECT sum(abs(a - b)) FROM unnest({l}) u(a), unnest({l}) v(b)) / (2.0 * len({l}) * (len({l}) - 1))"
_FOLDED = f"{_distance_sql('abs(y)', 'm', 's')} + {_distance_sql('-abs(y)', 'm', 's')} - {_distance_sql('0', 'm', 's')} - abs(y) - ({_distance_sql('0', '2 * m', 'sqrt(2) * s')} + 2 * s / sqrt(pi()) - 2 * {_distance_sql('0', 'm', 's')}) / 2"
SQL["l39_distributional"] = JUDGING.text(f"""k AS ({_MEMBERS}),
g AS (SELECT k.instrument, k.trading_day, arm, list(v.move) AS l, list(abs(v.move)) AS la, avg(v.move) AS m, stddev_samp(v.move) AS s FROM k JOIN {{member_moves}} v ON v.instrument = k.instrument AND v.trading_day = k.earlier AND v.move IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
r AS (SELECT g.*, o.move AS y, count(*) OVER (PARTITION BY g.instrument, g.trading_day) AS arms FROM g JOIN {{member_moves}} o ON o.instrument = g.instrument AND o.trading_day = g.trading_day AND o.move IS NOT NULL WHERE s > 0),
c AS (SELECT arm, {_distance_sql('y', 'm', 's')} - s / sqrt(pi()) AS gaussian, {_FOLDED} AS folded, {_MEMBER_SQL.format(y='y', l='l')} AS member, {_MEMBER_SQL.format(y='abs(y)', l='la')} AS member_size FROM r WHERE arms = 3)
SELECT arm, count(*) AS n, round(avg(gaussian), 6) AS gaussian, round(avg(folded), 6) AS folded, round(avg(member), 6) AS member, round(avg(member_size), 6) AS member_size FROM c GROUP BY 1""")
QUERIES["l39_distributional"] = l39
