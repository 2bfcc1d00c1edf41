"""Column helpers shared by the operators. All are built-in expressions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stamp(ts) -> Column:
    """A timestamp as text, the same in any session zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def r6(x) -> Column:
    """Rounded to six places, with no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def islands(df: DataFrame, keys: list[str], order: str, step) -> DataFrame:
    """Numbers runs (column run) in which `order` grows by `step` from row to row."""
    w = Window.partitionBy(*keys).orderBy(order)
    broken = F.when(F.col(order) - F.lag(order).over(w) == step, 0).otherwise(1)
    return df.withColumn("__b", broken).withColumn("run", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of right's last row of the same keys at or before (strict: before) its time.

    One union, one shuffle on the keys and one window: no range join, and a key's rows stream through it sorted.
    """
    l = left.select("*", F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.select(F.struct(right_time, *values)).schema[0].dataType).alias("__r"))
    r = right.select(*[(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(right_time, *values).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    side = 0 if strict else 1
    joined = l.unionAll(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == side)
    return joined.select(*left.columns, *[F.col(f"__m.{c}").alias(c) for c in [right_time, *values]])


def ema(df: DataFrame, keys: list[str], order: str, lines: dict[str, tuple[str, int]], block: int = 256) -> DataFrame:
    """df with exponential averages name: (column, length), alpha = 2 / (length + 1), each seeded with the first value of its key.

    Rows are cut into blocks. Within a block the average is a running sum of scaled values; what a block carries on is folded
    over one number a block, so no list of rows is made. A block's scale grows to (1 - alpha) ** -block at most.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__b", F.floor(F.col("__i") / block))
    x = x.withColumn("__j", F.col("__i") - F.col("__b") * block)
    inside, ends = Window.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0), []
    for name, (column, length) in lines.items():
        a = 2.0 / (length + 1)
        part = F.when(F.col("__i") == 0, F.col(column)).otherwise(a * F.col(column))  # the seed counts whole
        x = x.withColumn(f"__{name}", F.sum(part * F.pow(F.lit(1 - a), -F.col("__j"))).over(inside) * F.pow(F.lit(1 - a), F.col("__j")))
        ends.append(F.max_by(f"__{name}", "__i").alias(f"__e_{name}"))
    e = x.groupBy(*keys, "__b").agg(*ends)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    for name, (_, length) in lines.items():
        e = e.withColumn(f"__c_{name}", _folded(F.collect_list(f"__e_{name}").over(before), (1 - 2.0 / (length + 1)) ** block))  # a number a block
    out = x.join(e.select(*keys, "__b", *[f"__c_{n}" for n in lines]), [*keys, "__b"])
    made = [(F.col(f"__{n}") + F.col(f"__c_{n}") * F.pow(F.lit(1 - 2.0 / (length + 1)), F.col("__j") + 1)).alias(n) for n, (_, length) in lines.items()]
    return out.select(*df.columns, *made)


def _folded(values: Column, keep: float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s * keep + v)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 1024) -> DataFrame:
    """A row for each key with q: its exact percentiles (linear between neighbours, nulls left out), for keys of any number of rows.

    First counts by equal-width bins (partial sums before the shuffle, `bins` rows a key at most) tell which bins hold the
    wanted ranks; then only those bins' distinct values are counted and walked. No task holds a key's values. Keys are few: a row
    a key, and two for each percentile, are broadcast, so rows stay where they are read and only partial counts are shuffled.
    """
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    span = own.groupBy(*keys).agg(F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.count("*").alias("__n"))
    place = F.when(F.col("__z") == F.col("__a"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("__a")) / (F.col("__z") - F.col("__a")) * bins)))
    binned = own.join(F.broadcast(span), keys).withColumn("__bin", place.cast("int"))
    w = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*keys, "__bin", "__n").agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__upto", F.sum("__c").over(w)).withColumn("__before", F.col("__upto") - F.col("__c"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("__n") - 1)), F.ceil(F.lit(p) * (F.col("__n") - 1))) for p in probs])))
    wanted = counts.where(F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__upto")))).select(*keys, "__bin", "__before")
    values = binned.join(F.broadcast(wanted), [*keys, "__bin"]).groupBy(*keys, "__bin", "__before", "__n", "__v").agg(F.count("*").alias("__c"))
    run = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("__last", F.col("__before") + F.sum("__c").over(run) - 1)  # the rank of a value's last row
    at = lambda r: F.min(F.when(F.col("__last") >= r, F.col("__v")))
    sides = [at(f(F.lit(p) * (F.col("__n") - 1))).alias(f"__{k}{side}") for k, p in enumerate(probs) for side, f in (("l", F.floor), ("h", F.ceil))]
    got = values.groupBy(*keys, "__n").agg(*sides)
    part = lambda p: F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1))
    return got.select(*keys, F.array(*[F.col(f"__{k}l") + (F.col(f"__{k}h") - F.col(f"__{k}l")) * part(p) for k, p in enumerate(probs)]).alias("q"))


def trailing_quantiles(values: DataFrame, targets: DataFrame, keys: list[str], ordinal: str, value: str, probs: list[float], back: int) -> DataFrame:
    """targets (keys, ordinal) with n and q: exact percentiles (linear between neighbours) of the values whose ordinal lies 1 to `back` before.

    A key's values of one ordinal become one sorted list; lists are merged over a window of one row an ordinal, so no value is
    copied for the ordinals that it serves. An ordinal's own values must fit into a row. Targets without a value are left out.
    """
    lists = values.where(F.col(value).isNotNull()).groupBy(*keys, ordinal).agg(F.array_sort(F.collect_list(value)).alias("__own"))
    rows = targets.select(*keys, ordinal).distinct().withColumn("__asked", F.lit(True)).join(lists, [*keys, ordinal], "full")
    past = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-back, -1)
    rows = rows.withColumn("__all", F.array_sort(F.flatten(F.collect_list("__own").over(past)))).where(F.col("__asked") & (F.size("__all") > 0)).withColumn("n", F.size("__all").cast("long"))

    def at(p: Column) -> Column:
        place = p * (F.col("n") - 1)
        low, high = F.get("__all", F.floor(place).cast("int")), F.get("__all", F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return rows.select(*keys, ordinal, "n", F.transform(F.array(*[F.lit(float(p)) for p in probs]), at).alias("q"))


def wilder(column: str, keys: list[str], order: str, period: int, rows: int) -> Column:
    """Wilder's average of the last `rows` values: the mean of the first `period`, then (n - 1) parts old and one new; null before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    values = F.collect_list(column).over(w)
    seed = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda s, x: s + x) / period
    folded = F.aggregate(F.slice(values, period + 1, rows), seed, lambda s, x: (s * (period - 1) + x) / period)
    return F.when(F.size(values) == rows, folded)
