"""Ranks, quantiles and top fractions of groups of any size.

A window over a group sorts the whole group in one task. Here Spark sorts all groups at once by range:
each range is one task's share, a large group lies in many and small ones share one. Counts of
the ranges, summed up over those before, say how much of a group comes before a range; within a
range a running sum gives the rest. Equal values are counted first and are one row, so that
no value is too frequent either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.sources.shared import written

#: Positions of one value that are listed in one cell.
LISTED = 10_000


def same(a: str, b: str, columns: list[str]) -> Column:
    """Whether the columns of both aliases are equal, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def placed(df: DataFrame, keys: list[str], order: list[Column], weight: str) -> DataFrame:
    """df with before and total: the weights of the rows before a row in its group by rising order, and of the
    whole group. Rows must differ in keys or order."""
    named = [f"__o{k}" for k in range(len(order))]
    rows = df.withColumns(dict(zip(named, order)))
    # The ranges follow from a sample: written down, they are the same for all that reads them.
    parts = written(rows.repartitionByRange(*keys, *named).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*keys, "__part").agg(F.sum(weight).alias("__size"))
    group = W.partitionBy(*keys)
    earlier = F.coalesce(F.sum("__size").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row for each group and each range that a group spans.
    starts = sizes.select(*keys, "__part", earlier.alias("__start"), F.sum("__size").over(group).alias("total"))
    within = W.partitionBy(*keys, "__part").orderBy(*named).rowsBetween(W.unboundedPreceding, -1)
    inner = parts.withColumn("__inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    out = inner.alias("a").join(starts.alias("b"), same("a", "b", [*keys, "__part"]))
    return out.select(*[f"a.{c}" for c in df.columns], (F.col("b.__start") + F.col("a.__inner")).alias("before"), "b.total")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, v (the value as a double), n (rows that have it), before (rows of the group with a smaller
    one) and total, for values that are not null. NaN is the largest."""
    # Both zeros are one value.
    v = (F.col(value).cast("double") + F.lit(0.0)).alias("v")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, v).agg(F.count("*").alias("n"))
    return placed(counted, keys, [F.col("v")], "n")


def average_rank() -> Column:
    """The rank, from 1, of a row of value_counts(): equal values share the mean of their ranks."""
    return F.col("before") + (F.col("n") + 1) / 2


def positions(counts: DataFrame) -> DataFrame:
    """value_counts() with a row for each position (from 1) that a value takes. The positions of a very
    frequent value are listed in many tasks."""
    last = F.col("before") + F.col("n")
    spread = counts.withColumn("__first", F.explode(F.sequence(F.col("before") + 1, last, F.lit(LISTED))))
    spread = spread.hint("rebalance")
    return spread.withColumn("position", F.explode(F.sequence(F.col("__first"), F.least(last, F.col("__first") + LISTED - 1)))).drop("__first")


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and a column for each name of `at`: the exact quantile, between two values in proportion.
    Only the values at the places that are asked for meet by group."""
    counts = value_counts(df, keys, value)
    last = F.col("before") + F.col("n")
    names, sums = {}, []
    for k, share in enumerate(at.values()):
        place = (F.col("total") - 1) * F.lit(float(share))
        low = F.floor(place)
        names |= {f"__l{k}": low, f"__p{k}": place - low}
        for side, step in (("a", 0), ("b", 1)):
            wanted = F.least(F.col(f"__l{k}") + step, F.col("total") - 1)
            sums.append(F.max(F.when((F.col("before") <= wanted) & (wanted < last), F.col("v"))).alias(f"__{side}{k}"))
        sums.append(F.max(f"__p{k}").alias(f"__p{k}"))
    found = counts.withColumns(names).groupBy(*keys).agg(*sums)
    between = lambda k: F.when(F.col(f"__p{k}") == 0, F.col(f"__a{k}")).otherwise(F.col(f"__a{k}") + (F.col(f"__b{k}") - F.col(f"__a{k}")) * F.col(f"__p{k}"))
    return found.select(*keys, *[between(k).alias(name) for k, name in enumerate(at)])
