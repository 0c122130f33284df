"""Cleaning and description of per-subject series, by window functions.

A series is the rows of equal keys in the order of a frame column; nulls are missing values.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.operators import ranks
from kestrel.sources.shared import written


def _over(keys, order):
    return W.partitionBy(*keys).orderBy(order)


def _neighbours(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with the values and places of the nearest values before and after each row."""
    w = _over(keys, order)
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("__at", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.col("__at"))
    return df.withColumns({
        "__v0": F.last(value, ignorenulls=True).over(before), "__v1": F.first(value, ignorenulls=True).over(after),
        "__i0": F.last(known, ignorenulls=True).over(before), "__i1": F.first(known, ignorenulls=True).over(after),
    })


def _filled(df: DataFrame, keys, order, value, out, max_gap, between) -> DataFrame:
    df = _neighbours(df, keys, order, value)
    gap = F.col("__i1") - F.col("__i0") - 1
    weight = (F.col("__at") - F.col("__i0")) / (gap + 1)
    inner = F.when(gap <= max_gap, between(F.col("__v0").cast("double"), F.col("__v1").cast("double"), weight))
    edge = F.when(F.col("__v0").isNull(), F.col("__v1")).when(F.col("__v1").isNull(), F.col("__v0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__v0").isNull() | F.col("__v1").isNull(), edge).otherwise(inner)
    return df.withColumn(out, filled).drop("__at", "__v0", "__v1", "__i0", "__i1")


def gap_filled(df: DataFrame, keys: list[str], order: str, value: str, out: str, max_gap: int = 30) -> DataFrame:
    """Gaps of up to max_gap nulls filled on a straight line; longer inner ones stay null; the
    series' ends take the nearest value. A series of nulls stays null."""
    return _filled(df, keys, order, value, out, max_gap, lambda a, b, w: a + w * (b - a))


def angle_gap_filled(df: DataFrame, keys: list[str], order: str, value: str, out: str, max_gap: int = 30) -> DataFrame:
    """As gap_filled for angles of period 180: the line goes the short way round, and results
    lie in [0, 180)."""

    def between(a: Column, b: Column, w: Column) -> Column:
        diff = b - a
        far = F.when(diff > 90, b - 180).when(diff < -90, b + 180)
        turned = a + w * (far - a)
        return F.when(far.isNull(), a + w * diff).when(turned < 0, turned + 180).when(turned >= 180, turned - 180).otherwise(turned)

    return _filled(df, keys, order, value, out, max_gap, between)


def features_filled(df: DataFrame, keys: list[str], order: str, columns: list[str], angles: tuple[str, ...] = (), max_gap: int = 30) -> DataFrame:
    """df with the gaps of all the columns filled: angles by angle_gap_filled(), the others on
    straight lines. All columns share the series' one sort."""
    for c in columns:
        df = (angle_gap_filled if c in angles else gap_filled)(df, keys, order, c, c, max_gap)
    return df


def fill_report(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, n_before, n_after and n_filled: missing values of each column before and
    after filling."""
    a, b = (null_report(d, keys, columns).select(*keys, "feature", F.col("n_null").alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    return a.join(b, [*keys, "feature"]).withColumn("n_filled", F.col("n_before") - F.col("n_after"))


def gradient(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Central differences at unit steps, one-sided at the ends; a null neighbour gives null, as
    does a series of one row."""
    w = _over(keys, order)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    at, n = F.row_number().over(w), F.count("*").over(W.partitionBy(*keys))
    return df.withColumn(out, F.when(n == 1, None).when(at == 1, after - v).when(at == n, v - before).otherwise((after - before) / 2))


def spikes(df: DataFrame, keys: list[str], order: str, value: str, out: str, times: float = 8.0) -> DataFrame:
    """Whether the second difference is over `times` its population deviation in the series, or
    the value is the first after a null."""
    twice = gradient(gradient(df, keys, order, value, "__d1"), keys, order, "__d1", "__d2")
    limit = times * F.stddev_pop("__d2").over(W.partitionBy(*keys))
    w = _over(keys, order)
    back = (F.row_number().over(w) > 1) & F.lag(value).over(w).isNull() & F.col(value).isNotNull()
    return twice.withColumn(out, F.coalesce(F.col("__d2") > limit, F.lit(False)) | back).drop("__d1", "__d2")


#: Rows of a series that one task filters at a time, besides the neighbours that their windows reach.
STRETCH = 100_000


def running_median(values: list, size: int) -> list:
    """The element at size / 2 of each full window of `size` values in order. The window is kept sorted along
    the way: a value is found and one let in by bisection."""
    window, half = sorted(values[:size]), size // 2
    out = [window[half]]
    for old, new in zip(values, values[size:]):
        del window[bisect_left(window, old)]
        insort(window, new)
        out.append(window[half])
    return out


def median_filtered(df: DataFrame, keys: list[str], order: str, value: str, out: str, size: int = 5) -> DataFrame:
    """The element at size / 2 of the sorted window of `size` rows around each row (an even
    window reaches one further back); the series is mirrored at its ends. Nulls sort first, NaN last.

    Long series are cut into stretches that bring the rows beside them along.
    """
    left, right, width = size // 2, size - size // 2 - 1, STRETCH
    at = F.row_number().over(_over(keys, order)).cast("long") - 1
    rows = df.withColumns({"__at": at, "__n": F.count("*").over(W.partitionBy(*keys))})
    first = F.greatest(F.lit(0), F.floor((F.col("__at") - right) / width))
    last = F.least(F.floor((F.col("__at") + left) / width), F.floor((F.col("__n") - 1) / width))
    rows = rows.withColumn("__stretch", F.explode(F.sequence(first, last)))
    names = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("__at")
        places, n, stretch = group["__at"], group["__n"][0].as_py(), group["__stretch"][0].as_py()
        values = [-math.inf if v is None else math.inf if v != v else v for v in group[value].to_pylist()]
        low, high = places[0].as_py(), places[-1].as_py() + 1
        begin, end = stretch * width, min(n, (stretch + 1) * width)
        # Behind an end the series runs backwards, and forwards again behind its other end.
        mirrored = lambda k: min(k % (2 * n), 2 * n - 1 - k % (2 * n))
        around = [values[(k if 0 <= k < n else mirrored(k)) - low] for k in range(begin - left, end + right)]
        found = [None if v == -math.inf else math.nan if v == math.inf else v for v in running_median(around, size)]
        own = group.slice(begin - low, end - begin).select(names)
        made = pa.array(found, group.schema.field(value).type)
        return own.set_column(names.index(out), out, made) if out in names else own.append_column(out, made)

    return rows.groupBy(*keys, "__stretch").applyInArrow(run, df.withColumn(out, F.col(value)).schema)


def outliers(df: DataFrame, keys: list[str], value: str, out: str, sigmas: float = 2.5) -> DataFrame:
    """Whether a value is null or further than `sigmas` population deviations from the mean."""
    w = W.partitionBy(*keys)
    mean, deviation = F.avg(value).over(w), F.stddev_pop(value).over(w)
    inside = F.col(value).between(mean - sigmas * deviation, mean + sigmas * deviation)
    return df.withColumn(out, ~F.coalesce(inside, F.lit(False)))


def occluded(df: DataFrame, keys: list[str], order: str, value: str, out: str, ratio: float = 0.55, drop: float = 0.15) -> DataFrame:
    """Whether the value is null, or a five-row median lies under `ratio` of its sixty-row
    median and under it by more than `drop` of the series' median."""
    smooth = median_filtered(df, keys, order, value, "__smooth", 5)
    base = median_filtered(smooth, keys, order, "__smooth", "__base", 60)
    middle = ranks.quantiles(df, keys, value, {"__median": 0.5})
    joined = base.alias("a").join(middle.alias("b"), ranks.same("a", "b", keys), "left").select("a.*", "b.__median")
    low = (F.col("__smooth") / F.col("__base") < ratio) & (F.col("__base") - F.col("__smooth") > drop * F.col("__median"))
    return joined.withColumn(out, F.col(value).isNull() | F.coalesce(low, F.lit(False))).drop("__smooth", "__base", "__median")


def flagged_levels(df: DataFrame, keys: list[str], order: str, value: str, flag: str, out: str, tolerance: float = 50.0, reach: int = 150) -> DataFrame:
    """The flagged rows of df with the last frame before the row after each whose value is within
    the tolerance of that row's value: found among the `reach` + 1 rows before, null if none.

    Intervals over `reach` rows collapse to their end, so earlier rows change nothing. Flags are rare:
    flagged rows meet the rows of their stretch of the series and of the one before, and no
    other row is looked back from.
    """
    w = _over(keys, order)
    target = F.coalesce(F.lead(value).over(w), F.when(F.lead(order).over(w).isNull(), F.col(value)))
    marked = df.withColumns({"__target": target, "__end": F.lead(order).over(w).isNull(), "__place": F.row_number().over(w)})
    stretch = F.floor(F.col("__place") / (reach + 2))
    flagged = marked.where(F.coalesce(F.col(flag), F.lit(False)))
    back = flagged.select(*keys, "__place", "__target", "__end", F.explode(F.array(stretch - 1, stretch)).alias("__stretch"))
    rows = df.withColumn("__place", F.row_number().over(w)).select(*keys, stretch.alias("__stretch"), F.col("__place").alias("__at"), F.col(order).alias("__frame"), F.col(value).alias("__value"))
    met = back.alias("a").join(rows.alias("b"), ranks.same("a", "b", [*keys, "__stretch"])).select(*[f"a.{c}" for c in [*keys, "__place", "__target", "__end"]], "b.__at", "b.__frame", "b.__value")
    own = F.col("__end") & (F.col("__at") == F.col("__place")) & (F.col("__place") > 1)
    near = met.where((F.col("__at").between(F.col("__place") - reach - 1, F.col("__place"))) & ~own & (F.abs(F.col("__value") - F.col("__target")) <= tolerance))
    found = near.groupBy(*keys, "__place").agg(F.max("__frame").alias("__found"))
    joined = flagged.alias("a").join(found.alias("b"), ranks.same("a", "b", [*keys, "__place"]), "left")
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], F.col("b.__found").alias(out))


def last_near_level(df: DataFrame, keys: list[str], order: str, value: str, flag: str, out: str, tolerance: float = 50.0, reach: int = 150) -> DataFrame:
    """df with flagged_levels() for its flagged rows, null for all others."""
    flagged = flagged_levels(df, keys, order, value, flag, out, tolerance, reach)
    others = df.where(~F.coalesce(F.col(flag), F.lit(False)))
    return flagged.unionByName(others, allowMissingColumns=True)


def repair_intervals(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 150) -> DataFrame:
    """keys, start and end (frames, inclusive) to interpolate: from the last row near the level
    after each spike to the row after the spike; longer ones than `reach` only that row."""
    pop = F.coalesce(F.lead(order).over(_over(keys, order)), F.col(order))
    marked = spikes(df, keys, order, value, "__spike").withColumn("__pop", pop)
    found = flagged_levels(marked, keys, order, value, "__spike", "__from", reach=reach).where("__from is not null")
    start = F.when(F.col("__pop") - F.col("__from") <= reach, F.col("__from")).otherwise(F.col("__pop"))
    return found.select(*keys, start.alias("start"), F.col("__pop").alias("end"))


def cut_groups(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, low, high and cuts (end, start; in order): the intervals that see each other's rows, and the
    first and last row that they read, one before and one after them. Groups share no row."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max(F.col("end") + 1).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = intervals.where("start <= end").withColumn("__new", F.coalesce(F.col("start") - 1 > reach, F.lit(False)).cast("int"))
    rows = rows.withColumn("__group", F.sum("__new").over(order))
    cuts = F.array_sort(F.collect_list(F.struct(F.col("end").cast("long").alias("end"), F.col("start").cast("long").alias("start"))))
    return rows.groupBy(*keys, "__group").agg((F.min("start") - 1).cast("long").alias("low"), (F.max("end") + 1).cast("long").alias("high"), cuts.alias("cuts")).drop("__group")


def interpolated(df: DataFrame, intervals: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns interpolated inside each interval from the values beside it. Intervals apply
    one after the other, in order of their end, and see what earlier ones filled; those without
    a value on both sides are left out. Frames are distinct whole numbers.

    Only intervals that meet others depend on the order: they are folded by group, over the rows of the
    group alone. A lone interval is filled from its two ends, and all other rows pass.
    """
    groups = cut_groups(intervals, keys)
    at = F.col(order).cast("long").alias("__at")
    marks = groups.select(*keys, F.col("low").alias("__at"), F.struct("low", "high", F.size("cuts").alias("n")).alias("__g"))
    rows = df.select(*keys, at, F.struct(*df.columns).alias("__row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # The last group that began; its mark comes before the row of its place.
    w = W.partitionBy(*keys).orderBy("__at", F.col("__row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last("__g", ignorenulls=True).over(w)
    tagged = both.withColumn("__g", last).where("__row is not null").select("__row.*", "__at", F.when(F.col("__at") <= F.col("__g.high"), F.col("__g")).alias("__g"))
    tagged = written(tagged.select(*df.columns, "__at", *[F.col(f"__g.{c}").alias(f"__{c}") for c in ("low", "high", "n")]), "cut-rows")
    free = tagged.where("__low is null").select(*df.columns)

    alone = tagged.where("__n = 1")
    side = lambda end: F.max(F.when(F.col("__at") == F.col(end), F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))).alias(f"__at{end}")
    ends = alone.groupBy(*keys, "__low").agg(side("__low"), side("__high"))
    a, b = alone.alias("a"), ends.alias("b")
    lone = a.join(b, ranks.same("a", "b", [*keys, "__low"])).select("a.*", "b.__at__low", "b.__at__high")

    def line(c: str) -> Column:
        left, right = F.col(f"__at__low.`{c}`"), F.col(f"__at__high.`{c}`")
        inside = (F.col("__at") > F.col("__low")) & (F.col("__at") < F.col("__high")) & left.isNotNull() & right.isNotNull()
        return F.when(inside, left + (F.col("__at") - F.col("__low")) * (right - left) / (F.col("__high") - F.col("__low"))).otherwise(F.col(c).cast("double"))

    lone = lone.withColumns({c: line(c) for c in columns}).select(*df.columns)

    met = tagged.where("__n > 1").alias("a").join(groups.select(*keys, F.col("low").alias("__low"), F.col("cuts").alias("__cuts")).alias("b"), ranks.same("a", "b", [*keys, "__low"])).select("a.*", "b.__cuts")

    names = df.columns

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        low, cuts = int(group["__low"].iloc[0]), group["__cuts"].iloc[0]
        places = group["__at"].to_numpy() - low
        for c in columns:
            v = np.full(int(group["__high"].iloc[0]) - low + 1, np.nan)
            v[places] = group[c].to_numpy(dtype=float)
            for cut in cuts:
                i, j = int(cut["start"]) - low, int(cut["end"]) - low
                if v[i - 1] == v[i - 1] and v[j + 1] == v[j + 1]:
                    v[i : j + 1] = np.interp(np.arange(i, j + 1), [i - 1, j + 1], [v[i - 1], v[j + 1]])
            group[c] = pd.Series(v[places], index=group.index).where(~np.isnan(v[places]))
        return group[names]

    kinds = df.withColumns({c: F.col(c).cast("double") for c in columns}).schema
    folded = met.groupBy(*keys, "__low").applyInPandas(fold, kinds)
    return free.withColumns({c: F.col(c).cast("double") for c in columns}).unionByName(lone).unionByName(folded)


def cleaned(df: DataFrame, keys: list[str], order: str, level: str, columns: list[str]) -> DataFrame:
    """All columns null where the level is an outlier or occluded, then repaired at the level's
    jumps; the level is one of the columns."""
    flagged = occluded(outliers(df, keys, level, "__out"), keys, order, level, "__occluded")
    nulled = flagged.withColumns({c: F.when(~(F.col("__out") | F.col("__occluded")), F.col(c).cast("double")) for c in columns}).drop("__out", "__occluded")
    return interpolated(nulled, repair_intervals(df, keys, order, level), keys, order, columns)


def z_scored(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Population z-scores over the keys; where the deviation is 0 the value less the mean."""
    w = W.partitionBy(*keys)
    deviation = F.stddev_pop(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when(deviation == 0, 1.0).otherwise(deviation))


def min_max_scaled(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Values from 0 to 1 over the keys; null where all are equal."""
    w = W.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)))


def density(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin (from 0) and density of the values in [low, high]; the last bin includes its
    upper edge, and empty bins are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(*keys)) * width)).drop("n")


def feature_histogram(df: DataFrame, keys: list[str], value: str, bins: int = 30) -> DataFrame:
    """keys, bin, n, low, high, mean and deviation: equal bins over each key's own range."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    rows = df.where(F.col(value).isNotNull()).join(stats, keys)
    at = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    return rows.groupBy(*keys, at.cast("int").alias("bin"), "low", "high", "mean", "deviation").agg(F.count("*").alias("n"))


def stacked(df: DataFrame, keys: list[str], order: str, value: str, out: str, steps: int) -> DataFrame:
    """An array column of each row joined with those of the next `steps` - 1 rows; the last rows,
    which lack them, are left out."""
    w = _over(keys, order).rowsBetween(0, steps - 1)
    listed = F.collect_list(value).over(w)
    return df.withColumn("__l", listed).where(F.size("__l") == steps).withColumn(out, F.flatten("__l")).drop("__l")


def mean_by_place(df: DataFrame, keys: list[str], start: str, frame: str, value: str, least: float = 0.5) -> DataFrame:
    """Mean of the segments' values by place in the segment. Segments of which more than `least`
    is null are left out; shorter segments end early."""
    segment = W.partitionBy(*keys, start)
    share = F.count_if(F.col(value).isNull()).over(segment) / F.count("*").over(segment)
    rows = df.withColumn("__share", share).where(F.col("__share") <= least)
    return rows.groupBy(*keys, (F.col(frame) - F.col(start)).alias("place")).agg(F.avg(value).alias("mean"))


def null_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, feature, n_null and null_percent of the columns."""
    out = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return out.unpivot([*keys, "__n"], columns, "feature", "n_null").withColumn("null_percent", 100 * F.col("n_null") / F.col("__n")).drop("__n")


def feature_summary(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each key with <column>_mean, _std (population) and _null_percent."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), (100 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"{c}_null_percent")]
    return df.groupBy(*keys).agg(*stats)
