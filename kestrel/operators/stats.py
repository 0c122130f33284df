"""Intervals, trends and tests from grouped moments.

Every test is an aggregation to moments and an expression on them; only distribution
functions run in Python, on the grouped rows.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import special
from kestrel.operators import ranks


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean and sd (sample) of the values that are not null."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def mean_sem(df: DataFrame, keys: list[str], value: str, single: float | None = None) -> DataFrame:
    """moments() and sem; for one value sem is `single`."""
    sem = F.when(F.col("n") > 1, F.col("sd") / F.sqrt("n")).when(F.col("n") == 1, F.lit(single).cast("double"))
    return moments(df, keys, value).withColumn("sem", sem)


def mean_ci(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """mean_sem() with half_width, low and high of the t interval for the mean."""
    out = mean_sem(df, keys, value)
    half = special.t_ppf_column(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double")) * F.col("sem")
    return out.withColumn("half_width", half).withColumns({"low": F.col("mean") - F.col("half_width"), "high": F.col("mean") + F.col("half_width")})


#: 32-bit numbers of the generator's stream that a row of work draws.
DRAWN = 1 << 20


@lru_cache(maxsize=1)
def stream(seed: int, block: int, size: int = DRAWN) -> np.ndarray:
    """A block of the generator's stream as 32-bit numbers, the low half of each output first. The last
    one is kept: groups draw from the same stream, so a task that goes block by block makes each once."""
    bits = np.random.PCG64(seed)
    bits.advance(block * size // 2)
    return bits.random_raw(size // 2).astype("<u8", copy=False).view("<u4")


def rejected(raw: np.ndarray, n: int) -> np.ndarray:
    """Whether numbers of the stream are passed over in drawing integers below n: the generator multiplies
    each by n, takes the upper half of the product and rejects it if the lower half is too small.
    That depends on the number alone, so blocks can be drawn apart, after jumping ahead to each."""
    return raw * np.uint32(n) < np.uint32(((1 << 32) - n) % n)


#: Numbers of the stream that are tested at a time, so that what is made of them stays in a core's cache.
TESTED = 1 << 16


def rejected_at(raw: np.ndarray, n: int) -> np.ndarray:
    """The places of the rejected() numbers, of which there are few: they are looked for eight at a time."""
    low, hit, found = np.empty(TESTED, np.uint32), np.zeros(TESTED, bool), []
    for a in range(0, len(raw), TESTED):
        part = raw[a : a + TESTED]
        np.multiply(part, np.uint32(n), out=low[: len(part)])
        np.less(low[: len(part)], np.uint32(((1 << 32) - n) % n), out=hit[: len(part)])
        hit[len(part) :] = False
        eights = (np.flatnonzero(hit.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).ravel()
        found.append(a + eights[hit[eights]])
    return np.concatenate(found)


def drawn(seed: int, block: int, n: int, size: int = DRAWN) -> np.ndarray:
    """What a block of the generator's stream contributes to integers below n: the places that are
    not rejected, in order."""
    raw = stream(seed, block, size)
    return (raw[~rejected(raw, n)].astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@lru_cache(maxsize=4)
def pieces(seed: int, block: int, size: int, piece: int) -> np.ndarray:
    """The numbers of stream() in pieces, each in rising order; kept like these."""
    return np.sort(stream(seed, block, size).reshape(-1, piece), axis=1)


def piece_length(n: int, distinct: int, size: int) -> int:
    """Length of the pieces of a block in which draws below n of so many distinct values are counted: long
    ones are counted at little more cost, but where a resample begins part of one is looked up draw by
    draw. 0 if pieces would not be much shorter than a resample; then all draws are looked up."""
    piece = min(size, 1 << (math.isqrt(n * (100 + 11 * distinct)).bit_length() - 1))
    return piece if 8 * piece <= n and size % piece == 0 else 0


def first_numbers(counts: np.ndarray) -> np.ndarray:
    """The first number of the stream that stands for each distinct value but the first, given their counts."""
    ends = np.cumsum(counts[:-1]).astype(np.uint64) << np.uint64(32)
    return ((ends - np.uint64(1)) // np.uint64(counts.sum()) + np.uint64(1)).astype(np.uint32)


def resampled(raw: np.ndarray, ordered: np.ndarray, start: int, n: int, resamples: int, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of a block's draws for each resample that it touches, from the number start // n on, where
    `start` draws come before the block and `ordered` has the block in pieces of less than n.

    How many of a piece's draws have a value follows from the places of its first number in rising
    order; rejected ones are taken off. A piece in which a resample begins is parted: the shorter side is
    looked up, the other has the rest.
    """
    out, size, piece = rejected_at(raw, n), len(raw), ordered.shape[1]
    drawn = min(size - len(out), resamples * n - start)
    if drawn <= 0:
        return np.zeros(0)
    firsts = first_numbers(counts)
    below = np.array([p.searchsorted(firsts) for p in ordered])
    held = np.diff(below, axis=1, prepend=0, append=piece)
    np.subtract.at(held, (out // piece, np.searchsorted(firsts, raw[out], side="right")), 1)
    sums = held @ values
    # Where resamples begin (but the first) or the draws end within the block, as places in raw.
    begins = np.arange(start // n + 1, (start + size - len(out) - 1) // n + 1) * n - start
    begins = begins[begins <= drawn]
    at = begins + np.searchsorted(out - np.arange(len(out)), begins, side="right")
    parted, rests = at // piece, np.empty(len(at))
    for k, (a, q) in enumerate(zip(at.tolist(), parted.tolist())):
        left = 2 * (a - q * piece) <= piece
        side = raw[q * piece : a] if left else raw[a : (q + 1) * piece]
        found = values[np.searchsorted(firsts, side[~rejected(side, n)], side="right")].sum()
        rests[k] = sums[q] - found if left else found
        sums[q] = found if left else sums[q] - found
    sums = np.add.reduceat(np.insert(sums, parted + 1, rests), np.concatenate([[0], parted + 1 + np.arange(len(at))]))
    return sums[: (start + drawn - 1) // n + 1 - start // n]


def valued(raw: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values at the places that numbers of the stream stand for in a sorted list, given as distinct
    values and their counts.

    Places rise with the numbers, so each value has a range of numbers, and the upper 16 bits tell it
    but for the few in which a range begins; those, and lists of very many values, are searched.
    """
    firsts = first_numbers(counts).astype(np.uint64)
    if len(firsts) > 2048:
        return values[np.searchsorted(firsts, raw, side="right")]
    ends = (firsts + np.uint64(0xFFFF)) >> np.uint64(16)
    upper = np.repeat(values, np.diff(np.concatenate([[0], ends.astype(np.int64), [1 << 16]])))
    upper[(firsts[firsts % np.uint64(1 << 16) > 0] >> np.uint64(16)).astype(np.int64)] = np.nan
    out, halves = np.empty(len(raw)), np.ascontiguousarray(raw).view("<u2")[1::2]
    for a in range(0, len(raw), 1 << 15):
        part = out[a : a + (1 << 15)]
        upper.take(halves[a : a + (1 << 15)].astype(np.intp), out=part, mode="clip")
        left = np.flatnonzero(np.isnan(part))
        part[left] = values[np.searchsorted(firsts, raw[a + left], side="right")]
    return out


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in the order of its columns `by`, dealt to several tasks a core: rows that are little to carry
    and much to work on, which an adaptive plan would put together by their bytes."""
    return df.repartitionByRange(4 * df.sparkSession.sparkContext.defaultParallelism, *by).sortWithinPartitions(*by)


def _blocks(n: int, resamples: int, size: int) -> int:
    """Blocks that hold all draws, but for odds under one in 10^20."""
    kept = 1 - ((1 << 32) - n) % n / (1 << 32)
    mean = resamples * n / kept
    return math.ceil((mean + 10 * math.sqrt(mean * (1 - kept)) + 64) / size)


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, resamples: int = 10_000, level: float = 0.95, seed: int = 0, size: int = DRAWN) -> DataFrame:
    """keys, n, mean, low and high: the percentile interval of resampled means, from values in
    rising order with one generator for each group, as numpy's default_rng(seed).integers draws.

    The draws of a group are cut into blocks of the generator's stream, which tasks draw apart and
    of which only a sum for each resample leaves. Values are counted first: a block's row holds the
    group's distinct values, those of one plotted point, and their counts. A group has under 2^32 values.
    Rows go by blocks, so that a task makes a block's numbers once for its groups, and sorts them once:
    a large group's draws are counted by value in sorted pieces, not looked up one by one.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    listed = F.array_sort(F.collect_list(F.struct("__v", "__n")))
    points = counted.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.sum(F.col("__v") * F.col("__n")) / F.sum("__n")).alias("mean"), listed.alias("__l"))
    points = points.select(*keys, "n", "mean", F.transform("__l", lambda x: x["__v"]).alias("__values"), F.transform("__l", lambda x: x["__n"]).alias("__counts"))

    @F.pandas_udf("long")
    def blocks(n: pd.Series) -> pd.Series:
        return pd.Series([_blocks(int(x), resamples, size) for x in n])

    @F.pandas_udf("long")
    def accepted(block: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([size - np.count_nonzero(rejected(stream(seed, int(b), size), int(x))) for b, x in zip(block, n)])

    def spread(rows: DataFrame) -> DataFrame:
        """A row for each block, dealt out to all tasks."""
        return dealt(rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks("n") - 1))), "__block", *keys)

    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    sizes = spread(points.select(*keys, "n")).withColumn("__size", accepted("__block", "n"))
    starts = sizes.select(*keys, F.col("n").alias("__of"), "__block", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")).where(F.expr(f"__start < __of * {resamples}"))
    work = points.alias("a").join(starts.alias("b"), ranks.same("a", "b", keys)).select(*[f"a.{c}" for c in points.columns], "b.__block", "b.__start")

    def sums_of(row: dict) -> np.ndarray:
        """The sums of a row's block for each resample that it touches, from __start // n on."""
        n, start, block = int(row["n"]), int(row["__start"]), int(row["__block"])
        values, counts = np.asarray(row["__values"]), np.asarray(row["__counts"])
        raw, piece = stream(seed, block, size), piece_length(n, len(values), size)
        if piece and np.isfinite(values).all():
            return resampled(raw, pieces(seed, block, size, piece), start, n, resamples, values, counts)
        out = rejected_at(raw, n)
        # Few are out: the stretches between them are copied faster than chosen one by one.
        raw = np.delete(raw, out) if len(out) > 1000 else np.concatenate([raw[a:b] for a, b in zip([0, *(out + 1)], [*out, size])])
        raw = raw[: resamples * n - start]
        # Where each resample that the block touches begins in it.
        begins = np.maximum(np.arange(start // n, (start + len(raw) - 1) // n + 1) * n - start, 0)
        return np.add.reduceat(valued(raw, values, counts), begins) if len(raw) else np.zeros(0)

    def draw(frames):
        for frame in frames:
            rows = frame.to_dict("records")
            # A frame for some rows of work, as making one takes longer than many rows' few sums.
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                sums = [sums_of(row) for row in part]
                again = lambda c: [x for row, s in zip(part, sums) for x in [row[c]] * len(s)]  # noqa: B023, E731
                numbers = np.concatenate([int(row["__start"]) // int(row["n"]) + np.arange(len(s)) for row, s in zip(part, sums)])
                yield pd.DataFrame({**{k: again(k) for k in keys}, "n": again("n"), "mean": again("mean"), "__resample": numbers, "__sum": np.concatenate(sums)})

    kinds = "".join(f"{c} {dict(df.dtypes)[c]}, " for c in keys)
    parts = dealt(work, "__block", *keys).mapInPandas(draw, f"{kinds}n long, mean double, __resample long, __sum double")
    means = parts.groupBy(*keys, "n", "mean", "__resample").agg((F.sum("__sum") / F.col("n")).alias("__m"))
    # A value for each resample.
    ends = F.percentile("__m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return means.groupBy(*keys, "n", "mean").agg(ends.alias("__e")).select(*keys, "n", "mean", F.col("__e")[0].alias("low"), F.col("__e")[1].alias("high"))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sd, min, median and max. The median is exact and needs no group in one task."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = ranks.quantiles(df, keys, value, {"median": 0.5})
    joined = out.alias("a").join(middle.alias("b"), ranks.same("a", "b", keys), "left")
    return joined.select(*[f"a.{c}" for c in [*keys, "n", "mean", "sd", "min"]], "b.median", "a.max")


def slopes(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """keys, n, slope, intercept, r2, stderr and t of the regression of y on x, for keys with
    `least` pairs and two different x at least; stderr and t need three."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    ).where((F.col("n") >= least) & (F.col("sxx") > 0))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    out = out.withColumn("stderr", F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))))
    return out.withColumn("t", F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr"))).drop("sxx", "syy", "sxy")


def with_p(df: DataFrame, t: str = "t", df_column="df", out: str = "p") -> DataFrame:
    return df.withColumn(out, special.t_p_column(F.col(t), _col(df_column).cast("double")))


def one_sample_t(df: DataFrame, keys: list[str], value: str, mean: float = 0.0) -> DataFrame:
    """keys, n, mean, sd, t, df and d of the values against a given mean; two values needed."""
    out = moments(df, keys, value).where("n > 1 and sd > 0")
    diff = F.col("mean") - mean
    return out.withColumns({"t": diff / (F.col("sd") / F.sqrt("n")), "df": F.col("n") - 1, "d": diff / F.col("sd")})


def one_sided(p: Column, t: Column, greater: bool = True) -> Column:
    """The one-sided p-value of a two-sided one."""
    right = t > 0 if greater else t < 0
    return F.when(right, p / 2).otherwise(1 - p / 2)


def _two(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    sums = [f.alias(f"{name}_{k}") for k, g in (("a", a), ("b", b)) for name, f in (("n", F.count(side(g))), ("mean", F.avg(side(g))), ("var", F.var_samp(side(g))))]
    return df.groupBy(*keys).agg(*sums).where("n_a > 1 and n_b > 1")


def welch_t(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """The moments of groups a and b with t, df (Welch) and d (unweighted pooled variance)."""
    out = _two(df, keys, group, a, b, value).withColumns({"ea": F.col("var_a") / F.col("n_a"), "eb": F.col("var_b") / F.col("n_b")}).where("ea + eb > 0")
    return out.withColumns({
        "t": F.expr("(mean_a - mean_b) / sqrt(ea + eb)"),
        "df": F.expr("(ea + eb) * (ea + eb) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1))"),
        "d": F.expr("(mean_a - mean_b) / sqrt((var_a + var_b) / 2)"),
    }).drop("ea", "eb")


def pooled_t(df: DataFrame, keys: list[str], group: str, a, b, value: str) -> DataFrame:
    """The moments of groups a and b with t and df of the test with equal variances."""
    out = _two(df, keys, group, a, b, value).withColumn("pooled", F.expr("((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)")).where("pooled > 0")
    return out.withColumns({"t": F.expr("(mean_a - mean_b) / sqrt(pooled * (1 / n_a + 1 / n_b))"), "df": F.expr("n_a + n_b - 2")})


def paired_t(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys, n, mean, sd, t, df and d of second - first, over rows that have both."""
    return one_sample_t(df.withColumn("__d", F.col(second) - F.col(first)), keys, "__d")


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, k, n, ss_between, ss_within and f of the one-way analysis of variance."""
    parts = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    total_mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    out = parts.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), within.alias("ss_within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * total_mean * total_mean).alias("ss_between"))
    return out.where("k > 1 and n > k and ss_within > 0").withColumn("f", F.expr("(ss_between / (k - 1)) / (ss_within / (n - k))"))


def tost(df: DataFrame, keys: list[str], value: str, bound: float) -> DataFrame:
    """keys, n, mean, t_lower, t_upper, df: two one-sided tests of |mean| < bound."""
    out = moments(df, keys, value).where("n > 1 and sd > 0").withColumn("se", F.col("sd") / F.sqrt("n"))
    return out.withColumns({"t_lower": (F.col("mean") + bound) / F.col("se"), "t_upper": (F.col("mean") - bound) / F.col("se"), "df": F.col("n") - 1}).drop("se", "sd")


def tost_p(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tost() with p, the larger of the two, and equivalent."""
    n = F.col("df").cast("double")
    p = F.greatest(special.t_cdf_column(-F.col("t_lower"), n), special.t_cdf_column(F.col("t_upper"), n))
    return df.withColumn("p", p).withColumn("equivalent", F.col("p") < alpha)


def average_rank(value, keys: list[str]) -> Column:
    """Rank within the keys; equal values share the mean of their ranks."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(_col(value))) + (F.count("*").over(W.partitionBy(*keys, _col(value))) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and rho: the correlation of average ranks over rows that have both values, for groups
    of any size; equal rows are counted first."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = rows.groupBy(*keys, (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y")).agg(F.count("*").alias("__n"))
    for side in ("x", "y"):
        # The mean rank is known, so that sums stay small.
        ranked = ranks.value_counts(rows, keys, {"x": x, "y": y}[side]).select(*keys, F.col("v").alias(side), (ranks.average_rank() - (F.col("total") + 1) / 2).alias("r"))
        joined = pairs.alias("a").join(ranked.alias("b"), ranks.same("a", "b", [*keys, side]))
        pairs = joined.select(*[f"a.{c}" for c in pairs.columns], F.col("b.r").alias(f"r{side}"))
    n = F.col("__n")
    total = lambda c: F.sum(n * c)
    out = pairs.groupBy(*keys).agg(F.sum("__n").alias("n"), total(F.col("rx") * F.col("ry")).alias("xy"), total(F.col("rx") * F.col("rx")).alias("xx"), total(F.col("ry") * F.col("ry")).alias("yy"))
    return out.select(*keys, "n", F.when(F.expr("xx * yy > 0"), F.expr("xy / sqrt(xx * yy)")).alias("rho"))


def page_trend(df: DataFrame, keys: list[str], subject: str, block: str, value: str, blocks: int) -> DataFrame:
    """keys, n (subjects with all blocks 1 to `blocks`), l, and z by the normal approximation;
    page_p() adds exact p-values."""
    full = df.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(W.partitionBy(*keys, subject))).where(F.col("__n") == blocks)
    ranked = full.withColumn("__r", average_rank(value, [*keys, subject]))
    out = ranked.groupBy(*keys).agg((F.count("*") / blocks).cast("long").alias("n"), F.sum(F.col(block) * F.col("__r")).alias("l"))
    k = blocks
    z = (F.col("l") - F.col("n") * k * (k + 1) ** 2 / 4) / F.sqrt(F.col("n") * k**2 * (k + 1) * (k**2 - 1) / 144)
    return out.withColumn("z", z)


def page_p(df: DataFrame, blocks: int, exact: int = 20) -> DataFrame:
    """page_trend() with p of a trend as large: exact, over all orders of the blocks, up to
    `exact` subjects, whose convolution is exact in doubles; else by z."""
    one = np.zeros(blocks * (blocks + 1) * (2 * blocks + 1) // 6 + 1)
    for order in permutations(range(1, blocks + 1)):
        one[sum(k * r for k, r in enumerate(order, 1))] += 1 / math.factorial(blocks)

    @F.pandas_udf("double")
    def tail(n: pd.Series, l: pd.Series, z: pd.Series) -> pd.Series:  # noqa: E741
        out = []
        for subjects, total, score in zip(n, l, z):
            if subjects > exact:
                out.append(special.norm_cdf(-score))
                continue
            chances = np.ones(1)
            for _ in range(int(subjects)):
                chances = np.convolve(chances, one)
            out.append(min(1.0, float(chances[math.ceil(total) :].sum())))
        return pd.Series(out)

    return df.withColumn("p", tail("n", F.col("l").cast("double"), "z"))


def trend_band(df: DataFrame, keys: list[str], x: str, y: str, at: list[float], resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """keys, x, fitted, low and high: the regression line at given places, with the percentile band
    of resampled lines. A resample takes each row a Poisson number of times, drawn from a hash
    of the row, so tasks sum weights for all resamples and only sums leave."""
    names = [f"s{k}" for k in range(5)]
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = rows.groupBy(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__h", F.xxhash64(F.lit(seed), "__x", "__y"))
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)

    def weighed(frames):
        for frame in frames:
            for key, group in frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]:
                sums = np.zeros((5, resamples + 1))
                for a, b, n, h in zip(group["__x"], group["__y"], group["__n"], group["__h"]):
                    # The first column is the data itself.
                    weights = np.concatenate([[n], np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF).poisson(n, resamples)])
                    sums += np.outer([1, a, b, a * a, a * b], weights)
                yield pd.DataFrame([[*key, *(s.tolist() for s in sums)]], columns=[*keys, *names])

    def lines(group: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, sxy = (np.sum(np.stack(group[c].to_list()), axis=0) for c in names)
        spread = n * sxx - sx * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(spread > 0, (n * sxy - sx * sy) / spread, np.nan)
            made = sy / n + slope * (np.array(at)[:, None] - sx / n)
        low, high = np.nanquantile(made[:, 1:], [(1 - level) / 2, (1 + level) / 2], axis=1) if np.isfinite(made[:, 1:]).any() else (np.full(len(at), np.nan),) * 2
        key = list(group.loc[group.index[0], keys])
        return pd.DataFrame([[*key, p, m, a, b] for p, m, a, b in zip(at, made[:, 0], low, high)], columns=[*keys, "x", "fitted", "low", "high"])

    parts = counted.mapInPandas(weighed, ", ".join([kinds] * bool(keys) + [f"{c} array<double>" for c in names]))
    out = parts.groupBy(*keys).applyInPandas(lines, f"{kinds}{', ' * bool(keys)}x double, fitted double, low double, high double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("fitted", "low", "high")})


def shape(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, skew (3 values at least) and kurtosis (4 at least), corrected for bias."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n")
    skew = F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return out.withColumns({"skew": skew, "kurtosis": kurt}).drop("g1", "g2")


def shapiro(n: float, mm: float, mx: float, ss: float, m: tuple[float, float], x: tuple[float, float, float, float]) -> tuple[float, float]:
    """W and p by Royston's approximation (1995) from sums, so that no sample is gathered.

    n values; the sum of squares mm of the normal scores and their products mx with the values in
    order; the values' squared deviations ss; the largest two scores m, largest first; and the
    values x at the first, second, last but one and last place. NaN under three values or if
    all are equal.
    """
    if n < 3 or not ss > 0:
        return math.nan, math.nan
    u, (x1, x2, x3, x4) = 1 / math.sqrt(n), x
    if n == 3:
        top = math.sqrt(0.5) * (x4 - x1)
    else:
        # The published polynomials.
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[0] / math.sqrt(mm)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[1] / math.sqrt(mm)], u)
            phi = (mm - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            middle = mx - m[0] * (x4 - x1) - m[1] * (x3 - x2)
            top = last * (x4 - x1) + second * (x3 - x2) + middle / math.sqrt(phi)
        else:
            phi = (mm - 2 * m[0] ** 2) / (1 - 2 * last**2)
            top = last * (x4 - x1) + (mx - m[0] * (x4 - x1)) / math.sqrt(phi)
    w = min(top**2 / ss, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y, mu = -math.log(gamma - math.log(1 - w)), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, ln = math.log(1 - w), math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - special.norm_cdf((y - mu) / sigma)


def normality(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """shape() with w, p and verdict: how many of p under alpha, skew over 1 and kurtosis over 2
    hold. Under three values there is no verdict. Groups may have any size: their values are
    ranked by Spark, and only sums leave."""
    out = shape(df, keys, value)
    counts = ranks.value_counts(df, keys, value)
    rows = ranks.positions(counts).select(*keys, F.col("v").alias("__v"), F.col("position").alias("__i"), F.col("total").alias("__n"))
    rows = rows.withColumn("__m", special.norm_ppf_column((F.col("__i") - 0.375) / (F.col("__n") + 0.25)))
    at = lambda i, c="__v": F.max(F.when(F.col("__i") == i, F.col(c)))
    last = F.col("__n")
    sums = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("__m") * F.col("__m")).alias("mm"), F.sum(F.col("__m") * F.col("__v")).alias("mx"),
        (F.var_pop("__v") * F.count("*")).alias("ss"), at(last, "__m").alias("m1"), at(last - 1, "__m").alias("m2"),
        at(1).alias("x1"), at(2).alias("x2"), at(last - 1).alias("x3"), at(last).alias("x4"),
    )
    names = ["n", "mm", "mx", "ss", "m1", "m2", "x1", "x2", "x3", "x4"]

    @F.pandas_udf("w double, p double")
    def tested(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shapiro(*r[:4], r[4:6], r[6:]) for r in zip(*columns)], columns=["w", "p"])

    found = sums.withColumn("__t", tested(*names)).select(*keys, *[F.nanvl(f"__t.{c}", F.lit(None).cast("double")).alias(c) for c in ("w", "p")])
    out = out.join(found, keys, "left")
    flags = sum(F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("p") < alpha, F.abs("skew") > 1, F.abs("kurtosis") > 2))
    return out.withColumn("verdict", F.when(F.col("n") < 3, None).when(flags == 0, "normal").when(flags == 1, "borderline").otherwise("not normal"))


def against_reference(df: DataFrame, keys: list[str], value: str, slope: float, se: float, df_reference: int) -> DataFrame:
    """The subjects' mean against a published slope: as a fixed number (t, df, d) and with its
    standard error (t_w, df_w), and the difference."""
    out = one_sample_t(df, keys, value, slope).withColumn("sem", F.col("sd") / F.sqrt("n"))
    out = out.withColumn("difference", F.col("mean") - slope).withColumn("se_difference", F.sqrt(F.col("sem") ** 2 + se**2))
    va = F.col("sem") ** 2
    return out.withColumns({"t_w": F.col("difference") / F.col("se_difference"), "df_w": (va + se**2) ** 2 / (va**2 / F.col("df") + se**4 / df_reference)})


def reference_verdict(df: DataFrame, slope: float, level: float = 0.95) -> DataFrame:
    """against_reference() with p, p_w, the intervals and a verdict."""
    out = with_p(with_p(df), "t_w", "df_w", "p_w")
    q = F.lit((1 + level) / 2)
    half, half_w = special.t_ppf_column(q, F.col("df").cast("double")) * F.col("sem"), special.t_ppf_column(q, F.col("df_w")) * F.col("se_difference")
    out = out.withColumns({"half": half, "half_w": half_w})
    out = out.withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half"), "low_difference": F.col("difference") - F.col("half_w"), "high_difference": F.col("difference") + F.col("half_w")})
    sure = F.col("p_w") < 1 - level
    return out.withColumn("verdict", F.when(sure & (F.col("mean") < slope), "lower").when(sure & (F.col("mean") > slope), "higher").otherwise("not distinguished")).drop("half", "half_w")


def slope_interaction(df: DataFrame, keys: list[str], group: str, a, b, x: str, y: str) -> DataFrame:
    """keys, slope_a, slope_b, interaction (slope_b - slope_a), t and df of the regression of y on
    x, group and their product: the groups' own regressions with a common residual variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isin(a, b))
    parts = rows.groupBy(*keys, group).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    parts = parts.where("sxx > 0").withColumn("rest", F.expr("greatest(0.0, syy - slope * sxy)"))
    at = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    out = parts.groupBy(*keys).agg(at("slope", a).alias("slope_a"), at("slope", b).alias("slope_b"), F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.sum(1 / F.col("sxx")).alias("inverse"), F.count("*").alias("__groups"))
    out = out.where("__groups = 2 and n > 4 and rest > 0").withColumns({"interaction": F.expr("slope_b - slope_a"), "df": F.expr("n - 4")})
    return out.withColumn("t", F.expr("interaction / sqrt(rest / df * inverse)")).select(*keys, "slope_a", "slope_b", "interaction", "t", "df")


def bayes_factor(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, t, bf10_published and bf10_jzs. The first is the published integral, in which the
    number of values enters through t and its degrees alone; the second is the JZS factor with
    a Cauchy prior of scale sqrt(2)/2. Both by quadrature over the log of g."""
    out = one_sample_t(df, keys, value)
    step = 0.02
    u = np.arange(-30, 60, step)
    g, r2 = np.exp(u), 0.5

    def published(t: float, v: float) -> float:
        logs = (v - 1) / 2 * np.log1p(g) - (v + 1) / 2 * np.log1p(g * v / (v + t * t)) - 0.5 * math.log(2 * math.pi) - 1.5 * u - 1 / (2 * g * r2) + u
        return float(np.exp(logs).sum() * step)

    def jzs(t: float, v: float) -> float:
        n = v + 1
        logs = -0.5 * np.log1p(n * g * r2) - (v + 1) / 2 * np.log1p(t * t / ((1 + n * g * r2) * v)) - 0.5 * math.log(2 * math.pi) - 1.5 * u - 1 / (2 * g) + u
        return float(np.exp(logs).sum() * step / (1 + t * t / v) ** (-(v + 1) / 2))

    @F.pandas_udf("bf10_published double, bf10_jzs double")
    def factors(t: pd.Series, v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"bf10_published": [published(*x) for x in zip(t, v)], "bf10_jzs": [jzs(*x) for x in zip(t, v)]})

    found = out.withColumn("b", factors(F.col("t"), F.col("df").cast("double")))
    return found.select(*keys, "n", "t", "b.*")


def normal_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and quantile: points of the normal Q-Q plot (Filliben's positions)."""
    n, i = F.col("total"), F.col("position")
    end = F.pow(F.lit(0.5), 1.0 / n)
    position = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    rows = ranks.positions(ranks.value_counts(df, keys, value))
    return rows.select(*keys, F.col("v").alias(value), special.norm_ppf_column(position).alias("quantile"))


def tally(df: DataFrame, column: str) -> DataFrame:
    """Each verdict and its number of rows."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
