"""The bootstrap over blocks of the generator's stream against the generator itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import stats


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 123_457, (1 << 31) + 1, 3_000_000_000])
def test_blocks_are_the_generator_s_numbers(n):
    """Rejected numbers included: nearly half of them above 2^31."""
    for seed in (0, 7):
        got = np.concatenate([stats.drawn(seed, b, n, 512) for b in range(20)])
        assert (got == np.random.default_rng(seed).integers(0, n, size=len(got))).all()
        assert n < 1 << 31 or len(got) < 20 * 512 * 0.8


def test_there_are_blocks_enough():
    for n, resamples, size in ((1, 10, 64), (5, 1000, 64), ((1 << 31) + 1, 1, 1 << 30)):
        assert stats._blocks(n, resamples, size) * size >= n * resamples


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_intervals_of_many_blocks(spark, size):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=37), "b": rng.integers(0, 4, size=50).astype(float), "one": np.array([2.5]), None: rng.normal(size=8)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("none", None)]
    got = {r.k: r for r in stats.bootstrap_ci(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", 300, 0.9, 3, size).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        x = np.sort(x)
        means = x[np.random.default_rng(3).integers(0, len(x), size=(300, len(x)))].mean(axis=1)
        assert (got[k].low, got[k].high) == pytest.approx(tuple(np.quantile(means, [0.05, 0.95])), abs=1e-12)
        assert got[k].n == len(x) and got[k].mean == pytest.approx(x.mean())


def test_a_large_group_is_drawn_by_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("g").alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    out = stats.bootstrap_ci(df, ["k"], "v", 40)
    r = out.first()
    means = (np.arange(200_000) // 200)[np.random.default_rng(0).integers(0, 200_000, size=(40, 200_000))].mean(axis=1)
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("counts", [[1], [3, 1, 3], [1] * 3000, [1 << 20, 1, 5, 1 << 20], [2, 0xFFFF_FFFC]])
def test_values_of_numbers_of_the_stream(counts):
    """Ranges of numbers that begin within 2^16, at its ends and at the stream's last number included."""
    counts, values = np.array(counts), np.append(np.arange(len(counts) - 1) * 0.5, np.nan)
    n = int(counts.sum())
    edges = [((int(c) << 32) // n + d) % (1 << 32) for c in np.cumsum(counts) for d in (-1, 0, 1)]
    raw = np.concatenate([stats.stream(0, 0, 1 << 16), np.array([*edges, 0, 0xFFFF, 0x10000, 0xFFFF_FFFF], "<u4")])
    at = (raw.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    assert np.array_equal(stats.valued(raw, values, counts), values[np.searchsorted(np.cumsum(counts), at, side="right")], equal_nan=True)


def test_blocks_are_dealt_to_several_tasks(spark):
    """However few bytes their rows have: adaptive plans put them together, and one task drew all."""
    df = stats.dealt(spark.range(100).withColumnRenamed("id", "block"), "block").withColumn("task", F.spark_partition_id())
    df.write.format("noop").mode("overwrite").save()
    assert df.select("task").distinct().count() >= 4


def test_a_group_is_drawn_by_several_tasks(spark):
    df = spark.range(2000).select(F.lit("g").alias("k"), (F.col("id") % 50).cast("double").alias("v"))
    out = stats.bootstrap_ci(df, ["k"], "v", 1000, size=1 << 14)
    r = out.first()
    means = (np.arange(2000) // 40)[np.random.default_rng(0).integers(0, 2000, size=(1000, 2000))].mean(axis=1)
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-12)
    assert out._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2


def looked_up(raw, start, n, resamples, values, counts):
    """The sums of resamples with each draw looked up on its own."""
    raw = raw[~stats.rejected(raw, n)][: max(0, resamples * n - start)]
    begins = np.maximum(np.arange(start // n, (start + len(raw) - 1) // n + 1) * n - start, 0)
    return np.add.reduceat(stats.valued(raw, values, counts), begins) if len(raw) else np.zeros(0)


@pytest.mark.parametrize("most", [3, 200, 100_000, 40_000_000])
def test_counted_draws_are_those_looked_up(most):
    """Resamples that begin at a block's or piece's ends, draws that end within the block and many rejected ones included."""
    rng = np.random.default_rng(most)
    for trial in range(200):
        size, k = 1 << int(rng.integers(6, 14)), int(rng.integers(1, 40))
        counts, values = rng.integers(1, most, k), rng.integers(-50, 50, k).astype(float)
        n, resamples, block = int(counts.sum()), int(rng.integers(1, 40)), int(rng.integers(0, 50))
        piece = 1 << int(rng.integers(3, 13))
        if piece > min(size, n // 2):
            continue
        start = int(rng.integers(0, resamples * n + 2)) if trial % 2 else max(0, resamples * n - int(rng.integers(0, size)))
        raw, ordered = stats.stream(0, block, size), stats.pieces(0, block, size, piece)
        assert np.array_equal(stats.resampled(raw, ordered, start, n, resamples, values, counts), looked_up(raw, start, n, resamples, values, counts))
        assert np.array_equal(stats.rejected_at(raw, n), np.flatnonzero(stats.rejected(raw, n)))


def test_large_groups_draws_are_counted_in_pieces(spark):
    """Not looked up one by one, with the published generator's results; groups with values that are not finite are."""
    assert stats.piece_length(4_000_000, 50, 1 << 20) == 1 << 15 and stats.piece_length(1000, 50, 1 << 20) == 0
    assert stats.piece_length(200_000, 200_000, 1 << 20) == 0
    df = spark.range(100_000).select(F.lit("g").alias("k"), (F.col("id") % 40).cast("double").alias("v"))
    df = df.union(spark.range(50_000).select(F.lit("h"), F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id") % 10)))
    got = {r.k: r for r in stats.bootstrap_ci(df, ["k"], "v", 30).collect()}
    means = (np.arange(100_000) // 2500)[np.random.default_rng(0).integers(0, 100_000, size=(30, 100_000))].mean(axis=1)
    assert (got["g"].low, got["g"].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)
    assert got["h"].high == float("inf")
