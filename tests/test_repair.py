"""Repair by groups of cuts against the fold over whole series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import series


def plain(values, cuts):
    v = np.array([np.nan if x is None else x for x in values], float)
    for b, a in sorted((b, a) for a, b in cuts):
        if 1 <= a <= b < len(v) - 1 and not np.isnan(v[a - 1]) and not np.isnan(v[b + 1]):
            v[a : b + 1] = np.interp(np.arange(a, b + 1), [a - 1, b + 1], [v[a - 1], v[b + 1]])
    return [None if np.isnan(x) else x for x in v]


def test_groups_of_cuts(spark):
    cuts = spark.createDataFrame([("x", 3, 5), ("x", 6, 8), ("x", 11, 12), ("x", 11, 12), ("x", 15, 14), ("y", 0, 2), (None, 4, 4)], "s string, start int, end int")
    got = {(r.s, r.low, r.high, tuple((c["start"], c["end"]) for c in r.cuts)) for r in series.cut_groups(cuts, ["s"]).collect()}
    assert got == {("x", 2, 9, ((3, 5), (6, 8))), ("x", 10, 13, ((11, 12), (11, 12))), ("y", -1, 3, ((0, 2),)), (None, 3, 5, ((4, 4),))}


@pytest.mark.parametrize("density", [0.02, 0.2])
def test_against_the_fold(spark, density):
    rng, rows, cuts, want = random.Random(density), [], [], {}
    for s in [*range(12), None]:
        n = rng.choice([1, 2, 5, 60, 300])
        v = [None if rng.random() < 0.1 else rng.random() * 10 for _ in range(n)]
        w = [None if rng.random() < 0.3 else float(rng.randrange(9)) for _ in range(n)]
        mine = [(a, a + rng.randrange(-1, 6)) for a in range(-1, n + 2) if rng.random() < density]
        rows += [(s, k, v[k], w[k], f"r{k}") for k in range(n)]
        cuts += [(s, a, b) for a, b in mine] * rng.choice([1, 2])
        want |= {(s, k): (x, y, f"r{k}") for k, (x, y) in enumerate(zip(plain(v, mine), plain(w, mine)))}
    df = spark.createDataFrame(rows, "s int, frame int, v double, w double, low string").repartition(4)
    found = series.interpolated(df, spark.createDataFrame(cuts, "s int, start int, end int"), ["s"], "frame", ["v", "w"]).collect()
    assert len(found) == len(rows)
    for r in found:
        x, y, name = want[r.s, r.frame]
        assert r.low == name and (r.v is None) == (x is None) and (r.w is None) == (y is None)
        assert x is None or r.v == pytest.approx(x, abs=1e-9)
        assert y is None or r.w == pytest.approx(y, abs=1e-9)


def test_no_cuts_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, None)], "s int, frame int, v double")
    none = spark.createDataFrame([], "s int, start int, end int")
    assert sorted(tuple(r) for r in series.interpolated(df, none, ["s"], "frame", ["v"]).collect()) == [(1, 0, 2.0), (1, 1, None)]
    assert series.interpolated(df.limit(0), none, ["s"], "frame", ["v"]).collect() == []


def test_a_long_series_is_no_group(spark):
    """Lone cuts never reach Python, and the largest group of rows is that of the cuts that meet."""
    df = spark.range(300_000).select(F.lit(1).alias("s"), F.col("id").cast("int").alias("frame"), F.when(F.col("id") % 100 < 98, F.col("id").cast("double")).alias("v"))
    cuts = spark.range(1, 2999).selectExpr("1 AS s", "CAST(id * 100 + 98 AS INT) AS start", "CAST(id * 100 + 99 AS INT) AS end")
    out = series.interpolated(df, cuts, ["s"], "frame", ["v"])
    assert out.where("v is null").count() == 2 * 2 and out.where("v <> frame").isEmpty()
