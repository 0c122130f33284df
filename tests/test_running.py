"""Running medians and diameters against plain forms, at length."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from kestrel.functions import arrays
from kestrel.operators import series


def plain_median(values, size):
    n, out = len(values), []
    for i in range(n):
        window = []
        for k in range(i - size // 2, i - size // 2 + size):
            k %= 2 * n
            window.append(values[min(k, 2 * n - 1 - k)])
        out.append(sorted(window, key=lambda v: (v is not None, v or 0))[size // 2])
    return out


def test_running_median_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(series, "STRETCH", 50)
    rng, rows, want = random.Random(1), [], {}
    for s, n in enumerate([1, 2, 49, 50, 51, 100, 230]):
        v = [None if rng.random() < 0.1 else rng.randrange(20) for _ in range(n)]
        rows += [(s, k, v[k], f"{s}-{k}") for k in range(n)]
        for size in (1, 5, 60):
            want |= {(size, s, k): m for k, m in enumerate(plain_median(v, size))}
    df = spark.createDataFrame(rows, "s int, frame int, v int, note string").repartition(4)
    for size in (1, 5, 60):
        out = series.median_filtered(df, ["s"], "frame", "v", "m", size)
        assert dict(out.dtypes)["m"] == "int" and out.columns == [*df.columns, "m"]
        got = {(size, r.s, r.frame): r.m for r in out.collect()}
        assert got == {k: m for k, m in want.items() if k[0] == size}
        assert all(r.note == f"{r.s}-{r.frame}" for r in out.collect())
    assert series.median_filtered(df.limit(0), ["s"], "frame", "v", "v", 5).collect() == []


def test_the_window_costs_its_logarithm():
    values = [random.Random(2).random() for _ in range(200_000)]
    times = []
    for size in (5, 501):
        began = time.perf_counter()
        series.running_median(values, size)
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0]


def test_diameter():
    rng = random.Random(3)
    for case in range(2000):
        n, span = rng.randrange(1, 12), rng.choice([2, 5, 1000])
        points = [(rng.randrange(span), rng.randrange(span)) if case % 2 else (rng.random(), rng.random()) for _ in range(n)]
        assert arrays.diameter(points) == pytest.approx(max(math.dist(p, q) for p in points for q in points), abs=1e-12)


def test_a_long_outline(spark):
    circle = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((F.cos(i * 6.283185307179586 / 100_000) * 7).alias("x"), (F.sin(i * 6.283185307179586 / 100_000) * 7).alias("y")))
    began = time.perf_counter()
    rows = spark.range(1).select(circle.alias("p")).unionByName(spark.createDataFrame([(None,), ([],), ([{"x": 1.0, "y": None}, {"x": 1.0, "y": 2.0}],)], "p array<struct<x:double,y:double>>"))
    got = [r.d for r in rows.select(arrays.largest_distance("p").alias("d")).collect()]
    assert got[0] == pytest.approx(14.0, abs=1e-9) and got[1:] == [None, None, 0.0]
    assert time.perf_counter() - began < 30
