"""The exhaustive circular null against one shift at a time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import divergence


def plain(v, on, shift):
    flags = [on[(u - shift) % len(v)] for u in range(len(v))]
    a, b = ([x for x, f in zip(v, flags) if f is side and x is not None] for side in (True, False))
    if len(a) < 2 or len(b) < 2:
        return None
    va, vb = np.var(a, ddof=1) + 1e-12, np.var(b, ddof=1) + 1e-12
    return 0.5 * (np.log(vb / va) + (va + (np.mean(a) - np.mean(b)) ** 2) / vb - 1)


def test_every_shift(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for s in range(8):
        n = [1, 2, 3, 17, 40, 64, 41, 50][s]
        v = [None if rng.random() < 0.1 else float(x) for x in (rng.normal(1e6, 1, n) if s % 2 else rng.integers(0, 2, n))]
        w = [3.5] * n if s == 6 else [float(x) for x in rng.normal(size=n)]
        on = [None if rng.random() < 0.1 else bool(rng.random() < 0.3) for _ in range(n)]
        rows += [(s, k, on[k], v[k], w[k]) for k in range(n)]
        for shift in range(n):
            one, two = plain(v, on, shift), plain(w, on, shift)
            want[s, shift] = (one, two, None if one is None or two is None else one + two)
    df = spark.createDataFrame(rows, "s int, frame int, cs_on boolean, v double, w double").repartition(3)
    null = divergence.circular_null(df, ["s"], "frame", ["v", "w"])
    got = {(r.s, r["shift"]): (r.v_kl, r.w_kl, r.kl) for r in null.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]], k
        assert [x for x in got[k] if x is not None] == pytest.approx([x for x in want[k] if x is not None], rel=1e-6, abs=1e-8), k
    same = {(r.s, r["shift"]): r.kl for r in divergence.shifted_null(df, ["s"], "frame", ["v", "w"], [0, 1, 2]).where("s > 3").collect()}
    assert all(x == pytest.approx(got[k][2], rel=1e-6) for k, x in same.items() if x is not None)
    for r in divergence.null_p(null, ["s"]).collect():
        scores = [x[2] for (s, _), x in want.items() if s == r.s and x[2] is not None]
        first = want[r.s, 0][2]
        assert r.kl == pytest.approx(first, rel=1e-6) and r.n_shifts == len(scores)
        assert r.p_greater == sum(x >= first - 1e-9 for x in scores) / len(scores)
        assert r.p_two_sided == sum(abs(x - np.mean(scores)) >= abs(first - np.mean(scores)) - 1e-9 for x in scores) / len(scores)
    assert divergence.circular_null(df.limit(0), ["s"], "frame", ["v"]).collect() == []


def test_a_long_series_costs_no_square(spark):
    df = spark.range(200_000).select(F.lit(1).alias("s"), F.col("id").alias("frame"), (F.col("id") % 1800 < 300).alias("cs_on"), F.sin(F.col("id") / 50).alias("v"))
    began = time.perf_counter()
    r = divergence.null_p(divergence.circular_null(df, ["s"], "frame", ["v"]), ["s"]).first()
    assert r.n_shifts == 200_000 and 0 < r.p_greater <= 1 and time.perf_counter() - began < 60
