"""Ranks and quantiles of groups against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ranks, reshape, stats


def groups(spark):
    rng = random.Random(11)
    rows = []
    for k in ("a", "b", None, "one", "ties"):
        for _ in range(1 if k == "one" else 400):
            v = 1.5 if k == "ties" and rng.random() < 0.7 else rng.choice([rng.gauss(0, 3), float(rng.randrange(5)), -0.0, 0.0, None])
            rows.append((k, v, rng.choice([v, rng.random(), None])))
    rows.append(("nulls", None, None))
    return rows, spark.createDataFrame(rows, "k string, v double, before double").repartition(5)


def by_key(rows, at=1):
    out = {}
    for r in rows:
        if r[at] is not None:
            out.setdefault(r[0], []).append(r[at] + 0.0)
    return {k: sorted(v) for k, v in out.items()}


def test_value_counts(spark):
    rows, df = groups(spark)
    want = by_key(rows)
    got = ranks.value_counts(df, ["k"], "v").collect()
    assert {k: sorted((v, sum(x == v for x in l), sum(x < v for x in l), len(l)) for v in set(l)) for k, l in want.items()} == {
        k: sorted((r.v, r.n, r.before, r.total) for r in got if r.k == k) for k in want
    }
    placed = ranks.positions(ranks.value_counts(df, ["k"], "v")).select("k", "v", "position").collect()
    assert {k: [(v, i) for i, v in enumerate(l, 1)] for k, l in want.items()} == {k: sorted([(r.v, r.position) for r in placed if r.k == k], key=lambda x: x[1]) for k in want}
    everything = sorted(v for l in want.values() for v in l)
    assert {(r.v, r.before) for r in ranks.value_counts(df, [], "v").collect()} == {(v, everything.index(v)) for v in everything}
    assert ranks.value_counts(df.limit(0), ["k"], "v").collect() == []


def test_quantiles(spark):
    np = pytest.importorskip("numpy")
    rows, df = groups(spark)
    at = {"low": 0.0, "q": 0.1, "median": 0.5, "third": 1 / 3, "high": 1.0}
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", at).collect()}
    for k, l in by_key(rows).items():
        assert [got[k][n] for n in at] == pytest.approx([float(np.quantile(l, q)) for q in at.values()], abs=1e-12)
    described = {r.k: r for r in stats.described(df, ["k"], "v").collect()}
    assert described["a"].median == got["a"]["median"] and described["nulls"].median is None and described["nulls"].n == 0


def test_spearman_with_ties(spark):
    np = pytest.importorskip("numpy")
    rows, df = groups(spark)
    got = {r.k: r for r in stats.spearman(df, ["k"], "v", "before").collect()}

    def rank(l):
        return [sum(x < v for x in l) + (sum(x == v for x in l) + 1) / 2 for v in l]

    for k in got:
        pairs = [(v + 0.0, b + 0.0) for key, v, b in rows if key == k and v is not None and b is not None]
        assert got[k].n == len(pairs)
        if len(pairs) > 1:
            assert got[k].rho == pytest.approx(np.corrcoef(rank([p[0] for p in pairs]), rank([p[1] for p in pairs]))[0, 1], abs=1e-12)
        else:
            assert got[k].rho is None


def test_top_fraction_counts_keys(spark):
    df = spark.range(5000).select((F.col("id") % 500).alias("k"), (F.col("id") % 500 % 77).cast("double").alias("v"))
    means = sorted(range(500), key=lambda k: (-(k % 77), k))
    got = {r.k for r in reshape.top_fraction(df, "k", "v", 0.33).select("k").distinct().collect()}
    assert got == set(means[:165])


def test_a_million_different_values_in_one_group(spark):
    """No aggregation buffer, cell or window holds them: the largest window is a range."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(1_000_001).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 1_000_001).cast("double").alias("v"))
        counts = ranks.value_counts(df, ["k"], "v")
        assert ranks.quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}).first()[1:] == (500_000.0, pytest.approx(900_000.0))
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan.lower() and "collect_list" not in plan
        parts = counts.select(F.floor(F.col("before") / 62_500).alias("p")).groupBy("p").count().count()
        assert parts == 17 and counts.where("before <> v").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_session_on_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from kestrel.sources import shared

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
