"""Signs of zeros and values at a threshold, where engines differ in the last digits."""

import math

import duckdb
import numpy as np

from kestrel.plans.catalog import ORACLES, QUERIES


def test_small_negative_shares_keep_their_sign(spark, tmp_path):
    """Rounded to zero, they are -0.0 in SQL; a null sign or a zero has none to lose."""
    rows = [(1, [1e-7, -1e-7, 1.0, 0.0]), (2, [-0.0, 0.5, -0.5, -3e-6]), (3, [-1.0, 2.5e-6, -2.5e-6, 7.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {k: e for k, e in duck.execute(ORACLES["q_l1_normalize"]).fetchall()}
    got = {r.vec_id: r.e for r in QUERIES["q_l1_normalize"](spark, str(tmp_path)).collect()}
    assert {k: list(map(repr, e)) for k, e in got.items()} == {k: list(map(repr, e)) for k, e in want.items()}
    assert math.copysign(1, got[1][1]) == -1 and got[1][1] == 0


def test_a_slope_of_the_bound_is_no_rise(spark, tmp_path):
    """Totals of whole numbers whose slopes are 50 and -50 exactly, 200 subjects each."""
    rng, rows = np.random.default_rng(2), []
    for subject in range(400):
        slope, base, bend = (50 if subject % 2 else -50), int(rng.integers(500, 900)), int(rng.integers(-90, 90))
        totals = [base + slope * b + bend * e for b, e in zip(range(1, 6), (1, -2, 1, 0, 0))]
        rows += [(b, 0, subject, 1, float(q), 0.1, "R", "2020-01-01") for b, total in enumerate(totals) for q in (total - 7, 7)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_shipdate string"
    frame = spark.createDataFrame(rows, names).selectExpr("* EXCEPT (l_shipdate)", "CAST(l_shipdate AS timestamp) AS l_shipdate")
    frame.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["q_verdict_tally"](spark, str(tmp_path)).collect()] == [("flat", 400)]
