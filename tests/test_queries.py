"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from kestrel.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, dict):
        x = tuple(x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else x


def table(rows, names):
    return sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_have_no_nested_loop_over_rows(spark):
    for name in ("q_kl_diag", "q_trial_label_rangejoin", "q_match_greedy", "q_complement_gaps"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pushdown(spark):
    plan = QUERIES["q_behavior_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_comment" not in plan
