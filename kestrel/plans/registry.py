"""The catalog of named queries: name to function of (spark, sf_dir), and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of its rows if SQL has them."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def t_p_sql(t: str, df: str) -> str:
    """SQL for the two-sided p-value of t at whole degrees of freedom: the finite series of the
    angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda j: cos({angle}) ** (2 * j + 1) * exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2)), 0))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, ({df}) // 2), lambda j: cos({angle}) ** (2 * j) * exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi())))"
    return f"(1 - CASE WHEN ({df}) % 2 = 1 THEN {odd} ELSE {even} END)"


def t_quantile_sql(z: float, df: str) -> str:
    """SQL for the quantile of t whose normal quantile is z, by its expansion in 1 / df, which is
    exact to twelve digits from some hundred degrees of freedom on."""
    v = f"({df})::DOUBLE"
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z!r} + " + " + ".join(f"{c!r} / ({v}) ** {k}" for k, c in enumerate(terms, 1)) + ")"


def norm_cdf_sql(x: str) -> str:
    """SQL for the normal distribution function, by its series in odd powers; exact to about ten digits up to 6."""
    term = f"(abs({x})) ** (2 * k + 1) / exp(ln(2) * (k + 1) + lgamma(k + 1.5) - ln(pi()) / 2)"
    half = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda k: {term}))"
    return f"(0.5 + sign({x}) * {half})"


def newton_sql(start: str, step: str, rounds: int = 40) -> str:
    """SQL for start after some steps of Newton's method; step is an expression of v."""
    return f"list_reduce(list_prepend(({start})::DOUBLE, list_transform(range(0, {rounds}), lambda i: 0.0::DOUBLE)), lambda v, z: v + {step})"


def norm_ppf_sql(p: str) -> str:
    """SQL for the normal quantile: Newton's method from 0, which rises steadily in the upper half."""
    upper = f"greatest({p}, 1 - ({p}))"
    found = newton_sql("0", f"({upper} - {norm_cdf_sql('v')}) / (exp(-v * v / 2) / sqrt(2 * pi()))")
    return f"(sign(({p}) - 0.5) * {found})"


def t_ppf_sql(p: float, df: str) -> str:
    """SQL for an upper quantile of t at whole degrees of freedom, by Newton's method from 0."""
    density = f"(exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * (1 + v * v / ({df})) ** (-(({df}) + 1) / 2))"
    return newton_sql("0", f"({p!r} - (1 - {t_p_sql('v', df)} / 2)) / {density}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns to a few digits: sums in another order differ in the last ones."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
