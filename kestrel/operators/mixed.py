"""Linear mixed models with a random intercept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import special


def _profile(log_ratio: float, parts: list[tuple], reml: bool):
    """Minus twice the profiled log likelihood at a variance ratio, and the estimates.

    parts: for subjects with the same number n of rows, their number m, n, and the sums over them
    of X'X, (X'1)(X'1)', X'y, (X'1)(1'y), y'y and (1'y)^2. With V = I + r 11', its inverse is
    I - r / (1 + n r) 11', a weight that only n decides, so that these sums suffice.
    """
    r = float(np.exp(log_ratio))
    p = len(parts[0][4])
    a, b, c, logdet, total = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0
    for m, n, xx, x1x1, xy, x1y1, yy, y1y1 in parts:
        w = r / (1 + n * r)
        a += xx - w * x1x1
        b += xy - w * x1y1
        c += yy - w * y1y1
        logdet += m * np.log1p(n * r)
        total += m * n
    beta = np.linalg.solve(a, b)
    free = total - p if reml else total
    variance = max((c - b @ beta) / free, 1e-300)
    value = free * (np.log(2 * np.pi * variance) + 1) + logdet + (np.linalg.slogdet(a)[1] if reml else 0.0)
    return value, beta, variance, np.linalg.inv(a) * variance, r


def fit(parts: list[tuple], reml: bool):
    """The best profile over the variance ratio, by golden sections, and ratio 0."""
    low, high, g = -18.0, 18.0, (5**0.5 - 1) / 2
    grid = np.linspace(low, high, 37)
    values = [_profile(x, parts, reml)[0] for x in grid]
    k = int(np.argmin(values))
    low, high = grid[max(0, k - 1)], grid[min(36, k + 1)]
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        if _profile(a, parts, reml)[0] < _profile(b, parts, reml)[0]:
            high = b
        else:
            low = a
    return _profile((low + high) / 2, parts, reml)


def random_intercept(df: DataFrame, keys: list[str], subject: str, y: str, x: dict[str, str], reml: bool = True) -> DataFrame:
    """keys, term, estimate, stderr, z, p, residual_variance, subject_variance and log_likelihood
    of y ~ 1 + x with a random intercept for each subject. x maps a term's name to a SQL
    expression. Rows with a null are left out.

    Spark reduces the rows to sums for each subject, and these to sums for each number of rows
    that a subject has: a fit sees one row for each such number, however many subjects there
    are. Models without more rows than terms, or of dependent terms, are left out.
    """
    names = ["intercept", *x]
    terms = ["double(1)", *(f"double({e})" for e in x.values())]
    rows = df.select(*keys, F.col(subject).alias("__s"), F.col(y).cast("double").alias("__y"), *[F.expr(e).alias(f"__x{i}") for i, e in enumerate(terms)]).na.drop()
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count("*").alias("n"), F.sum("__y").alias("y1"), F.sum(F.col("__y") ** 2).alias("yy")]
    sums += [F.sum(F.col(f"__x{i}") * F.col("__y")).alias(f"xy{i}") for i in range(k)]
    sums += [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"xx{i}_{j}") for i, j in pairs]
    subjects = rows.groupBy(*keys, "__s").agg(*sums)
    # The first term is the constant, so a subject's X'1 is the first row of its X'X.
    sums = [F.count("*").alias("m"), F.sum("yy").alias("yy"), F.sum(F.col("y1") ** 2).alias("y1y1")]
    sums += [f for i in range(k) for f in (F.sum(f"xy{i}").alias(f"xy{i}"), F.sum(F.col(f"xx0_{i}") * F.col("y1")).alias(f"x1y1{i}"))]
    sums += [f for i, j in pairs for f in (F.sum(f"xx{i}_{j}").alias(f"xx{i}_{j}"), F.sum(F.col(f"xx0_{i}") * F.col(f"xx0_{j}")).alias(f"x1x1{i}_{j}"))]
    grouped = subjects.groupBy(*keys, "n").agg(*sums)
    columns = [*keys, "term", "estimate", "stderr", "z", "p", "residual_variance", "subject_variance", "log_likelihood"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in group.to_dict("records"):
            xx, x1x1 = np.zeros((k, k)), np.zeros((k, k))
            for i, j in pairs:
                xx[i, j] = xx[j, i] = r[f"xx{i}_{j}"]
                x1x1[i, j] = x1x1[j, i] = r[f"x1x1{i}_{j}"]
            xy, x1y1 = (np.array([r[f"{c}{i}"] for i in range(k)]) for c in ("xy", "x1y1"))
            parts.append((r["m"], r["n"], xx, x1x1, xy, x1y1, r["yy"], r["y1y1"]))
        whole = sum(p[2] for p in parts)
        if sum(p[0] * p[1] for p in parts) <= k or np.linalg.matrix_rank(whole) < k:
            return pd.DataFrame(columns=columns)
        value, beta, variance, cov, ratio = fit(parts, reml)
        error = np.sqrt(np.diag(cov))
        key = list(group.loc[group.index[0], keys])
        out = []
        for name, b, e in zip(names, beta, error):
            out.append([*key, name, b, e, b / e, 2 * special.norm_cdf(-abs(b / e)), variance, ratio * variance, -value / 2])
        return pd.DataFrame(out, columns=columns)

    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)
    doubles = ", ".join(f"{c} double" for c in columns[len(keys) + 1 :])
    return grouped.groupBy(*keys).applyInPandas(run, f"{kinds}{', ' * bool(keys)}term string, {doubles}")


def likelihood_ratio(full: DataFrame, null: DataFrame, keys: list[str], terms: int) -> DataFrame:
    """keys, chi2, df and p of two models fitted by maximum likelihood (reml=False); `terms` is
    the number of terms that only the full model has. The null model belongs on the same y."""
    a = full.groupBy(*keys).agg(F.max("log_likelihood").alias("full"))
    b = null.groupBy(*keys).agg(F.max("log_likelihood").alias("null"))
    out = a.join(b, keys).withColumn("chi2", F.greatest(F.lit(0.0), 2 * (F.col("full") - F.col("null")))).withColumn("df", F.lit(terms))
    return out.withColumn("p", special.chi2_sf_column(F.col("chi2"), F.col("df").cast("double")))
