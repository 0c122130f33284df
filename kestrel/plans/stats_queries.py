"""Queries of tests, trends and models on subjects' block totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import special
from kestrel.operators import mixed, projection, stats
from kestrel.plans import views
from kestrel.plans.registry import norm_cdf_sql, norm_ppf_sql, query, rounded, t_p_sql, t_ppf_sql, table
from kestrel.plans.views import BLOCKS_SQL

_SLOPES_SQL = f"""{BLOCKS_SQL}, k AS (SELECT cohort, subject, count(*) AS n, regr_slope(total, block) AS slope, regr_intercept(total, block) AS intercept, regr_r2(total, block) AS r2, regr_sxx(total, block) AS sxx, regr_syy(total, block) AS syy, regr_sxy(total, block) AS sxy
  FROM b GROUP BY ALL HAVING count(*) >= 2)"""


def _slopes(spark, sf_dir, least: int = 2):
    return stats.slopes(views.blocks(spark, sf_dir), ["cohort", "subject"], "block", "total", least)


@query(f"WITH {_SLOPES_SQL} SELECT cohort, subject, n, round(slope, 5) AS slope FROM k WHERE sxx > 0")
def q_slopes(spark, sf_dir):
    """Each subject's slope of totals over blocks."""
    return rounded(_slopes(spark, sf_dir), "slope", digits=5).select("cohort", "subject", "n", "slope")


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT cohort, block, avg(total) AS y FROM b GROUP BY ALL), k AS (SELECT cohort, count(*) AS n, regr_slope(y, block) AS slope, regr_intercept(y, block) AS intercept, regr_r2(y, block) AS r2, sqrt(greatest(0, regr_syy(y, block) - regr_slope(y, block) * regr_sxy(y, block)) / (count(*) - 2) / regr_sxx(y, block)) AS stderr FROM d GROUP BY cohort)
SELECT cohort, n, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(stderr, 5) AS stderr, round(slope / stderr, 5) AS t FROM k""")
def q_slope_summary(spark, sf_dir):
    """Regression of the cohorts' block means."""
    means = views.blocks(spark, sf_dir).groupBy("cohort", "block").agg(F.avg("total").alias("y"))
    out = stats.slopes(means, ["cohort"], "block", "y")
    return rounded(rounded(rounded(out, "slope", "stderr", "t", digits=5), "r2"), "intercept", digits=4)


@query(f"WITH {_SLOPES_SQL}, m AS (SELECT cohort, count(*) AS n, avg(slope) AS mean, stddev_samp(slope) AS sd FROM k GROUP BY cohort) SELECT cohort, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean / (sd / sqrt(n)), 5) AS t, n - 1 AS df, round(mean / sd, 5) AS d FROM m")
def q_slope_ttest(spark, sf_dir):
    """Whether a cohort's mean slope differs from 0."""
    return rounded(stats.one_sample_t(_slopes(spark, sf_dir), ["cohort"], "slope"), "mean", "sd", "t", "d", digits=5)


@query(f"""WITH {_SLOPES_SQL}, m AS (SELECT cohort, count(*) AS n, avg(slope) AS mean, stddev_samp(slope) AS sd, avg(slope) / (stddev_samp(slope) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM k GROUP BY cohort), p AS (SELECT *, {t_p_sql("t", "df")} AS p FROM m)
SELECT cohort, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, df, round(mean / sd, 6) AS d, round(p, 6) AS p, round(CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_greater FROM p""")
def q_slope_ttest_p(spark, sf_dir):
    """The same with two- and one-sided p-values."""
    out = stats.with_p(stats.one_sample_t(_slopes(spark, sf_dir), ["cohort"], "slope"))
    return rounded(out.withColumn("p_greater", stats.one_sided(F.col("p"), F.col("t"))), "mean", "sd", "t", "d", "p", "p_greater")


_TWO_SQL = """g AS (SELECT count(*) FILTER (cohort = 'TC') AS na, count(*) FILTER (cohort = 'TP') AS nb, avg(slope) FILTER (cohort = 'TC') AS ma, avg(slope) FILTER (cohort = 'TP') AS mb, var_samp(slope) FILTER (cohort = 'TC') AS va, var_samp(slope) FILTER (cohort = 'TP') AS vb FROM k)"""


@query(f"""WITH {_SLOPES_SQL}, {_TWO_SQL} SELECT round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 5) AS df, round((ma - mb) / sqrt((va + vb) / 2), 5) AS d FROM g""")
def q_welch(spark, sf_dir):
    """Cohorts' slopes against each other, variances apart, with the effect size."""
    return rounded(stats.welch_t(_slopes(spark, sf_dir), [], "cohort", "TC", "TP", "slope"), "t", "df", "d", digits=5).select("t", "df", "d")


@query(f"""WITH {_SLOPES_SQL}, {_TWO_SQL} SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 5) AS t, na + nb - 2 AS df FROM g""")
def q_pooled_t(spark, sf_dir):
    """The same with equal variances."""
    return rounded(stats.pooled_t(_slopes(spark, sf_dir), [], "cohort", "TC", "TP", "slope"), "t", digits=5).select("t", "df")


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT cohort, subject, max(total) FILTER (block = 5) - max(total) FILTER (block = 1) AS d FROM b GROUP BY ALL), m AS (SELECT cohort, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM w GROUP BY cohort)
SELECT cohort, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean / (sd / sqrt(n)), 5) AS t, n - 1 AS df, round(mean / sd, 5) AS d FROM m""")
def q_paired(spark, sf_dir):
    """The last block against the first, by subject."""
    from kestrel.operators import reshape

    wide = reshape.to_wide(views.blocks(spark, sf_dir), ["cohort", "subject"], "block", "total", [1, 5], "b{}")
    return rounded(stats.paired_t(wide, ["cohort"], "b1", "b5"), "mean", "sd", "t", "d", digits=5)


@query(f"""WITH {BLOCKS_SQL}, g AS (SELECT cohort, block, count(*) AS n, avg(total) AS m, var_pop(total) * count(*) AS w FROM b GROUP BY ALL), a AS (SELECT cohort, avg(total) AS gm FROM b GROUP BY cohort),
s AS (SELECT cohort, count(*) AS k, sum(n)::BIGINT AS n, sum(w) AS ssw, sum(n * (m - gm) ** 2) AS ssb FROM g JOIN a USING (cohort) GROUP BY cohort) SELECT cohort, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS f FROM s""")
def q_anova(spark, sf_dir):
    """Whether block totals differ between blocks."""
    return rounded(stats.anova(views.blocks(spark, sf_dir), ["cohort"], "block", "total"), "f", digits=5).select("cohort", "k", "n", "f")


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT cohort, subject FROM b GROUP BY ALL HAVING count(*) = 5), r AS (SELECT b.cohort, b.subject, b.block, rank() OVER (PARTITION BY b.cohort, b.subject ORDER BY total) + (count(*) OVER (PARTITION BY b.cohort, b.subject, total) - 1) / 2 AS r FROM b SEMI JOIN f USING (cohort, subject))
SELECT cohort, count(DISTINCT subject) AS n, round(sum(block * r), 5) AS l, round((sum(block * r) - count(DISTINCT subject) * 5 * 36 / 4) / sqrt(count(DISTINCT subject) * 25 * 6 * 24 / 144), 5) AS z FROM r GROUP BY cohort""")
def q_page_trend(spark, sf_dir):
    """Page's trend over the five blocks."""
    return rounded(stats.page_trend(views.blocks(spark, sf_dir), ["cohort"], "subject", "block", "total", 5), "l", "z", digits=5)


@query()
def q_page_p(spark, sf_dir):
    """The same with its p-value."""
    out = stats.page_p(stats.page_trend(views.blocks(spark, sf_dir), ["cohort"], "subject", "block", "total", 5), 5)
    return rounded(out, "l", "z", "p", digits=5)


@query()
def q_trend_band(spark, sf_dir):
    """The line of totals over blocks with its bootstrap band, by cohort."""
    out = stats.trend_band(views.blocks(spark, sf_dir), ["cohort"], "block", "total", [1.0, 2.0, 3.0, 4.0, 5.0], 500)
    return rounded(out, "fitted", "low", "high", digits=4)


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY block) + (count(*) OVER (PARTITION BY cohort, block) - 1) / 2 AS x, rank() OVER (PARTITION BY cohort ORDER BY total) + (count(*) OVER (PARTITION BY cohort, total) - 1) / 2 AS y FROM b)
SELECT cohort, count(*) AS n, round(corr(x, y), 5) AS rho FROM r GROUP BY cohort""")
def q_spearman(spark, sf_dir):
    """Rank correlation of block and total."""
    return rounded(stats.spearman(views.blocks(spark, sf_dir), ["cohort"], "block", "total"), "rho", digits=5)


@query(f"""WITH {_SLOPES_SQL}, m AS (SELECT cohort, count(*) AS n, avg(slope) AS mean, stddev_samp(slope) AS sd FROM k GROUP BY cohort), e AS (SELECT *, sd / sqrt(n) AS sem FROM m)
SELECT cohort, n, round((mean - 1.4) / sem, 5) AS t, round(mean - 1.4, 5) AS difference, round((mean - 1.4) / sqrt(sem ** 2 + 0.25), 5) AS t_w, round((sem ** 2 + 0.25) ** 2 / (sem ** 4 / (n - 1) + 0.0625 / 3), 4) AS df_w FROM e""")
def q_slope_vs_reference(spark, sf_dir):
    """Mean slopes against a published slope of 1.4 with error 0.5 and 3 degrees of freedom."""
    out = stats.against_reference(_slopes(spark, sf_dir), ["cohort"], "slope", 1.4, 0.5, 3)
    return rounded(rounded(out, "t", "difference", "t_w", digits=5), "df_w", digits=4).select("cohort", "n", "t", "difference", "t_w", "df_w")


@query()
def q_reference_verdict(spark, sf_dir):
    """The same with p-values, intervals and a verdict."""
    out = stats.reference_verdict(stats.against_reference(_slopes(spark, sf_dir), ["cohort"], "slope", 1.4, 0.5, 3), 1.4)
    return rounded(out, "p", "p_w", "low", "high", "low_difference", "high_difference").select("cohort", "n", "p", "p_w", "low", "high", "low_difference", "high_difference", "verdict")


@query(f"""WITH {BLOCKS_SQL}, g AS (SELECT cohort, count(*) AS n, regr_slope(total, block) AS s, regr_sxx(total, block) AS sxx, regr_syy(total, block) - regr_slope(total, block) * regr_sxy(total, block) AS rest FROM b GROUP BY cohort),
p AS (SELECT max(s) FILTER (cohort = 'TC') AS a, max(s) FILTER (cohort = 'TP') AS b, sum(n)::BIGINT - 4 AS df, sum(rest) AS rest, sum(1 / sxx) AS inv FROM g)
SELECT round(a, 5) AS slope_a, round(b, 5) AS slope_b, round(b - a, 5) AS interaction, round((b - a) / sqrt(rest / df * inv), 5) AS t, df FROM p""")
def q_interaction_ols(spark, sf_dir):
    """Whether the cohorts' slopes differ, in one regression."""
    return rounded(stats.slope_interaction(views.blocks(spark, sf_dir), [], "cohort", "TC", "TP", "block", "total"), "slope_a", "slope_b", "interaction", "t", digits=5)


@query(f"""WITH {_SLOPES_SQL}, m AS (SELECT cohort, count(*) AS n, avg(slope) AS mean, stddev_samp(slope) / sqrt(count(*)) AS se FROM k GROUP BY cohort) SELECT cohort, n, round(mean, 5) AS mean, round((mean + 50) / se, 5) AS t_lower, round((mean - 50) / se, 5) AS t_upper, n - 1 AS df FROM m""")
def q_tost(spark, sf_dir):
    """Whether mean slopes are equivalent to 0 within 50."""
    return rounded(stats.tost(_slopes(spark, sf_dir), ["cohort"], "slope", 50.0), "mean", "t_lower", "t_upper", digits=5)


@query(f"""WITH {_SLOPES_SQL}, m AS (SELECT cohort, count(*) AS n, avg(slope) AS mean, stddev_samp(slope) / sqrt(count(*)) AS se, count(*) - 1 AS df FROM k GROUP BY cohort), t AS (SELECT *, (mean + 50) / se AS a, (mean - 50) / se AS b FROM m),
p AS (SELECT *, {t_p_sql("a", "df")} / 2 AS pa, {t_p_sql("b", "df")} / 2 AS pb FROM t), q AS (SELECT *, greatest(CASE WHEN a > 0 THEN pa ELSE 1 - pa END, CASE WHEN b < 0 THEN pb ELSE 1 - pb END) AS p FROM p)
SELECT cohort, n, round(mean, 6) AS mean, round(a, 6) AS t_lower, round(b, 6) AS t_upper, df, round(p, 6) AS p, p < 0.05 AS equivalent FROM q""")
def q_tost_p(spark, sf_dir):
    """The same with its p-value and verdict."""
    return rounded(stats.tost_p(stats.tost(_slopes(spark, sf_dir), ["cohort"], "slope", 50.0)), "mean", "t_lower", "t_upper", "p")


@query(f"WITH {_SLOPES_SQL} SELECT cohort, count(*) AS n, round(skewness(slope), 5) AS skew, round(kurtosis(slope), 5) AS kurtosis FROM k GROUP BY cohort")
def q_skew_kurt(spark, sf_dir):
    """Skew and kurtosis of slopes, corrected for bias."""
    return rounded(stats.shape(_slopes(spark, sf_dir), ["cohort"], "slope"), "skew", "kurtosis", digits=5)


def _poly(coefficients: list[float], x: str) -> str:
    """SQL for a polynomial, highest power first."""
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


# The published polynomials of Royston's approximation.
_NORMALITY_SQL = f"""{_SLOPES_SQL},
r AS (SELECT cohort, slope AS v, row_number() OVER (PARTITION BY cohort ORDER BY slope) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM k WHERE sxx > 0),
q AS (SELECT *, {norm_ppf_sql("(i - 0.375) / (n + 0.25)")} AS m FROM r),
s AS (SELECT cohort, max(n)::DOUBLE AS n, sum(m * m) AS mm, sum(m * v) AS mx, var_pop(v) * count(*) AS ss,
  max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, max(v) FILTER (i = 1) AS x1, max(v) FILTER (i = 2) AS x2,
  max(v) FILTER (i = n - 1) AS x3, max(v) FILTER (i = n) AS x4, skewness(v) AS skew, kurtosis(v) AS kurtosis FROM q GROUP BY cohort),
c AS (SELECT *, {_poly([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157], "(1 / sqrt(n))")} / sqrt(n) + m1 / sqrt(mm) AS a1,
  {_poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981], "(1 / sqrt(n))")} / sqrt(n) + m2 / sqrt(mm) AS a2 FROM s),
w AS (SELECT *, least(1, CASE WHEN n > 5
    THEN (a1 * (x4 - x1) + a2 * (x3 - x2) + (mx - m1 * (x4 - x1) - m2 * (x3 - x2)) / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))) ** 2
    ELSE (a1 * (x4 - x1) + (mx - m1 * (x4 - x1)) / sqrt((mm - 2 * m1 ** 2) / (1 - 2 * a1 ** 2))) ** 2 END / ss) AS w FROM c WHERE n > 3),
z AS (SELECT *, CASE WHEN n > 11
    THEN (ln(1 - w) - ({_poly([0.0038915, -0.083751, -0.31082, -1.5861], "ln(n)")})) / exp({_poly([0.0030302, -0.082676, -0.4803], "ln(n)")})
    ELSE (-ln(-2.273 + 0.459 * n - ln(1 - w)) - ({_poly([-0.0006714, 0.025054, -0.39978, 0.5440], "n")})) / exp({_poly([-0.0020322, 0.062767, -0.77857, 1.3822], "n")}) END AS z FROM w),
p AS (SELECT *, 1 - {norm_cdf_sql("z")} AS p FROM z),
f AS (SELECT *, (p < 0.05)::INTEGER + (abs(skew) > 1)::INTEGER + (abs(kurtosis) > 2)::INTEGER AS flags FROM p)"""


@query(f"""WITH {_NORMALITY_SQL} SELECT cohort, n::BIGINT AS n, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(w, 6) AS w, round(p, 6) AS p,
  CASE flags WHEN 0 THEN 'normal' WHEN 1 THEN 'borderline' ELSE 'not normal' END AS verdict FROM f""")
def q_normality(spark, sf_dir):
    """The battery on slopes: shape, Shapiro-Wilk and verdict."""
    return rounded(stats.normality(_slopes(spark, sf_dir), ["cohort"], "slope"), "skew", "kurtosis", "w", "p")


@query(f"""WITH {_SLOPES_SQL}, r AS (
  SELECT cohort, slope, row_number() OVER (PARTITION BY cohort ORDER BY slope) AS i, count(*) OVER (PARTITION BY cohort) AS n FROM k WHERE sxx > 0),
p AS (SELECT *, CASE WHEN i = n THEN 0.5 ** (1 / n) WHEN i = 1 THEN 1 - 0.5 ** (1 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM r)
SELECT cohort, round(slope, 6) AS slope, round({norm_ppf_sql("p")}, 6) AS quantile FROM p""")
def q_qq_points(spark, sf_dir):
    """Points of the normal quantile plot of slopes."""
    return rounded(stats.normal_quantiles(_slopes(spark, sf_dir), ["cohort"], "slope"), "slope", "quantile")


@query()
def q_bayes_factor(spark, sf_dir):
    """Bayes factors of mean slopes, as published and with the usual prior."""
    from kestrel.functions import text

    out = stats.bayes_factor(_slopes(spark, sf_dir), ["cohort"], "slope")
    return rounded(out.withColumn("label", text.bayes_label(1 / F.col("bf10_jzs"))), "t", "bf10_published", "bf10_jzs")


@query()
def q_lmm(spark, sf_dir):
    """log(total) ~ block * cohort with a random intercept for each subject (REML)."""
    rows = views.blocks(spark, sf_dir).withColumn("y", F.ln("total")).withColumn("one", F.lit(1))
    out = mixed.random_intercept(rows, ["one"], "subject", "y", {"block": "block", "TP": "cohort = 'TP'", "block:TP": "IF(cohort = 'TP', block, 0)"})
    return rounded(out, "estimate", "stderr", "z", "p", "residual_variance", "subject_variance", "log_likelihood", digits=5).drop("one")


@query()
def q_lmm_by_cohort(spark, sf_dir):
    """Blocks as categories against an intercept alone, by cohort, by likelihood ratio."""
    rows = views.blocks(spark, sf_dir).withColumn("y", F.ln("total"))
    terms = {f"block{k}": f"block = {k}" for k in range(2, 6)}
    full = mixed.random_intercept(rows, ["cohort"], "subject", "y", terms, reml=False)
    return rounded(mixed.likelihood_ratio(full, mixed.random_intercept(rows, ["cohort"], "subject", "y", {}, reml=False), ["cohort"], 4), "full", "null", "chi2", "p", digits=4)


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT cohort, count(DISTINCT subject) AS n FROM b GROUP BY cohort)
SELECT cohort, n, round({t_ppf_sql(0.975, "n - 1")}, 6) AS critical FROM c""")
def q_t_quantiles(spark, sf_dir):
    """Critical values of t by cohort size."""
    n = views.blocks(spark, sf_dir).groupBy("cohort").agg(F.count_distinct("subject").alias("n"))
    return rounded(n.withColumn("critical", special.t_ppf_column(F.lit(0.975), (F.col("n") - 1).cast("double"))), "critical")


@query()
def q_pca_projection(spark, sf_dir):
    """Embeddings on the first components of their own reference space."""
    rows = table(spark, sf_dir, "embeddings")
    space = projection.reference_space(rows, "embedding", 3)
    out = projection.projected(rows, "embedding", space)
    return out.select("vec_id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))
