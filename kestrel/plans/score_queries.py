"""Queries on score sheets: counts, summaries, reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import arrays
from kestrel.operators import reshape, scores, stats
from kestrel.plans import views
from kestrel.plans.registry import query, rounded, t_quantile_sql
from kestrel.plans.views import BLOCKS_SQL, SCORES_SQL

BEHAVIORS = ["CRturn", "CRcon", "UCRturn", "UCRcon"]


@query(f"""WITH {SCORES_SQL}, c AS (SELECT troupe, day, worm, {", ".join(f"coalesce(sum(score) FILTER (behavior = '{b}'), 0) AS {b}" for b in BEHAVIORS)} FROM sc GROUP BY ALL)
SELECT *, CRturn + CRcon AS CR, UCRturn + UCRcon AS UCR FROM c""")
def q_raw_counts(spark, sf_dir):
    """Sums of each behaviour by troupe, day and subject, missing scores as 0, and their totals."""
    return scores.raw_counts(views.scores(spark, sf_dir), ["troupe", "day", "worm"], BEHAVIORS)


@query(f"""WITH {SCORES_SQL} SELECT cohort, behavior, day, round(avg(score), 2) AS mean, round(stddev_samp(score) / sqrt(count(score)), 3) AS sem, count(score) AS n, round(stddev_samp(score), 2) AS sd FROM sc WHERE day IN (1, 2, 3) GROUP BY ALL""")
def q_behavior_summary(spark, sf_dir):
    """Mean, error, number and deviation of the pooled trial scores, rounded for print."""
    rows = views.scores(spark, sf_dir).where(F.col("day").isin(1, 2, 3))
    return scores.behavior_summary(rows, ["cohort", "behavior", "day"], "score").drop("error")


@query(f"""WITH {SCORES_SQL}, m AS (SELECT cohort, behavior, day, avg(score) AS m, stddev_samp(score) AS s, count(score) AS n FROM sc GROUP BY ALL)
SELECT cohort, behavior, day, round(m, 2) AS mean, round(s / sqrt(n), 3) AS sem, n, round(s, 2) AS sd, round({t_quantile_sql(1.959963984540054, "n - 1")} * s / sqrt(n), 3) AS error FROM m""")
def q_behavior_summary_ci(spark, sf_dir):
    """The same with the half width of the t interval."""
    return scores.behavior_summary(views.scores(spark, sf_dir), ["cohort", "behavior", "day"], "score", "ci")


@query()
def q_behavior_summary_bootstrap(spark, sf_dir):
    """The same with the half width of the bootstrap interval."""
    return scores.behavior_summary(views.scores(spark, sf_dir), ["cohort", "behavior", "day"], "score", "bootstrap")


@query(f"""WITH {SCORES_SQL} SELECT cohort, day, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(stddev_samp(score) / sqrt(count(score)), 6) AS sem FROM sc GROUP BY ALL""")
def q_mean_sem(spark, sf_dir):
    """Mean and standard error by cohort and day."""
    return rounded(stats.mean_sem(views.scores(spark, sf_dir), ["cohort", "day"], "score"), "mean", "sd", "sem")


@query(f"""WITH {SCORES_SQL}, m AS (SELECT cohort, day, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM sc GROUP BY ALL), e AS (SELECT *, sd / sqrt(n) AS sem, {t_quantile_sql(1.959963984540054, "n - 1")} * sd / sqrt(n) AS half FROM m)
SELECT cohort, day, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sem, 6) AS sem, round(half, 6) AS half_width, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM e""")
def q_mean_ci(spark, sf_dir):
    """Mean with its t interval by cohort and day."""
    return rounded(stats.mean_ci(views.scores(spark, sf_dir), ["cohort", "day"], "score"), "mean", "sd", "sem", "half_width", "low", "high")


@query(f"""WITH {SCORES_SQL}, c AS (SELECT cohort, block, subject, sum(score) AS s FROM sc WHERE score IS NOT NULL GROUP BY ALL), p AS (SELECT cohort, block, avg(score) AS probability FROM sc GROUP BY ALL)
SELECT cohort, block, round(any_value(probability), 6) AS probability, round(avg(s), 6) AS counts, count(*) AS n FROM c JOIN p USING (cohort, block) GROUP BY cohort, block""")
def q_counts_vs_probability(spark, sf_dir):
    """The two scales of a learning curve: mean of all cells, and mean of the subjects' sums."""
    return rounded(scores.block_curve(views.scores(spark, sf_dir), ["cohort", "block"], "subject", "score"), "probability", "counts")


@query()
def q_bootstrap_ci(spark, sf_dir):
    """Bootstrap intervals of the subjects' block totals by cohort and block."""
    return rounded(stats.bootstrap_ci(views.blocks(spark, sf_dir), ["cohort", "block"], "total", 2000), "mean", "low", "high")


@query(f"""WITH {BLOCKS_SQL} SELECT cohort, block, round(avg(total), 6) AS mean, count(*) AS n FROM b WHERE cohort IN ('TC', 'TP') GROUP BY ALL""")
def q_block_pooled(spark, sf_dir):
    """Block totals of each subject, pooled by cohort."""
    return rounded(views.blocks(spark, sf_dir).where(F.col("cohort").isin("TC", "TP")).groupBy("cohort", "block").agg(F.avg("total").alias("mean"), F.count("*").alias("n")), "mean")


@query(f"""WITH {SCORES_SQL} SELECT CASE WHEN subject % 3 = 0 THEN 'short' WHEN subject % 3 = 1 THEN 'long' END AS paradigm, block, count(DISTINCT subject) AS n, round(sum(score) / count(DISTINCT subject), 6) AS mean
FROM sc WHERE subject % 3 < 2 AND score IS NOT NULL GROUP BY ALL""")
def q_paradigm_curve(spark, sf_dir):
    """Learning curves of paradigms, each of which pools some cohorts."""
    rows = views.scores(spark, sf_dir).withColumn("paradigm", F.try_element_at(F.create_map(F.lit(0), F.lit("short"), F.lit(1), F.lit("long")), (F.col("subject") % 3).cast("int")))
    return rounded(scores.block_curve(rows.where("paradigm IS NOT NULL"), ["paradigm", "block"], "subject", "score").select("paradigm", "block", "n", F.col("counts").alias("mean")), "mean")


@query(f"WITH {SCORES_SQL} SELECT behavior, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, min(score) AS min, median(score) AS median, max(score) AS max FROM sc GROUP BY ALL")
def q_described(spark, sf_dir):
    """The usual figures of each behaviour's scores."""
    return rounded(stats.described(views.scores(spark, sf_dir), ["behavior"], "score"), "mean", "sd")


@query(f"WITH {SCORES_SQL} SELECT behavior, count(DISTINCT (troupe, worm)) AS n_subjects, count(DISTINCT subject) AS n_runs FROM sc WHERE score IS NOT NULL GROUP BY ALL")
def q_distinct_individuals(spark, sf_dir):
    """Subjects with a score at least, by behaviour."""
    rows = views.scores(spark, sf_dir).where("score IS NOT NULL")
    return rows.groupBy("behavior").agg(F.count_distinct("troupe", "worm").alias("n_subjects"), F.count_distinct("subject").alias("n_runs"))


@query(f"WITH {SCORES_SQL} SELECT coalesce(cohort, 'All (Pooled)') AS cohort, day, round(avg(score), 6) AS mean, count(score) AS n FROM sc GROUP BY GROUPING SETS ((cohort, day), (day))")
def q_grouping_pooled(spark, sf_dir):
    """Means by day of each cohort and of all together."""
    rows = views.scores(spark, sf_dir)
    pooled = rows.groupingSets([["cohort", "day"], ["day"]], "cohort", "day").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    return rounded(pooled.withColumn("cohort", F.coalesce("cohort", F.lit("All (Pooled)"))), "mean")


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT cohort, subject, {", ".join(f"sum(total) FILTER (block = {k}) AS b{k}" for k in range(1, 6))} FROM b GROUP BY ALL)
SELECT *, (coalesce(b1, 0) + coalesce(b2, 0) + coalesce(b3, 0)) / nullif((b1 IS NOT NULL)::INTEGER + (b2 IS NOT NULL)::INTEGER + (b3 IS NOT NULL)::INTEGER, 0) AS early FROM w""".replace("SELECT *, (", "SELECT * , round((").replace(", 0) AS early", ", 0), 6) AS early"))
def q_rank_and_row_mean(spark, sf_dir):
    """Blocks as columns, and the mean over the early ones that are there."""
    wide = reshape.to_wide(views.blocks(spark, sf_dir), ["cohort", "subject"], "block", "total", [1, 2, 3, 4, 5], "b{}")
    return rounded(wide.withColumn("early", arrays.mean_of_present("b1", "b2", "b3")), "early")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS worm FROM orders)
SELECT o_custkey, max(o_totalprice) FILTER (worm = 1) AS W1_KL, max(o_totalprice) FILTER (worm = 2) AS W2_KL, max(o_totalprice) FILTER (worm = 3) AS W3_KL FROM o WHERE worm <= 3 GROUP BY o_custkey""")
def q_rank_in_session(spark, sf_dir):
    """Subjects numbered by their place in a session, as one wide row."""
    from kestrel.plans.registry import table

    ranked = reshape.rank_in(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "worm").where("worm <= 3")
    return reshape.to_wide(ranked, ["o_custkey"], "worm", "o_totalprice", [1, 2, 3], "W{}_KL")


@query("SELECT o_custkey, p.name[1:2] AS worm, p.metric AS metric, p.value AS value FROM (SELECT o_custkey, unnest([{'name': 'W1_price', 'metric': 'price', 'value': max(o_totalprice)}, {'name': 'W1_n', 'metric': 'n', 'value': count(*)::DOUBLE}, {'name': 'W2_price', 'metric': 'price', 'value': min(o_totalprice)}]) AS p FROM orders GROUP BY o_custkey)")
def q_melt_split(spark, sf_dir):
    """Wide columns as rows, the name split at its first separator."""
    from kestrel.plans.registry import table

    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("W1_price"), F.count("*").cast("double").alias("W1_n"), F.min("o_totalprice").alias("W2_price"))
    return reshape.split_name(reshape.to_long(wide, ["o_custkey"], ["W1_price", "W1_n", "W2_price"]), "name", "worm", "metric").drop("name")


@query("""SELECT l_orderkey, min_by(l_quantity, l_linenumber) FILTER (l_returnflag = 'A' AND l_tax > 0) AS A, min_by(l_quantity, l_linenumber) FILTER (l_returnflag = 'N' AND l_tax > 0) AS N, min_by(l_quantity, l_linenumber) FILTER (l_returnflag = 'R' AND l_tax > 0) AS R FROM (SELECT l_orderkey, l_returnflag, l_tax, l_quantity, (l_linenumber, l_quantity) AS l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def q_pivot_first(spark, sf_dir):
    """Rows as columns, the first value in the rows' order that is not missing."""
    from kestrel.plans.registry import table

    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "IF(l_tax > 0, l_quantity, NULL) AS q")
    return reshape.to_wide(rows, ["l_orderkey"], "l_returnflag", "q", ["A", "N", "R"], order="l_linenumber")


@query("SELECT o_custkey, max(o_totalprice) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY o_custkey")
def q_melt_pivot_roundtrip(spark, sf_dir):
    """Columns to rows and back."""
    from kestrel.plans.registry import table

    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"))
    return reshape.to_wide(reshape.to_long(wide, ["o_custkey"], ["price", "n"]), ["o_custkey"], "name", "value", ["price", "n"])


@query(f"""WITH {BLOCKS_SQL} SELECT cohort, subject, list(total ORDER BY block) AS totals FROM b GROUP BY ALL HAVING count(*) = 5""")
def q_subject_matrix(spark, sf_dir):
    """Each subject's totals in the order of blocks, for those with all blocks."""
    return scores.trajectories(views.blocks(spark, sf_dir), ["cohort", "subject"], "block", "total", 5)


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT subject, max(total) FILTER (block = 1) AS d1, max(total) FILTER (block = 2) AS d2 FROM b GROUP BY subject) SELECT * FROM w WHERE d1 IS NOT NULL AND d2 IS NOT NULL""")
def q_pivot_days(spark, sf_dir):
    """Two days as columns, subjects that lack one left out."""
    return reshape.to_wide(views.blocks(spark, sf_dir), ["subject"], "block", "total", [1, 2], "d{}").na.drop()


@query(f"""WITH {SCORES_SQL}, w AS (SELECT subject, day, avg(score) AS m FROM sc GROUP BY ALL) SELECT day, round(avg(m), 6) AS grand_mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS n FROM w GROUP BY day""")
def q_phenotype_means(spark, sf_dir):
    """Mean over subjects of their daily means."""
    daily = views.scores(spark, sf_dir).groupBy("subject", "day").agg(F.avg("score").alias("m"))
    return rounded(stats.mean_sem(daily, ["day"], "m").select("day", F.col("mean").alias("grand_mean"), "sem", "n"), "grand_mean", "sem")


@query(f"""WITH {SCORES_SQL}, w AS (SELECT troupe, subject, sum(coalesce(score, 0)) AS total FROM sc GROUP BY ALL) SELECT troupe, subject, total, row_number() OVER (PARTITION BY troupe ORDER BY total, subject)::INTEGER AS place FROM w""")
def q_position_by_score(spark, sf_dir):
    """Subjects in the order of their totals within a troupe."""
    totals = views.scores(spark, sf_dir).groupBy("troupe", "subject").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    return reshape.rank_in(totals, ["troupe"], [F.col("total"), F.col("subject")], "place")


@query(f"WITH {SCORES_SQL} SELECT troupe, worm, day, trial, trial + 21 * (day - 1) AS abs_trial, count(*) AS n FROM sc GROUP BY ALL")
def q_abs_trial(spark, sf_dir):
    """Trials numbered on over the days."""
    return scores.absolute_trial(views.scores(spark, sf_dir), 21).groupBy("troupe", "worm", "day", "trial", "abs_trial").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES_SQL}, m AS (SELECT subject, avg(score) AS m FROM sc GROUP BY subject), k AS (SELECT subject FROM m ORDER BY m DESC NULLS LAST, subject LIMIT (SELECT greatest(1, floor(count(*) * 0.33))::INTEGER FROM m))
SELECT subject, block, round(avg(score), 6) AS mean FROM sc SEMI JOIN k USING (subject) GROUP BY ALL""")
def q_top_fraction(spark, sf_dir):
    """Block means of the third of subjects that respond most."""
    top = reshape.top_fraction(views.scores(spark, sf_dir), "subject", "score", 0.33)
    return rounded(top.groupBy("subject", "block").agg(F.avg("score").alias("mean")), "mean")


@query(f"""WITH {SCORES_SQL} SELECT troupe, worm, block, sum(CASE WHEN troupe = 'R' AND worm = 'W6' THEN NULL ELSE score END) AS total FROM sc GROUP BY ALL""")
def q_conditional_null(spark, sf_dir):
    """A subject's scores set to missing by a correction."""
    rows = views.scores(spark, sf_dir).withColumn("score", F.when(~((F.col("troupe") == "R") & (F.col("worm") == "W6")), F.col("score")))
    return rows.groupBy("troupe", "worm", "block").agg(F.sum("score").alias("total"))


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT subject FROM b GROUP BY subject HAVING count(DISTINCT block) = 5) SELECT cohort, count(DISTINCT subject) AS n, round(avg(total), 6) AS mean FROM b SEMI JOIN f USING (subject) GROUP BY cohort""")
def q_full_blocks(spark, sf_dir):
    """Only subjects with all blocks."""
    rows = scores.with_all_blocks(views.blocks(spark, sf_dir), ["subject"], "block", 5)
    return rounded(rows.groupBy("cohort").agg(F.count_distinct("subject").alias("n"), F.avg("total").alias("mean")), "mean")


@query(f"""WITH {BLOCKS_SQL}, k AS (SELECT cohort, subject, regr_slope(total, block) AS s FROM b GROUP BY ALL HAVING count(*) >= 2), v AS (SELECT cohort, CASE WHEN s > 50 THEN 'up' WHEN s < -50 THEN 'down' ELSE 'flat' END AS verdict FROM k) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def q_verdict_tally(spark, sf_dir):
    """How many subjects rise, fall or stay. A slope of the bound itself stays: moments merged in another
    order differ in the last digits, which must not decide."""
    slopes = rounded(stats.slopes(views.blocks(spark, sf_dir), ["cohort", "subject"], "block", "total"), "slope", digits=9)
    return stats.tally(slopes.withColumn("verdict", F.when(F.col("slope") > 50, "up").when(F.col("slope") < -50, "down").otherwise("flat")), "verdict")


@query(f"""WITH {SCORES_SQL} SELECT troupe, block, string_agg(worm || ': day ' || day, '; ' ORDER BY day, worm, subject) AS notes FROM (SELECT DISTINCT troupe, block, worm, day, subject FROM sc) GROUP BY ALL""")
def q_notes_concat(spark, sf_dir):
    """Notes of each cell, in order."""
    rows = views.scores(spark, sf_dir).select("troupe", "block", "worm", "day", "subject").distinct()
    rows = rows.withColumn("pos", F.struct("day", "worm", "subject"))
    return reshape.notes_joined(rows, ["troupe", "block"], "pos", F.concat("worm", F.lit(": day "), F.col("day").cast("string")))


@query(f"""WITH {SCORES_SQL}, t AS (SELECT DISTINCT troupe, block, trial FROM sc), v AS (SELECT troupe, block, trial, {", ".join(f"sum(score) FILTER (worm = 'W{k}') AS W{k}" for k in range(1, 7))} FROM sc GROUP BY ALL)
SELECT t.troupe, t.block, t.trial, {", ".join(f"coalesce(v.W{k}, -1.0) AS W{k}" for k in range(1, 7))} FROM t LEFT JOIN v USING (troupe, block, trial)""")
def q_template_update(spark, sf_dir):
    """An empty sheet filled with the scores that there are."""
    rows = views.scores(spark, sf_dir)
    template = rows.select("troupe", "block", "trial").distinct().withColumns({f"W{k}": F.lit(-1.0) for k in range(1, 7)})
    worms = [f"W{k}" for k in range(1, 7)]
    cells = rows.groupBy("troupe", "block", "trial", "worm").agg(F.sum("score").alias("s"))
    values = reshape.to_wide(cells, ["troupe", "block", "trial"], "worm", "s", worms)
    return reshape.updated(template, values, ["troupe", "block", "trial"], worms)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN NULLIF(o_orderstatus, '') END AS run FROM orders)
SELECT o_custkey, o_orderkey, last_value(run IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM r""")
def q_fill_keys(spark, sf_dir):
    """Keys that stand on the first row only, filled down."""
    from kestrel.functions import text
    from kestrel.plans.registry import table

    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, text.null_if_blank("o_orderstatus")).alias("run"))
    return reshape.filled_down(rows, ["o_custkey"], "o_orderkey", ["run"])


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT cohort, block, avg(total) AS m, stddev_samp(total) / sqrt(count(*)) AS e, count(*) AS n FROM b GROUP BY ALL) SELECT cohort, block, n, round(m - e, 6) AS low, round(m, 6) AS mean, round(m + e, 6) AS high FROM d""")
def q_curve_band(spark, sf_dir):
    """A learning curve with its band of one standard error."""
    out = stats.mean_sem(views.blocks(spark, sf_dir), ["cohort", "block"], "total", single=0.0)
    return rounded(out.withColumns({"low": F.col("mean") - F.col("sem"), "high": F.col("mean") + F.col("sem")}), "low", "mean", "high").drop("sd", "sem")


@query(f"""WITH {BLOCKS_SQL} SELECT subject, block, total, total - lag(total) OVER (PARTITION BY subject ORDER BY block) AS change FROM b""")
def q_trace_changes(spark, sf_dir):
    """Each subject's trace with the change from block to block."""
    return views.blocks(spark, sf_dir).select("subject", "block", "total", (F.col("total") - F.lag("total").over(W.partitionBy("subject").orderBy("block"))).alias("change"))
