"""Summaries of long score sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.operators import stats


def raw_counts(df: DataFrame, keys: list[str], behaviors: list[str], behavior: str = "behavior", score: str = "score") -> DataFrame:
    """keys, a sum for each behaviour (missing scores and behaviours count as 0), and CR and UCR,
    the sums over behaviours with these prefixes. One aggregation; no pivot's second pass."""
    out = df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(behavior) == b, F.col(score))), F.lit(0.0)).alias(b) for b in behaviors])
    total = lambda prefix: sum((F.col(b) for b in behaviors if b.startswith(prefix)), F.lit(0.0))
    return out.withColumns({"CR": total("CR"), "UCR": total("UCR")})


def behavior_summary(df: DataFrame, keys: list[str], score: str, error: str = "sem") -> DataFrame:
    """keys, mean (2 digits), sem (3), n, sd (2) and error: the half width or interval asked for,
    "sem", "ci" (t interval) or "bootstrap" (percentile interval's half width). One value has
    no sem."""
    if error == "ci":
        out = stats.mean_ci(df, keys, score).withColumn("error", F.col("half_width"))
    else:
        out = stats.mean_sem(df, keys, score).withColumn("error", F.col("sem"))
    if error == "bootstrap":
        band = stats.bootstrap_ci(df, keys, score).select(*keys, ((F.col("high") - F.col("low")) / 2).alias("error"))
        out = out.drop("error").join(band, keys, "left")
    return out.select(*keys, F.round("mean", 2).alias("mean"), F.round("sem", 3).alias("sem"), "n", F.round("sd", 2).alias("sd"), F.round("error", 3).alias("error"))


def block_curve(df: DataFrame, keys: list[str], subject: str, score: str) -> DataFrame:
    """keys, probability (mean of all scores), counts (mean over subjects of their sums) and n, the
    number of subjects with a score."""
    parts = df.where(F.col(score).isNotNull()).groupBy(*keys, subject).agg(F.sum(score).alias("s"), F.count("*").alias("k"))
    return parts.groupBy(*keys).agg((F.sum("s") / F.sum("k")).alias("probability"), F.avg("s").alias("counts"), F.count("*").alias("n"))


def trajectories(df: DataFrame, keys: list[str], block: str, value: str, blocks: int) -> DataFrame:
    """keys and <value>s, an array in the order of blocks, for keys with all `blocks` of them; a
    key has one row a block, so the array is short."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col(value).alias("v"))))
    out = df.groupBy(*keys).agg(listed.alias("__l")).where(F.size("__l") == blocks)
    return out.select(*keys, F.transform("__l", lambda x: x["v"]).alias(f"{value}s"))


def with_all_blocks(df: DataFrame, keys: list[str], block: str, blocks: int) -> DataFrame:
    """df's rows of the keys that have `blocks` different blocks."""
    full = df.groupBy(*keys).agg(F.count_distinct(block).alias("__n")).where(F.col("__n") == blocks).select(*keys)
    return df.join(full, keys, "left_semi")


def absolute_trial(df: DataFrame, trials_a_day: int, day: str = "day", trial: str = "trial") -> DataFrame:
    """df with abs_trial, trials numbered on from day to day."""
    return df.withColumn("abs_trial", F.col(trial) + trials_a_day * (F.col(day) - 1))


def labels_of_blocks(df: DataFrame, labels: dict[int, list[str]], block: str = "block") -> DataFrame:
    """df with trial_num (from 1) and label, a row for each label of the row's block; blocks
    without labels are left out."""
    listed = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = df.select("*", F.posexplode(F.try_element_at(listed, F.col(block))).alias("__k", "label"))
    return rows.withColumn("trial_num", F.col("__k") + 1).drop("__k")


def checked_labels(trials: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """trials with the label of their trial_num; a key whose numbers of trials and labels differ is
    an error. labels as from labels_of_blocks()."""
    n = labels.groupBy(key).agg(F.count("*").alias("__labels"))
    counted = trials.withColumn("__trials", F.count("*").over(W.partitionBy(key))).join(n, key, "left")
    wrong = ~F.col("__trials").eqNullSafe(F.col("__labels"))
    message = F.concat(F.lit("trials and labels differ in number: "), F.col(key).cast("string"))
    checked = counted.withColumn("trial_num", F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col("trial_num")))
    return checked.drop("__trials", "__labels").join(labels.select(key, "trial_num", "label"), [key, "trial_num"], "left")


def boxes_numbered(df: DataFrame, key: str, box: str, x: str) -> DataFrame:
    """key, box and worm: the distinct boxes of each key numbered from the left, and n_boxes."""
    distinct = df.select(key, box, x).distinct()
    out = distinct.withColumn("worm", F.row_number().over(W.partitionBy(key).orderBy(x, box)))
    return out.withColumn("n_boxes", F.count("*").over(W.partitionBy(key)))
