"""The experiment's tables as views of the test tables, in Spark and as DuckDB SQL.

`events` gives frame series (a user is a subject) and scored events (sixty events are a video);
`lineitem` gives score sheets; `orders` gives sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.plans.registry import table

#: Frames of the trials of each series, and a series' shortest gap.
TRIALS = {1: (5, 14), 2: (20, 29), 3: (35, 41)}
FEATURES = ["v", "area", "angle"]

SERIES_SQL = """s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame, event_type, value,
  CASE WHEN event_type <> 'error' THEN value END AS v, 100 + value * 2 AS area, (value * 7) % 180 AS angle FROM events)"""

LABELLED_SQL = f"""{SERIES_SQL}, t AS (SELECT * FROM (VALUES (1, 5, 14), (2, 20, 29), (3, 35, 41)) x(trial_num, start_frame, end_frame)),
l AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM t WHERE s.frame BETWEEN t.start_frame AND t.end_frame) THEN true WHEN frame >= 5 THEN false END AS cs_on FROM s)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, frame (from 0), event_type, value, v (null at errors), area and angle."""
    events = table(spark, sf_dir, "events")
    frame = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame")
    rows = events.select("user_id", frame, "event_type", "value")
    return rows.withColumns({"v": F.when(F.col("event_type") != "error", F.col("value")), "area": 100 + F.col("value") * 2, "angle": (F.col("value") * 7) % 180})


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, trial_num, start_frame and end_frame: the same trials for all subjects."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    listed = F.array(*[F.struct(F.lit(n).alias("trial_num"), F.lit(a).alias("start_frame"), F.lit(b).alias("end_frame")) for n, (a, b) in TRIALS.items()])
    return users.select("user_id", F.inline(listed))


SCORES_SQL = """sc AS (SELECT l_returnflag AS troupe, month(l_shipdate)::INTEGER AS day, (1 + l_orderkey % 5)::INTEGER AS block, (1 + l_partkey % 10)::INTEGER AS trial,
  'W' || l_linenumber AS worm, CASE l_suppkey % 4 WHEN 0 THEN 'CRturn' WHEN 1 THEN 'CRcon' WHEN 2 THEN 'UCRturn' ELSE 'UCRcon' END AS behavior,
  l_suppkey AS subject, CASE WHEN l_suppkey % 2 = 0 THEN 'TC' ELSE 'TP' END AS cohort, CASE WHEN l_tax > 0 THEN l_quantity END AS score FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long score sheet; scores of untaxed items are missing."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS troupe", "month(l_shipdate) AS day", "CAST(1 + l_orderkey % 5 AS INT) AS block", "CAST(1 + l_partkey % 10 AS INT) AS trial", "concat('W', l_linenumber) AS worm",
        "element_at(array('CRturn', 'CRcon', 'UCRturn', 'UCRcon'), CAST(l_suppkey % 4 + 1 AS INT)) AS behavior",
        "l_suppkey AS subject", "IF(l_suppkey % 2 = 0, 'TC', 'TP') AS cohort", "IF(l_tax > 0, l_quantity, NULL) AS score",
    )


BLOCKS_SQL = f"{SCORES_SQL}, b AS (SELECT cohort, subject, block, sum(score) AS total, avg(score) AS mean FROM sc WHERE score IS NOT NULL GROUP BY ALL)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort, subject, block, total and mean of the scores."""
    return scores(spark, sf_dir).where("score IS NOT NULL").groupBy("cohort", "subject", "block").agg(F.sum("score").alias("total"), F.avg("score").alias("mean"))


MARKS_SQL = """m AS (SELECT 'V' || (event_id // 60) AS video, CASE WHEN event_type IN ('click', 'error') THEN 'turn' ELSE 'contraction' END AS event_type, 'S' || (1 + user_id % 3) AS scorer,
  ((event_id % 60) * 3 + user_id % 7)::INTEGER AS t, event_id FROM events),
e AS (SELECT video, event_type, scorer, (row_number() OVER (PARTITION BY video, event_type, scorer ORDER BY t, event_id) - 1)::INTEGER AS idx, t FROM m)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events: video, event_type (turn or contraction), scorer (S1 to S3), idx and t."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('V', event_id DIV 60) AS video", "IF(event_type IN ('click', 'error'), 'turn', 'contraction') AS event_type", "concat('S', 1 + user_id % 3) AS scorer",
        "CAST((event_id % 60) * 3 + user_id % 7 AS INT) AS t", "event_id",
    )
    idx = F.row_number().over(W.partitionBy("video", "event_type", "scorer").orderBy("t", "event_id")) - 1
    return rows.select("video", "event_type", "scorer", idx.alias("idx"), "t")
