"""Queries of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.plans.registry import query, table
from kestrel.sources.shared import shared_dir
from kestrel.streaming import events

_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(_SQL)
def q_window_counts(spark, sf_dir):
    """Events of each hour and type, as a batch."""
    out = events.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_SQL)
def q_stream_window(spark, sf_dir):
    """The same plan as a stream, whose updates go into a table by key."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = events.windowed_counts(events.stream(spark, f"{sf_dir}/events.parquet"), "ts", ["event_type"])
    path = events.upserted(counts, f"{folder}/counts", ["window_start", "event_type"], f"{folder}/log")
    return spark.read.parquet(path).select("window_start", "event_type", "n").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
