"""Streams of events: window counts, duplicates, upserts and gap filling.

The functions on columns work on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrel.sources import sinks


def stream(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A stream of the Parquet files that appear in the folder at path; the path of a file is a
    stream of this file."""
    kind = spark.read.parquet(path).schema if schema is None else schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # Streams read folders only.
        path, _, name = path.rpartition("/")
        options["pathGlobFilter"] = name
    return spark.readStream.schema(kind).options(**options).parquet(path)


def windowed_counts(df: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, keys and n for each window. In a stream, state goes with the watermark, `late`
    behind the latest event, and events after that are left out."""
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        rows = rows.withWatermark(time, late)
    counts = rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "n")


def without_duplicates(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each keys; in a stream, of those within the watermark."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upserted(df: DataFrame, path: str, keys: list[str], checkpoint: str, **trigger) -> str:
    """Runs a stream in update mode into versions of a table; returns the last version's path. A
    batch that is run again after a loss writes its own version again."""

    def write(batch: DataFrame, number: int) -> None:
        sinks.upsert(batch, path, keys, number)

    query = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return f"{path}/v{query.lastProgress['batchId'] if query.lastProgress else 0}"


def gap_filled(df: DataFrame, keys: list[str], frame: str, value: str, max_gap: int = 30, timeout_ms: int | None = None) -> DataFrame:
    """keys, frame, value and filled of a stream whose rows of a key come in order of frames: gaps
    of up to max_gap frames lie on a straight line once the next value is there, longer ones are
    null. What waits is at most one gap a key; it goes out null when no row comes for timeout_ms,
    which only streams without an end can have.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", {frame} long, {value} double, filled double"
    columns = [*keys, frame, value, "filled"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known, waiting = state.get if state.exists else (None, None, [])
        waiting, out = list(waiting), []
        if state.hasTimedOut:
            out = [[*key, f, None, None] for f in waiting]
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(frame)
            for f, v in zip(rows[frame].tolist(), rows[value].tolist()):
                if v is None or v != v:
                    waiting.append(f)
                    if len(waiting) > max_gap:  # too long to fill: goes out as it is
                        out += [[*key, g, None, None] for g in waiting]
                        waiting, known = [], None
                    continue
                if waiting:
                    line = np.interp(waiting, [last, f], [known, v]).tolist() if known is not None else [v if last is None else None] * len(waiting)
                    out += [[*key, g, None, x] for g, x in zip(waiting, line)]
                out.append([*key, f, v, v])
                last, known, waiting = f, v, []
            state.update((last, known, waiting))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=columns).astype({value: float, "filled": float})

    rows = df.select(*keys, F.col(frame).cast("long").alias(frame), F.col(value).cast("double").alias(value))
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "last long, known double, waiting array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
