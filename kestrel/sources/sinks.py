"""Writers: tables by key, upserts, append logs and reports."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import reshape


def parquet(df: DataFrame, path: str, by: list[str] = (), mode: str = "overwrite") -> None:
    """Parquet, in a folder for each value of the partition columns; rows of a value meet in few
    files, and Spark splits the values that are too large for one."""
    out = df.hint("rebalance", *by) if by else df
    out.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in each file, so that appended files (mode "append") read as one table."""
    df.write.mode(mode).option("header", True).csv(path)


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A line of JSON for each row, nested columns as they are."""
    df.write.mode(mode).json(path)


def snapshot(df: DataFrame, folder: str, name: str, stamp: str) -> str:
    """Writes df under a name that carries the stamp; returns the path."""
    path = f"{folder.rstrip('/')}/{name}_{stamp}"
    parquet(df, path, mode="errorifexists")
    return path


def created(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, made empty under the schema if there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def lookup_records(df: DataFrame, stamp: str) -> DataFrame:
    """Rows for the table of anonymous names (tables.LOOKUP) from anonymous_name, original_file,
    box_coordinates, trial_number and trial_frames: date and kind of the session come from the
    file's name. append() adds them."""
    parts = F.split("original_file", "_")
    return df.select(
        "anonymous_name", "original_file", "box_coordinates", "trial_number", "trial_frames", F.concat_ws("_", F.slice(parts, 1, 3)).alias("session_date"),
        F.element_at(parts, -1).alias("trial_type"), F.lit(stamp).alias("timestamp_created"),
    )


def upsert(new: DataFrame, path: str, keys: list[str], version: int) -> str:
    """Writes the table `path`/v<version - 1> with new rows in place of those with equal keys as
    `path`/v<version>. A version is never written over, so a task that is lost or a job that is
    run again finds its input whole."""
    spark = new.sparkSession
    if version:
        new = reshape.upserted(spark.read.parquet(f"{path}/v{version - 1}"), new, keys)
    new.write.mode("overwrite").parquet(f"{path}/v{version}")
    return f"{path}/v{version}"


def nested(df: DataFrame, keys: list[str], name: str = "result") -> DataFrame:
    """keys and the other columns as one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))


def arrays(df: DataFrame, folder: str, file: str, order: str, values: str, key: str | None = None, shape: tuple[int, ...] = (), transposed: bool = False, dtype: str = "f8") -> int:
    """Writes a NumPy file for each value of the column `file`: the arrays of `values` stacked in the order
    of `order`, each in the given shape; with a key as that member of an archive. Returns how many
    files there are. A file's rows meet in one task; one that is repeated writes the same file."""
    from pyarrow import fs

    def save(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        data = np.array([np.asarray(v, float).reshape(shape or -1) for v in group["values"]]).astype(dtype)
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where)
        with system.open_output_stream(f"{where}/{group['file'].iloc[0]}") as out:
            data = np.ascontiguousarray(data.T) if transposed else data
            held = io.BytesIO()
            np.savez_compressed(held, **{key: data}) if key else np.save(held, data)
            out.write(held.getvalue())
        return pd.DataFrame({"file": [group["file"].iloc[0]]})

    rows = df.select(F.col(file).alias("file"), F.col(order).alias("at"), F.col(values).alias("values"))
    return rows.groupBy("file").applyInPandas(save, "file string").count()


def pickled(df: DataFrame, folder: str, file: str, order: str, values: str, by: str | None = None) -> int:
    """Writes side files as other tools of the experiment do, one for each value of the column `file`: a pickle of
    a tuple with the stacked arrays, or with `by` a .npy file of a dict from its values to the
    stacked arrays of each. Returns how many files there are. A file's rows meet in one task."""
    import pickle

    from pyarrow import fs

    def save(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        held = io.BytesIO()
        stack = lambda rows: np.array([np.asarray(v, float) for v in rows["values"]])
        if by:
            np.save(held, {int(k): stack(rows) for k, rows in group.groupby("by")}, allow_pickle=True)
        else:
            pickle.dump((stack(group), {"n": len(group)}), held)
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where)
        with system.open_output_stream(f"{where}/{group['file'].iloc[0]}") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"file": [group["file"].iloc[0]]})

    rows = df.select(F.col(file).alias("file"), F.col(order).alias("at"), F.col(values).alias("values"), (F.col(by) if by else F.lit(0)).alias("by"))
    return rows.groupBy("file").applyInPandas(save, "file string").count()
