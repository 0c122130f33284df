"""Principal components of array columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.arrays import l1_normalized


class Space:
    """A reference space: mean and population deviation of each element, and components whose
    largest loading in magnitude is positive."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, components: np.ndarray, explained: np.ndarray):
        self.mean, self.deviation, self.components, self.explained = mean, deviation, components, explained

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the space as a small table, a row for each vector."""
        rows = [("mean", 0, self.mean), ("deviation", 0, self.deviation), ("explained", 0, self.explained), *(("component", k, c) for k, c in enumerate(self.components))]
        made = spark.createDataFrame([(name, k, v.tolist()) for name, k, v in rows], "name string, place int, vector array<double>")
        made.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Space:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.name, r.place))
        one = {r.name: np.array(r.vector) for r in rows}
        return Space(one["mean"], one["deviation"], np.array([r.vector for r in rows if r.name == "component"]), one["explained"])


def reference_space(df: DataFrame, column: str, k: int) -> Space:
    """The first k principal components of the L1-normalised, centred and scaled arrays. Null
    elements count as 0, null arrays are left out. Only moments and the components, of the
    arrays' length, reach the driver."""
    rows = df.where(F.col(column).isNotNull()).select(array_to_vector(l1_normalized(F.transform(column, lambda x: x.cast("double")))).alias("v"))
    m = rows.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    n = m["count"]
    mean, deviation = m["mean"].toArray(), np.sqrt(m["variance"].toArray() * (n - 1) / n)
    deviation[deviation == 0] = 1.0
    scaled = _scaled(rows, mean, deviation)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    components = model.pc.toArray().T
    signs = np.sign(components[np.arange(k), np.abs(components).argmax(1)])
    return Space(mean, deviation, components * signs[:, None], model.explainedVariance.toArray())


def _scaled(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    centre = F.array(*map(F.lit, mean.tolist()))
    scale = F.array(*map(F.lit, deviation.tolist()))
    z = F.transform(F.arrays_zip(vector_to_array("v").alias("v"), centre.alias("m"), scale.alias("d")), lambda x: (x["v"] - x["m"]) / x["d"])
    return rows.withColumn("z", array_to_vector(z))


def projected(df: DataFrame, column: str, space: Space, out: str = "pc") -> DataFrame:
    """df with an array of its components: arrays are L1-normalised, then centred and scaled by
    the space's moments. A null array gives null."""
    values = l1_normalized(F.transform(column, lambda x: x.cast("double")))
    loads = [F.array(*map(F.lit, row.tolist())) for row in space.components / space.deviation]
    shift = (space.components / space.deviation) @ space.mean
    made = [F.aggregate(F.zip_with(values, load, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - float(c) for load, c in zip(loads, shift)]
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.array(*made)))
