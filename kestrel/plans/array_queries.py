"""Queries of arrays, shapes and images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kestrel.functions import arrays
from kestrel.operators import shapes
from kestrel.plans.registry import query, rounded, table


@query("WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(list_transform(e, lambda y: abs(y))), 6)) AS e FROM a")
def q_l1_normalize(spark, sf_dir):
    """Arrays over the sum of their magnitudes; what is rounded to zero keeps its sign, as in SQL."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(arrays.l1_normalized(values), lambda x: F.signum(x) * F.round(F.abs(x), 6)).alias("e"))


@query("WITH a AS (SELECT vec_id, embedding AS e, list_position(embedding, list_max(embedding))::INTEGER AS k FROM embeddings) SELECT vec_id, list_concat(e[k:], e[1:k - 1]) AS e FROM a")
def q_roll_to_max(spark, sf_dir):
    """Arrays turned to begin at their largest element."""
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.rolled_to_max(F.col("embedding")).alias("e"))


@query("SELECT vec_id, list_transform(range(0, 10), lambda i: embedding[1 + floor(i * (len(embedding) - 1) / 9.0)::INTEGER]) AS e FROM embeddings")
def q_resample(spark, sf_dir):
    """Ten elements at even steps."""
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.resampled(F.col("embedding"), 10).alias("e"))


@query("""WITH p AS (SELECT vec_id, unnest(list_transform(range(1, 33), lambda i: {'x': embedding[i]::DOUBLE, 'y': embedding[i + 32]::DOUBLE})) AS p FROM embeddings) SELECT a.vec_id, round(max(sqrt((a.p.x - b.p.x) ** 2 + (a.p.y - b.p.y) ** 2)), 6) AS span FROM p a JOIN p b USING (vec_id) GROUP BY a.vec_id""")
def q_max_distance(spark, sf_dir):
    """The largest distance between two points of an outline."""
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i).cast("double").alias("x"), F.get("embedding", i + 32).cast("double").alias("y")))
    return rounded(table(spark, sf_dir, "embeddings").withColumn("points", points).select("vec_id", arrays.largest_distance(F.col("points")).alias("span")), "span")


@query("""WITH p AS (SELECT vec_id, list_transform(range(1, 33), lambda i: sqrt((embedding[i]::DOUBLE * 10 - 1) ** 2 + (embedding[i + 32]::DOUBLE * 10 - 2) ** 2)) AS d FROM embeddings), r AS (SELECT vec_id, list_transform(range(0, 20), lambda i: d[1 + floor(i * 31 / 19.0)::INTEGER]) AS e FROM p),
k AS (SELECT vec_id, e, list_position(e, list_max(e))::INTEGER AS k FROM r) SELECT vec_id, list_transform(list_concat(e[k:], e[1:k - 1]), lambda x: round(x, 6)) AS wheel FROM k""")
def q_radial_profile(spark, sf_dir):
    """Distances of an outline from its centre, from the farthest point on."""
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.get("embedding", i).cast("double") * 10).alias("x"), (F.get("embedding", i + 32).cast("double") * 10).alias("y")))
    rows = table(spark, sf_dir, "embeddings").withColumn("points", points)
    return rows.select("vec_id", F.transform(arrays.radial_profile(F.col("points"), F.lit(1), F.lit(2), 20), lambda x: F.round(x, 6)).alias("wheel"))


#: The mean, and five turns, of 64 values: the weight of a value so many places away.
_KERNEL = [(1 + 2 * sum(math.cos(2 * math.pi * k * d / 64) for k in range(1, 6))) / 64 for d in range(64)]


@query(f"""WITH k AS (SELECT {_KERNEL} AS w) SELECT vec_id, list_transform(range(0, 64), lambda n: round(list_sum(list_transform(range(0, 64), lambda m: embedding[m + 1]::DOUBLE * w[(n - m + 64) % 64 + 1])), 6) + 0.0) AS e FROM embeddings, k""")
def q_lowpass(spark, sf_dir):
    """Arrays without their higher frequencies."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(arrays.lowpass(values, F.lit(5)), lambda x: F.round(x, 6) + F.lit(0.0)).alias("e"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 10 AS p, p_size + 5.0 AS h FROM part) SELECT p_partkey, round(a / nullif(p, 0), 6) AS area_perimeter_ratio, round(4 * pi() * a / nullif(p * p, 0), 6) AS circularity, round((h - a) / nullif(h, 0), 6) AS concavity FROM p""")
def q_shape_ratios(spark, sf_dir):
    """Ratios of area, perimeter and hull."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS area", "p_retailprice / 10 AS perimeter", "p_size + 5.0D AS hull_area")
    return rounded(shapes.ratio_columns(rows), "area_perimeter_ratio", "circularity", "concavity").select("p_partkey", "area_perimeter_ratio", "circularity", "concavity")


@query("""WITH b AS (SELECT p_partkey, (p_partkey % 300 - 20)::INTEGER AS a, (p_partkey % 70)::INTEGER AS b, (p_size * 5)::INTEGER AS c, (p_partkey % 250)::INTEGER AS d FROM part) SELECT p_partkey, greatest(0, least(least(a, c), 200)) AS x1, greatest(0, least(least(b, d), 100)) AS y1, greatest(0, least(greatest(a, c), 200)) AS x2, greatest(0, least(greatest(b, d), 100)) AS y2 FROM b""")
def q_boxes(spark, sf_dir):
    """Boxes with their corners in order, inside the image."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 300 - 20 AS INT) AS a", "CAST(p_partkey % 70 AS INT) AS b", "CAST(p_size * 5 AS INT) AS c", "CAST(p_partkey % 250 AS INT) AS d")
    return rows.select("p_partkey", shapes.clipped_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 200, 100).alias("box")).select("p_partkey", "box.*")


def _masks(spark, sf_dir, on: str = "01"):
    """Masks of 16 by 16 pixels, a rectangle in each."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 10 AS INT) AS x", "CAST(p_size % 11 AS INT) AS y", "16 AS height", "16 AS width")
    # A small file's few tasks would draw and measure all masks.
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    clear = lambda n: F.repeat(F.lit("00"), n)
    line = F.concat(clear(F.col("x")), F.lit(on * 5), clear(11 - F.col("x")))
    drawn = F.concat(clear(16 * F.col("y")), F.repeat(line, F.lit(4)), clear(16 * (12 - F.col("y"))))
    return rows.withColumn("mask", F.unhex(F.coalesce(drawn, clear(F.lit(256)))))


@query("""SELECT p_partkey, 20.0::DOUBLE AS area, 7.8125::DOUBLE AS area_percentage, 14.0::DOUBLE AS perimeter, (p_partkey % 10 + 2)::DOUBLE AS centroid_x, (p_size % 11 + 1.5)::DOUBLE AS centroid_y, 0.0::DOUBLE AS orientation_angle, 12.0::DOUBLE AS hull_area FROM part""")
def q_mask_measures(spark, sf_dir):
    """Area, outline, centre, axis and hull of masks (here rectangles of 5 by 4)."""
    return rounded(shapes.shape_measures(_masks(spark, sf_dir), ["p_partkey"], "mask", "height", "width").drop("contour"), "area_percentage", "orientation_angle")


@query("""WITH m AS (SELECT (p_partkey % 3)::INTEGER AS kind, (p_partkey % 10)::INTEGER AS x, (p_size % 11)::INTEGER AS y FROM part), i AS (SELECT unnest(range(256)) AS i), p AS (SELECT kind, i, count(*) AS n, sum(CASE WHEN i % 16 >= x AND i % 16 < x + 5 AND i // 16 >= y AND i // 16 < y + 4 THEN 255 ELSE 0 END)::BIGINT AS total FROM m, i GROUP BY ALL)
SELECT kind, any_value(n) AS n, string_agg(printf('%02X', total // n), '' ORDER BY i) AS image FROM p GROUP BY kind""")
def q_mean_image(spark, sf_dir):
    """The mean of the masks of each kind, by pixel."""
    rows = _masks(spark, sf_dir, "FF").withColumn("kind", (F.col("p_partkey") % 3).cast("int"))
    return shapes.mean_image(rows, ["kind"], "mask").select("kind", "n", F.hex("image").alias("image"))
