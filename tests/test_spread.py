"""Work that is more than its rows' bytes is spread over tasks, with results unchanged."""

import numpy as np
from pyspark.sql import functions as F

from kestrel.functions import arrays
from kestrel.operators import reshape, shapes
from kestrel.plans import array_queries


def plan(df):
    return df._jdf.queryExecution().toString()


def test_long_notes_are_joined_by_ranges(spark):
    """No list of all of a cell's notes; null, blank and equal ones and a null key included."""
    rows = [(k, (i * 7919) % 1000 // 3, None if i % 11 == 0 else " " if i % 13 == 0 else f"n{i % 5}") for k in ("a", None, "b") for i in range(1000)]
    out = reshape.notes_joined(spark.createDataFrame(rows, "k string, pos int, n string").repartition(5), ["k"], "pos", F.col("n"))
    want = {k: "; ".join(n for _, n in sorted((p, n) for key, p, n in rows if key == k and n and n.strip())) for k in ("a", None, "b")}
    assert {r.k: r.notes for r in out.collect()} == want
    assert "rangepartitioning" in plan(out).lower()


def test_masks_of_a_small_file_are_drawn_in_many_tasks(spark):
    masks = array_queries._masks(spark, "/root/testdata/sf0.001")
    for rows in (masks, shapes.shape_measures(masks, ["p_partkey"], "mask", "height", "width")):
        assert rows.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    for r in masks.limit(50).join(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey").collect():
        want = np.zeros((16, 16), np.uint8)
        want[r.p_size % 11 : r.p_size % 11 + 4, r.p_partkey % 10 : r.p_partkey % 10 + 5] = 1
        assert r.mask == want.tobytes()


def test_equal_masks_of_other_sizes_are_told_apart(spark):
    """Masks are measured once by their bytes and both sizes; a second component still counts."""
    bits = bytes([0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0])
    rows = [(k, bits, h, w) for k, (h, w) in enumerate([(3, 4), (4, 3), (2, 6), (3, 4), (1, 12)] * 3)] + [(99, None, 3, 4), (98, b"", 0, 0)]
    got = {r.k: list(r)[1:] for r in shapes.shape_measures(spark.createDataFrame(rows, "k int, m binary, h int, w int").coalesce(1), ["k"], "m", "h", "w").collect()}
    for k, m, h, w in rows:
        want = shapes.measures(np.frombuffer(m, np.uint8).reshape(h, w)) if m else [None] * 8
        assert got[k][:7] == want[:7] and (not m or [tuple(p) for p in got[k][7]] == [(p["x"], p["y"]) for p in want[7]])


def test_distances_are_taken_of_numbers_not_of_structs(spark):
    """What goes to Python is arrays of numbers; points that lack a coordinate are left out."""
    rows = [(1, [(0.0, 0.0), (3.0, 4.0), (None, 99.0), (99.0, None)]), (2, [None, (1.0, 1.0)]), (3, []), (4, None), (5, [(float("nan"), 0.0)]), (6, [(0.0, 0.0), None, (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    frame = spark.createDataFrame(rows, "k int, p array<struct<x:double,y:double>>")
    got = frame.select("k", arrays.largest_distance(F.col("p")).alias("d"))
    assert {r.k: r.d for r in got.collect()} == {1: 5.0, 2: 0.0, 3: None, 4: None, 5: None, 6: 2**0.5}
    evaluated = next(line for line in plan(got).splitlines() if "ArrowEvalPython" in line)
    assert "largest_distance(p#" not in evaluated
