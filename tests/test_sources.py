"""Readers, writers and streams on small files."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.sources import sinks, tables
from kestrel.streaming import events


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_raw_video(spark, tmp_path):
    pixels = np.arange(3 * 4 * 5 + 7, dtype=np.uint8)
    (tmp_path / "a.bin").write_bytes(pixels.tobytes())
    got = rows(tables.video_frames(spark, str(tmp_path), 5, 4), "file", "frame", "pixels")
    assert [(f, k, bytes(p)) for f, k, p in got] == [("a.bin", k, pixels[k * 20 : k * 20 + 20].tobytes()) for k in range(3)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/short.bin").write_bytes(b"12")
    with pytest.raises(Exception, match="less than one frame"):
        tables.video_frames(spark, str(tmp_path / "b"), 5, 4).collect()


def test_raw_videos_are_read_by_range(spark, tmp_path):
    from kestrel.sources import ranged

    rng = np.random.default_rng(1)
    videos = {f"v{k}.raw": rng.integers(0, 256, n, np.uint8).tobytes() for k, n in enumerate((20, 999, 2000, 5019))}
    for name, data in videos.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    read = lambda **o: ranged.registered(spark).format("frames").options(width=5, height=4, **o).load(str(tmp_path))
    want = sorted((f, k, d[k * 20 : k * 20 + 20]) for f, d in videos.items() for k in range(len(d) // 20))
    df = read(range=100)
    assert df.rdd.getNumPartitions() == sum(-(-(len(d) // 20) // 5) for d in videos.values())
    assert sorted((r.file, r.frame, bytes(r.pixels)) for r in df.collect()) == want
    some = read(range=100).where("frame >= 90 and frame < 101 and file <> 'v3.raw'")
    assert sorted((r.file, r.frame, bytes(r.pixels)) for r in some.collect()) == [w for w in want if 90 <= w[1] < 101 and w[0] != "v3.raw"]
    assert some.rdd.getNumPartitions() == 2 + 3
    assert [r.frame for r in read().where("frame = 3 and file = 'v1.raw'").collect()] == [3] and read().where("frame > 10000").collect() == []


@pytest.mark.parametrize("fortran", [False, True])
@pytest.mark.parametrize("packed", [None, np.savez, np.savez_compressed])
def test_arrays_are_read_by_range(spark, tmp_path, fortran, packed):
    from kestrel.sources import ranged

    data = np.arange(700 * 12, dtype="<i2").reshape(12, 700)
    data = np.asfortranarray(data) if fortran else data
    if packed:
        packed(tmp_path / "m.npz", other=np.zeros(3), m=data)
    else:
        np.save(tmp_path / "m.npy", data)
    for axis, want in ((0, data), (1, data.T)):
        read = ranged.registered(spark).format("arrays").options(axis=axis, range=1000, key="m").load(f"{tmp_path}/m.np*")
        assert packed is np.savez_compressed or read.rdd.getNumPartitions() > 10
        got = sorted((r.at, r.values, r["shape"]) for r in read.collect())
        assert [g[1] for g in got] == want.astype(float).tolist() and got[0][2] == [want.shape[1]]
        part = read.where("at >= 5 and at < 8").collect()
        assert sorted((r.at, r.values) for r in part) == [(k, want[k].astype(float).tolist()) for k in (5, 6, 7)]


def test_pickled_objects_are_not_read(spark, tmp_path):
    from kestrel.sources import ranged

    np.save(tmp_path / "o.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="pickled"):
        ranged.registered(spark).format("arrays").load(str(tmp_path)).collect()


def test_arrays_of_features_and_masks(spark, tmp_path):
    session = "2025_10_15_10_20_58_trial_1_TC"
    data = np.arange(24.0).reshape(12, 2)
    data[3, 1] = np.nan
    np.save(tmp_path / f"{session}_regions_1_2_3_4_FINAL_Feature_vector.npy", data)
    got = tables.feature_matrices(spark, str(tmp_path / "*.npy")).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1] and got[0].session == session and got[0].region == "1_2_3_4"
    assert got[0].areas == 0.0 and got[1].pc2 == 23.0 and got[1].area_perimeter_ratios is None
    np.savez_compressed(tmp_path / "v_100_102.npz", masks=np.ones((2, 1, 3, 4), bool))
    masks = tables.masks(spark, str(tmp_path / "*.npz")).orderBy("frame").collect()
    assert [(r.frame, r.height, r.width, bytes(r.mask)) for r in masks] == [(100, 3, 4, b"\1" * 12), (101, 3, 4, b"\1" * 12)]


def test_sheets_with_odd_cells(spark, tmp_path):
    (tmp_path / "blind.csv").write_text('Video_filename,TimestampID,Number_turns,Turn_timestamps,Number_contractions,Contraction_timestamps,Notes\nVideo_A//,,2,"1,2",0,,"two\nlines"\nVideo_filename,TimestampID,Number_turns,Turn_timestamps,Number_contractions,Contraction_timestamps,Notes\nVideo_B/,,1,x,,,\n')
    got = rows(tables.blind_scores(spark, str(tmp_path / "blind.csv")), "video", "n_turns", "turns", "n_contractions", "contractions")
    assert got == [("A", 2, [1, 2], 0, []), ("B", 1, [], 0, [])]
    (tmp_path / "tidy.csv").write_text("Run,Troupe,Day,Block,Trial,CRturn_W1,CRturn_W7,Notes\nr1,t,1,1,1,2,5,\n,t,1,1,2,NA,5,\n,t,1,1,3,4,5,x\n")
    assert rows(tables.tidy_scores(spark, str(tmp_path / "tidy.csv")), "run", "trial", "behavior", "worm", "score") == [("r1", 1, "CRturn", "W1", 2.0), ("r1", 3, "CRturn", "W1", 4.0)]
    (tmp_path / "block.csv").write_text("Run,Troupe,Day,BlockNum,Trial ,W1,W2,W3,W4,W5,W6,Notes\nr,t,1,1,1,1,0,,0,0,0,\n,,,,2,0,0,1,0,0,x,\n")
    block = tables.block_scores(spark, str(tmp_path / "block.csv"))
    assert block.count() == 10 and rows(block.where("trial = 2 AND worm = 'W3'"), "run", "troupe", "block", "score") == [("r", "t", 1, 1.0)]
    (tmp_path / "pheno.csv").write_text("Run,Troupe,Day,Trial,W1,W2,W3,W4,W5,W6,Notes\n,,,,,,,,,,\nr,p,1,1,1,NA,Q,0,0,0,\nr,p,2,1,1,1,1,1,1,1,\n")
    pheno = tables.pheno_scores(spark, str(tmp_path / "pheno.csv"))
    assert rows(pheno.where("day = 1"), "worm", "score") == [("W1", 1.0), ("W2", 0.0), ("W3", 0.0), ("W4", 0.0), ("W5", 0.0), ("W6", 0.0)]
    assert {r.abs_trial for r in pheno.where("day = 2").collect()} == {22}
    (tmp_path / "splits.csv").write_text("v,[1,5],[3,9]\n\nv,[7],[8]\nw,[]\n")
    assert {r.video: [tuple(i) for i in r.intervals] for r in tables.video_splits(spark, str(tmp_path / "splits.csv")).collect()} == {"v": [(1, 3), (5, 9)], "w": [(0, 1799)]}


def test_missing_sources_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    got = tables.sources(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "no.csv")}, tables.csv)
    assert rows(got, "x", "source") == [("1", "a")]
    with pytest.raises(FileNotFoundError):
        tables.sources(spark, {"b": str(tmp_path / "no.csv")}, tables.csv)


def test_listing_and_what_is_left_to_do(spark, tmp_path):
    for folder, n in (("one", 3), ("two", 3), ("three", 1)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"{k}.jpg").write_bytes(b"x")
    (tmp_path / "two/mask.npz").write_bytes(b"x")
    found = tables.unfinished(tables.listing(spark, str(tmp_path), "*.jpg"), tables.listing(spark, str(tmp_path), "*.npz"), least=2)
    assert rows(found, "folder", "n") == [("one", 3)]
    names = spark.createDataFrame([("z",), ("trial_10_regions_1_2_3_4",), ("trial_2_regions_10_2_3_4",), ("trial_2_regions_9_2_3_4",)], "name string")
    assert [r.name for r in tables.ordered_by_numbers(names).collect()] == ["trial_2_regions_9_2_3_4", "trial_2_regions_10_2_3_4", "trial_10_regions_1_2_3_4", "z"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 2.0), ("t", 2, None)], "session string, k int, v double")
    sinks.parquet(df, str(tmp_path / "p"), ["session"])
    assert (tmp_path / "p/session=s").is_dir() and rows(spark.read.parquet(str(tmp_path / "p")), "session", "k", "v") == [("s", 1, 2.0), ("t", 2, None)]
    path = str(tmp_path / "table")
    sinks.upsert(df, path, ["session"], 0)
    last = sinks.upsert(spark.createDataFrame([("t", 3, 4.0), ("u", 4, 5.0)], df.schema), path, ["session"], 1)
    assert rows(spark.read.parquet(last), "session", "k", "v") == [("s", 1, 2.0), ("t", 3, 4.0), ("u", 4, 5.0)]
    # A version that is run again gives the same table.
    sinks.upsert(spark.createDataFrame([("t", 3, 4.0), ("u", 4, 5.0)], df.schema), path, ["session"], 1)
    assert spark.read.parquet(last).count() == 3
    empty = sinks.created(spark, str(tmp_path / "log"), "a int, b string")
    assert empty.count() == 0
    sinks.append(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "log"))
    assert sinks.created(spark, str(tmp_path / "log"), "a int, b string").count() == 1
    named = spark.createDataFrame([("Odd_Fox", "2025_10_15_10_20_58_trial_1_TC", "1_2_3_4", 1, "18-291")], "anonymous_name string, original_file string, box_coordinates string, trial_number int, trial_frames string")
    record = sinks.lookup_records(named, "2026-01-01").first()
    assert (record.session_date, record.trial_type) == ("2025_10_15", "TC") and sinks.lookup_records(named, "x").columns == [x.split()[0] for x in tables.LOOKUP.split(", ")]
    stamped = sinks.snapshot(df, str(tmp_path), "kl", "2026_01_01")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.snapshot(df, str(tmp_path), "kl", "2026_01_01")
    assert spark.read.parquet(stamped).count() == 2
    assert json.loads(sinks.nested(df, ["session"]).where("session = 's'").first().result) == {"k": 1, "v": 2.0}
    sinks.csv(df, str(tmp_path / "c"))
    sinks.json(df, str(tmp_path / "j"))
    assert tables.csv(spark, str(tmp_path / "c"), "session string, k int, v double").count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_streams_give_what_batches_give(spark, tmp_path):
    data = pd.DataFrame({"ts": pd.to_datetime([10**9 + s for s in (0, 1800, 3600, 3700, 9000)], unit="s"), "kind": list("abaab"), "id": [1, 2, 3, 3, 4]})
    (tmp_path / "in").mkdir()
    spark.createDataFrame(data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = events.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["kind"])
    stream = events.windowed_counts(events.stream(spark, str(tmp_path / "in")), "ts", ["kind"])
    path = events.upserted(stream, str(tmp_path / "out"), ["window_start", "kind"], str(tmp_path / "log"))
    assert rows(spark.read.parquet(path), "window_start", "kind", "n") == rows(batch, "window_start", "kind", "n")
    once = events.without_duplicates(events.stream(spark, str(tmp_path / "in")), "ts", ["id"])
    query = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == events.without_duplicates(spark.read.parquet(str(tmp_path / "in")), "ts", ["id"]).count() == 4


def test_stream_gap_fill(spark, tmp_path):
    data = [("a", k, v) for k, v in enumerate([0.0, None, None, 3.0, None, 5.0])] + [("b", 0, None), ("b", 1, 7.0), ("b", 2, 8.0)] + [("c", k, v) for k, v in enumerate([1.0, None, None, None, None, 2.0])]
    spark.createDataFrame(data, "s string, frame long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    filled = events.gap_filled(events.stream(spark, str(tmp_path / "in")), ["s"], "frame", "v", max_gap=3)
    query = filled.writeStream.format("memory").queryName("filled").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.s, r.frame): r.filled for r in spark.table("filled").collect()}
    assert [got["a", k] for k in range(6)] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert [got["b", k] for k in range(3)] == [7.0, 7.0, 8.0]
    assert [got["c", k] for k in range(6)] == [1.0, None, None, None, None, 2.0]
    assert spark.table("filled").where(F.col("v").isNull()).count() == 8
