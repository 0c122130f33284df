"""Published numbers, from small inputs written here in the published files' form."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import intervals, matching
from kestrel.sources import tables

#: The example session's light and shock times, and its trials.
LIGHTS = [(7.5936361e7, 7.5966265e7, 7.596336e7, 7.5966259e7), (7.5996391e7, 7.6026276e7, 7.6023374e7, 7.6026269e7), (7.605643e7, 7.6086145e7, 7.6083245e7, 7.6086139e7)]
TRIALS = [(1, 18, 291), (2, 618, 892), (3, 1218, 1490)]
SESSION = "2025_10_15_10_20_58_trial_1_TC"


@pytest.fixture(scope="module")
def windows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw") / SESSION
    folder.mkdir()
    lines = ["ev_stimtimes,ev_labels,white_light_on,white_light_off,UV_light_on,UV_light_off,shock_on,shock_off"]
    lines += [f"NaN,NaN,{a},{b},NaN,NaN,{c},{d}" for a, b, c, d in LIGHTS]
    (folder / "stim_extra.csv").write_text("\n".join(lines) + "\n")
    return intervals.trial_windows(tables.stimuli(spark, str(folder / "stim_extra.csv")), "TC")


def test_trial_windows(windows):
    assert sorted((r.trial_num, r.start_frame, r.end_frame) for r in windows.collect()) == TRIALS
    assert windows.first().session == SESSION


def test_frames_on_and_off(spark, windows):
    frames = spark.range(1799).selectExpr(f"'{SESSION}' AS session", "CAST(id AS INT) AS frame")
    counts = {r.cs_on: r["count"] for r in intervals.labelled(frames, windows).groupBy("cs_on").count().collect()}
    assert counts == {True: 822, False: 959, None: 18}


def marks(spark, lists):
    return spark.createDataFrame([("v", "turn", s, k, t) for s, ts in lists.items() for k, t in enumerate(ts)], "video string, event_type string, scorer string, idx int, t int")


@pytest.mark.parametrize("ref, test, want", [([10, 20], [15], (1, 0, 1)), ([10], [], (0, 0, 1)), ([], [7, 9], (0, 2, 0)), ([0, 8], [9, 18], (1, 1, 1)), ([5], [5, 5], (1, 1, 0))])
def test_matches_of_two_scorers(spark, ref, test, want):
    events = marks(spark, {"S1": ref, "S2": test})
    pairs = spark.createDataFrame([("v", "turn", "S1", "S2")], "video string, event_type string, ref string, test string")
    row = matching.matched(events, pairs, F.lit(10)).first()
    assert (row.tp, row.fp, row.fn) == want


def test_equal_distances_go_to_the_lower_place(spark):
    pairs = spark.createDataFrame([("v", "turn", "S1", "S2")], "video string, event_type string, ref string, test string")
    row = matching.matched(marks(spark, {"S1": [10, 20], "S2": [15]}), pairs, F.lit(10)).first()
    assert [(m.diff, m.test_idx, m.ref_idx) for m in row.matches] == [(5, 0, 0)]


def test_a_triplet_of_two_passing_distances_is_passed_over(spark):
    row = matching.unanimity(marks(spark, {"S1": [0], "S2": [8], "S3": [16]}), ["S1", "S2", "S3"], F.lit(10)).first()
    assert (row.s123, row.s12, row.s13, row.s23, row.total_unique) == (0, 1, 0, 0, 2)
