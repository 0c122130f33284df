"""One test for each of the survey's hazards H1 to H21: where results differ quietly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import text
from kestrel.operators import divergence, intervals, matching, mixed, projection, reshape, scores, series, stats
from kestrel.sources import tables


def test_h1_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double").withColumn("v", text.null_if_nan("v"))
    assert df.agg(F.avg("v").alias("m")).first().m == 2.0


def gaps(spark, trials, n):
    df = spark.createDataFrame([("s", k + 1, a, b) for k, (a, b) in enumerate(trials)], "session string, trial_num int, start_frame int, end_frame int")
    found = intervals.gaps(df, spark.createDataFrame([("s", n)], "session string, n_frames int"))
    return sorted((r.start_frame, r.end_frame) for r in found.collect())


def test_h2_the_last_gap_ends_at_the_last_frame(spark):
    found = gaps(spark, [(18, 291), (618, 892), (1218, 1490)], 1799)
    assert found == [(292, 617), (893, 1217), (1491, 1798)] and sum(b - a + 1 for a, b in found) == 959


def test_h3_a_trial_that_ends_the_series_leaves_no_gap(spark):
    assert gaps(spark, [(0, 9), (20, 29)], 30) == [(10, 19)]


def test_h4_frames_before_the_first_trial(spark):
    trials = spark.createDataFrame([("s", 1, 2, 3)], "session string, trial_num int, start_frame int, end_frame int")
    frames = spark.range(5).selectExpr("'s' AS session", "CAST(id AS INT) AS frame")
    for before, want in ((False, [None, None, True, True, False]), (True, [False, False, True, True, False])):
        assert [r.cs_on for r in intervals.labelled(frames, trials, before_is_off=before).orderBy("frame").collect()] == want


def test_h5_ends_are_inclusive(spark):
    lines = spark.createDataFrame([("a,[1,5],[3,9]",), ("b,[1,5]",), ("c,[]",)], "value string")
    found = lines.select(intervals.split_intervals(text.bracketed_lists("value")).alias("i")).collect()
    assert [[tuple(x) for x in r.i] for r in found] == [[(1, 3), (5, 9)], [(1, 4), (5, 1799)], [(0, 1799)]]


def test_h6_the_day_comes_from_another_column(spark, tmp_path):
    names = "Run_Date,Start Time,Run_Name,Species,Group,Troupe,Block,Worms_Day,Block Type,Data_Folder,No. worms,Trough No.,Worm Runner"
    (tmp_path / "log.csv").write_text(names + "\n1,,,,,,1,3,,f,~18,,\n1,,,,,,1,tbd,,g,6,,\n")
    assert {(r.data_folder, r.day, r.n_worms) for r in tables.experiment_log(spark, str(tmp_path / "log.csv")).collect()} == {("f", 3, 18), ("g", None, 6)}


def test_h7_a_run_is_known_by_its_file(spark):
    lookup = spark.createDataFrame([("Fox", "run_2"), ("Fox", "run_1")], "anonymous_name string, original_file string")
    found = reshape.looked_up(spark.createDataFrame([("Fox",)], "name string"), lookup, "name", "anonymous_name", [F.col("original_file")], first=True)
    assert found.first().original_file == "run_1"


def test_h8_the_region_comes_from_the_name(spark):
    name = "2025_10_15_10_20_58_trial_1_TC_regions_712_248_930_1170_FINAL_Feature_vector.npy"
    row = spark.createDataFrame([(name,)], "n string").select(text.region_of("n").alias("r"), text.session_of("n").alias("s")).first()
    assert (row.r, row.s) == ("712_248_930_1170", "2025_10_15_10_20_58_trial_1_TC")


def test_h9_angles_keep_their_own_filling(spark):
    df = spark.createDataFrame([(1, 0, 170.0, 1.0), (1, 1, None, None), (1, 2, 10.0, 3.0)], "s int, frame int, a double, v double")
    row = series.features_filled(df, ["s"], "frame", ["a", "v"], ("a",)).where("frame = 1").first()
    assert (row.a % 180, row.v) == (0.0, 2.0)


def test_h10_skew_and_kurtosis_are_corrected_for_bias(spark):
    got = stats.shape(spark.createDataFrame([("k", v) for v in (1.0, 2.0, 3.0, 7.0)], "k string, v double"), ["k"], "v").first()
    x = np.array([1.0, 2.0, 3.0, 7.0]) - 3.25
    g1, g2 = (x**3).mean() / (x**2).mean() ** 1.5, (x**4).mean() / (x**2).mean() ** 2 - 3
    assert got.skew == pytest.approx(g1 * math.sqrt(12) / 2) and got.kurtosis == pytest.approx((5 * g2 + 6) * 3 / 2)


def test_h11_and_h13_macro_pools_and_micro_averages(spark):
    counts = spark.createDataFrame([("v", "turn", "A", "B", 1, 0, 0), ("w", "turn", "A", "B", 0, 3, 3)], "video string, event_type string, ref string, test string, tp int, fp int, fn int")
    got = {r.kind: r for r in matching.f1_both(counts).collect()}
    assert got["macro"].f1 == pytest.approx(0.25) and got["micro"].f1 == pytest.approx(0.5)
    # The two published tables have their names swapped; here the kind stands in each row.
    assert set(got) == {"macro", "micro"}


def test_h12_names_lose_all_marks(spark):
    df = spark.createDataFrame([("Video_A_Video_B//",)], "n string")
    assert df.select(text.video_key("n").alias("k")).first().k == "A_B"


def test_h14_one_active_scorer_gives_no_row(spark):
    events = spark.createDataFrame([("v", "turn", "S1", 0, 5), ("w", "turn", "S1", 0, 5), ("w", "turn", "S2", 0, 90)], "video string, event_type string, scorer string, idx int, t int")
    rows = matching.unanimity(events, ["S1", "S2", "S3"], F.lit(10)).collect()
    assert [(r.video, r.s123, r.total_unique) for r in rows] == [("w", 0, 2)]


def test_h15_projection_centres_and_scales_by_population(spark):
    data = np.random.default_rng(5).random((60, 4))
    df = spark.createDataFrame([(x.tolist(),) for x in data], "e array<double>")
    space = projection.reference_space(df, "e", 2)
    z = data / data.sum(1, keepdims=True)
    assert space.mean == pytest.approx(z.mean(0)) and space.deviation == pytest.approx(z.std(0))
    got = np.array([r.pc for r in projection.projected(df, "e", space).collect()])
    assert got.mean(0) == pytest.approx([0, 0], abs=1e-9) and all(c[np.abs(c).argmax()] > 0 for c in space.components)


def test_h16_stacked_rows_end_early(spark):
    df = spark.createDataFrame([(1, k, [float(k)]) for k in range(4)], "s int, frame int, v array<double>")
    assert series.stacked(df, ["s"], "frame", "v", "x", 2).count() == 3


def test_h17_likelihood_ratio_of_one_response(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("k", s, d, float(s + d + rng.normal())) for s in range(8) for d in range(4)], "k string, s int, d int, y double")
    full, null = (mixed.random_intercept(df, ["k"], "s", "y", x, reml=False) for x in ({"d": "d"}, {}))
    row = mixed.likelihood_ratio(full, null, ["k"], 1).first()
    assert row.full > row.null and row.chi2 == pytest.approx(2 * (row.full - row.null)) and row.p < 0.01


def test_h18_both_bayes_factors(spark):
    df = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 1.5, 2.5, 1.2)], "k string, v double")
    row = stats.bayes_factor(df, ["k"], "v").first()
    assert row.bf10_jzs > 3 and row.bf10_published != pytest.approx(row.bf10_jzs, rel=0.01)


def test_h19_exact_and_approximate_trend(spark):
    df = spark.createDataFrame([("few", 3, 42.0, 2.4), ("many", 50, 1.0, 0.0)], "k string, n long, l double, z double")
    got = {r.k: r.p for r in stats.page_p(df, 3).collect()}
    assert got["few"] == pytest.approx(1 / 216) and got["many"] == pytest.approx(0.5)


def test_h20_no_response_is_zero_only_in_one_sheet(spark):
    df = spark.createDataFrame([("NA",), ("Q",), ("2",), (None,)], "c string")
    assert [r.z for r in df.select(text.number_or_zero("c").alias("z")).collect()] == [0.0, 0.0, 2.0, 0.0]
    assert [r.n for r in df.select(text.number("c").alias("n")).collect()] == [None, None, 2.0, None]


def test_h21_errors_of_one_value(spark):
    one = spark.createDataFrame([("k", 1.0)], "k string, v double")
    assert stats.mean_sem(one, ["k"], "v").first().sem is None and stats.mean_sem(one, ["k"], "v", single=0.0).first().sem == 0.0
    three = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 4.0)], "k string, v double")
    found = {e: scores.behavior_summary(three, ["k"], "v", e).first().error for e in ("sem", "ci", "bootstrap")}
    assert len(set(found.values())) == 3 and all(v > 0 for v in found.values())
