"""Operators on small tables: edge cases, invariants and plain recomputation."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import arrays, special, text
from kestrel.operators import divergence, intervals, matching, mixed, projection, reshape, scores, series, shapes, stats


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(df, column, n=1):
    found = [r[column] for r in df.collect()]
    assert len(found) == n
    return found[0]


# --- special functions -------------------------------------------------------------------------


def test_distributions_against_tables():
    # Fixed values from published tables.
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert special.t_ppf(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert special.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, abs=1e-10)
    assert special.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-10)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert math.isnan(special.t_cdf(1.0, 0)) and special.chi2_sf(0.0, 3) == 1.0
    # A normal quantile is undone by its distribution; t is symmetric.
    for p in (1e-6, 0.2, 0.5, 0.9):
        assert special.norm_cdf(special.norm_ppf(p)) == pytest.approx(p, rel=1e-9)
        assert special.t_ppf(p, 7) == pytest.approx(-special.t_ppf(1 - p, 7), rel=1e-7, abs=1e-9)


# --- names, cells ------------------------------------------------------------------------------


def test_cells(spark):
    df = spark.createDataFrame([("1,2, 3",), ("",), (None,), ("4,x",), ("7",)], "c string")
    assert [r.l for r in df.select(text.int_list("c").alias("l")).collect()] == [[1, 2, 3], [], [], [], [7]]
    dirty = spark.createDataFrame([("NA",), ("Q",), ("",), (" 3 ",), (None,)], "c string")
    assert [r.a for r in dirty.select(text.number("c").alias("a")).collect()] == [None, None, None, 3.0, None]
    assert [r.a for r in dirty.select(text.number_or_zero("c").alias("a")).collect()] == [0.0, 0.0, 0.0, 3.0, 0.0]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "c double")
    assert [r.a for r in nan.select(text.null_if_nan("c").alias("a")).collect()] == [None, 1.0, None]


def test_names(spark):
    name = "/x/2025_10_15_10_20_58_trial_1_TP_regions_712_248_930_1170_FINAL_Feature_vector.npy"
    df = spark.createDataFrame([(name,), ("other",), (None,)], "c string")
    got = df.select(text.session_of("c").alias("s"), text.region_of("c").alias("r"), text.condition_of(text.session_of("c")).alias("k")).collect()
    assert tuple(got[0]) == ("2025_10_15_10_20_58_trial_1_TP", "712_248_930_1170", "TP") and got[1].s == "" and got[1].k == "TC"
    # All occurrences of the mark go, and all slashes at the end.
    keys = spark.createDataFrame([("Video_A_Video_B//",)], "c string").select(text.video_key("c").alias("k"))
    assert keys.first().k == "A_B"
    with pytest.raises(Exception, match="no frame range"):
        df.select(text.frame_range("c")).collect()
    prefixes = spark.createDataFrame([("CC_1",), ("CCX",), (None,)], "c string")
    assert [r.x for r in prefixes.select(text.has_any("c", ["CC_"], "prefix").alias("x")).collect()] == [True, False, False]
    assert [r.x for r in prefixes.select(text.has_any("c", None).alias("x")).collect()] == [False] * 3


def test_bayes_labels(spark):
    df = spark.createDataFrame([(200.0,), (5.0,), (1.0,), (0.5,), (0.01,), (None,), (float("inf"),)], "b double")
    assert [r.x.split(" evidence")[0] for r in df.select(text.bayes_label("b").alias("x")).collect()] == ["extreme", "moderate", "anecdotal", "anecdotal", "very strong", "not computable", "not computable"]


# --- arrays and shapes -------------------------------------------------------------------------


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, -3.0, None, 0.0],), ([0.0, 0.0],), ([],)], "a array<double>")
    assert [r.x for r in df.select(arrays.l1_normalized(F.col("a")).alias("x")).collect()] == [[0.25, -0.75, 0.0, 0.0], [0.0, 0.0], []]
    turned = spark.createDataFrame([([1, 5, 2, 5],), ([3],), ([],)], "a array<int>")
    assert [r.x for r in turned.select(arrays.rolled_to_max(F.col("a")).alias("x")).collect()] == [[5, 2, 5, 1], [3], []]
    means = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r.x for r in means.select(arrays.mean_of_present("a", "b", "c").alias("x")).collect()] == [2.0, None]
    wave = spark.createDataFrame([([math.sin(2 * math.pi * 2 * k / 32) + math.sin(2 * math.pi * 9 * k / 32) for k in range(32)],)], "a array<double>")
    low = wave.select(arrays.lowpass(F.col("a"), F.lit(4)).alias("x")).first().x
    assert max(abs(x - math.sin(2 * math.pi * 2 * k / 32)) for k, x in enumerate(low)) < 1e-9


def test_shapes(spark):
    mask = np.zeros((12, 20), np.uint8)
    mask[3:8, 4:16] = 1
    flipped = 1 - mask
    data = [(1, mask.tobytes()), (2, bytes(240)), (3, None), (4, flipped.tobytes())]
    df = spark.createDataFrame(data, "k int, m binary").withColumns({"h": F.lit(12), "w": F.lit(20)})
    got = {r.k: r for r in shapes.shape_measures(df, ["k"], "m", "h", "w").collect()}
    assert got[1].area == 60 and got[1].area_percentage == 25 and got[1].perimeter == 2 * (11 + 4)
    assert (got[1].centroid_x, got[1].centroid_y) == (9.5, 5) and got[1].orientation_angle == 0 and got[1].hull_area == 44
    assert got[2].area is None and got[3].area is None and got[2].contour is None
    # A mask that is mostly set is taken as inverted.
    assert got[4].area == 60
    image = shapes.mean_image(spark.createDataFrame([(1, bytes([1, 4])), (1, bytes([2, 4])), (1, None), (2, bytes([9, 9]))], "k int, m binary"), ["k"], "m")
    assert {r.k: (r.n, bytes(r.image)) for r in image.collect()} == {1: (2, bytes([1, 4])), 2: (1, bytes([9, 9]))}
    ratios = shapes.ratio_columns(spark.createDataFrame([(1.0, 0.0, 0.0), (math.pi, 2 * math.pi, math.pi)], "area double, perimeter double, hull_area double")).collect()
    assert ratios[0].circularity is None and ratios[0].concavity is None and ratios[1].circularity == pytest.approx(1)


def test_outline_of_odd_shapes():
    rng = random.Random(4)
    for _ in range(60):
        mask = np.array([[rng.random() < 0.55 for _ in range(7)] for _ in range(6)])
        if mask.any():
            outline = shapes.trace(mask)
            assert all(mask[y, x] for x, y in outline.tolist())
            steps = np.abs(np.roll(outline, -1, axis=0) - outline).max(axis=1)
            assert len(outline) == 1 or (steps <= 1).all()


# --- intervals ---------------------------------------------------------------------------------


def test_windows(spark):
    nan = float("nan")
    log = spark.createDataFrame([("a", 1, 1000.0, 28400.0), ("a", 2, 61000.0, nan), ("a", 3, nan, 99.0), ("b", 1, 5000.0, 32400.0)], "session string, trial_num int, white_light_on double, shock_on double")
    tc = rows(intervals.trial_windows(log, "TC"), "session", "trial_num", "start_frame", "end_frame")
    assert tc == [("a", 1, 18, 296), ("b", 1, 18, 296)]
    tp = rows(intervals.trial_windows(log, "TP"), "session", "trial_num", "start_frame", "end_frame")
    assert tp == [("a", 1, 18, 291), ("a", 2, 618, 891), ("b", 1, 18, 291)]


def test_gaps_and_labels(spark):
    trials = spark.createDataFrame([("a", 1, 2, 4), ("a", 2, 5, 6), ("a", 3, 9, 11)], "session string, trial_num int, start_frame int, end_frame int")
    lengths = lambda n: spark.createDataFrame([("a", n)], "session string, n_frames int")
    # Adjacent trials leave no gap; a last trial that ends with the series leaves none after it.
    assert rows(intervals.gaps(trials, lengths(12)), "after_trial", "start_frame", "end_frame") == [(2, 7, 8)]
    assert rows(intervals.gaps(trials, lengths(14)), "after_trial", "start_frame", "end_frame") == [(2, 7, 8), (3, 12, 13)]
    frames = spark.range(14).selectExpr("'a' AS session", "CAST(id AS INT) AS frame").union(spark.createDataFrame([("z", 1)], "session string, frame int"))
    got = {(r.session, r.frame): r.cs_on for r in intervals.labelled(frames, trials).collect()}
    assert [got["a", k] for k in range(14)] == [None, None, True, True, True, True, True, False, False, True, True, True, False, False] and got["z", 1] is None
    before = {r.frame: r.cs_on for r in intervals.labelled(frames, trials, before_is_off=True).where("session = 'a'").collect()}
    assert before[0] is False and before[1] is False
    with pytest.raises(Exception, match="outside the series"):
        intervals.checked_windows(trials, lengths(11)).collect()
    assert intervals.checked_windows(trials, lengths(12)).count() == 3


def test_splits_and_overwrites(spark):
    lines = spark.createDataFrame([("v,[1,20],[5,30]",), ("v,[]",), ("v,[10,50]",), ("v",)], "c string")
    got = [[tuple(x) for x in r.i] for r in lines.select(intervals.split_intervals(text.bracketed_lists("c"), 99).alias("i")).collect()]
    assert got == [[(1, 5), (20, 30)], [(0, 99)], [(10, 49), (50, 99)], [(0, 99)]]
    base = spark.createDataFrame([(k, float(k)) for k in range(5)], "frame int, v double")
    cut = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (3, 30.0, 1)], "frame int, v double, listed int")
    assert rows(intervals.overwritten(base, cut, ["frame"], "v", "listed"), "frame", "v") == [(0, 0.0), (1, 20.0), (2, 2.0), (3, 30.0), (4, 4.0)]


# --- series ------------------------------------------------------------------------------------


def frame_series(spark, values, kind="double"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"s int, frame int, v {kind}")


def in_order(df, column):
    return [r[column] for r in df.orderBy("frame").collect()]


def test_gap_fill(spark):
    df = frame_series(spark, [None, 1.0, None, None, 4.0, None, None, None, 8.0, None])
    assert in_order(series.gap_filled(df, ["s"], "frame", "v", "f", 2), "f") == [1.0, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, 8.0]
    assert in_order(series.gap_filled(df, ["s"], "frame", "v", "f", 30), "f") == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 8.0]
    assert in_order(series.gap_filled(frame_series(spark, [None, None]), ["s"], "frame", "v", "f"), "f") == [None, None]
    # 30 missing frames are filled, 31 are not.
    for n, filled in ((30, True), (31, False)):
        got = in_order(series.gap_filled(frame_series(spark, [0.0, *[None] * n, 1.0]), ["s"], "frame", "v", "f", 30), "f")
        assert (None not in got) == filled
    assert in_order(series.angle_gap_filled(frame_series(spark, [170.0, None, 10.0]), ["s"], "frame", "v", "f"), "f") == [170.0, 0.0, 10.0]
    assert in_order(series.angle_gap_filled(frame_series(spark, [10.0, None, 170.0]), ["s"], "frame", "v", "f"), "f") == [10.0, 0.0, 170.0]


def test_gradient_and_spikes(spark):
    values = [1.0, 2.0, 4.0, 7.0, 11.0]
    assert in_order(series.gradient(frame_series(spark, values), ["s"], "frame", "v", "g"), "g") == np.gradient(values).tolist()
    assert in_order(series.gradient(frame_series(spark, [1.0]), ["s"], "frame", "v", "g"), "g") == [None]
    after = in_order(series.spikes(frame_series(spark, [None, 1.0, 1.0, None, 1.0]), ["s"], "frame", "v", "x"), "x")
    assert after == [False, True, False, False, True]


@pytest.mark.parametrize("size", [1, 2, 5, 6, 60])
def test_median_filter(spark, size):
    rng = random.Random(size)
    for n in (1, 3, 70):
        values = [float(rng.randrange(50)) for _ in range(n)]
        left, want = size // 2, []
        mirrored = lambda i: values[next(j for j in [i % (2 * n)])] if i % (2 * n) < n else values[2 * n - 1 - i % (2 * n)]
        if size // 2 > n:
            continue
        for i in range(n):
            want.append(sorted(mirrored(j) for j in range(i - left, i - left + size))[size // 2])
        assert in_order(series.median_filtered(frame_series(spark, values), ["s"], "frame", "v", "m", size), "m") == want


def test_cleaning(spark):
    values = [100.0 + k % 3 for k in range(120)]
    values[50:60] = [20.0] * 10
    df = frame_series(spark, values).withColumn("w", F.col("v") * 2)
    flags = in_order(series.occluded(df, ["s"], "frame", "v", "x"), "x")
    assert all(flags[52:58]) and not any(flags[:47]) and not any(flags[63:])
    out = series.cleaned(df, ["s"], "frame", "v", ["v", "w"]).orderBy("frame").collect()
    assert all(v == r.v for v, r in zip(values[:45], out)) and all(r.v is None or r.v > 90 for r in out)
    # Later intervals see what earlier ones filled.
    chain = frame_series(spark, [0.0, 9.0, 9.0, 3.0, 9.0, 5.0])
    cuts = spark.createDataFrame([(1, 1, 2), (1, 2, 4)], "s int, start int, end int")
    assert in_order(series.interpolated(chain, cuts, ["s"], "frame", ["v"]), "v") == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_scales(spark):
    df = frame_series(spark, [1.0, 3.0, None, 5.0])
    assert in_order(series.min_max_scaled(df, ["s"], "v", "x"), "x") == [0.0, 0.5, None, 1.0]
    assert in_order(series.min_max_scaled(frame_series(spark, [2.0, 2.0]), ["s"], "v", "x"), "x") == [None, None]
    assert in_order(series.z_scored(frame_series(spark, [2.0, 2.0]), ["s"], "v", "x"), "x") == [0.0, 0.0]
    edge = series.density(frame_series(spark, [-4.0, 4.0, 0.0, 9.0]), ["s"], "v", -4.0, 4.0, 50)
    got = {r.bin: r.density for r in edge.collect()}
    assert set(got) == {0, 25, 49} and sum(got.values()) * 0.16 == pytest.approx(1)


# --- divergence --------------------------------------------------------------------------------


def test_divergence(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 40), rng.normal(1, 2, 50)
    data = [(1, True, float(x)) for x in a] + [(1, False, float(x)) for x in b] + [(1, None, 1e9), (1, True, None)]
    df = spark.createDataFrame(data, "k int, cs_on boolean, v double")
    va, vb = a.var(ddof=1) + 1e-12, b.var(ddof=1) + 1e-12
    want = 0.5 * (np.log(vb / va) + (va + (a.mean() - b.mean()) ** 2) / vb - 1)
    got = divergence.gaussian_divergence(df, ["k"], ["v"]).first()
    assert got.kl == pytest.approx(want, rel=1e-9) and (got.n_on, got.n_off) == (41, 50)
    full = divergence.full_divergence(df, ["k"], ["v"], eps=1e-12).first()
    assert full.kl_full == pytest.approx(want, rel=1e-6)
    same = spark.createDataFrame([(1, f, float(x)) for f in (True, False) for x in (1, 2, 5)], "k int, cs_on boolean, v double")
    assert divergence.gaussian_divergence(same, ["k"], ["v"]).first().kl == pytest.approx(0, abs=1e-9)
    single = spark.createDataFrame([(1, True, 1.0), (1, False, 1.0), (1, False, 2.0)], "k int, cs_on boolean, v double")
    assert divergence.gaussian_divergence(single, ["k"], ["v"]).first().kl is None
    constant = spark.createDataFrame([(1, f, 1.0) for f in (True, True, False, False)], "k int, cs_on boolean, v double")
    assert divergence.gaussian_divergence(constant, ["k"], ["v"]).first().kl == pytest.approx(0, abs=1e-9)


# --- matching ----------------------------------------------------------------------------------


def events_of(spark, lists):
    data = [(v, "turn", s, k, t) for (v, s), ts in lists.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(data, "video string, event_type string, scorer string, idx int, t int")


def brute_match(ref, test, limit):
    used_ref, used_test, tp = set(), set(), 0
    for d, j, i in sorted((abs(x - y), j, i) for j, x in enumerate(test) for i, y in enumerate(ref)):
        if d <= limit and i not in used_ref and j not in used_test:
            used_ref.add(i)
            used_test.add(j)
            tp += 1
    return tp, len(test) - tp, len(ref) - tp


def test_matching_against_brute_force(spark):
    rng = random.Random(7)
    lists = {(f"v{v}", s): sorted(rng.sample(range(120), rng.randrange(0, 8))) for v in range(25) for s in ("A", "B")}
    lists["tie", "A"], lists["tie", "B"] = [10, 20], [15]
    events = events_of(spark, lists)
    videos = spark.createDataFrame([(v,) for v in {v for v, _ in lists}], "video string")
    got = {r.video: (r.tp, r.fp, r.fn, [tuple(m) for m in r.matches]) for r in matching.matched(events, matching.scored_pairs(videos, ["turn"], ["A", "B"]), F.lit(10)).collect()}
    for v in got:
        assert got[v][:3] == brute_match(lists[v, "A"], lists[v, "B"], 10)
        assert len({m[1] for m in got[v][3]}) == len({m[2] for m in got[v][3]}) == got[v][0]
    assert got["tie"][3] == [(5, 0, 0)]


def test_scores_of_empty_lists(spark):
    counts = spark.createDataFrame([("a", "turn", "A", "B", 0, 0, 0), ("b", "turn", "A", "B", 0, 2, 0), ("c", "turn", "A", "B", 1, 0, 1)], "video string, event_type string, ref string, test string, tp int, fp int, fn int")
    by_video = matching.f1_by_video(counts).first()
    assert by_video.precision == pytest.approx((1 + 0 + 1) / 3) and by_video.recall == pytest.approx((1 + 0 + 0.5) / 3)
    pooled = matching.f1_pooled(counts).first()
    assert (pooled.precision, pooled.recall) == (pytest.approx(1 / 3), 0.5)
    swapped = matching.both_ways(counts).where("ref = 'B' AND video = 'b'").first()
    assert (swapped.fp, swapped.fn) == (0, 2)


def test_unanimity_of_two_passing_distances(spark):
    # Exactly two of the triplet's distances pass: the triplet is passed over and a pair decides; of
    # pairs with equal distances the first scorers' comes first, as they are listed.
    found = matching.unanimity(events_of(spark, {("v", "A"): [0], ("v", "B"): [8], ("v", "C"): [16]}), ["A", "B", "C"], F.lit(10)).first()
    assert (found.s123, found.s12, found.s13, found.s23, found.total_unique) == (0, 1, 0, 0, 2)
    common = matching.unanimity(events_of(spark, {("v", "A"): [0], ("v", "B"): [4], ("v", "C"): [8], ("w", "A"): [1]}), ["A", "B", "C"], F.lit(10))
    assert rows(common, "video", "s123", "total_unique", "unanimity_rate") == [("v", 1, 1, 1.0)]


# --- statistics --------------------------------------------------------------------------------


def test_tests_against_formulas(spark):
    a, b = [2.0, 4.0, 4.5, 7.0], [1.0, 1.5, 3.0, 2.0, 2.5]
    df = spark.createDataFrame([("A", x) for x in a] + [("B", x) for x in b] + [("A", None)], "g string, v double")
    na, nb, va, vb = len(a), len(b), np.var(a, ddof=1), np.var(b, ddof=1)
    welch = stats.welch_t(df, [], "g", "A", "B", "v").first()
    assert welch.t == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va / na + vb / nb))
    assert welch.d == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt((va + vb) / 2))
    pooled = stats.pooled_t(df, [], "g", "A", "B", "v").first()
    f = stats.anova(df, [], "g", "v").first()
    assert f.f == pytest.approx(pooled.t**2) and pooled.df == na + nb - 2
    ci = stats.mean_ci(df, ["g"], "v").where("g = 'A'").first()
    assert ci.half_width == pytest.approx(special.t_ppf(0.975, 3) * math.sqrt(va / 4))
    single = stats.mean_sem(spark.createDataFrame([("x", 1.0)], "g string, v double"), ["g"], "v").first()
    zero = stats.mean_sem(spark.createDataFrame([("x", 1.0)], "g string, v double"), ["g"], "v", single=0.0).first()
    assert single.sem is None and zero.sem == 0.0


def test_slopes_of_short_series(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 5.0), ("same", 1.0, 2.0), ("same", 1.0, 3.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0), ("line", 3.0, 3.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.stderr, r.t) for r in stats.slopes(df, ["k"], "x", "y").collect()}
    assert got == {"two": (3.0, None, None), "line": (1.0, 0.0, None)}


def test_bootstrap_is_the_published_generator(spark):
    values = [3.0, 1.0, 2.0, 2.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(3)
    got = stats.bootstrap_ci(df, ["k"], "v", resamples=1000).first()
    x, rng = np.sort(values), np.random.default_rng(0)
    means = x[rng.integers(0, 4, size=(1000, 4))].mean(axis=1)
    assert (got.low, got.high, got.n) == (*np.quantile(means, [0.025, 0.975]), 4)


def test_ranks_and_trends(spark):
    xs, ys = [1.0, 2.0, 2.0, 4.0, 5.0], [2.0, 1.0, 3.0, 3.0, 9.0]
    df = spark.createDataFrame([("k", x, y) for x, y in zip(xs, ys)] + [("k", None, 1.0)], "k string, x double, y double")
    rank = lambda v: [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
    assert stats.spearman(df, ["k"], "x", "y").first().rho == pytest.approx(np.corrcoef(rank(xs), rank(ys))[0, 1])
    matrix = [[1.0, 2.0, 3.0], [2.0, 2.0, 1.0], [0.0, 5.0, 9.0]]
    data = [("k", s, b + 1, v) for s, row in enumerate(matrix) for b, v in enumerate(row)] + [("k", 9, 1, 1.0)]
    page = stats.page_trend(spark.createDataFrame(data, "k string, s int, b int, v double"), ["k"], "s", "b", "v", 3).first()
    assert page.n == 3 and page.l == sum((b + 1) * r for row in matrix for b, r in enumerate(rank(row)))


def test_shape_and_normality(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    got = stats.shape(spark.createDataFrame([("k", v) for v in x], "k string, v double"), ["k"], "v").first()
    m = np.array(x) - np.mean(x)
    g1 = (m**3).mean() / (m**2).mean() ** 1.5
    g2 = (m**4).mean() / (m**2).mean() ** 2 - 3
    n = 4
    assert got.skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert got.kurtosis == pytest.approx(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    # Fixed values from Shapiro and Wilk's example (weights of eleven men).
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]
    rng = np.random.default_rng(1)
    large = [("large", float(v)) for v in rng.normal(0, 1, 6000)] + [("skewed", float(v)) for v in rng.exponential(1, 6000)]
    data = [("men", float(v)) for v in men] + [("two", 1.0), ("two", 2.0), ("flat", 1.0), ("flat", 1.0), ("flat", 1.0), ("three", 1.0), ("three", 2.0), ("three", 4.0), ("men", None)] + large
    got = {r.k: r for r in stats.normality(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v").collect()}
    assert got["men"].w == pytest.approx(0.79, abs=0.005) and 0.005 < got["men"].p < 0.02
    assert got["two"].verdict is None and got["flat"].w is None and got["three"].w == pytest.approx(27 / 28)
    assert got["large"].w > 0.999 and got["large"].verdict == "normal" and got["skewed"].verdict == "not normal" and got["skewed"].p < 1e-9


def test_exact_page_p(spark):
    from itertools import permutations, product

    orders = [sum(k * r for k, r in enumerate(o, 1)) for o in permutations((1, 2, 3))]
    chances = sum(sum(x) >= 40 for x in product(orders, repeat=3)) / 6**3
    df = spark.createDataFrame([("k", 3, 40.0, 1.0), ("l", 100, 1.0, 1.96)], "k string, n long, l double, z double")
    got = {r.k: r.p for r in stats.page_p(df, 3).collect()}
    assert got["k"] == pytest.approx(chances) and got["l"] == pytest.approx(0.025, abs=1e-4)


def test_trend_band(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 300).astype(float)
    y = 2 + 3 * x + rng.normal(0, 2, 300)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 1.0), ("k", None, 1.0)], "k string, x double, y double")
    got = {(r.k, r.x): r for r in stats.trend_band(df.repartition(4), ["k"], "x", "y", [0.0, 5.0], 400).collect()}
    slope, start = np.polyfit(x, y, 1)
    assert got["k", 0.0].fitted == pytest.approx(start) and got["k", 5.0].fitted == pytest.approx(start + 5 * slope)
    lines = [np.polyval(np.polyfit(x[i], y[i], 1), 5.0) for i in (rng.integers(0, 300, 300) for _ in range(1000))]
    assert got["k", 5.0].low == pytest.approx(np.quantile(lines, 0.025), abs=0.15) and got["k", 5.0].high == pytest.approx(np.quantile(lines, 0.975), abs=0.15)
    assert got["one", 0.0].low is None
    again = {(r.k, r.x): r.low for r in stats.trend_band(df.repartition(1), ["k"], "x", "y", [0.0, 5.0], 400).collect()}
    assert again["k", 5.0] == pytest.approx(got["k", 5.0].low)


def test_interaction_is_the_least_squares_fit(spark):
    rng = np.random.default_rng(3)
    x = np.tile(np.arange(6.0), 2)
    g = np.repeat([0.0, 1.0], 6)
    y = 1 + 2 * x + g - 0.7 * g * x + rng.normal(0, 1, 12)
    df = spark.createDataFrame([("k", "b" if gi else "a", float(xi), float(yi)) for gi, xi, yi in zip(g, x, y)], "k string, g string, x double, y double")
    got = stats.slope_interaction(df, ["k"], "g", "a", "b", "x", "y").first()
    design = np.column_stack([np.ones(12), x, g, g * x])
    beta, rest, *_ = np.linalg.lstsq(design, y, rcond=None)
    error = math.sqrt(rest[0] / 8 * np.linalg.inv(design.T @ design)[3, 3])
    assert got.interaction == pytest.approx(beta[3]) and got.t == pytest.approx(beta[3] / error) and got.df == 8


def test_mixed_model_against_dense_algebra(spark):
    rng = np.random.default_rng(5)
    data = []
    for s in range(12):
        u = rng.normal(0, 1.5)
        data += [("k", s, float(d), 1 + 0.5 * d + u + rng.normal(0, 0.8)) for d in range(4 + s % 2)]
    df = spark.createDataFrame([(k, s, d, float(y)) for k, s, d, y in data], "k string, s int, d double, y double")
    got = {r.term: r for r in mixed.random_intercept(df, ["k"], "s", "y", {"d": "d"}).collect()}
    y, x = np.array([r[3] for r in data]), np.column_stack([np.ones(len(data)), [r[2] for r in data]])
    z = np.array([[float(r[1] == s) for s in range(12)] for r in data])

    def reml(ve, vu):
        v = ve * np.eye(len(y)) + vu * z @ z.T
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        r = y - x @ np.linalg.solve(a, x.T @ w @ y)
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + r @ w @ r + (len(y) - 2) * math.log(2 * math.pi))

    ve, vu = got["d"].residual_variance, got["d"].subject_variance
    assert got["d"].log_likelihood == pytest.approx(reml(ve, vu), abs=1e-6)
    assert all(reml(ve * a, vu * b) <= got["d"].log_likelihood + 1e-6 for a, b in itertools.product((0.9, 1, 1.1), repeat=2))
    assert abs(got["d"].estimate - 0.5) < 0.3
    # A model without enough rows is left out.
    assert mixed.random_intercept(df.limit(2), ["k"], "s", "y", {"d": "d"}).count() == 0


def test_bayes_factors(spark):
    weak = spark.createDataFrame([("k", v) for v in (-1.0, 1.0, 0.5, -0.6, 0.2, -0.1)], "k string, v double")
    strong = spark.createDataFrame([("k", 5 + v) for v in (-1.0, 1.0, 0.5, -0.6, 0.2, -0.1)], "k string, v double")
    assert stats.bayes_factor(weak, ["k"], "v").first().bf10_jzs < 1 < 100 < stats.bayes_factor(strong, ["k"], "v").first().bf10_jzs


def test_equivalence(spark):
    df = spark.createDataFrame([("k", v) for v in (0.1, -0.1, 0.05, -0.02, 0.0)], "k string, v double")
    wide, narrow = (stats.tost_p(stats.tost(df, ["k"], "v", b)).first() for b in (1.0, 0.01))
    assert wide.equivalent and not narrow.equivalent


# --- reshaping ---------------------------------------------------------------------------------


def test_lookup_and_upsert(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dimension = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 9, 2)], "d string, v int, pos int")
    assert rows(reshape.looked_up(left, dimension, "k", "d", [F.col("pos")]), "k", "v") == [("a", 2), ("b", None), (None, None)]
    old = spark.createDataFrame([("s", "r", 1, 5), ("s", "q", 2, 6)], "session string, region string, b int, a int")
    new = spark.createDataFrame([("s", "r", 7, 8), ("t", "r", 3, 4)], "session string, region string, a int, c int")
    got = reshape.upserted(old, new, ["session", "region"])
    assert got.columns == ["session", "region", "a", "b", "c"]
    assert rows(got, *got.columns) == [("s", "q", 6, 2, None), ("s", "r", 7, None, 8), ("t", "r", 3, None, 4)]


def test_first_and_last(spark):
    rows_ = spark.createDataFrame([(1, 2, "a", None), (1, 3, "a", 5.0), (1, 4, "a", 1.0), (2, 1, "b", 7.0)], "k int, pos int, n string, v double")
    assert rows(reshape.to_wide(rows_, ["k"], "n", "v", ["a", "b"], order="pos"), "k", "a", "b") == [(1, 5.0, None), (2, None, 7.0)]
    dimension = spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "d string, v int")
    df = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    found = [reshape.looked_up(df, dimension, "k", "d", [F.col("v")], first) for first in (True, False)]
    assert [{r.k: r.v for r in f.collect()} for f in found] == [{"x": 1, "y": None, None: None}, {"x": 2, "y": None, None: None}]


def test_last_start_and_required_splits(spark):
    starts = spark.createDataFrame([("a", 0), ("a", 10), ("b", 5), ("a", None)], "k string, s int")
    asked = spark.createDataFrame([("a", 9, 1), ("a", 10, 2), ("b", 4, 3), ("c", 1, 4), ("a", 10, 2)], "k string, t int, s int")
    got = intervals.last_start(asked, starts, ["k"], "t", "s", "since")
    assert got.columns == ["k", "t", "s", "since"] and rows(got, "k", "t", "s", "since") == [("a", 10, 2, 10), ("a", 10, 2, 10), ("a", 9, 1, 0), ("b", 4, 3, None), ("c", 1, 4, None)]
    splits = spark.createDataFrame([("v", [(1, 2)])], "video string, intervals array<struct<start:int,end:int>>")
    assert intervals.required(spark.createDataFrame([("v",)], "video string"), splits).first().intervals[0].end == 2
    with pytest.raises(Exception, match="no split for w"):
        intervals.required(spark.createDataFrame([("w",)], "video string"), splits).collect()


def test_outline_is_the_largest_components(spark):
    mask = np.zeros((12, 12), np.uint8)
    mask[0, 0:2] = 1
    mask[3:8, 2:9] = 1
    mask[10:12, 10:12] = 1
    df = spark.createDataFrame([(1, mask.tobytes())], "k int, m binary").selectExpr("*", "12 AS h", "12 AS w")
    got = shapes.shape_measures(df, ["k"], "m", "h", "w").first()
    assert got.area == mask.sum() and got.perimeter == pytest.approx(20.0) and got.hull_area == pytest.approx(24.0)


def test_space_is_saved(spark, tmp_path):
    df = spark.createDataFrame([([float(x) for x in row],) for row in np.random.default_rng(1).random((40, 5))], "e array<double>")
    space = projection.reference_space(df, "e", 2)
    space.save(spark, str(tmp_path / "space"))
    again = projection.Space.load(spark, str(tmp_path / "space"))
    assert all((getattr(space, n) == getattr(again, n)).all() for n in ("mean", "deviation", "components", "explained"))


def test_long_series_and_many_marks_end_soon(spark):
    import time

    began = time.perf_counter()
    long = spark.range(100_000).selectExpr("1 AS s", "id AS frame", "double(id % 100) AS v")
    assert series.median_filtered(long, ["s"], "frame", "v", "f", 60).agg(F.sum("f")).first()[0] > 0
    marks = spark.range(6000).selectExpr("'v' AS video", "'turn' AS event_type", "concat('S', 1 + id % 3) AS scorer", "CAST(id DIV 3 AS INT) AS idx", "CAST(id DIV 3 * 40 + id % 3 AS INT) AS t")
    pairs = matching.scored_pairs(marks, ["turn"], ["S1", "S2", "S3"])
    assert {r.tp for r in matching.matched(marks, pairs, F.lit(10)).collect()} == {2000}
    assert time.perf_counter() - began < 60


def test_wide_and_long(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "k int, W1_a double, W2_a double")
    assert rows(reshape.to_long(wide, ["k"], ["W1_a", "W2_a"]), "k", "name", "value") == [(1, "W1_a", 2.0)]
    filled = reshape.filled_down(spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, None)], "k int, pos int, r string"), ["k"], "pos", ["r"])
    assert rows(filled, "k", "pos", "r") == [(1, 1, "x"), (1, 2, "x"), (2, 1, None)]
    notes = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " "), (1, 4, None)], "k int, pos int, n string")
    assert one(reshape.notes_joined(notes, ["k"], "pos", F.col("n")), "notes") == "a; b"


def test_samples_and_names_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    assert rows(reshape.sampled(df, ["k"], 5, 1), "k") == rows(reshape.sampled(df.repartition(7), ["k"], 5, 1), "k")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    names = reshape.anonymized(df, "k", words, words)
    assert names.count() == names.select("name").distinct().count() == 200
    assert all(n[0] == "Video" and n[1] != n[2] and {*n[1:4]} <= {"a", "b", "c"} for n in (r.name.split("_") for r in names.collect()))
    assert rows(names, "k", "name") == rows(reshape.anonymized(df.repartition(5), "k", words, words), "k", "name")


def test_top_fraction_keeps_one_at_least(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 1.0)], "k string, v double")
    assert rows(reshape.top_fraction(df, "k", "v", 0.33), "k", "v") == [("b", 1.0), ("b", 3.0)]


def test_sheets(spark):
    df = spark.createDataFrame([("t", "CRturn", 1.0), ("t", "CRturn", None), ("t", "UCRcon", 2.0)], "troupe string, behavior string, score double")
    assert rows(scores.raw_counts(df, ["troupe"], ["CRturn", "CRcon", "UCRturn", "UCRcon"]), "CRturn", "CRcon", "UCRcon", "CR", "UCR") == [(1.0, 0.0, 2.0, 1.0, 2.0)]
    for error in ("sem", "ci", "bootstrap"):
        got = scores.behavior_summary(spark.createDataFrame([("t", v) for v in (1.0, 2.0, 4.0)], "troupe string, score double"), ["troupe"], "score", error).first()
        assert got["mean"] == 2.33 and got["n"] == 3 and got["error"] > 0


def test_features_filled_and_reported(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 170.0), (1, 1, None, None), (1, 2, 2.0, 10.0), (1, 3, None, 10.0)], "s int, frame int, v double, a double")
    out = series.features_filled(df, ["s"], "frame", ["v", "a"], ("a",))
    assert [(r.v, r.a) for r in out.orderBy("frame").collect()] == [(0.0, 170.0), (1.0, 0.0), (2.0, 10.0), (2.0, 10.0)]
    assert rows(series.fill_report(df, out, ["s"], ["v", "a"]), "feature", "n_before", "n_after", "n_filled") == [("a", 1, 0, 1), ("v", 2, 0, 2)]


def test_labels_are_counted(spark):
    trials = spark.createDataFrame([("x", 1), ("x", 2)], "session string, trial_num int")
    sessions = spark.createDataFrame([("x", 1), ("y", 9)], "session string, block int")
    labels = scores.labels_of_blocks(sessions, {1: ["a", "b"], 2: ["c"]})
    assert rows(scores.checked_labels(trials, labels, "session"), "trial_num", "label") == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="differ in number"):
        scores.checked_labels(trials.limit(1), labels, "session").collect()


@pytest.mark.parametrize("operator", [
    lambda d: series.gap_filled(d, ["s"], "frame", "v", "f"),
    lambda d: series.spikes(d, ["s"], "frame", "v", "f"),
    lambda d: series.median_filtered(d, ["s"], "frame", "v", "f"),
    lambda d: stats.mean_ci(d, ["s"], "v"),
    lambda d: stats.bootstrap_ci(d, ["s"], "v"),
    lambda d: stats.slopes(d, ["s"], "frame", "v"),
    lambda d: stats.normality(d, ["s"], "v"),
    lambda d: mixed.random_intercept(d, ["s"], "frame", "v", {}),
])
def test_empty_tables(spark, operator):
    assert operator(frame_series(spark, [1.0]).limit(0)).collect() == []
