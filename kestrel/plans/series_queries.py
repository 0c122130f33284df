"""Queries on frame series: trials, divergence, cleaning and description."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import divergence, intervals, series
from kestrel.plans import views
from kestrel.plans.registry import query, rounded, table
from kestrel.plans.views import LABELLED_SQL, SERIES_SQL

KEYS = ["user_id"]


def _labelled(spark, sf_dir):
    return intervals.labelled(views.series(spark, sf_dir), views.trials(spark, sf_dir), session="user_id")


def _kl_sql(c: str) -> str:
    m = {side: f"avg({c}) FILTER ({flag})" for side, flag in (("on", "cs_on"), ("off", "NOT cs_on"))}
    v = {side: f"(var_samp({c}) FILTER ({flag}) + 1e-12)" for side, flag in (("on", "cs_on"), ("off", "NOT cs_on"))}
    return f"0.5 * (ln({v['off']} / {v['on']}) + ({v['on']} + power({m['on']} - {m['off']}, 2)) / {v['off']} - 1)"


_KL_SQL = f"""k AS (SELECT user_id, count(*) FILTER (cs_on) AS n_on, count(*) FILTER (NOT cs_on) AS n_off,
  {", ".join(f"{_kl_sql(c)} AS {c}_kl" for c in views.FEATURES)} FROM l WHERE cs_on IS NOT NULL GROUP BY user_id)"""


@query(f"WITH {LABELLED_SQL}, {_KL_SQL} SELECT user_id, n_on, n_off, round(v_kl, 6) AS v_kl, round(area_kl, 6) AS area_kl, round(angle_kl, 6) AS angle_kl, round(v_kl + area_kl + angle_kl, 6) AS kl FROM k")
def q_kl_diag(spark, sf_dir):
    """Divergence of trial frames from the rest, by subject."""
    out = divergence.gaussian_divergence(_labelled(spark, sf_dir), KEYS, views.FEATURES)
    return rounded(out, "v_kl", "area_kl", "angle_kl", "kl")


@query(f"""WITH {LABELLED_SQL}, {_KL_SQL}, c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'TC' ELSE 'TP' END AS condition, (1 + user_id % 5)::INTEGER AS day, v_kl + area_kl + angle_kl AS kl FROM k)
SELECT condition, day, count(kl) AS n, round(avg(kl), 6) AS mean, round(stddev_samp(kl) / sqrt(count(kl)), 6) AS sem FROM c GROUP BY ALL""")
def q_kl_by_condition(spark, sf_dir):
    """Mean divergence and its error by condition and day: windows, labels, moments, summary."""
    from kestrel.operators import stats

    kl = divergence.gaussian_divergence(_labelled(spark, sf_dir), KEYS, views.FEATURES)
    kl = kl.selectExpr("IF(user_id % 2 = 0, 'TC', 'TP') AS condition", "CAST(1 + user_id % 5 AS INT) AS day", "kl")
    return rounded(stats.mean_sem(kl, ["condition", "day"], "kl"), "mean", "sem").select("condition", "day", "n", "mean", "sem")


@query(f"""WITH {LABELLED_SQL}, c AS (SELECT user_id, cs_on, count(*) AS n, avg(area) AS ma, avg(angle) AS mb, var_samp(area) + 1e-6 AS vaa, var_samp(angle) + 1e-6 AS vbb, covar_samp(area, angle) AS vab FROM l WHERE cs_on IS NOT NULL GROUP BY ALL),
p AS (SELECT x.user_id, x.ma, x.mb, x.vaa, x.vbb, x.vab, y.ma AS ma2, y.mb AS mb2, y.vaa AS waa, y.vbb AS wbb, y.vab AS wab, y.vaa * y.vbb - y.vab * y.vab AS det2, x.vaa * x.vbb - x.vab * x.vab AS det1
  FROM c x JOIN c y ON x.user_id = y.user_id AND x.cs_on AND NOT y.cs_on)
SELECT user_id, round(0.5 * ((wbb * vaa - 2 * wab * vab + waa * vbb) / det2 + (wbb * (ma2 - ma) ** 2 - 2 * wab * (ma2 - ma) * (mb2 - mb) + waa * (mb2 - mb) ** 2) / det2 - 2 + ln(det2 / det1)), 5) AS kl_full FROM p""")
def q_kl_full(spark, sf_dir):
    """Divergence with full covariances of two features."""
    return rounded(divergence.full_divergence(_labelled(spark, sf_dir), KEYS, ["area", "angle"]), "kl_full", digits=5)


@query(f"""WITH {LABELLED_SQL}, n AS (SELECT user_id, max(frame) + 1 AS n FROM l GROUP BY user_id), h AS (SELECT unnest([3, 7, 11])::INTEGER AS shift),
f AS (SELECT l.user_id, shift, (frame + shift) % n.n AS frame, cs_on FROM l JOIN n USING (user_id), h),
j AS (SELECT f.user_id, f.shift, f.cs_on, s.area FROM f JOIN s ON f.user_id = s.user_id AND f.frame = s.frame WHERE f.cs_on IS NOT NULL)
SELECT user_id, shift, round({_kl_sql("area")}, 6) AS kl FROM j GROUP BY ALL""")
def q_circular_null(spark, sf_dir):
    """The null distribution of the divergence by turned labels, for three shifts."""
    return rounded(divergence.shifted_null(_labelled(spark, sf_dir), KEYS, "frame", ["area"], [3, 7, 11]), "kl")


_EVERY_SHIFT_SQL = f"""{LABELLED_SQL}, n AS (SELECT user_id, max(frame) + 1 AS n FROM l GROUP BY user_id),
f AS (SELECT l.user_id, n.n, unnest(range(0, n.n)) AS shift, frame, cs_on FROM l JOIN n USING (user_id) WHERE cs_on IS NOT NULL),
j AS (SELECT f.user_id, f.shift, f.cs_on, s.area, s.angle FROM f JOIN s ON f.user_id = s.user_id AND (f.frame + f.shift) % f.n = s.frame),
c AS (SELECT user_id, shift, {_kl_sql("area")} AS area_kl, {_kl_sql("angle")} AS angle_kl FROM j GROUP BY ALL)"""


@query(f"""WITH {_EVERY_SHIFT_SQL} SELECT user_id, shift, round(area_kl, 6) AS area_kl, round(angle_kl, 6) AS angle_kl, round(area_kl + angle_kl, 6) AS kl FROM c""")
def q_circular_null_every(spark, sf_dir):
    """The null distribution of the divergence of two features by every turn of the labels."""
    return rounded(divergence.circular_null(_labelled(spark, sf_dir), KEYS, "frame", ["area", "angle"]), "area_kl", "angle_kl", "kl")


@query(f"""WITH {_EVERY_SHIFT_SQL}, k AS (SELECT user_id, shift, area_kl + angle_kl AS kl FROM c WHERE area_kl + angle_kl IS NOT NULL),
m AS (SELECT user_id, max(kl) FILTER (shift = 0) AS s, count(*) AS n_shifts, avg(kl) AS null_mean, stddev_pop(kl) AS null_sd FROM k GROUP BY user_id)
SELECT user_id, round(s, 6) AS kl, n_shifts, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd,
  round(count(*) FILTER (kl >= s - 1e-9) / n_shifts, 6) AS p_greater,
  round(count(*) FILTER (abs(kl - null_mean) >= abs(s - null_mean) - 1e-9) / n_shifts, 6) AS p_two_sided
FROM k JOIN m USING (user_id) WHERE s IS NOT NULL GROUP BY user_id, s, n_shifts, null_mean, null_sd""")
def q_circular_p(spark, sf_dir):
    """Whether the divergence is larger than those of turned labels: its p-values by subject."""
    null = divergence.circular_null(_labelled(spark, sf_dir), KEYS, "frame", ["area", "angle"])
    return rounded(divergence.null_p(null, KEYS), "kl", "null_mean", "null_sd", "p_greater", "p_two_sided")


@query(f"WITH {LABELLED_SQL} SELECT user_id, frame, cs_on FROM l")
def q_trial_label_rangejoin(spark, sf_dir):
    """Frames with their class: in a trial, after one, or before the first."""
    return _labelled(spark, sf_dir).select("user_id", "frame", "cs_on")


@query(f"""WITH {SERIES_SQL}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), t AS (SELECT user_id, n, unnest([{{'a': 1, 'e': 14, 'x': 20}}, {{'a': 2, 'e': 29, 'x': 35}}, {{'a': 3, 'e': 41, 'x': NULL}}]) AS g FROM n)
SELECT user_id, g.a::INTEGER AS after_trial, (g.e + 1)::INTEGER AS start_frame, (coalesce(g.x, n) - 1)::BIGINT AS end_frame FROM t WHERE coalesce(g.x, n) - 1 >= g.e + 1""")
def q_complement_gaps(spark, sf_dir):
    """The rest intervals after each trial."""
    lengths = views.series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_frames"))
    return intervals.gaps(views.trials(spark, sf_dir), lengths, session="user_id")


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS trial_num, (epoch_us(ts) // 1000)::DOUBLE AS light, event_id FROM events WHERE event_type = 'purchase'),
q AS (SELECT *, CASE WHEN event_id % 5 > 0 THEN light + 27400 + (event_id % 7) * 100 END AS shock FROM p), r AS (SELECT *, first_value(light) OVER (PARTITION BY user_id ORDER BY trial_num) - 2300 AS began FROM q WHERE shock IS NOT NULL)
SELECT user_id, trial_num, (trunc((light - began) / 1000 * 10) - 5)::INTEGER AS start_frame, (trunc((shock - began) / 1000 * 10) - 1)::INTEGER AS end_frame FROM r""")
def q_trial_windows(spark, sf_dir):
    """Trial windows from a stimulus log; trials without a shock are skipped."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    light = F.expr("CAST(unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 AS DOUBLE)")
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    log = events.select("user_id", number.alias("trial_num"), light.alias("white_light_on"), F.when(F.col("event_id") % 5 > 0, light + 27400 + (F.col("event_id") % 7) * 100).alias("shock_on"))
    return intervals.trial_windows(log, "TC", session="user_id")


@query(f"WITH {SERIES_SQL} SELECT user_id, frame, CASE WHEN NOT (frame BETWEEN 5 AND 14 OR frame BETWEEN 20 AND 29 OR frame BETWEEN 35 AND 41) THEN area END AS area FROM s")
def q_null_ranges(spark, sf_dir):
    """A feature set to null inside listed intervals."""
    cuts = views.trials(spark, sf_dir).selectExpr("user_id", "start_frame AS start", "end_frame AS end")
    return intervals.nulled(views.series(spark, sf_dir), cuts, ["area"], session="user_id").select("user_id", "frame", "area")


@query(f"""WITH {SERIES_SQL}, g AS (SELECT user_id, frame, area, CASE WHEN user_id % 3 = 0 THEN 'late' ELSE 'early' END AS kind FROM s WHERE frame BETWEEN 10 AND 20 AND (user_id + frame) % 2 = 0)
SELECT s.user_id, s.frame, coalesce(CASE WHEN g.kind = 'late' THEN g.area + 2000 WHEN g.kind = 'early' THEN g.area + 1000 END, s.area) AS area FROM s LEFT JOIN g USING (user_id, frame)""")
def q_segment_overwrite(spark, sf_dir):
    """A base series overwritten by segments, of which the last listed one wins."""
    base = views.series(spark, sf_dir).select("user_id", "frame", "area")
    segment = base.where("frame BETWEEN 10 AND 20 AND (user_id + frame) % 2 = 0")
    one = segment.selectExpr("user_id", "frame", "area + 1000 AS area", "1 AS listed")
    two = segment.where("user_id % 3 = 0").selectExpr("user_id", "frame", "area + 2000 AS area", "2 AS listed")
    return intervals.overwritten(base, one.union(two), ["user_id", "frame"], "area", "listed")


_NEAR_SQL = f"""{SERIES_SQL}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1,
  last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS i1 FROM s
  WINDOW b AS (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {_NEAR_SQL} SELECT user_id, frame, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN i1 - i0 - 1 <= 2 THEN v0 + (frame - i0) / (i1 - i0) * (v1 - v0) END, 6) AS filled FROM w""")
def q_gapfill_linear(spark, sf_dir):
    """Gaps of up to two frames on a straight line, flat at the ends."""
    return rounded(series.gap_filled(views.series(spark, sf_dir), KEYS, "frame", "v", "filled", 2), "filled").select("user_id", "frame", "filled")


@query(f"""WITH {_NEAR_SQL.replace("CASE WHEN event_type <> 'error' THEN value END AS v", "CASE WHEN event_type <> 'error' THEN (value * 7) % 180 END AS v")},
c AS (SELECT *, v1 - v0 AS d, (frame - i0) / (i1 - i0) AS r FROM w), f AS (SELECT *, v0 + r * (CASE WHEN d > 90 THEN d - 180 WHEN d < -90 THEN d + 180 ELSE d END) AS x FROM c)
SELECT user_id, frame, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 WHEN i1 - i0 - 1 <= 3 THEN CASE WHEN abs(d) <= 90 THEN x WHEN x < 0 THEN x + 180 WHEN x >= 180 THEN x - 180 ELSE x END END, 6) AS filled FROM f""")
def q_gapfill_angle(spark, sf_dir):
    """Gaps of angles of period 180, the short way round."""
    rows = views.series(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("angle")))
    return rounded(series.angle_gap_filled(rows, KEYS, "frame", "v", "filled", 3), "filled").select("user_id", "frame", "filled")


_GRADIENT_SQL = "CASE WHEN n = 1 THEN NULL WHEN frame = 0 THEN lead({0}) OVER w - {0} WHEN frame = n - 1 THEN {0} - lag({0}) OVER w ELSE (lead({0}) OVER w - lag({0}) OVER w) / 2 END"


@query(f"""WITH {SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s),
g AS (SELECT *, {_GRADIENT_SQL.format("v")} AS d1 FROM n WINDOW w AS (PARTITION BY user_id ORDER BY frame)), h AS (SELECT *, {_GRADIENT_SQL.format("d1")} AS d2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
k AS (SELECT *, stddev_pop(d2) OVER (PARTITION BY user_id) AS sd, lag(v) OVER (PARTITION BY user_id ORDER BY frame) AS p FROM h)
SELECT user_id, frame, round(d1, 6) AS d1, coalesce(d2 > 2 * sd, false) OR (frame > 0 AND p IS NULL AND v IS NOT NULL) AS spike FROM k""")
def q_gradient_spikes(spark, sf_dir):
    """First differences, and jumps by the second difference or after a gap."""
    rows = series.gradient(views.series(spark, sf_dir), KEYS, "frame", "v", "d1")
    return rounded(series.spikes(rows.withColumnRenamed("d1", "first"), KEYS, "frame", "v", "spike", 2.0).withColumnRenamed("first", "d1"), "d1").select("user_id", "frame", "d1", "spike")


def _median_sql(size: int) -> str:
    left, right = size // 2, size - size // 2 - 1
    return f"""WITH {SERIES_SQL}, n AS (SELECT user_id, count(*) AS n, list(area ORDER BY frame) AS a FROM s GROUP BY user_id)
SELECT s.user_id, s.frame, list_sort(list_transform(range(s.frame - {left}, s.frame + {right} + 1), lambda i: a[1 + CASE WHEN i < 0 THEN -1 - i WHEN i >= n THEN 2 * n - 1 - i ELSE i END]))[{size // 2 + 1}] AS smooth
FROM s JOIN n USING (user_id)"""


@query(_median_sql(5))
def q_median5(spark, sf_dir):
    """Five-frame median, the series mirrored at its ends."""
    return series.median_filtered(views.series(spark, sf_dir), KEYS, "frame", "area", "smooth", 5).select("user_id", "frame", "smooth")


@query(_median_sql(20))
def q_median_even(spark, sf_dir):
    """Median over an even window: the upper middle element."""
    return series.median_filtered(views.series(spark, sf_dir), KEYS, "frame", "area", "smooth", 20).select("user_id", "frame", "smooth")


@query(f"""WITH {SERIES_SQL}, m AS (SELECT *, avg(v) OVER p AS mean, stddev_pop(v) OVER p AS sd FROM s WINDOW p AS (PARTITION BY user_id))
SELECT user_id, frame, v IS NULL OR NOT (v BETWEEN mean - 2.5 * sd AND mean + 2.5 * sd) AS outlier FROM m""")
def q_outlier_sigma(spark, sf_dir):
    """Values further than 2.5 deviations from the subject's mean, and missing ones."""
    return series.outliers(views.series(spark, sf_dir), KEYS, "v", "outlier").select("user_id", "frame", "outlier")


def _window_sql(source: str, value: str, size: int, out: str) -> str:
    left, right = size // 2, size - size // 2 - 1
    return f"""SELECT x.*, list_sort(list_transform(range(x.frame - {left}, x.frame + {right} + 1), lambda i: a[1 + CASE WHEN i < 0 THEN -1 - i WHEN i >= n THEN 2 * n - 1 - i ELSE i END]), 'ASC', 'NULLS FIRST')[{size // 2 + 1}] AS {out}
FROM {source} x JOIN (SELECT user_id, count(*) AS n, list({value} ORDER BY frame) AS a FROM {source} GROUP BY user_id) USING (user_id)"""


@query(f"""WITH {SERIES_SQL}, q AS ({_window_sql("s", "area", 5, "smooth")}), r AS ({_window_sql("q", "smooth", 60, "base")}), m AS (SELECT user_id, median(area) AS mid FROM s GROUP BY user_id)
SELECT user_id, frame, area IS NULL OR coalesce(smooth / base < 0.55 AND base - smooth > 0.15 * mid, false) AS occluded FROM r JOIN m USING (user_id)""")
def q_occlusion(spark, sf_dir):
    """Frames whose smoothed level falls under the running level."""
    return series.occluded(views.series(spark, sf_dir), KEYS, "frame", "area", "occluded").select("user_id", "frame", "occluded")


@query(f"""WITH {SERIES_SQL}, x AS (SELECT *, lead(area) OVER w AS nxt, lead(frame) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame)), f AS (SELECT * FROM x WHERE event_type = 'signup')
SELECT f.user_id, f.frame, max(s.frame) AS at FROM f LEFT JOIN s ON f.user_id = s.user_id AND s.frame <= f.frame AND s.frame >= f.frame - 21 AND NOT (f.last AND s.frame = f.frame AND f.frame > 0) AND abs(s.area - coalesce(f.nxt, f.area)) <= 40 GROUP BY ALL""")
def q_asof_prev_level(spark, sf_dir):
    """For each flagged frame the last earlier one at the level that follows it."""
    rows = views.series(spark, sf_dir).withColumn("flag", F.col("event_type") == "signup")
    return series.flagged_levels(rows, KEYS, "frame", "area", "flag", "at", 40.0, 20).select("user_id", "frame", "at")


def _cut_sql(v: str) -> str:
    """SQL for the list v, from frame 0, after the cut from x.s to x.e."""
    line = f"{v}[x.s] + (i - x.s) * ({v}[x.e + 2] - {v}[x.s]) / (x.e - x.s + 2)"
    inside = f"x.s >= 1 AND x.e < len({v}) - 1 AND {v}[x.s] IS NOT NULL AND {v}[x.e + 2] IS NOT NULL"
    return f"CASE WHEN {inside} THEN list_transform({v}, lambda y, i: CASE WHEN i - 1 BETWEEN x.s AND x.e THEN {line} ELSE y END) ELSE {v} END"


_REPAIR_SQL = f"""WITH RECURSIVE {SERIES_SQL},
q AS ({_window_sql("s", "area", 5, "smooth")}), r AS ({_window_sql("q", "smooth", 60, "base")}),
m AS (SELECT user_id, median(area) AS mid, avg(area) AS mean, stddev_pop(area) AS sd, count(*) AS n FROM s GROUP BY user_id),
o AS (SELECT user_id, frame, area, angle, n, area IS NULL OR coalesce(smooth / base < 0.55 AND base - smooth > 0.15 * mid, false)
    OR NOT coalesce(area BETWEEN mean - 2.5 * sd AND mean + 2.5 * sd, false) AS bad FROM r JOIN m USING (user_id)),
g AS (SELECT *, {_GRADIENT_SQL.format("area")} AS d1 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
h AS (SELECT *, {_GRADIENT_SQL.format("d1")} AS d2, lag(area) OVER w AS p, lead(area) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
k AS (SELECT *, stddev_pop(d2) OVER (PARTITION BY user_id) AS d2_sd FROM h),
j AS (SELECT user_id, frame, n, coalesce(nxt, CASE WHEN frame = n - 1 THEN area END) AS target FROM k
    WHERE coalesce(d2 > 8 * d2_sd, false) OR (frame > 0 AND p IS NULL AND area IS NOT NULL)),
c AS (SELECT j.user_id, least(j.frame + 1, j.n - 1) AS pop, max(s.frame) AS back FROM j JOIN s ON s.user_id = j.user_id AND s.frame BETWEEN j.frame - 151 AND j.frame
    AND NOT (j.frame = j.n - 1 AND s.frame = j.frame AND j.frame > 0) AND abs(s.area - j.target) <= 50 GROUP BY j.user_id, j.frame, j.n),
cuts AS (SELECT user_id, list({{'e': pop, 's': CASE WHEN pop - back <= 150 THEN back ELSE pop END}} ORDER BY pop, CASE WHEN pop - back <= 150 THEN back ELSE pop END) AS cut FROM c GROUP BY user_id),
v AS (SELECT user_id, list(CASE WHEN NOT bad THEN area END ORDER BY frame) AS area, list(CASE WHEN NOT bad THEN angle END ORDER BY frame) AS angle FROM o GROUP BY user_id),
z AS (SELECT user_id, area, angle, coalesce(cut, []) AS cut, 1 AS step FROM v LEFT JOIN cuts USING (user_id)
    UNION ALL SELECT user_id, {_cut_sql("area")}, {_cut_sql("angle")}, cut, step + 1 FROM (SELECT *, cut[step] AS x FROM z WHERE step <= len(cut)))
SELECT user_id, frame::INTEGER AS frame, round(area, 6) AS area, round(angle, 6) AS angle
FROM (SELECT user_id, unnest(range(0, len(area))) AS frame, unnest(area) AS area, unnest(angle) AS angle FROM z WHERE step = len(cut) + 1)"""


@query(_REPAIR_SQL)
def q_interval_repair(spark, sf_dir):
    """The cleaned series: outliers and occlusions nulled, jumps interpolated one by one."""
    rows = views.series(spark, sf_dir).select("user_id", "frame", "area", "angle")
    return rounded(series.cleaned(rows, KEYS, "frame", "area", ["area", "angle"]), "area", "angle")


@query(f"""WITH {SERIES_SQL}, z AS (SELECT user_id, event_type, (value - avg(value) OVER p) / CASE WHEN stddev_pop(value) OVER p = 0 THEN 1 ELSE stddev_pop(value) OVER p END AS z FROM s WINDOW p AS (PARTITION BY user_id)),
b AS (SELECT event_type, least(floor((z + 4) / 0.5), 15)::INTEGER AS bin, count(*) AS n FROM z WHERE z BETWEEN -4 AND 4 GROUP BY ALL)
SELECT event_type, bin, round(n / (sum(n) OVER (PARTITION BY event_type) * 0.5), 6) AS density FROM b""")
def q_zscore_hist(spark, sf_dir):
    """Density of the subjects' z-scores on fixed bins, by event type."""
    return rounded(series.density(series.z_scored(views.series(spark, sf_dir), KEYS, "value", "z"), ["event_type"], "z", -4.0, 4.0, 16), "density")


@query(f"""WITH {SERIES_SQL}, m AS (SELECT *, min(value) OVER p AS a, max(value) OVER p AS b FROM s WINDOW p AS (PARTITION BY user_id))
SELECT user_id, frame, CASE WHEN b > a THEN round((value - a) / (b - a), 6) END AS scaled FROM m""")
def q_minmax_segment(spark, sf_dir):
    """Values from 0 to 1 by subject."""
    return rounded(series.min_max_scaled(views.series(spark, sf_dir), KEYS, "value", "scaled"), "scaled").select("user_id", "frame", "scaled")


@query(f"""WITH {LABELLED_SQL}, g AS (SELECT s.user_id, t.start_frame, s.frame - t.start_frame AS place, s.v FROM s, t WHERE s.frame BETWEEN t.start_frame AND t.end_frame),
k AS (SELECT user_id, start_frame FROM g GROUP BY ALL HAVING count(*) FILTER (v IS NULL) <= 0.3 * count(*)) SELECT g.user_id, g.place::INTEGER AS place, round(avg(v), 6) AS mean FROM g JOIN k USING (user_id, start_frame) GROUP BY ALL""")
def q_segment_mean(spark, sf_dir):
    """Mean course of a trial, over the trials that are not mostly missing."""
    rows = views.series(spark, sf_dir).join(views.trials(spark, sf_dir), "user_id").where("frame BETWEEN start_frame AND end_frame")
    return rounded(series.mean_by_place(rows, KEYS, "start_frame", "frame", "v", 0.3), "mean")


@query(f"""WITH {LABELLED_SQL}, g AS (SELECT s.user_id, t.trial_num, avg(s.area) FILTER (s.frame BETWEEN t.start_frame AND t.end_frame) AS a, avg(s.area) FILTER (s.frame NOT BETWEEN t.start_frame AND t.end_frame) AS b FROM s, t GROUP BY ALL)
SELECT user_id, round(avg(a), 6) AS mean_on, round(avg(b), 6) AS mean_off, round(100 * (avg(a) - avg(b)) / avg(b), 6) AS percent FROM g GROUP BY user_id""")
def q_on_off_means(spark, sf_dir):
    """Means of the segments' means in and out of trials, and their difference in percent."""
    rows = views.series(spark, sf_dir).join(views.trials(spark, sf_dir), "user_id")
    inside = F.col("frame").between(F.col("start_frame"), F.col("end_frame"))
    parts = rows.groupBy("user_id", "trial_num").agg(F.avg(F.when(inside, F.col("area"))).alias("a"), F.avg(F.when(~inside, F.col("area"))).alias("b"))
    out = parts.groupBy("user_id").agg(F.avg("a").alias("mean_on"), F.avg("b").alias("mean_off"))
    return rounded(out.withColumn("percent", 100 * (F.col("mean_on") - F.col("mean_off")) / F.col("mean_off")), "mean_on", "mean_off", "percent")


@query(f"""WITH {SERIES_SQL}, c AS (SELECT user_id, count(*) AS n, count(*) FILTER (v IS NULL) AS v, count(*) FILTER (area IS NULL) AS area FROM s GROUP BY user_id)
SELECT user_id, 'v' AS feature, v AS n_null, round(100.0 * v / n, 6) AS null_percent FROM c UNION ALL SELECT user_id, 'area', area, round(100.0 * area / n, 6) FROM c""")
def q_null_report(spark, sf_dir):
    """Missing values of each feature by subject."""
    return rounded(series.null_report(views.series(spark, sf_dir), KEYS, ["v", "area"]), "null_percent")


@query(f"""WITH {SERIES_SQL} SELECT user_id, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(100.0 * count(*) FILTER (v IS NULL) / count(*), 6) AS v_null_percent,
round(avg(angle), 6) AS angle_mean, round(stddev_pop(angle), 6) AS angle_std, round(100.0 * count(*) FILTER (angle IS NULL) / count(*), 6) AS angle_null_percent FROM s GROUP BY user_id""")
def q_feature_summary(spark, sf_dir):
    """Mean, deviation and missing share of each feature by subject."""
    out = series.feature_summary(views.series(spark, sf_dir), KEYS, ["v", "angle"])
    return rounded(out, *[c for c in out.columns if c != "user_id"])


@query("""WITH r AS (SELECT event_type, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS deviation FROM events GROUP BY ALL)
SELECT event_type, CASE WHEN high = low THEN 0 ELSE least(floor((value - low) / (high - low) * 30), 29) END::INTEGER AS bin, low, high, round(mean, 6) AS mean, round(deviation, 6) AS deviation, count(*) AS n FROM events JOIN r USING (event_type) GROUP BY ALL""")
def q_feature_histogram(spark, sf_dir):
    """Thirty equal bins over each type's own range, with the moments for its bounds."""
    return rounded(series.feature_histogram(table(spark, sf_dir, "events"), ["event_type"], "value"), "mean", "deviation")


@query(f"""WITH {SERIES_SQL} SELECT user_id, frame, list(area) OVER w AS joined FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY len(joined) = 3""")
def q_stacked(spark, sf_dir):
    """Each frame's state joined with those of the next two."""
    rows = views.series(spark, sf_dir).withColumn("state", F.array("area"))
    return series.stacked(rows, KEYS, "frame", "state", "joined", 3).select("user_id", "frame", "joined")


@query(f"WITH {SERIES_SQL} SELECT user_id, frame, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS filled FROM s")
def q_ffill(spark, sf_dir):
    """Missing values as the last one before them."""
    from kestrel.operators import reshape

    rows = views.series(spark, sf_dir).select("user_id", "frame", F.col("v").alias("filled"))
    return reshape.filled_down(rows, KEYS, "frame", ["filled"])


@query(f"""WITH {SERIES_SQL}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id), t AS (SELECT * FROM (VALUES (1, 5, 14), (2, 20, 29), (3, 35, 61)) x(trial_num, start_frame, end_frame))
SELECT user_id, trial_num, start_frame, end_frame, end_frame >= n AS bad FROM n, t""")
def q_trial_validation(spark, sf_dir):
    """Trials that end after the series (the operator checked_windows makes such an error)."""
    lengths = views.series(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_frames"))
    rows = views.trials(spark, sf_dir).withColumn("end_frame", F.when(F.col("trial_num") == 3, 61).otherwise(F.col("end_frame")))
    return rows.join(lengths, "user_id").select("user_id", "trial_num", "start_frame", "end_frame", intervals.outside("start_frame", "end_frame", "n_frames").alias("bad"))
