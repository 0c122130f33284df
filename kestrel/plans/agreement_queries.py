"""Queries on scored events: matches, reliability, unanimity."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import matching
from kestrel.plans import views
from kestrel.plans.registry import query, rounded
from kestrel.plans.views import MARKS_SQL

SCORERS = ["S1", "S2", "S3"]
TYPES = ["turn", "contraction"]


def _limit():
    return F.when(F.col("event_type") == "turn", 10).otherwise(15)


def _matched(spark, sf_dir):
    events = views.marks(spark, sf_dir)
    return events, matching.matched(events, matching.scored_pairs(events, TYPES, SCORERS), _limit())


def _lost(spark, sf_dir):
    events = views.marks(spark, sf_dir)
    return matching.orphans(events, matching.match_rows(events, matching.scored_pairs(events, TYPES, SCORERS), _limit()))


_MATCH_SQL = f"""{MARKS_SQL}, p AS (SELECT DISTINCT e.video, y.event_type, z.ref, z.test FROM e, (VALUES ('turn'), ('contraction')) y(event_type), (VALUES ('S1', 'S2'), ('S1', 'S3'), ('S2', 'S3')) z(ref, test)),
n AS (SELECT video, event_type, scorer, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT a.video, a.event_type, a.scorer AS ref, b.scorer AS test, list({{'d': abs(b.t - a.t), 'j': b.idx, 'i': a.idx}} ORDER BY abs(b.t - a.t), b.idx, a.idx) AS l
  FROM e a JOIN e b ON a.video = b.video AND a.event_type = b.event_type AND a.scorer < b.scorer AND abs(b.t - a.t) <= CASE a.event_type WHEN 'turn' THEN 10 ELSE 15 END GROUP BY ALL),
g AS (SELECT * EXCLUDE l, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.j = x[1].j OR k.i = x[1].i)) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM c),
f AS (SELECT p.*, coalesce(len(g.m), 0)::INTEGER AS tp, (coalesce(t.n, 0) - coalesce(len(g.m), 0))::INTEGER AS fp, (coalesce(r.n, 0) - coalesce(len(g.m), 0))::INTEGER AS fn, g.m FROM p LEFT JOIN g USING (video, event_type, ref, test)
  LEFT JOIN n r ON r.video = p.video AND r.event_type = p.event_type AND r.scorer = p.ref LEFT JOIN n t ON t.video = p.video AND t.event_type = p.event_type AND t.scorer = p.test),
w AS (SELECT video, event_type, ref, test, tp, fp, fn FROM f UNION ALL SELECT video, event_type, test, ref, tp, fn, fp FROM f)"""
_POOLED_SQL = """pooled AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (SELECT ref, test, event_type,
  CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END AS precision, CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0 END AS recall FROM w GROUP BY ALL))"""
_VIDEO_SQL = """v AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM w),
byvideo AS (SELECT ref, test, event_type, avg(p) AS precision, avg(r) AS recall, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1 FROM v GROUP BY ALL)"""


@query(f"WITH {_MATCH_SQL} SELECT video, event_type, ref, test, tp, fp, fn FROM f")
def q_match_greedy(spark, sf_dir):
    """Greedy one-to-one matches of each pair of scorers: hits, extra and missed events."""
    return _matched(spark, sf_dir)[1].select("video", "event_type", "ref", "test", "tp", "fp", "fn")


@query(f"WITH {_MATCH_SQL}, {_POOLED_SQL} SELECT ref, test, event_type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pooled")
def q_f1_macro(spark, sf_dir):
    """Precision, recall and F1 of the counts over all videos, for ordered pairs."""
    out = matching.f1_pooled(matching.both_ways(_matched(spark, sf_dir)[1]))
    return rounded(out, "precision", "recall", "f1").select("ref", "test", "event_type", "precision", "recall", "f1")


@query(f"WITH {_MATCH_SQL}, {_VIDEO_SQL} SELECT ref, test, event_type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM byvideo")
def q_f1_micro(spark, sf_dir):
    """Means over videos of precision, recall and F1."""
    out = matching.f1_by_video(matching.both_ways(_matched(spark, sf_dir)[1]))
    return rounded(out, "precision", "recall", "f1").drop("n_videos")


@query(f"""WITH {_MATCH_SQL}, {_POOLED_SQL}, {_VIDEO_SQL} SELECT ref, test, event_type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, 'macro' AS kind FROM pooled
UNION ALL SELECT ref, test, event_type, round(precision, 6), round(recall, 6), round(f1, 6), 'micro' FROM byvideo""")
def q_f1_both(spark, sf_dir):
    """Both forms of F1 for all ordered pairs and types."""
    return rounded(matching.f1_both(matching.both_ways(_matched(spark, sf_dir)[1])), "precision", "recall", "f1")


@query(f"""WITH {_MATCH_SQL}, {_POOLED_SQL} SELECT ref, CASE WHEN ref = 'S1' THEN 1.0::DOUBLE ELSE max(f1) FILTER (test = 'S1') END AS S1, CASE WHEN ref = 'S2' THEN 1.0::DOUBLE ELSE max(f1) FILTER (test = 'S2') END AS S2,
CASE WHEN ref = 'S3' THEN 1.0::DOUBLE ELSE max(f1) FILTER (test = 'S3') END AS S3 FROM (SELECT ref, test, round(f1, 6) AS f1 FROM pooled WHERE event_type = 'turn') GROUP BY ref""")
def q_f1_matrix(spark, sf_dir):
    """F1 of turns as a matrix of scorers, 1 on the diagonal."""
    scores = rounded(matching.f1_both(matching.both_ways(_matched(spark, sf_dir)[1])), "f1")
    return matching.f1_matrix(scores, SCORERS, "turn")


_LOST_SQL = f"""{_MATCH_SQL}, used AS (SELECT video, event_type, ref AS scorer, unnest(m).i AS idx FROM f WHERE m IS NOT NULL UNION SELECT video, event_type, test, unnest(m).j FROM f WHERE m IS NOT NULL),
lost AS (SELECT * FROM e ANTI JOIN used USING (video, event_type, scorer, idx)),
crossed AS (SELECT a.video, a.scorer AS first_scorer, b.scorer AS second_scorer, a.t AS first_t, b.t AS second_t, abs(a.t - b.t) AS distance FROM lost a JOIN lost b ON a.video = b.video AND a.event_type = 'turn' AND b.event_type = 'contraction' AND a.scorer <> b.scorer AND abs(a.t - b.t) <= 10)"""


@query(f"WITH {_LOST_SQL} SELECT video, event_type, scorer, idx, t FROM lost")
def q_orphans(spark, sf_dir):
    """Events that no other scorer has."""
    return _lost(spark, sf_dir).select("video", "event_type", "scorer", "idx", "t")


@query(f"WITH {_LOST_SQL} SELECT * FROM crossed")
def q_orphans_cross_type(spark, sf_dir):
    """Turns and contractions of different scorers that may be one event."""
    return matching.cross_type(_lost(spark, sf_dir), 10)


_RELIABLE_SQL = f"""{_LOST_SQL}, sums AS (SELECT ref, test, event_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM w GROUP BY ALL), xs AS (SELECT first_scorer, second_scorer, count(*) AS x FROM crossed GROUP BY ALL),
rel AS (SELECT ref, test, event_type, tp + fn AS total_ref, tp + fp AS total_test, tp AS matched, fn AS unmatched_ref, fp AS unmatched_test, coalesce(x, 0) AS cross_confused,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision FROM sums LEFT JOIN xs ON first_scorer = CASE event_type WHEN 'turn' THEN ref ELSE test END AND second_scorer = CASE event_type WHEN 'turn' THEN test ELSE ref END)"""


@query(f"""WITH {_RELIABLE_SQL} SELECT * EXCLUDE (recall, precision), round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
round(CASE WHEN total_ref > 0 THEN unmatched_ref / total_ref ELSE 0 END, 6) AS miss_rate, round(CASE WHEN unmatched_ref > 0 THEN cross_confused / unmatched_ref ELSE 0 END, 6) AS confusion_rate FROM rel""")
def q_reliability_pairs(spark, sf_dir):
    """Totals and rates of agreement for ordered pairs of scorers."""
    out = matching.reliability(matching.both_ways(_matched(spark, sf_dir)[1]), matching.cross_type(_lost(spark, sf_dir), 10))
    return rounded(out, "recall", "precision", "f1", "miss_rate", "confusion_rate")


@query(f"""WITH {_RELIABLE_SQL}, x AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN total_ref > 0 THEN unmatched_ref / total_ref ELSE 0 END AS miss_rate FROM rel)
SELECT ref, test, event_type, printf('%s vs %s, %s: matched %d of %d (recall %.3f), precision %.3f, F1 %.3f, missed %.3f', ref, test, event_type, matched, total_ref, round(recall, 3)::DOUBLE, round(precision, 3)::DOUBLE, round(f1, 3)::DOUBLE, round(miss_rate, 3)::DOUBLE) AS line FROM x""")
def q_reliability_report(spark, sf_dir):
    """The same as lines of text."""
    return matching.reliability_report(matching.reliability(matching.both_ways(_matched(spark, sf_dir)[1]), matching.cross_type(_lost(spark, sf_dir), 10)))


@query(f"""WITH {MARKS_SQL}, u AS (SELECT video, event_type, list({{'i': idx, 't': t}} ORDER BY idx) FILTER (scorer = 'S1') AS s1, list({{'i': idx, 't': t}} ORDER BY idx) FILTER (scorer = 'S2') AS s2, list({{'i': idx, 't': t}} ORDER BY idx) FILTER (scorer = 'S3') AS s3,
  CASE event_type WHEN 'turn' THEN 10 ELSE 15 END AS lim FROM e GROUP BY ALL HAVING (s1 IS NOT NULL)::INTEGER + (s2 IS NOT NULL)::INTEGER + (s3 IS NOT NULL)::INTEGER >= 2),
k AS (SELECT u.video, u.event_type, lim, 0 AS rank, a.a.i AS a, b.b.i AS b, c.c.i AS c, greatest(abs(a.a.t - b.b.t), abs(a.a.t - c.c.t), abs(b.b.t - c.c.t)) - least(abs(a.a.t - b.b.t), abs(a.a.t - c.c.t), abs(b.b.t - c.c.t)) AS spread,
    abs(a.a.t - b.b.t) + abs(a.a.t - c.c.t) + abs(b.b.t - c.c.t) AS total, abs(a.a.t - b.b.t) <= lim AS p12, abs(a.a.t - c.c.t) <= lim AS p13, abs(b.b.t - c.c.t) <= lim AS p23 FROM u, unnest(s1) a(a), unnest(s2) b(b), unnest(s3) c(c)
  UNION ALL SELECT x.video, x.event_type, CASE x.event_type WHEN 'turn' THEN 10 ELSE 15 END, CASE WHEN y.scorer = 'S2' THEN 1 WHEN x.scorer = 'S1' THEN 2 ELSE 3 END, CASE WHEN x.scorer = 'S1' THEN x.idx ELSE -1 END, CASE WHEN x.scorer = 'S2' THEN x.idx WHEN y.scorer = 'S2' THEN y.idx ELSE -1 END, CASE WHEN y.scorer = 'S3' THEN y.idx ELSE -1 END, 0, abs(x.t - y.t),
    x.scorer = 'S1' AND y.scorer = 'S2', x.scorer = 'S1' AND y.scorer = 'S3', x.scorer = 'S2' FROM e x JOIN e y ON x.video = y.video AND x.event_type = y.event_type AND x.scorer < y.scorer AND abs(x.t - y.t) <= CASE x.event_type WHEN 'turn' THEN 10 ELSE 15 END),
g AS (SELECT video, event_type, list({{'a': a, 'b': b, 'c': c, 'k': CASE WHEN p12 AND p13 AND p23 THEN 's123' WHEN p12 THEN 's12' WHEN p13 THEN 's13' ELSE 's23' END}} ORDER BY rank > 0, spread, total, rank, a, b, c) AS l FROM k WHERE p12::INTEGER + p13::INTEGER + p23::INTEGER IN (1, 3) GROUP BY ALL),
h AS (SELECT video, event_type, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: (q.a >= 0 AND q.a = x[1].a) OR (q.b >= 0 AND q.b = x[1].b) OR (q.c >= 0 AND q.c = x[1].c))) > 0 THEN acc ELSE list_concat(acc, x) END) AS m FROM g),
r AS (SELECT u.video, u.event_type, coalesce(len(list_filter(m, lambda q: q.k = 's123')), 0)::INTEGER AS s123, coalesce(len(list_filter(m, lambda q: q.k = 's12')), 0)::INTEGER AS s12, coalesce(len(list_filter(m, lambda q: q.k = 's13')), 0)::INTEGER AS s13,
  coalesce(len(list_filter(m, lambda q: q.k = 's23')), 0)::INTEGER AS s23, coalesce(len(s1), 0)::INTEGER AS s1_raw, coalesce(len(s2), 0)::INTEGER AS s2_raw, coalesce(len(s3), 0)::INTEGER AS s3_raw FROM u LEFT JOIN h USING (video, event_type)),
z AS (SELECT *, s1_raw + s2_raw + s3_raw - (s12 + s123) - (s13 + s123) - (s23 + s123) + s123 AS total_unique FROM r)
SELECT *, round(CASE WHEN total_unique > 0 THEN s123 / total_unique ELSE 0 END, 6) AS unanimity_rate FROM z""")
def q_unanimity(spark, sf_dir):
    """Events that all three scorers, two, or one have, by video and type."""
    return rounded(matching.unanimity(views.marks(spark, sf_dir), SCORERS, _limit()), "unanimity_rate")


@query(f"""WITH {MARKS_SQL} SELECT a.video, a.event_type, a.t AS t1, b.t AS t2, c.t AS t3, abs(a.t - b.t) <= 10 AS p12, abs(a.t - c.t) <= 10 AS p13, abs(b.t - c.t) <= 10 AS p23
FROM e a JOIN e b ON a.video = b.video AND a.event_type = b.event_type AND a.scorer = 'S1' AND b.scorer = 'S2' JOIN e c ON a.video = c.video AND a.event_type = c.event_type AND c.scorer = 'S3' WHERE p12 OR p13 OR p23""")
def q_scorer_triplets(spark, sf_dir):
    """Triplets of the three scorers' events within a video of which a distance passes."""
    return matching.triplets(views.marks(spark, sf_dir), SCORERS, 10)


@query(f"""WITH {MARKS_SQL} SELECT video, count(*) FILTER (scorer = 'S1') AS n1, count(*) FILTER (scorer = 'S2') AS n2, count(*) FILTER (scorer = 'S3') AS n3 FROM e GROUP BY video HAVING n1 > 0 AND n2 > 0 AND n3 > 0""")
def q_three_way_inner(spark, sf_dir):
    """Videos that all three scorers have, with their numbers of events."""
    events = views.marks(spark, sf_dir)
    out = None
    for k, s in enumerate(SCORERS, 1):
        sheet = events.where(F.col("scorer") == s).groupBy("video").agg(F.count("*").alias(f"n{k}"))
        out = sheet if out is None else out.join(sheet, "video")
    return out


@query(f"""WITH {_MATCH_SQL}, q AS (SELECT video, sum(tp) AS m, sum(fn) AS missed FROM f GROUP BY video) SELECT count(*) AS n_videos, sum(m)::BIGINT AS matched, sum(missed)::BIGINT AS missed, round(avg(m), 6) AS matched_per_video FROM q""")
def q_batch_summary(spark, sf_dir):
    """Totals and averages over all videos."""
    by_video = _matched(spark, sf_dir)[1].groupBy("video").agg(F.sum("tp").alias("m"), F.sum("fn").alias("missed"))
    return rounded(by_video.agg(F.count("*").alias("n_videos"), F.sum("m").alias("matched"), F.sum("missed").alias("missed"), F.avg("m").alias("matched_per_video")), "matched_per_video")


@query("""SELECT 'V' || (event_id // 60) AS video, event_type, list_sort(list_distinct(list((event_id % 60)::INTEGER // 4))) AS frames, count(DISTINCT (event_id % 60) // 4)::INTEGER AS n FROM events GROUP BY ALL""")
def q_event_marks(spark, sf_dir):
    """Marks set while scoring: a frame holds one mark of a type at most."""
    from kestrel.plans.registry import table

    marks = table(spark, sf_dir, "events").selectExpr("concat('V', event_id DIV 60) AS video", "event_type", "CAST((event_id % 60) DIV 4 AS INT) AS frame")
    return matching.mark_lists(marks, ["video", "event_type"], "frame")
