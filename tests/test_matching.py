"""Matching by islands against plain forms that know no islands."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import matching


def table(spark, lists):
    """events of {(video, scorer): times}; the places in a list need not follow the times."""
    rows = [(v, "turn", s, i, t) for (v, s), times in lists.items() for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "video string, event_type string, scorer string, idx int, t int")


def plain_matches(ref, test, limit):
    near = sorted((abs(t - r), j, i) for j, t in enumerate(test) for i, r in enumerate(ref) if abs(t - r) <= limit)
    out = []
    for d, j, i in near:
        if all(j != k[1] and i != k[2] for k in out):
            out.append((d, j, i))
    return out


def plain_unanimity(one, two, three, limit):
    """Every triplet of the three lists, then every pair, in the published order."""
    found = []
    for (a, x), (b, y), (c, z) in itertools.product(*map(enumerate, (one, two, three))):
        d = [abs(x - y), abs(x - z), abs(y - z)]
        passing = [v <= limit for v in d]
        if sum(passing) in (1, 3):
            kind = "s123" if sum(passing) == 3 else ("s12", "s13", "s23")[passing.index(True)]
            found.append((0, max(d) - min(d), sum(d), 0, a, b, c, kind))
    for rank, (p, q) in enumerate(((0, 1), (0, 2), (1, 2)), 1):
        for (i, x), (j, y) in itertools.product(enumerate((one, two, three)[p]), enumerate((one, two, three)[q])):
            if abs(x - y) <= limit:
                places = [-1, -1, -1]
                places[p], places[q] = i, j
                found.append((1, 0, abs(x - y), rank, *places, ("s12", "s13", "s23")[rank - 1]))
    used, counts = [set(), set(), set()], dict.fromkeys(("s123", "s12", "s13", "s23"), 0)
    for *_, a, b, c, kind in sorted(found):
        if not any(i >= 0 and i in u for i, u in zip((a, b, c), used)):
            for i, u in zip((a, b, c), used):
                u.add(i)
            counts[kind] += 1
    return tuple(counts.values())


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(8)
    out = {}
    for v in range(120):
        span = rng.choice([20, 60, 300, 2000])
        for s in ("A", "B", "C"):
            times = [rng.randrange(span) for _ in range(rng.randrange(9))]
            if times:
                out[f"v{v}", s] = times if v % 3 else sorted(times)
    return out


def test_matches(spark, lists):
    events = table(spark, lists)
    pairs = matching.scored_pairs(events, ["turn"], ["A", "B", "C"])
    got = {(r.video, r.ref, r.test): r for r in matching.matched(events, pairs, F.lit(10)).collect()}
    assert len(got) == 3 * len({v for v, _ in lists})
    for (v, ref, test), r in got.items():
        a, b = lists.get((v, ref), []), lists.get((v, test), [])
        want = plain_matches(a, b, 10)
        assert [tuple(m) for m in r.matches] == want
        assert (r.tp, r.fp, r.fn) == (len(want), len(b) - len(want), len(a) - len(want))
    rows = matching.match_rows(events, pairs, F.lit(10)).groupBy("video", "ref", "test").count().collect()
    assert {(r.video, r.ref, r.test): r["count"] for r in rows} == {k: r.tp for k, r in got.items() if r.tp}


def test_unanimity(spark, lists):
    got = {r.video: r for r in matching.unanimity(table(spark, lists), ["A", "B", "C"], F.lit(10)).collect()}
    for v in {v for v, _ in lists}:
        three = [lists.get((v, s), []) for s in "ABC"]
        assert (v in got) == (sum(map(bool, three)) >= 2)
        if v in got:
            r = got[v]
            assert (r.s123, r.s12, r.s13, r.s23) == plain_unanimity(*three, 10)
            assert (r.s1_raw, r.s2_raw, r.s3_raw) == tuple(map(len, three))


def test_the_rest_of_many_random_lists():
    """The waiting pairs give what all triplets and pairs in order give, ties of all kinds included."""
    rng = random.Random(9)
    for case in range(3000):
        limit, span = rng.choice([0, 1, 5, 10]), rng.choice([8, 30, 200])
        three = [[rng.randrange(span) for _ in range(rng.randrange(8))] for _ in range(3)]
        events = [sorted((t, i) for i, t in enumerate(x)) for x in three]
        taken = matching.common_events(*events, limit)
        left = [[e for e in x if e[1] not in {t[k] for t in taken}] for k, x in enumerate(events)]
        assert (len(taken), *matching.events_of_two(left, limit)) == plain_unanimity(*three, limit)


def test_islands(spark):
    marks = table(spark, {("v", "A"): [0, 5, 40], ("v", "B"): [15, 15, 26, 41], ("w", "A"): [7]}).withColumn("limit", F.lit(10))
    got = {(r.video, r.scorer, r.idx): r.island for r in matching.islands(marks, ["video"]).collect()}
    assert got == {("v", "A", 0): 0, ("v", "A", 1): 0, ("v", "B", 0): 0, ("v", "B", 1): 0, ("v", "B", 2): 1, ("v", "A", 2): 2, ("v", "B", 3): 2, ("w", "A", 0): 0}


def test_missing_times_and_empty_tables(spark):
    events = table(spark, {("v", "A"): [3, None], ("v", "B"): [None, 4, None]})
    pairs = matching.scored_pairs(events, ["turn"], ["A", "B"])
    r = matching.matched(events, pairs, F.lit(10)).first()
    assert (r.tp, r.fp, r.fn, [tuple(m) for m in r.matches]) == (1, 2, 1, [(1, 1, 0)])
    u = matching.unanimity(events, ["A", "B", "C"], F.lit(10)).first()
    assert (u.s123, u.s12, u.s1_raw, u.s2_raw, u.s3_raw) == (0, 1, 2, 3, 0)
    assert matching.matched(events.limit(0), pairs.limit(0), F.lit(10)).collect() == []
    assert matching.unanimity(events.limit(0), ["A", "B", "C"], F.lit(10)).collect() == []


def test_a_hundred_thousand_marks_in_one_video(spark):
    """Most in islands of their own, ten thousand of each scorer in one without a gap."""
    one = spark.range(100_000).select(F.when(F.col("id") < 90_000, F.col("id") * 40).otherwise(3_600_000 + (F.col("id") - 90_000) * 7).cast("int").alias("x"), "id")
    shifts = F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.lit(d).alias("d")) for s, d in (("A", 0), ("B", 1), ("C", 2))]))
    events = one.select("x", "id", shifts.alias("s")).selectExpr("'v' AS video", "'turn' AS event_type", "s.scorer AS scorer", "CAST(id AS INT) AS idx", "CAST(x + s.d AS INT) AS t")
    found = matching.matched(events, matching.scored_pairs(events, ["turn"], ["A", "B", "C"]), F.lit(10)).select("ref", "test", "tp").collect()
    assert {(r.ref, r.test): r.tp for r in found} == {("A", "B"): 100_000, ("A", "C"): 100_000, ("B", "C"): 100_000}
    r = matching.unanimity(events, ["A", "B", "C"], F.lit(10)).first()
    assert (r.s123, r.s12, r.s13, r.s23, r.total_unique) == (100_000, 0, 0, 0, 100_000)
