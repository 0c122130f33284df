"""Agreement of scorers on events: greedy one-to-one matches, reliability and unanimity.

events has one row for each scored event: video, event_type, scorer, idx (place in the
scorer's list, from 0) and t. Events farther apart than the limit can never be matched, so the
merged marks of a video are cut into islands wherever the next one is beyond the limit, and each
island is matched alone: nothing holds the list of a whole video. What is taken first decides what is left, which
no built-in function folds in less than quadratic time; a small function does it, for many
islands at a time.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["video", "event_type"]


def events_of(sheet: DataFrame, scorer: str, lists: dict[str, str], video: str = "video") -> DataFrame:
    """events from a sheet with a list column for each event type."""
    parts = [sheet.select(F.col(video).alias("video"), F.lit(kind).alias("event_type"), F.lit(scorer).alias("scorer"), F.posexplode(c).alias("idx", "t")) for kind, c in lists.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored_pairs(videos: DataFrame, event_types: list[str], scorers: list[str]) -> DataFrame:
    """video, event_type, ref and test for each pair of scorers in order, for every video."""
    pairs = F.array(*[F.struct(F.lit(a).alias("ref"), F.lit(b).alias("test")) for i, a in enumerate(scorers) for b in scorers[i + 1 :]])
    kinds = F.explode(F.array(*map(F.lit, event_types)))
    return videos.select("video").distinct().withColumn("event_type", kinds).select(*KEYS, F.explode(pairs).alias("p")).select(*KEYS, "p.*")


def islands(events: DataFrame, keys: list[str], limit: str = "limit", t: str = "t") -> DataFrame:
    """events with island (from 0): a new one begins where the next event of the keys is farther than
    `limit` from the last one. Events without a time are in the first island."""
    order = W.partitionBy(*keys).orderBy(t)
    far = F.coalesce(F.col(t) - F.lag(t).over(order) > F.col(limit), F.lit(False))
    # The frame takes in all events of one time, so that these share an island in any order.
    return events.withColumn("far", far.cast("int")).withColumn("island", F.sum("far").over(order)).drop("far")


def _events(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Each row's events as (t, idx)."""
    values = pc.list_flatten(column)
    pairs = list(zip(pc.struct_field(values, "t").to_pylist(), pc.struct_field(values, "idx").to_pylist()))
    start = 0
    for n in pc.list_value_length(column).to_pylist():
        yield pairs[start : start + n]
        start += n


def _times(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Each row's events in order, without those that have no time."""
    return (sorted(e for e in events if e[0] is not None) for events in _events(column))


def _near(one: list, two: list, limit: float) -> Iterator[tuple]:
    """(x, y) for the events x of one and y of two within the limit; both are in order."""
    low = 0
    for x in one:
        while low < len(two) and two[low][0] < x[0] - limit:
            low += 1
        for k in range(low, len(two)):
            if two[k][0] > x[0] + limit:
                break
            yield x, two[k]


def _map(rows: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, keys: list[str]) -> DataFrame:
    """The keys of rows, and the columns that function makes of a batch, whose names and types schema gives."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = {k: batch.column(k) for k in keys} | function(batch)
                yield pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, list) else v for v in made.values()], list(made))

    return rows.mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema]))


PAIR = [*KEYS, "ref", "test"]
_MATCHES = pa.list_(pa.struct([("diff", pa.int32()), ("test_idx", pa.int32()), ("ref_idx", pa.int32())]))
_FOUND = pa.list_(pa.struct([("ref", pa.string()), ("test", pa.string()), ("n_ref", pa.int32()), ("n_test", pa.int32()), ("tp", pa.int32()), ("matches", _MATCHES)]))


def nearest_first(ref: list, test: list, limit: float) -> list[dict]:
    """The events (t, idx) of two lists matched one to one: nearest first, of equal distances the lower
    test and then reference index first."""
    out, used_test, used_ref = [], set(), set()
    for diff, j, i in sorted((abs(x[0] - y[0]), x[1], y[1]) for x, y in _near(test, ref, limit)):
        if j not in used_test and i not in used_ref:
            used_test.add(j)
            used_ref.add(i)
            out.append({"diff": diff, "test_idx": j, "ref_idx": i})
    return out


def _matched_islands(events: DataFrame, pairs: DataFrame, threshold: Column) -> DataFrame:
    """A row for each island of a pair of scorers: the pair, n_ref, n_test, tp and matches. All pairs
    of a video share its islands, so that its marks are ordered once."""
    marks = events.select(*KEYS, "scorer", F.col("idx").cast("int").alias("idx"), F.col("t").cast("int").alias("t"), threshold.cast("double").alias("limit"))
    grouped = islands(marks, KEYS).groupBy(*KEYS, "island", "limit").agg(F.collect_list(F.struct("t", "idx", "scorer")).alias("l"))
    wanted = pairs.groupBy(*KEYS).agg(F.collect_set(F.struct("ref", "test")).alias("pairs"))

    def match(batch):
        scorers = iter(pc.struct_field(pc.list_flatten(batch.column("l")), "scorer").to_pylist())
        out = []
        for marks, asked, limit in zip(_events(batch.column("l")), batch.column("pairs").to_pylist(), batch.column("limit").to_pylist()):
            lists: dict[str, list] = {}
            for mark in marks:
                lists.setdefault(next(scorers), []).append(mark)
            timed = {s: sorted(m for m in l if m[0] is not None) for s, l in lists.items()}
            for p in asked:
                found = nearest_first(timed.get(p["ref"], []), timed.get(p["test"], []), limit)
                p |= {"n_ref": len(lists.get(p["ref"], [])), "n_test": len(lists.get(p["test"], [])), "tp": len(found), "matches": found}
            out.append(asked)
        return {"found": pa.array(out, _FOUND)}

    kind = "array<struct<ref:string,test:string,n_ref:int,n_test:int,tp:int,matches:array<struct<diff:int,test_idx:int,ref_idx:int>>>>"
    return _map(grouped.join(wanted, KEYS), match, f"found {kind}", KEYS).select(*KEYS, F.inline("found"))


def match_rows(events: DataFrame, pairs: DataFrame, threshold: Column) -> DataFrame:
    """A row for each match of each pair: video, event_type, ref, test, diff, test_idx and ref_idx."""
    return _matched_islands(events, pairs, threshold).select(*PAIR, F.inline("matches"))


def matched(events: DataFrame, pairs: DataFrame, threshold: Column) -> DataFrame:
    """pairs with matches (array of diff, test_idx, ref_idx), tp, fp and fn: each pair's events
    matched one to one, nearest first; of equal distances the lower test and then reference
    index first. threshold, an expression of event_type, bounds the distance. Where only counts
    are read, the arrays are never gathered."""
    found = _matched_islands(events, pairs, threshold).groupBy(*PAIR)
    found = found.agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"), *[F.sum(c).cast("int").alias(c) for c in ("tp", "n_ref", "n_test")])
    none = F.array().cast("array<struct<diff:int,test_idx:int,ref_idx:int>>")
    rows = pairs.select(*PAIR).join(found, PAIR, "left").withColumns({"matches": F.coalesce("matches", none), **{c: F.coalesce(c, F.lit(0)) for c in ("tp", "n_ref", "n_test")}})
    return rows.select(*PAIR, "matches", "tp", F.expr("n_test - tp").alias("fp"), F.expr("n_ref - tp").alias("fn"))


def both_ways(counts: DataFrame) -> DataFrame:
    """counts (video, event_type, ref, test, tp, fp, fn) and the same with the roles swapped."""
    way = lambda ref, test, fp, fn: F.struct(F.col(ref).alias("ref"), F.col(test).alias("test"), "tp", F.col(fp).alias("fp"), F.col(fn).alias("fn"))
    return counts.select(*KEYS, F.inline(F.array(way("ref", "test", "fp", "fn"), way("test", "ref", "fn", "fp"))))


def ratio(top, bottom, otherwise: float = 0.0) -> Column:
    return F.when(F.expr(bottom) > 0, F.expr(top) / F.expr(bottom)).otherwise(otherwise)


def _f1(precision: str = "precision", recall: str = "recall") -> Column:
    return ratio(f"2 * {precision} * {recall}", f"{precision} + {recall}")


def _pooled() -> tuple[list[Column], dict[str, Column]]:
    """Sums of counts, and the rates of these sums."""
    return [F.sum(c).alias(c) for c in ("tp", "fp", "fn")], {"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn")}


def _rates(counts: DataFrame) -> DataFrame:
    """counts with the rates p, r and f of each video; one where both lists are empty is 1."""
    none = F.expr("tp + fp + fn = 0")
    rows = counts.withColumns({"p": F.when(none, 1.0).otherwise(ratio("tp", "tp + fp")), "r": F.when(none, 1.0).otherwise(ratio("tp", "tp + fn"))})
    return rows.withColumn("f", _f1("p", "r"))


def f1_pooled(counts: DataFrame) -> DataFrame:
    """ref, test, event_type, tp, fp, fn, precision, recall and f1 of the counts' sums."""
    sums, rates = _pooled()
    return counts.groupBy("ref", "test", "event_type").agg(*sums).withColumns(rates).withColumn("f1", _f1())


def f1_by_video(counts: DataFrame) -> DataFrame:
    """Means over videos of precision, recall and f1; a video where both lists are empty is 1."""
    return _rates(counts).groupBy("ref", "test", "event_type").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"), F.count("*").alias("n_videos"))


def f1_both(counts: DataFrame) -> DataFrame:
    """The two forms in one table, from one pass. Their names are the published ones: "macro" pools the
    counts, "micro" averages videos, the other way round than usual."""
    sums, rates = _pooled()
    means = [F.avg(c).alias(f"mean_{c}") for c in "prf"]
    rows = _rates(counts).groupBy("ref", "test", "event_type").agg(*sums, *means).withColumns(rates).withColumn("f1", _f1())
    micro = F.struct(F.col("mean_p").alias("precision"), F.col("mean_r").alias("recall"), F.col("mean_f").alias("f1"), F.lit("micro").alias("kind"))
    return rows.select("ref", "test", "event_type", F.inline(F.array(F.struct("precision", "recall", "f1", F.lit("macro").alias("kind")), micro)))


def f1_matrix(scores: DataFrame, scorers: list[str], event_type: str, kind: str = "macro") -> DataFrame:
    """A row for each ref with a column for each test, 1 on the diagonal."""
    rows = scores.where((F.col("event_type") == event_type) & (F.col("kind") == kind))
    out = rows.groupBy("ref").pivot("test", scorers).agg(F.first("f1"))
    return out.withColumns({s: F.when(F.col("ref") == s, 1.0).otherwise(F.col(s)) for s in scorers})


def orphans(events: DataFrame, matches: DataFrame) -> DataFrame:
    """The events that no pair of scorers matched; matches are rows of match_rows() or matched()."""
    hit = matches.select(*PAIR, F.inline("matches")) if "matches" in matches.columns else matches
    ends = F.array(F.struct(F.col("ref").alias("scorer"), F.col("ref_idx").alias("idx")), F.struct(F.col("test").alias("scorer"), F.col("test_idx").alias("idx")))
    used = hit.select(*KEYS, F.inline(ends))
    return events.join(used.distinct(), [*KEYS, "scorer", "idx"], "left_anti")


def cross_type(lost: DataFrame, threshold: int, first: str = "turn", second: str = "contraction") -> DataFrame:
    """Orphans of one type near those of the other by another scorer: video, first_scorer,
    second_scorer, first_t, second_t and distance, within the threshold. They meet in bands of
    time as wide as the threshold."""
    width = max(1, threshold)
    band = F.floor(F.col("t") / width)
    a = lost.where(F.col("event_type") == first).select("video", F.col("scorer").alias("first_scorer"), F.col("t").alias("first_t"), band.alias("band"))
    b = lost.where(F.col("event_type") == second).select("video", F.col("scorer").alias("second_scorer"), F.col("t").alias("second_t"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    out = a.join(b, ["video", "band"]).drop("band").where("first_scorer <> second_scorer").withColumn("distance", F.abs(F.col("first_t") - F.col("second_t")))
    return out.where(F.col("distance") <= threshold)


def reliability(counts: DataFrame, crossed: DataFrame, first: str = "turn") -> DataFrame:
    """For each ordered pair and event type: totals, matched, unmatched, cross_confused and the
    rates. An empty side counts as recall or precision 1."""
    pairs = crossed.groupBy("first_scorer", "second_scorer").agg(F.count("*").alias("cross_confused"))
    sums = counts.groupBy("ref", "test", "event_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    turn = F.col("event_type") == first
    sums = sums.withColumns({"first_scorer": F.when(turn, F.col("ref")).otherwise(F.col("test")), "second_scorer": F.when(turn, F.col("test")).otherwise(F.col("ref"))})
    rows = sums.join(pairs, ["first_scorer", "second_scorer"], "left").withColumn("cross_confused", F.coalesce("cross_confused", F.lit(0)).cast("long"))
    rows = rows.select("ref", "test", "event_type", F.expr("tp + fn").alias("total_ref"), F.expr("tp + fp").alias("total_test"), F.col("tp").alias("matched"), F.col("fn").alias("unmatched_ref"), F.col("fp").alias("unmatched_test"), "cross_confused")
    rows = rows.withColumn("recall", ratio("matched", "total_ref", 1.0)).withColumn("precision", ratio("matched", "total_test", 1.0))
    return rows.withColumn("f1", _f1()).withColumn("miss_rate", ratio("unmatched_ref", "total_ref")).withColumn("confusion_rate", ratio("cross_confused", "unmatched_ref"))


def reliability_report(table: DataFrame) -> DataFrame:
    """One line of text for each row of reliability()."""
    line = F.format_string("%s vs %s, %s: matched %d of %d (recall %.3f), precision %.3f, F1 %.3f, missed %.3f", "ref", "test", "event_type", "matched", "total_ref", *[F.round(c, 3) for c in ("recall", "precision", "f1", "miss_rate")])
    return table.select("ref", "test", "event_type", line.alias("line"))


def common_events(one: list, two: list, three: list, limit: float) -> list[tuple[int, int, int]]:
    """Of the triplets of events (t, idx) of three lists that are all within the limit of each other
    those that are taken: by range and sum of distances, then by places; an event is used once."""
    found = []
    for x, y in _near(one, two, limit):
        first, last = max(x[0], y[0]) - limit, min(x[0], y[0]) + limit
        for k in range(bisect_left(three, (first,)), len(three)):
            z = three[k]
            if z[0] > last:
                break
            d = sorted((abs(x[0] - y[0]), abs(x[0] - z[0]), abs(y[0] - z[0])))
            found.append((d[2] - d[0], sum(d), x[1], y[1], z[1]))
    used, out = (set(), set(), set()), []
    for _, _, *places in sorted(found):
        if not any(p in u for p, u in zip(places, used)):
            for p, u in zip(places, used):
                u.add(p)
            out.append(tuple(places))
    return out


class _Unused:
    """The events (t, idx) of a list that are still free, found from either side of a time: of
    equal times the lower index first. Events that are used are skipped in nearly constant time."""

    def __init__(self, events: list):
        self.sides = []
        for step, order in ((1, sorted(events)), (-1, sorted(events, key=lambda e: (e[0], -e[1])))):
            self.sides.append((step, [e[0] for e in order], [e[1] for e in order], list(range(len(order) + 2))))
        self.used: set[int] = set()

    def _free(self, side: int, at: int) -> int:
        """The first place from at (counted from 1) on in the side's direction that is free."""
        step, _, places, skip = self.sides[side]
        path = []
        while True:
            while skip[at] != at:
                path.append(at)
                at = skip[at]
            if not 1 <= at <= len(places) or places[at - 1] not in self.used:
                break
            skip[at] = at + step
        for p in path:
            skip[p] = at
        return at

    def beyond(self, low: float, high: float, limit: float) -> tuple[float, int] | None:
        """Distance and index of the free event nearest to low and high but farther than the limit."""
        best = None
        for side, at in ((0, bisect_right(self.sides[0][1], high + limit) + 1), (1, bisect_left(self.sides[1][1], low - limit))):
            _, times, places, _ = self.sides[side]
            at = self._free(side, at)
            if 1 <= at <= len(times):
                found = (times[at - 1] - high if side == 0 else low - times[at - 1], places[at - 1])
                best = found if best is None else min(best, found)
        return best


def events_of_two(lists: list[list], limit: float) -> tuple[int, int, int]:
    """How many events are counted for scorers 1 and 2, 1 and 3, 2 and 3, among those that are in
    no common event.

    First come triplets of which one distance passes: they count for that pair and use up all three
    events. As the third event is outside the pair and beyond the limit, the range of the distances
    is its distance from the pair; each pair waits with its nearest free third event. Then the
    pairs that are left are taken by distance, of equals those of the first scorers, then by places.
    """
    kinds = ((0, 1, 2), (0, 2, 1), (1, 2, 0))
    free, counts = [_Unused(x) for x in lists], [0, 0, 0]
    pairs = [(k, x, y) for k, (a, b, _) in enumerate(kinds) for x, y in _near(lists[a], lists[b], limit)]

    def waiting(pair):
        k, x, y = pair
        a, b, c = kinds[k]
        third = free[c].beyond(min(x[0], y[0]), max(x[0], y[0]), limit)
        if third is None:
            return None
        places = [0, 0, 0]
        places[a], places[b], places[c] = x[1], y[1], third[1]
        return third[0], 2 * (third[0] + abs(x[0] - y[0])), *places, pair

    heap = [w for w in map(waiting, pairs) if w]
    heapq.heapify(heap)
    while heap:
        *_, p0, p1, p2, pair = heapq.heappop(heap)
        a, b, c = kinds[pair[0]]
        places = (p0, p1, p2)
        if places[a] in free[a].used or places[b] in free[b].used:
            continue
        if places[c] in free[c].used:
            again = waiting(pair)
            if again:
                heapq.heappush(heap, again)
            continue
        for f, p in zip(free, places):
            f.used.add(p)
        counts[pair[0]] += 1
    for _, k, i, j in sorted((abs(x[0] - y[0]), k, x[1], y[1]) for k, x, y in pairs):
        a, b, _ = kinds[k]
        if i not in free[a].used and j not in free[b].used:
            free[a].used.add(i)
            free[b].used.add(j)
            counts[k] += 1
    return tuple(counts)


def unanimity(events: DataFrame, scorers: list[str], threshold: Column) -> DataFrame:
    """For each video and event type with events of two scorers at least: s123, s12, s13, s23,
    the raw counts, total_unique and unanimity_rate.

    Triplets come first: one whose three distances pass is a common event, one with a single
    passing distance is an event of that pair and uses up all three, one with two is passed
    over; then pairs. An event is used once. Common events come before all others, and are found in
    each island alone; only what they leave, with near marks of two scorers, meets by video.
    """
    marks = events.where(F.col("scorer").isin(scorers)).select(*KEYS, "scorer", F.col("idx").cast("int").alias("idx"), F.col("t").cast("int").alias("t"), threshold.cast("double").alias("limit"))
    names = ["l0", "l1", "l2"]
    listed = [F.collect_list(F.when(F.col("scorer") == s, F.struct("t", "idx"))).alias(n) for n, s in zip(names, scorers)]
    grouped = islands(marks, KEYS).groupBy(*KEYS, "island", "limit").agg(*listed)
    event, kind = pa.list_(pa.struct([("t", pa.int32()), ("idx", pa.int32())])), "array<struct<t:int,idx:int>>"

    def common(batch):
        lists = [list(_times(batch.column(n))) for n in names]
        taken = [common_events(*x) if all(x[:3]) else [] for x in zip(*lists, batch.column("limit").to_pylist())]
        out = {"limit": batch.column("limit"), "s123": pa.array([len(t) for t in taken], pa.int32())}
        for k, n in enumerate(names):
            used = [{t[k] for t in found} for found in taken]
            out[f"s{k + 1}_raw"] = pc.list_value_length(batch.column(n))
            out[n] = pa.array([[{"t": t, "idx": i} for t, i in rows if i not in u] for rows, u in zip(lists[k], used)], event)
        return out

    schema = "limit double, s123 int, " + ", ".join(f"s{k + 1}_raw int, {n} {kind}" for k, n in enumerate(names))
    counts = ["s123", "s1_raw", "s2_raw", "s3_raw"]
    rows = _map(grouped, common, schema, KEYS).groupBy(*KEYS, "limit")
    rows = rows.agg(*[F.sum(c).cast("int").alias(c) for c in counts], *[F.flatten(F.collect_list(n)).alias(n) for n in names])
    rows = rows.where("int(s1_raw > 0) + int(s2_raw > 0) + int(s3_raw > 0) >= 2")

    def rest(batch):
        found = [events_of_two(list(x[:3]), x[3]) for x in zip(*[_times(batch.column(n)) for n in names], batch.column("limit").to_pylist())]
        return {n: pa.array([f[k] for f in found], pa.int32()) for k, n in enumerate(("s12", "s13", "s23"))}

    rows = _map(rows, rest, "s12 int, s13 int, s23 int", [*KEYS, *counts]).select(*KEYS, "s123", "s12", "s13", "s23", *counts[1:])
    rows = rows.withColumn("total_unique", F.expr("s1_raw + s2_raw + s3_raw - (s12 + s123) - (s13 + s123) - (s23 + s123) + s123"))
    return rows.withColumn("unanimity_rate", ratio("s123", "total_unique"))


def triplets(events: DataFrame, scorers: list[str], threshold: int) -> DataFrame:
    """Each video's and type's triplets of one event a scorer of which any two are within the
    threshold: t1, t2, t3 and which of their distances pass. Triplets that pass nowhere are
    never assigned; the others start from a pair that meets in a band of time.
    """
    width = max(1, threshold)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= threshold
    sheets = [events.where(F.col("scorer") == s).select(*KEYS, F.col("idx").alias(f"i{k}"), F.col("t").alias(f"t{k}")) for k, s in enumerate(scorers, 1)]
    out = None
    for x, y, z in ((1, 2, 3), (1, 3, 2), (2, 3, 1)):
        band = lambda k: F.floor(F.col(f"t{k}") / width)
        one = sheets[x - 1].withColumn("band", band(x))
        two = sheets[y - 1].withColumn("band", F.explode(F.array(band(y) - 1, band(y), band(y) + 1)))
        found = one.join(two, [*KEYS, "band"]).where(near(f"t{x}", f"t{y}")).join(sheets[z - 1], KEYS).select(*KEYS, *[f"{c}{k}" for k in (1, 2, 3) for c in "it"])
        # Each triplet once: by the first of its pairs that passes.
        first = ~near("t1", "t2") & ~near("t1", "t3") if x == 2 else ~near("t1", "t2") if y == 3 else F.lit(True)
        out = found.where(first) if out is None else out.unionByName(found.where(first))
    return out.select(*KEYS, "t1", "t2", "t3", near("t1", "t2").alias("p12"), near("t1", "t3").alias("p13"), near("t2", "t3").alias("p23"))


def mark_lists(marks: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """keys, frames (sorted, each once) and n of marks; n is always the list's length."""
    out = marks.groupBy(*keys).agg(F.array_sort(F.collect_set(frame)).alias("frames"))
    return out.withColumn("n", F.size("frames"))
