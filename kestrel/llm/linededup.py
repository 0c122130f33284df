"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are near with at most one edit for each EVERY characters of the shorter one, up to K.
A line for which e edits are allowed is cut into e + 1 segments. A line within e edits of it
holds one of the segments unchanged and near its old place, so that segments filed under
length and number, and probes with the substrings of those lengths and places, bring the
pairs together. A banded bit-parallel edit distance decides: the diagonals that can still lead to
few enough edits are bits of one number, which takes a few operations for each character. Only distinct lines
join; copies are counted before. Near copies of one line share segments, so many lines meet
under one key: under frequent keys the lines go along, and only near pairs leave the join.

A line of a document goes if an equal or a near line occurs earlier, by document id and then
line number. Lines are judged on the input.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written

#: Edits allowed between lines at most, and the characters of the shorter one for each.
K, EVERY = 2, 6
#: Bits of a field of the edit distance: a band of 2 K + 1 diagonals and room beside it. K + 1 fields make an int.
FIELD = 3 * K + 2
#: Pieces of a line that are looked for in another one before their distance is taken.
PIECES = 4 * K
#: Steps by which lines are found to be alike from their ends on, in halves.
STEPS = [1 << x for x in range(15, -1, -1)]
#: Rows of keys of lines that may go to every task: at most 30 MB. More are joined by a shuffle.
BROADCAST = 300_000
#: Lines under keys that more than about CROWD lines are filed under, up to HOT keys (the most frequent,
#: a broadcast of 80 kB), go along with the key, and the join itself compares them.
CROWD, HOT = 16, 10_000
#: One line in so many is counted for them: which keys these are moves cost, not results.
COUNTED = 8
#: The id that rows without one are ordered as: the last. Their keys tell them from rows that have it.
LAST = (1 << 63) - 1


def _parts(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


#: Names a document: its order and the hash of order and text, which rows that repeat both share. The
#: hash is negative for rows with an id, which makes them the first of equal order.
DOCUMENT = ["doc", "dkey"]


def _named(id_col: Column, text: Column) -> dict[str, Column]:
    """DOCUMENT of a row."""
    order = F.coalesce(id_col.cast("long"), F.lit(LAST))
    key = F.xxhash64(order, F.coalesce(text, F.lit("")))
    return {"doc": order, "dkey": F.when(id_col.cast("long").isNull(), key.bitwiseAND(F.lit(LAST))).otherwise(key.bitwiseOR(F.lit(-1 - LAST)))}


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOCUMENT and lines of each row."""
    names = _named(F.col(id_col), F.col(text_col))
    return df.select(*[c.alias(name) for name, c in names.items()], _parts(text_col).alias("parts"))


def _keys(line: Column) -> tuple[Column, Column]:
    """Two hashes that tell lines apart, 128 bits together."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")


def _occurrences(documents: DataFrame) -> DataFrame:
    lines = documents.select("doc", "dkey", F.posexplode("parts").alias("line_no", "line")).where(F.trim("line") != "")
    return lines.select("doc", "dkey", "line_no", *_keys(F.col("line")), F.length("line").alias("n"))


def _allowed(length: Column) -> Column:
    return F.least(F.lit(K), F.floor(length / EVERY)).cast("int")


def _within(a: str, b: str, most: Column) -> Column:
    """Whether the two lines are within `most` edits, K at most.

    Bit d of field e says that the characters so far of a become those of b up to d - K places
    further by e edits. A character moves all fields at once: equal ones keep the diagonal, others
    pass to the next field, on the same diagonal or (deleted) one lower; insertions pass bits one
    higher. Bits that leave the band fall between the fields.
    """
    places = [K + at for at in range(-K, K + 1)]
    field = lambda bits: sum(bits << FIELD * e for e in range(K + 1))
    mask = F.lit(field((1 << len(places)) - 1))

    def equal(line: Column) -> Column:
        """For each character of a, in each field, the diagonals on which b has the same one."""
        bits = lambda x, i, d: F.when(F.get(line.b, i + (d - K)) == x, field(1 << d)).otherwise(0)
        return F.transform(line.a, lambda x, i: functools.reduce(Column.__add__, [bits(x, i, d) for d in places]))

    def step(state: Column, same: Column) -> Column:
        kept = state.bitwiseAND(same).bitwiseOR(F.shiftleft(state, FIELD)).bitwiseOR(F.shiftleft(state, FIELD - 1)).bitwiseAND(mask)
        return functools.reduce(Column.bitwiseOR, [F.shiftleft(kept, (FIELD + 1) * e) for e in range(1, K + 1)], kept).bitwiseAND(mask)

    start = F.lit(sum(1 << FIELD * e + K + d for e in range(K + 1) for d in range(e + 1)))
    ends = _bound(_middles(_pair(a, b)), lambda line: F.aggregate(equal(line), start, step))
    longer = F.length(b) - F.length(a)
    return F.when(F.abs(longer) <= most, F.getbit(F.get(ends, F.lit(0)), FIELD * most + K + longer) == 1).otherwise(False)


def _bound(x: Column, function) -> Column:
    """An array of one of the function's value for the one in x, which binds it: what is used several
    times in higher-order functions is otherwise made anew each time."""
    return F.transform(x, function)


def _pair(a: str, b: str) -> Column:
    """Two lines and their lengths, bound."""
    return F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.length(a).alias("na"), F.length(b).alias("nb"), F.least(F.length(a), F.length(b)).alias("least")))


def _grown(most: Column, same) -> Column:
    """The largest number up to most and below twice the largest of STEPS for which same holds, if it
    holds for all smaller ones."""
    return F.aggregate(F.array(*[F.lit(x) for x in STEPS]), F.lit(0), lambda n, more: F.when((n + more <= most) & same(n + more), n + more).otherwise(n))


def _middles(pair: Column) -> Column:
    """The characters of both lines between what they begin with and what they end with alike, which
    the edit distance does not depend on."""
    begun = _bound(pair, lambda x: F.struct(x.alias("x"), _grown(x.least, lambda n: F.substr(x.a, F.lit(1), n) == F.substr(x.b, F.lit(1), n)).alias("at")))
    ended = _bound(begun, lambda y: F.struct(y.x.alias("x"), y.at.alias("at"), _grown(y.x.least - y.at, lambda n: F.substr(y.x.a, y.x.na - n + 1) == F.substr(y.x.b, y.x.nb - n + 1)).alias("end")))
    # An empty line is cut into one part, so what is gone through is cut to its length.
    cut = lambda z, line, n: F.split(F.substr(line, z.at + 1, n - z.at - z.end), "")
    return _bound(ended, lambda z: F.struct(F.slice(cut(z, z.x.a, z.x.na), F.lit(1), z.x.na - z.at - z.end).alias("a"), cut(z, z.x.b, z.x.nb).alias("b")))


def _holds(a: str, b: str) -> Column:
    """Whether b has all but `most` of PIECES pieces of a within `most` places of where a has them, for the
    edits allowed for the shorter one. Of near lines it does, as an edit changes one piece at most and moves
    the others by one place."""
    pieces = F.lit(PIECES)

    def held(x: Column, i: Column) -> Column:
        start, size, most = _start(x.na, i, pieces), _size(x.na, i, pieces), _allowed(x.least)
        return F.contains(F.substr(x.b, F.greatest(F.lit(1), start - most), size + most * 2), F.substr(x.a, start, size))

    found = _bound(_pair(a, b), lambda x: F.size(F.filter(F.sequence(F.lit(0), pieces - 1), lambda i: held(x, i))) >= pieces - _allowed(x.least))
    return F.get(found, F.lit(0))


def _near(a: str, b: str) -> Column:
    """Whether the two lines are within the edits allowed for the shorter one. Most pairs that share a
    segment differ in many pieces, which is told without going through their characters."""
    return F.when(_holds(a, b), _within(a, b, _allowed(F.least(F.length(a), F.length(b))))).otherwise(False)


def _start(length: Column, i: Column, segments: Column) -> Column:
    """Where segment i (from 0) of a line begins, from 1: the last segments are the longer."""
    base, longer = F.floor(length / segments), F.pmod(length, segments)
    return (F.lit(1) + base * i + F.greatest(F.lit(0), i - (segments - longer))).cast("int")


def _size(length: Column, i: Column, segments: Column) -> Column:
    return (F.floor(length / segments) + F.when(F.pmod(length, segments) >= segments - i, 1).otherwise(0)).cast("int")


#: What a line is filed under, and what it is looked up by: (less, e, i, shift) is segment i of lines for
#: which e edits are allowed and which are shorter by less, taken at a shift of its place.
FILED = [(0, e, i, 0) for e in range(1, K + 1) for i in range(e + 1)]
#: For segment i at most i edits come before it or at most e - i after it; both bound its shift, and
#: it is enough to look where both hold.
PROBES = [
    (less, e, i, shift)
    for less in range(K + 1) for e in range(max(1, less), K + 1) for i in range(e + 1)
    for shift in range(max(-i, less - (e - i)), min(i, less + e - i) + 1)
]


def _keys_of(texts: DataFrame, places: list[tuple[int, int, int, int]]) -> DataFrame:
    """h1, line and key, a row for each of the places that a line has.

    The places are rows and one expression makes the key of each: written out place by place the
    code would be a method of more than 8000 bytes, which the JVM interprets and never compiles.
    """
    names = ("less", "e", "i", "shift")
    table = F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(names, place)]) for place in places])
    length, segments = F.col("n") - F.col("less"), F.col("e") + 1
    rows = texts.select("h1", "line", "n", F.inline(table)).where(_allowed(length) == F.col("e"))
    part = F.substr("line", _start(length, F.col("i"), segments) + F.col("shift"), _size(length, F.col("i"), segments))
    return rows.select("h1", "line", F.xxhash64("i", length, part).alias("key"))


def _pick(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of wanted lines (DOCUMENT, line_no and other columns); documents move by key."""
    grouped = wanted.groupBy(*DOCUMENT).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in DOCUMENT])).alias("wanted"))
    joined = documents.select(*DOCUMENT, "parts").join(grouped.hint("shuffle_hash"), DOCUMENT)
    rows = joined.select("parts", F.explode("wanted").alias("w"))
    return rows.select("w.*", F.get("parts", F.col("w.line_no")).alias("line")).withColumn("n", F.length("line"))


def _few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def near_links(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs of distinct near lines: (a1, a2) and (b1, b2), their hashes, a1 <= b1."""
    long = firsts.where(F.col("n") >= EVERY).select("first.doc", "first.dkey", "first.line_no", "h1")
    texts = _pick(documents, long)
    filed, probes = _keys_of(texts, FILED), _keys_of(texts, PROBES)
    counted = filed.where(F.pmod("h1", F.lit(COUNTED)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    crowded = counted.where(F.col("n") > CROWD // COUNTED)
    hot = F.broadcast(crowded.orderBy(F.col("n").desc(), "key").limit(HOT).select("key", F.lit(True).alias("hot")))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(hot, "key", "left").select("key", F.col("h1").alias(name), F.when(F.col("hot"), F.col("line")).alias(f"{name}_line"))

    filed, probes = keyed(filed, "f"), keyed(probes, "p")
    # Where lines don't go along the pair is met here and compared below.
    near = F.when(F.col("p_line").isNotNull() & F.col("f_line").isNotNull(), _near("p_line", "f_line")).otherwise(True)
    met = probes.join(filed.hint("shuffle_hash"), "key").where((F.col("p") != F.col("f")) & near)
    pairs = written(met.select(F.least("p", "f").alias("a1"), F.greatest("p", "f").alias("b1")).distinct(), "line-pairs")
    named = pairs.select(F.col("a1").alias("h1")).union(pairs.select("b1")).distinct()
    named = _few(written(named, "line-pair-keys"))
    lines = documents.select(F.explode("parts").alias("line")).where(F.length("line") >= EVERY).select(*_keys(F.col("line")), "line")
    lines = lines.join(named, "h1", "left_semi").groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    a = lines.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = lines.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    return pairs.join(a, "a1").join(b, "b1").where(_near("a", "b")).select("a1", "a2", "b1", "b2")


def _firsts(lines: DataFrame) -> DataFrame:
    """Each distinct line's keys, first place, length and number of occurrences."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no", "dkey")).alias("first"), F.max("n").alias("n"), F.count("*").alias("times"))


def _flags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOCUMENT, exact and near: the numbers (from 0) of a document's lines that go because an
    equal line, or else a near one, occurs earlier."""
    documents = _documents(df, id_col, text_col)
    lines = _occurrences(documents)
    firsts = written(_firsts(lines), "lines")
    links = written(near_links(documents, firsts), "line-links")
    one = firsts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.struct("first", "h1", "h2").alias("fa"))
    two = firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.struct("first", "h1", "h2").alias("fb"))
    # Links are few beside lines: while a count bounds them, they go to the lines.
    placed = _few(links).join(one, ["a1", "a2"])
    placed = _few(written(placed, "line-places")).join(two, ["b1", "b2"])
    later = F.when(F.col("fa") < F.col("fb"), F.struct("b1", "b2")).otherwise(F.struct(F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    near = placed.select(later.alias("x")).select(F.col("x.b1").alias("h1"), F.col("x.b2").alias("h2")).distinct().withColumn("near", F.lit(True))
    marked = firsts.join(_few(written(near, "near-lines")), ["h1", "h2"], "left").select("h1", "h2", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    # Only lines that repeat or are near matter. As both sides of the join are plain shuffles, Spark
    # splits the occurrences of a very common line among tasks.
    marked = written(marked.where("times > 1 or near").drop("times"), "marked-lines")
    found = lines.join(marked, ["h1", "h2"]).withColumn("copy", F.struct("doc", "line_no", "dkey") != F.col("first")).where("copy or near")
    return found.groupBy(*DOCUMENT).agg(
        F.array_sort(F.collect_set(F.when(F.col("copy"), F.col("line_no")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(~F.col("copy"), F.col("line_no")))).alias("near"),
    )


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_lines (not blank), exact_lines and near_lines, the
    numbers from 0 of the lines that go, and n_removed.

    Blank lines, and so null and empty texts, have no copies. Rows that repeat id and text get the same result. Rows without an
    id are ordered as if they had the largest id there is, and at the same line number come after
    rows that do have it. Other columns are ignored.
    """
    flags = _flags(df, id_col, text_col)
    documents = _documents(df, id_col, text_col)
    base = documents.select(*DOCUMENT, F.size(F.filter("parts", lambda x: F.trim(x) != "")).alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = base.join(flags, DOCUMENT, "left").withColumn("doc_id", F.when(F.col("dkey") < 0, F.col("doc"))).withColumns({"exact_lines": F.coalesce("exact", none), "near_lines": F.coalesce("near", none)})
    return joined.select("doc_id", "n_lines", "exact_lines", "near_lines", (F.size("exact_lines") + F.size("near_lines")).alias("n_removed"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the lines that go cut from the text; texts may end up empty, null texts stay."""
    flags = _flags(df, id_col, text_col).select(*DOCUMENT, F.array_union("exact", "near").alias("gone"))
    whole = df.select(F.struct(*df.columns).alias("row"))
    text = F.col(f"row.`{text_col}`")
    keyed = whole.withColumns(_named(F.col(f"row.`{id_col}`"), text))
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    joined = keyed.join(flags, DOCUMENT, "left")
    return joined.select(*[(left if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])
