"""Best-fit packing by patterns: a non-negative least squares fit of the histogram of lengths.

A document is encoded, ends with a token of its own and is cut only if it is longer than a
sequence: every piece but the first then fills one. What fits together is decided on the
histogram of piece lengths alone, which has at most `capacity` numbers whatever the input's
size. Patterns are the ways of filling a sequence with few pieces. How often each is used is
fitted to the histogram by non-negative least squares with an active set, rounded and limited
to the pieces there are; the pieces left over are packed by best fit, the longest first.

The pieces of a length are then numbered without gaps and dealt to the places of the patterns
by number. All of it follows from the rows alone, so that a lost task is simply repeated.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from kestrel.llm.bpe import byte_symbols
from kestrel.llm.common import map_arrow, texts_of, written

CAPACITY = 1024
#: Pieces in a pattern at most, and the part of a sequence that a pattern may leave free.
MOST, SLACK = 3, 128
#: Patterns that join the active set in a round, rounds at most, and the gain at which they end.
ADDED, ROUNDS, GAIN = 96, 60, 1e-4
#: Weight of pieces that the fit asks for beyond those there are.
OVER = 4
#: Shares of a repeat from which it is rounded up; the one that needs fewest sequences is taken.
ROUNDINGS = (1.0, 0.5, 0.25)
#: Pieces of a length are numbered by bucket: the largest window holds a length's share of one bucket.
BUCKETS = 4096
#: The split of byte-level vocabularies into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids of whole texts by a tokenizers file of byte-level BPE.

    Its ids are in the order of its merges, so they are ranks, and the ranked encoder gives the
    library's ids at several times its speed wherever both split a text into the same words.
    They differ at most in the kind (letter, number, space, other) of characters that only one of
    them knows; each character is asked for once, and texts with one that differs go to the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids are not in the order of the merges")
        back = {s: b for b, s in enumerate(byte_symbols())}
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        single = {bytes([b]): b for b in range(256)}
        self.kinds = [tiktoken.Encoding("kind", pat_str=k, mergeable_ranks=single, special_tokens={}).encode_ordinary for k in (r"\p{L}", r"\p{N}", r"\s")]
        self.special = {content: array("I", [i]).tobytes() for content, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.agreed = {chr(c) for c in range(128)}

    def agrees(self, c: str) -> bool:
        ends = [end for _, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}.{c}")]
        letter, number, space = (bool(k(c)) for k in self.kinds)
        return ends == ([2, 3, 4, 5, 6] if letter else [1, 4, 5, 6] if number else [1, 2, 3, 4, 5, 6] if space else [1, 2, 3, 6])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if not text.isascii():
            new = set(text) - self.agreed
            if not all(map(self.agrees, new)):
                return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            self.agreed |= new
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(self.special[part] if k % 2 else array("I", self.ranked(part)).tobytes() for k, part in enumerate(parts))


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(df: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece of each row of df: doc_id, piece (from 0), start (the document's ids
    before it), length, ids_crc32 and, if asked for, its ids (binary, little-endian unsigned
    32-bit). Null and empty texts are the end token alone."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    names = [*PIECE[1:], *["ids"] * ids]
    end = array("I", [end_id]).tobytes()

    def cut(batch):
        made = encoder(vocabulary)
        at, out = [], {name: [] for name in names}
        for row, text in enumerate(texts_of(batch, "t")):
            data = made.encode(text) + end
            n = len(data) // 4
            start = 0
            for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                part = data[4 * start : 4 * stop]
                at.append(row)
                for name, value in zip(names, (piece, start, stop - start, zlib.crc32(part), part)):
                    out[name].append(value)
                start = stop
        return {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int32()))} | out

    return map_arrow(rows, cut, schema)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of up to MOST lengths, 0 for none, that fill a sequence but for one part in SLACK; counts has how many
    pieces there are of each length from 0 to the capacity. The last length of a row is the longest
    that still fits."""
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    below = np.zeros(capacity + 1, int)  # the longest length there is, up to each
    below[present] = present
    below = np.maximum.accumulate(below)
    found = [np.stack([present, 0 * present, 0 * present], 1)]
    for a in present[::-1]:
        b = present[(present <= a) & (present <= capacity - a)]
        found.append(np.stack([np.full(len(b), a), b, below[np.minimum(b, capacity - a - b)]], 1))
    made = np.concatenate(found)[:, :MOST]
    return np.unique(made[made.sum(1) >= capacity - capacity // SLACK], axis=0)


def _columns(chosen: np.ndarray, size: int) -> np.ndarray:
    """The matrix whose columns count the lengths of the chosen patterns."""
    matrix = np.zeros((size, len(chosen)))
    for k in range(chosen.shape[1]):
        np.add.at(matrix, (chosen[:, k], np.arange(len(chosen))), 1)
    matrix[0] = 0
    return matrix


def fitted(counts: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often to use each: non-negative least squares of the histogram. A length
    weighs by itself, as a longer piece left over costs more, and where the fit asks for more
    pieces than there are, OVER times that.

    In each round the patterns with the steepest gradients, no two of which share a length, join
    the active set; the set is solved, and patterns leave it until all repeats are positive.
    """
    size = len(counts)
    lengths = np.arange(size) / (size - 1)
    active, matrix, x, last = np.zeros(0, int), np.zeros((size, 0)), np.zeros(0), np.inf
    for _ in range(ROUNDS):
        residual = counts - matrix @ x
        weight = lengths * np.where(residual < 0, OVER, 1)
        error = float(weight @ (residual * residual))
        if error > last * (1 - GAIN):
            break
        last = error
        gradient = (weight * residual)[ways].sum(1)
        gradient[active] = 0
        used, added = np.zeros(size, bool), []
        for at in np.argsort(-gradient, kind="stable")[: ADDED * 16].tolist():
            if gradient[at] <= 0 or len(added) == ADDED:
                break
            if not used[ways[at]].any():
                used[ways[at]] = True
                used[0] = False
                added.append(at)
        active = np.concatenate([active, np.array(added, int)])
        while True:
            matrix = _columns(ways[active], size)
            weighted = matrix.T * weight
            x = np.linalg.solve(weighted @ matrix + 1e-9 * np.eye(len(active)), weighted @ counts)
            if (x > 0).all():
                break
            active = active[x > 0]
    return ways[active], x


def rounded(counts: np.ndarray, ways: np.ndarray, repeats: np.ndarray, up: float) -> tuple[dict, np.ndarray]:
    """Whole repeats of patterns, the most used first and never more than pieces are left; and the
    pieces left over."""
    left, out = counts.copy(), {}
    for at in np.argsort(-repeats, kind="stable").tolist():
        way = tuple(int(n) for n in ways[at] if n)
        need = {n: way.count(n) for n in way}
        times = min(int(repeats[at] + 1 - up), *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            out[way] = times
            for n, k in need.items():
                left[n] -= k * times
    return out, left


def best_fit(left: np.ndarray) -> dict:
    """Patterns and repeats of the pieces left over, the longest first into the fullest sequence that has room.

    Sequences alike are one group, so that the work depends on the lengths, not on the pieces.
    """
    capacity = len(left) - 1
    rooms, groups = [], {}  # free places in order; groups of sequences [pattern, how many] by free places

    def put(way, times, room):
        if times:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append([way, times])

    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each, way, times, room = capacity // n, (), max(1, count // (capacity // n)), capacity
            else:
                room = rooms[at]
                way, times = groups[room].pop()
                each = room // n
                if not groups[room]:
                    del groups[room], rooms[at]
            each = min(each, count)
            filled = min(times, count // each)
            if way:
                put(way, times - filled, room)
            put(way + (n,) * each, filled, room - each * n)
            count -= filled * each
    out = {}
    for found in groups.values():
        for way, times in found:
            out[way] = out.get(way, 0) + times
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often to use each, which together use every piece once."""
    counts = np.asarray(counts, int)
    if not counts.any():
        return []
    ways = patterns(counts)
    chosen, repeats = fitted(counts, ways) if len(ways) else (ways, np.zeros(0))
    best = None
    for up in ROUNDINGS:
        whole, left = rounded(counts, chosen, repeats, up)
        made = list(whole.items()) + list(best_fit(left).items())
        if best is None or sum(n for _, n in made) < sum(n for _, n in best):
            best = made
    return best


def _slots(spark: SparkSession, planned) -> DataFrame:
    """length, low, high, each, base and at: pieces of the length numbered from low to below high
    go, `each` at a time, to the sequences from base on, from place `at` in them. A few rows for each
    pattern, whatever the input's size."""
    rows, used, base = [], {}, 0
    for way, times in planned:
        place = 0
        for n in sorted(set(way), reverse=True):
            each = way.count(n)
            low = used.get(n, 0)
            used[n] = low + each * times
            rows.append((n, low, used[n], each, base, place))
            place += each * n
        base += times
    return spark.createDataFrame(rows, "length long, low long, high long, each long, base long, at long")


def packed(df: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row.

    Null and empty texts are one token, the end token. Repeated rows are packed each on their own;
    rows without an id like any other; other columns are ignored. Equal pieces are counted before
    the shuffle and spread out after it. An empty table gives an empty table.
    """
    spark = df.sparkSession
    counted = pieces(df, vocabulary, end_id, capacity, id_col, text_col).groupBy(*PIECE).agg(F.count("*").alias("n"))
    counted = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    counted = written(counted, "pieces")
    totals = counted.groupBy("length", "bucket").agg(F.sum("n").alias("rows"))
    histogram = np.zeros(capacity + 1, int)
    for r in totals.groupBy("length").agg(F.sum("rows").alias("rows")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["rows"]
    slots = _slots(spark, plan(histogram))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most BUCKETS rows for each length, whatever the size of the table.
    offsets = totals.select("length", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("length", "bucket").orderBy(*PIECE).rowsBetween(W.unboundedPreceding, -1)
    numbered = counted.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["length", "bucket"])
    first = F.col("first") + F.col("before")
    numbered = numbered.select(*PIECE, F.explode(F.sequence(first, first + F.col("n") - 1)).alias("number"))
    placed = numbered.join(F.broadcast(slots), "length").where("number >= low and number < high")
    nth = F.col("number") - F.col("low")
    return placed.select(*PIECE, (F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"))


def sequences(df: DataFrame, places: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary) and lengths of the pieces in order, by the
    places that packed() gave for df. A sequence has at most `capacity` ids."""
    texts = pieces(df, vocabulary, end_id, capacity, id_col, text_col, ids=True).groupBy(*PIECE).agg(F.any_value("ids").alias("ids"))
    p, t = places.alias("p"), texts.alias("t")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) if c == "doc_id" else F.col(f"p.{c}") == F.col(f"t.{c}") for c in PIECE]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    rows = p.join(t, condition).groupBy("p.sequence_id").agg(F.array_sort(F.collect_list(F.struct("p.offset", "p.length", "t.ids"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return rows.select("sequence_id", whole.alias("ids"), F.transform("parts", lambda x: x["length"]).alias("lengths"))
