"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a document with at most e edits shares at least
m - q + 1 - q e of its q-grams with it, and all of them lie on e + 1 neighbouring diagonals,
those that the match goes through. Documents' q-grams are looked up among the benchmark's,
the hits are counted in bands of diagonals that overlap by e, so that one band holds the
whole match, bands that meet the bound become regions, and an alignment along the band finds
the edits in each region.

e is a tenth of m, and q the most that leaves a shared q-gram, up to Q: short passages have
shorter q-grams, and the same rule holds for all. Texts are compared in lower case with runs
of white space as one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_arrow, slices, texts_of

Q = 8
#: One edit is allowed for so many characters of a passage.
CHARACTERS_AN_EDIT = 10
#: Characters of benchmark text that go out with one pass over the documents, and parts of
#: such a block's size into which the passages are dealt to fill the blocks.
BLOCK, PARTS = 4_000_000, 64
#: Hits of q-grams that are counted, and cells that are aligned, at a time.
HITS, CELLS = 1 << 21, 1 << 18
ONE = 1 << 32
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
FOUND = ("item_id", "edits", "start", "end")
SCHEMA = "doc_id long, item_id long, edits int, start int, end int"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int) -> int:
    """The edits allowed for a passage."""
    return length // CHARACTERS_AN_EDIT


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q characters from each place on. Equal q-grams have equal hashes, so none is
    missed; others that have them cost an alignment."""
    out, span = codes.astype(np.uint64), 1
    for m in MIX:
        step = min(span, q - span)
        if step <= 0 or len(codes) < q:
            break
        out = (out[:-step] * np.uint64(m)) + (out[step:] ^ out[step:] >> np.uint64(29))
        span += step
    return out[: max(0, len(codes) - q + 1)]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges of count numbers from first on, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def align(text: np.ndarray, passages: list[np.ndarray], low: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each passage the fewest edits that turn it into a part of the text on the diagonals from
    low - e to low + 3 e, with the part's start and end, the leftmost of equals; None over the
    budget. Rows of all passages go on together; cells are edits and start in one number.
    """
    out: list = [None] * len(passages)
    sizes = np.array([len(p) for p in passages], np.int64)
    order = np.argsort(sizes, kind="stable").tolist()
    # A character that equals no other stands before and after the text.
    padded, n = np.concatenate([[-1], text.astype(np.int64), [-1]]), len(text)
    while order:
        width = 4 * budget(int(sizes[order[-1]])) + 1
        at = np.array(order[-max(1, CELLS // width) :])
        del order[-len(at) :]
        size, edits = sizes[at], sizes[at] // CHARACTERS_AN_EDIT
        base, steps = (low[at] - edits)[:, None] + np.arange(width), np.arange(width) * ONE
        letters = np.full((len(at), size.max()), -2, np.int64)
        for row, k in enumerate(at.tolist()):
            letters[row, : sizes[k]] = passages[k]
        cells = np.clip(base, 0, n)
        for i in range(1, int(size.max()) + 1):
            differs = padded[np.clip(base + i, 0, n + 1)] != letters[:, i - 1 : i]
            new = cells + (differs.astype(np.int64) << 32)
            np.minimum(new[:, :-1], cells[:, 1:] + ONE, out=new[:, :-1])
            # Characters only in the text: the least of earlier cells plus the distance.
            new -= steps
            np.minimum.accumulate(new, axis=1, out=new)
            cells = new + steps
            done = size == i
            if done.any() or i % 16 == 0:
                least = cells.min(1)
                near = least >> 32 <= edits
                for row in np.flatnonzero(done & near).tolist():
                    end = int(np.clip(base[row, int(cells[row].argmin())] + i, 0, n))
                    out[at[row]] = (int(least[row] >> 32), int(least[row] & ONE - 1), end)
                keep = near & ~done
                if not keep.any():
                    break
                if not keep.all():
                    at, size, edits, base, letters, cells = (x[keep] for x in (at, size, edits, base, letters, cells))
    return out


class _Grams:
    """The q-grams of passages that have the same q."""

    def __init__(self, q: int, passages: list[str]):
        self.q, self.passages = q, passages
        self.codes = [codes_of(p) for p in passages]
        found = [grams(c, q) for c in self.codes]
        lengths = np.array([len(c) for c in self.codes], np.int64)
        joined, counts = np.concatenate(found), np.array([len(f) for f in found])
        order = np.argsort(joined, kind="stable")
        self.owners = np.repeat(np.arange(len(passages), dtype=np.int32), counts)[order]
        self.places = _spread(np.zeros(len(counts), np.int64), counts).astype(np.int32)[order]
        self.grams, self.first, self.count = np.unique(joined[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(32 * len(self.grams)))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True
        self.edits = lengths // CHARACTERS_AN_EDIT
        self.lengths, self.bound = lengths, lengths - q + 1 - q * self.edits

    def _slot(self, found: np.ndarray) -> np.ndarray:
        return (found * np.uint64(MIX[0])) >> np.uint64(64 - self.bits)

    def matches(self, text: str, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Edits, start and end of each passage found, by its number: its best place in the text."""
        own = grams(codes, self.q)
        at = np.flatnonzero(self.seen[self._slot(own)])
        place = np.minimum(np.searchsorted(self.grams, own[at]), len(self.grams) - 1)
        same = self.grams[place] == own[at]
        at, place = at[same], place[same]
        if len(at) < self.bound.min():
            return {}
        # Passages enough of whose q-grams are in the text at all, wherever they are.
        present, of, times = np.unique(place, return_inverse=True, return_counts=True)
        rows = _spread(self.first[present], self.count[present])
        item, spot, gram = self.owners[rows], self.places[rows], np.repeat(np.arange(len(present)), self.count[present])
        enough = np.bincount(item, minlength=len(self.bound)) >= self.bound
        best: dict[int, tuple[int, int, int]] = {}
        for i in np.flatnonzero(enough).tolist():
            if (start := text.find(self.passages[i])) >= 0:
                best[i], enough[i] = (0, start, start + len(self.passages[i])), False
        keep = np.flatnonzero(enough[item])
        keep = keep[np.argsort(item[keep], kind="stable")]
        item, spot, gram = item[keep], spot[keep], gram[keep]
        if not len(item):
            return best
        starts, before = at[np.argsort(of, kind="stable")], np.cumsum(times) - times
        regions = []
        # Passages in groups of at most HITS hits; one that has more is counted window by window.
        hits = np.cumsum(times[gram])
        last = np.flatnonzero(np.concatenate([item[1:] != item[:-1], [True]])) + 1
        begin = done = 0
        while begin < len(item):
            fits = last[(last > begin) & (hits[last - 1] - done <= HITS)]
            end = int(fits[-1]) if len(fits) else int(last[last > begin][0])
            part = slice(begin, end)
            if len(fits):
                regions.append(self._regions(item[part], spot[part], gram[part], starts, before, times))
            else:
                regions += self._windows(item[part], spot[part], gram[part], starts, of[np.argsort(of, kind="stable")], len(present))
            begin, done = end, int(hits[end - 1])
        number, low = (np.concatenate(x) for x in zip(*regions))
        for i, found in zip(number.tolist(), align(codes, [self.codes[i] for i in number.tolist()], low)):
            if found and (i not in best or found < best[i]):
                best[i] = found
        return best

    def _windows(self, item, spot, gram, starts, of, kinds):
        """_regions() of one passage in windows of the text that overlap by a match's length."""
        reach = len(self.codes[item[0]]) + 4 * int(self.edits[item[0]])
        step = max(reach, HITS // len(item))
        for a in range(0, int(starts.max()) + 1, step):
            inside = (starts >= a) & (starts < a + step + reach)
            times = np.bincount(of[inside], minlength=kinds)
            yield self._regions(item, spot, gram, starts[inside], np.cumsum(times) - times, times)

    def _regions(self, item, spot, gram, starts, before, times) -> tuple[np.ndarray, np.ndarray]:
        """The passages (by number) and the lowest diagonals of the bands that meet the bound."""
        n = times[gram]
        begin = starts[_spread(before[gram], n)]
        item, spot = np.repeat(item, n).astype(np.int64), np.repeat(spot, n)
        e, shift = self.edits[item], begin - spot + self.lengths[item]
        band = shift // (e + 1)
        lower = (shift - band * (e + 1) < e) & (band > 0)
        key = np.concatenate([item << 40 | band, item[lower] << 40 | band[lower] - 1])
        keys, inverse, hits = np.unique(key, return_inverse=True, return_counts=True)
        full = hits >= self.bound[keys >> 40]
        # A q-gram that repeats hits often, but the bound is one of places in the passage and in the
        # text: only different ones count.
        for places in (spot, begin):
            among = full[inverse]
            different = np.unique(inverse[among].astype(np.int64) << 32 | np.concatenate([places, places[lower]])[among]) >> 32
            full &= np.bincount(different, minlength=len(keys)) >= self.bound[keys >> 40]
        number = keys[full] >> 40
        return number, (keys[full] & (1 << 40) - 1) * (self.edits[number] + 1) - self.lengths[number]


class Index:
    """The q-grams of benchmark passages, given as (item, text, number of such rows)."""

    def __init__(self, items: list[tuple[int, str, int]]):
        texts: dict[str, list[int]] = {}
        for item, text, n in items:
            texts.setdefault(normalized(text or ""), []).extend([item] * n)
        texts.pop("", None)
        self.items = texts
        by_q: dict[int, list[str]] = {}
        for text in texts:
            by_q.setdefault(min(Q, len(text) // (budget(len(text)) + 1)), []).append(text)
        self.parts = [_Grams(q, passages) for q, passages in sorted(by_q.items())]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each passage found: its best place in the normalized text."""
        text = normalized(text)
        codes = codes_of(text)
        found = [(part.passages[i], place) for part in self.parts for i, place in part.matches(text, codes).items()]
        return sorted((item, *place) for passage, place in found for item in self.items[passage])


def _passages(benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """The benchmark as broadcast lists for Index, in blocks of at most BLOCK characters (or one
    passage): passages are dealt into small parts by hash, and parts fill the blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 + PARTS * (total // BLOCK))))
    blocks: list[list[int]] = []
    room = -1
    # One row for each part, a bounded number for each block.
    for part, size in sorted(dealt.groupBy("part").agg(F.sum(F.length("text"))).collect()):
        if size > room:
            blocks.append([])
            room = BLOCK
        blocks[-1].append(part)
        room -= size
    if not total:
        blocks = []
    found = (dealt.where(F.col("part").isin(b)).select("item_id", "text", "n").toArrow() for b in blocks)
    return [spark.sparkContext.broadcast(sorted(zip(*(t[c].to_pylist() for c in ("item_id", "text", "n"))), key=repr)) for t in found]


#: The broadcast and its index that a Python worker has built last.
_last: list = [None, None]


def _index(held) -> Index:
    if _last[0] is not held:
        _last[:] = held, Index(held.value)
    return _last[1]


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, start and end for each passage of the benchmark that a row of df
    holds within the edit budget: its best place, in characters of the normalized text.

    The benchmark is a stated query set: it goes over the rows in blocks of at most BLOCK
    characters, one pass each. Null and empty texts match nothing, nor do null and blank
    passages; passages under ten characters match where they occur as they are; repeated rows
    and passages match each; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for n, held in enumerate(_passages(benchmark, item_col, item_text)):
        found = map_arrow(rows, _search(held), SCHEMA)
        out = out.union(found) if n else found
    return out


def _search(held):
    def run(batch):
        index = _index(held)
        found = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "t")) for m in index.matches(t)]
        if found:
            return dict(zip(("doc_id", *FOUND), zip(*found)))

    return run


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """df's rows that hold no passage of the benchmark by leaks(), with df's columns. The text alone
    decides, so ids may be null or repeat."""
    at = df.columns.index(text_col)
    for held in _passages(benchmark, item_col, item_text):

        def run(batches, held=held):
            index = _index(held)
            for batch in slices(batches):
                yield batch.filter(pa.array([not index.matches(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
