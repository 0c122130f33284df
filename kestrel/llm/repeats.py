"""Suffix-array dedup of passages that repeat across documents.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Documents are dealt into chunks by a hash of id and text, a shuffle that three steps
share:

1. Every string of LENGTH bytes has an anchor, the Q bytes in it with the least hash, the same
   wherever the string occurs. Each chunk lists the hashes of its anchors by bucket.
2. A bucket tells each chunk which of its hashes other documents have, too.
3. The chunks send the segments around shared anchors - the bytes of all strings with that
   anchor - to the buckets, each text of a segment once with the least id it occurs in.
4. A bucket sorts the suffixes of its segments: by two-stage sorting it orders directly only
   the suffixes smaller than their successors and induces the rest bucket by bucket;
   neighbours with a common prefix of LENGTH bytes form a class, and the least id of its class
   goes back to each chunk for each string.
5. The chunks compare these ids with their documents' and cut the bytes.

A passage in any number of documents is one entry for each chunk, so no group grows with its
copies; chunks and buckets are as many as the input's bytes ask for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import payload

LENGTH = 50
#: Bytes of an anchor; a string has WINDOW of them.
Q = 20
WINDOW = LENGTH - Q + 1
#: Bytes of text in a chunk, of text for each bucket, and the low bits of a hash that are sent
#: (the bucket is its high bits). Different anchors of equal bits only cost comparisons.
CHUNK, SHARE, LOW = 8 << 20, 8 << 20, 40
#: A document is searched in pieces of at most this many bytes that overlap by LENGTH - 1.
PIECE = 1 << 22
PLACE = (1 << 23) - 1
LAST = (1 << 63) - 1
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _words(data: bytes, order: str) -> np.ndarray:
    """The eight bytes from each place on, as integers."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(data, order + "u8", offset=k, count=(len(data) - k) // 8)
    return out


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of a piece's strings, and the first and last start of the strings
    that each is the anchor of, in order."""
    words, n = _words(data, "<"), len(data) - Q + 1
    h = words[:n] * np.uint64(MIX[0])
    h ^= h >> np.uint64(31)
    h += words[8 : n + 8] * np.uint64(MIX[1])
    h ^= h >> np.uint64(29)
    h += words[12 : n + 12] * np.uint64(MIX[2])
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX[3])
    # The least hash, of equals the leftmost, by one minimum over hash and place.
    least = (h & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & np.uint64(PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    # The bits that choose the anchor are small; mix again so that buckets fill evenly.
    found = (h[at[first]] * np.uint64(MIX[0]))
    found ^= found >> np.uint64(32)
    found *= np.uint64(MIX[1])
    return found, first, np.concatenate([first[1:] - 1, [len(at) - 1]])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_anchors() of a whole document: hashes, first and last starts of strings."""
    found = [(a, *_anchors(data[a : a + PIECE])) for a in range(0, len(data) - LENGTH + 1, PIECE - LENGTH + 1)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[1] for x in found]), np.concatenate([x[2] + x[0] for x in found]), np.concatenate([x[3] + x[0] for x in found])


def suffix_classes(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of `length` bytes in the segments, ordered by two-stage suffix sorting.

    Returns, in suffix order, each string's segment, its start there, and its class: equal
    strings have equal classes. Suffixes compare by their first bytes, `length` at least.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    data = b"".join(segments) + bytes(length + 16)
    n = len(data) - length - 16
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(n) - offsets[owner] <= sizes[owner] - length
    text = np.frombuffer(data, np.uint8)[: n + 1].astype(np.int64)
    # Larger than the successor, judged at the next byte that differs.
    differs = np.concatenate([text[:-1] != text[1:], [True]])
    following = np.where(differs, np.arange(n + 1), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    larger = text[np.minimum(following, n - 1)] > text[np.minimum(following + 1, n)] if n else np.zeros(1, bool)
    larger[n:] = False
    # What is induced needs its successor in order, too.
    needed = np.concatenate([valid, [False]])
    front = np.flatnonzero(needed & larger)
    while len(front):
        front = front[~needed[front + 1]] + 1
        needed[front] = True
        front = front[larger[front]]
    words = _words(data, ">")
    depth = -(-length // 8)
    direct = np.flatnonzero(needed & ~larger)
    direct = direct[np.lexsort([words[np.minimum(direct + 8 * k, len(words) - 1)] for k in reversed(range(depth))])]
    starts = np.searchsorted(text[direct], np.arange(257))
    induced = needed & larger
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def passed(suffixes: np.ndarray, c: int) -> np.ndarray:
        """Hands the suffixes' predecessors that are to be induced to their buckets; returns
        those of the bucket c itself."""
        before = suffixes[suffixes > 0] - 1
        before = before[induced[before]]
        heads = text[before]
        for head in np.unique(heads[heads > c]).tolist():
            waiting[head].append(before[heads == head])
        return before[heads == c]

    for c in range(256):
        # A suffix c x... with x < c precedes all c c...: rounds in order of the run of c.
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(part):
            order.append(part)
            part = passed(part, c)
        part = direct[starts[c] : starts[c + 1]]
        if len(part):
            order.append(part)
            passed(part, c)
    suffixes = np.concatenate(order) if order else np.zeros(0, np.int64)
    suffixes = suffixes[needed[suffixes] & np.concatenate([valid, [False]])[suffixes]]
    # Neighbours whose common prefix has the full length are equal strings.
    same = np.ones(max(0, len(suffixes) - 1), bool)
    for k in range(depth):
        w = words[np.minimum(suffixes + 8 * k, len(words) - 1)]
        if rest := max(0, 8 * (k + 1) - length):
            w = w >> np.uint64(8 * rest)
        same &= w[1:] == w[:-1]
    classes = np.concatenate([[0], np.cumsum(~same)]) if len(suffixes) else np.zeros(0, np.int64)
    return owner[suffixes], suffixes - offsets[owner[suffixes]], classes


def _pack(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (LOW // 8), 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(data, np.uint8).reshape(-1, LOW // 8)
    return out.view("<u8").ravel()


def _split(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and low bits of hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), hashes & np.uint64((1 << LOW) - 1)


def _rows(group: pa.Table) -> list[tuple[int, bytes]]:
    """Documents (id, bytes) of a chunk, in the one order that every step uses."""
    return sorted((i, (t or "").encode("utf-8")) for i, t in zip(group["doc"].to_pylist(), group["t"].to_pylist()))


WIRE = "bucket int, chunk int, kind int, count long, a binary, b binary, c binary"
WIRE_NAMES = [x.split()[0] for x in WIRE.split(", ")]
WIRE_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 3


def _wire(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(WIRE_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, WIRE_TYPES)], names=WIRE_NAMES)


def _listed(group: pa.Table, bits: int) -> pa.Table:
    """Step 1: the distinct anchors of a chunk, those of several documents first."""
    chunk = group["chunk"][0].as_py()
    found = [np.unique(anchors(data)[0]) for _, data in _rows(group)]
    hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
    bucket, low = _split(hashes, bits)
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    out = []
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        if y > x:
            many = counts[x:y] > 1
            out.append((b, chunk, 0, int(many.sum()), _pack(np.concatenate([low[x:y][many], low[x:y][~many]])), b"", b""))
    return _wire(out)


def _matched(group: pa.Table) -> pa.Table:
    """Step 2: for each chunk its hashes that several documents have."""
    bucket, chunks = group["bucket"][0].as_py(), group["chunk"].to_pylist()
    lists = [_unpack(x) for x in group["a"].to_pylist()]
    # Low bits that one chunk holds twice count as in several documents.
    many = [np.unique(x[:n]) for x, n in zip(lists, group["count"].to_pylist())]
    hashes, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = np.union1d(hashes[counts > 1], np.concatenate(many))
    out = []
    for chunk, own in zip(chunks, lists):
        own = np.unique(own)
        own = own[np.isin(own, shared, assume_unique=True)]
        if len(own):
            out.append((bucket, chunk, 1, len(own), _pack(own), b"", b""))
    return _wire(out)


class _Segments:
    """The segments around a chunk's shared anchors: of each bucket the distinct ones, by first
    occurrence in the order of documents, with the least id."""

    def __init__(self, rows: list[tuple[int, bytes]], messages: pa.Table, bits: int):
        keys = [np.zeros(0, np.uint64)]
        for bucket, kind, a in zip(*(messages[c].to_pylist() for c in ("bucket", "kind", "a"))):
            if kind == 1:
                keys.append(_unpack(a) | np.uint64(bucket << LOW))
        shared = np.sort(np.concatenate(keys))
        self.numbers: dict[bytes, int] = {}
        self.bucket: list[int] = []
        self.least: list[int] = []
        #: For each document: numbers of its segments, and where they begin and end.
        self.places: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for doc, data in rows:
            hashes, first, last = anchors(data)
            bucket, low = _split(hashes, bits)
            key = low | bucket.astype(np.uint64) << np.uint64(LOW)
            if len(shared):
                at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
                keep = shared[at] == key
            else:
                keep = np.zeros(len(key), bool)
            first, last, own = first[keep], last[keep] + LENGTH, []
            for b, x, y in zip(bucket[keep].tolist(), first.tolist(), last.tolist()):
                segment = data[x:y]
                number = self.numbers.get(segment)
                if number is None:
                    number = self.numbers[segment] = len(self.least)
                    self.bucket.append(b)
                    self.least.append(doc)
                own.append(number)
            self.places.append((own, first, last))

    def by_bucket(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for number, b in enumerate(self.bucket):
            out.setdefault(b, []).append(number)
        return out


def _sent(chunk: int, group: pa.Table, messages: pa.Table, bits: int) -> pa.Table:
    """Step 3: the chunk's segments to their buckets."""
    found = _Segments(_rows(group), messages, bits)
    texts = list(found.numbers)
    out = []
    for b, numbers in found.by_bucket().items():
        own = [texts[k] for k in numbers]
        out.append((
            b, chunk, 2, len(own), b"".join(own), np.array([len(x) for x in own], "<u2").tobytes(),
            np.array([found.least[k] for k in numbers], "<i8").tobytes(),
        ))
    return _wire(out)


def _sorted(group: pa.Table) -> pa.Table:
    """Step 4: the least id of each string, by the chunks' segments in their order."""
    bucket = group["bucket"][0].as_py()
    numbers: dict[bytes, int] = {}
    least: list[int] = []
    asked = []
    for chunk, a, b, c in zip(*(group[x].to_pylist() for x in ("chunk", "a", "b", "c"))):
        own, at = [], 0
        for size, doc in zip(np.frombuffer(b, "<u2").tolist(), np.frombuffer(c, "<i8").tolist()):
            segment = a[at : at + size]
            at += size
            number = numbers.setdefault(segment, len(least))
            if number == len(least):
                least.append(doc)
            elif doc < least[number]:
                least[number] = doc
            own.append(number)
        asked.append((chunk, own))
    # Every string of every segment takes the least id of its class in the suffix order.
    owner, start, classes = suffix_classes(list(numbers))
    heads = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    lowest = np.minimum.reduceat(np.array(least, np.int64)[owner], heads)[classes]
    strings = lowest[np.lexsort((start, owner))]
    ends = np.cumsum([len(x) - LENGTH + 1 for x in numbers])
    begins = np.concatenate([[0], ends[:-1]])
    single = np.minimum.reduceat(strings, begins)
    varied = single != np.maximum.reduceat(strings, begins)
    out = []
    for chunk, own in asked:
        own = np.array(own)
        several = np.flatnonzero(varied[own])
        ids = b"".join(strings[begins[k] : ends[k]].astype("<i8").tobytes() for k in own[several].tolist())
        out.append((bucket, chunk, 3, len(own), single[own].astype("<i8").tobytes(), several.astype("<i8").tobytes(), ids))
    return _wire(out)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _spans(group: pa.Table, messages: pa.Table, bits: int):
    """Step 5: (id, bytes, first and end of each run of removed bytes) for each document."""
    rows = _rows(group)
    found = _Segments(rows, messages, bits)
    texts = list(found.numbers)
    single = np.array(found.least, np.int64)
    several: dict[int, np.ndarray] = {}
    by_bucket = found.by_bucket()
    for bucket, kind, a, b, c in zip(*(messages[x].to_pylist() for x in ("bucket", "kind", "a", "b", "c"))):
        if kind == 3:
            numbers, at = by_bucket[bucket], 0
            single[numbers] = np.frombuffer(a, "<i8")
            ids = np.frombuffer(c, "<i8")
            for j in np.frombuffer(b, "<i8").tolist():
                n = len(texts[numbers[j]]) - LENGTH + 1
                several[numbers[j]] = ids[at : at + n]
                at += n
    mixed = np.zeros(len(single), bool)
    mixed[list(several)] = True
    for (doc, data), (own, first, last) in zip(rows, found.places):
        own = np.array(own, np.int64)
        cover = np.zeros(len(data) + 1, np.int64)
        whole = (single[own] < doc) & ~mixed[own]
        np.add.at(cover, first[whole], 1)
        np.add.at(cover, last[whole], -1)
        for j in np.flatnonzero(mixed[own]).tolist():
            starts = first[j] + np.flatnonzero(several[int(own[j])] < doc)
            cover[starts] += 1
            cover[starts + LENGTH] -= 1
        gone = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        yield doc, data, edges[::2], edges[1::2]


def _report(group: pa.Table, messages: pa.Table, bits: int) -> pa.Table:
    out = []
    for doc, data, first, end in _spans(group, messages, bits):
        cuts = [0, *np.ravel(np.column_stack([first, end])).tolist(), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
        out.append((None if doc == LAST else doc, len(data), len(data) - len(kept), len(first), hashlib.sha256(kept).hexdigest()))
    columns = zip(*out) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes)
    and kept_sha256 of the bytes that stay.

    Null texts count as empty. Documents under LENGTH bytes lose nothing, nor do the documents
    with the smallest id that holds a string; rows that share an id are equals and lose nothing
    to each other. Rows without an id come after all others. Other columns are ignored.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    chunks = max(1, size // CHUNK)
    bits = max(4, (size // SHARE).bit_length())
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    # Rows that share an id lose nothing to each other, so they may lie in different chunks.
    spread = F.xxhash64(doc, F.col(text_col))
    rows = df.select(F.pmod(spread, F.lit(chunks)).cast("int").alias("chunk"), doc.alias("doc"), F.col(text_col).alias("t"))
    by_chunk = rows.groupBy("chunk")

    def cogrouped(messages: DataFrame, function, schema: str) -> DataFrame:
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return function(key[0].as_py(), left, right)

        return by_chunk.cogroup(messages.groupBy("chunk")).applyInArrow(run, schema)

    listed = by_chunk.applyInArrow(lambda g: _listed(g, bits), WIRE)
    matched = listed.groupBy("bucket").applyInArrow(_matched, WIRE)
    sent = cogrouped(matched, lambda c, g, m: _sent(c, g, m, bits) if g.num_rows else _wire([]), WIRE)
    answered = sent.groupBy("bucket").applyInArrow(_sorted, WIRE)
    return cogrouped(matched.union(answered), lambda c, g, m: _report(g, m, bits), SCHEMA)


def without_repeats_sql() -> str:
    """DuckDB SQL for without_repeats(documents), by grouping all strings."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
    g AS (SELECT doc_id, k, substr(h, 2 * k + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, n - {LENGTH - 1})) AS k FROM d)),
    m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
    c AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM g JOIN m USING (s) WHERE first < doc_id),
    i AS (SELECT doc_id, k, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
    r AS (SELECT doc_id, run, min(k) AS a, max(k) + {LENGTH} AS b FROM i GROUP BY ALL),
    p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
    x AS (SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)"""
