"""Packing against the tokenizers library and an exact account of every place."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brute import table
from kestrel.llm import packing

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (1, "A short text.", 5, "x"),
    (2, None, 5, "x"),
    (3, "", 5, "x"),
    (3, "", 5, "x"),
    (None, "no id", 5, "x"),
    (4, "Ünïcode ß <|endoftext|> 日本語 ͸ \U000e0041 'll\t\n " + "x" * 300, 5, "x"),
    (5, "word and " * 9_000, 5, None),
    (5, "other text of a known id", 5, None),
    (6, "a b " * 511 + "a", 5, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, length int, bucket string").repartition(3)


def plain_pieces(rows, capacity=1024):
    t, out = Tokenizer.from_file(VOCABULARY), []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces, rest = [], ids
        while rest:
            pieces.insert(0, rest[-capacity:])
            rest = rest[:-capacity]
        start = 0
        for k, piece in enumerate(pieces):
            out.append((i, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
            start += len(piece)
    return out


def least_sequences(lengths, capacity=1024):
    """No packing needs fewer: the tokens, and the pieces that cannot share a sequence."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def test_packing(spark, odd):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((odd, [r[:2] for r in ROWS]), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got = packing.packed(df, VOCABULARY).collect()
        assert table(r[:5] for r in got) == table(plain_pieces(rows))
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for placed in sequences.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= 1024
        least = least_sequences([r.length for r in got])
        assert least <= len(sequences) <= least + 2
    assert packing.packed(odd.limit(0), VOCABULARY).collect() == []


def test_sequences_hold_the_ids(spark, odd):
    places = packing.packed(odd, VOCABULARY)
    got = packing.sequences(odd, places, VOCABULARY).collect()
    found = []
    for r in got:
        ids, at = np.frombuffer(r.ids, "<u4"), 0
        assert len(ids) == sum(r.lengths) <= 1024
        for n in r.lengths:
            found.append((n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted(found) == sorted(p[3:] for p in plain_pieces([r[:2] for r in ROWS]))


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for case in range(40):
        capacity = int(rng.choice([1, 2, 7, 64, 256]))
        counts = rng.integers(0, int(rng.choice([2, 5, 1000])), capacity + 1)
        counts[0] = 0
        counts[rng.random(capacity + 1) < rng.choice([0, 0.5, 0.95])] = 0
        used = np.zeros(capacity + 1, int)
        for way, times in packing.plan(counts):
            assert times > 0 and 0 < sum(way) <= capacity
            np.add.at(used, list(way), times)
        assert (used == counts).all()
    assert packing.plan(np.zeros(65, int)) == []


def test_fit_is_a_least_squares_fit():
    """On a histogram made of patterns, the fit leaves next to nothing and so does the plan."""
    rng = np.random.default_rng(2)
    ways = packing.patterns(np.ones(129, int))
    counts = np.zeros(129, int)
    for way in ways[rng.choice(len(ways), 40)]:
        np.add.at(counts, way[way > 0], 500)
    chosen, repeats = packing.fitted(counts, packing.patterns(counts))
    left = counts - packing._columns(chosen, 129) @ repeats
    assert (repeats > 0).all() and np.abs(left[1:]).sum() < 0.02 * counts.sum()
    assert sum(n for _, n in packing.plan(counts)) <= 1.005 * least_sequences(np.repeat(np.arange(129), counts).tolist(), 128)


def test_one_length_of_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit(" word"), (F.col("id") % 900).cast("int"))).alias("text"))
    got = packing.packed(df, VOCABULARY).collect()
    assert len(got) == 3000
    sequences = defaultdict(int)
    for r in got:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024 and len(sequences) <= least_sequences([r.length for r in got]) * 1.01 + 1
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000


def test_ids_are_the_library_s():
    made, rng = packing.ByteEncoder(VOCABULARY), random.Random(3)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000, 3)]]
    texts = ["".join(rng.choices(points[:0x600] if rng.random() < 0.5 else points, k=rng.randrange(12))) + rng.choice(["", " 's", "\n\n a", "<|endoftext|>"]) for _ in range(20_000)]
    want = made.library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want) if np.frombuffer(made.encode(t), "<u4").tolist() != w.ids] == []
    # Characters of another kind to one of the two go to the library.
    made.agrees = lambda c: False
    assert all(np.frombuffer(made.encode(t), "<u4").tolist() == w.ids for t, w in zip(texts[:500], want))
