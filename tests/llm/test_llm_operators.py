"""Each operator against brute force, on a small table of odd rows and on sf0.001."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from brute import brute_components, brute_edits, brute_lines, brute_repeats, brute_warc, edits, exact_similar, shingles, table
from kestrel.llm import bpe, components, decontaminate, html, linededup, media, repeats, sharding, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "The quick brown fox jumps over the lazy dog while 12 cats watch from the wall. "
#: Null and empty cells, ties, repeated rows, long texts and columns that clash with inner names.
ROWS = [
    (1, LONG * 3 + "\nsecond line of some length here\n\nshort\nshort", "a", 1),
    (2, LONG * 3 + "\nsecond line of some lengxh here\nshort", "b", 2),
    (3, None, None, None),
    (4, "", "c", 3),
    (4, "", "c", 3),
    (5, "   \n\t", "d", 4),
    (None, LONG * 3, "e", 5),
    (7, "Ünïcode ß <|endoftext|> ΑΣ 日本語 'll " + "x" * 300, "f", 6),
    (8, "abc " * 20_000, "g", 7),
    (9, "second line of some length here", None, 8),
    (9, "second line of some length here", None, 8),
    (10, "prefix " + LONG * 2, "h", 9),
    (11, "Ünïcode ß <|endoftext|> ΑΣ 日本語 'll " + "x" * 300, "f", 6),
]
SCHEMA = "doc_id long, text string, line string, chunk int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumnsRenamed({})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(odd, documents):
    return [(odd, [(r[0], r[1]) for r in ROWS]), (documents, [(r.doc_id, r.text) for r in documents.collect()])]


def test_bpe_matches_the_library(odd, documents):
    t = Tokenizer.from_file(VOCABULARY)
    for df, rows in both(odd, documents):
        got = bpe.encoded(df, VOCABULARY, outputs=("n_tokens", "ids", "decoded")).collect()
        want = []
        for i, text in rows:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want.append((i, len(ids), bytearray(np.array(ids, "<u4").tobytes()), t.decode(ids, skip_special_tokens=False)))
        assert table(got) == table(want)


def test_bpe_knows_every_character():
    """As the library: every assigned code point and more, and random strings of odd ones."""
    t, own, rng = Tokenizer.from_file(VOCABULARY), bpe.encoder(VOCABULARY), random.Random(1)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x32400, 7), *range(0xE0000, 0x110000, 97)]]
    odd = [c for c in points if c < "\u3400"] + points[-500:] + list("aȩ\u0301\u0323 '1²ΣİſKẛßΑs.각") * 300
    texts = [f"a{c}b1{c}\u0301" for c in points] + ["".join(rng.choices(odd, k=rng.randrange(1, 14))) for _ in range(30_000)]
    want = t.encode_batch(texts, add_special_tokens=False)
    assert [x for x, w in zip(texts, want) if np.frombuffer(own.encode(x)[0], "<u4").tolist() != w.ids] == []


def test_bpe_empty_table(odd):
    assert bpe.encoded(odd.limit(0), VOCABULARY).collect() == []


def test_sharding(odd, documents):
    for df, rows in both(odd, documents):
        got = sharding.sharded(df).collect()
        data = [(t or "").encode() for _, t in rows]
        assert table((r.doc_id, r.size, r.text_crc32) for r in got) == table((i, len(d) + 1, zlib.crc32(d)) for (i, _), d in zip(rows, data))
        slots, shards = defaultdict(list), {}
        for r in got:
            slots[r.shard].append(r.slot)
            assert shards.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
            assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(odd.limit(0)).collect() == []


def test_sharding_weights_move_rows_only_into_the_heavier_subtree(spark):
    from pyspark.sql import functions as F

    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    light = sharding.even_tree()
    heavy = {**light, "region0": {**light["region0"], "region0/rack0": {**light["region0"]["region0/rack0"], 0: 3.0}}}
    moved = sharding.with_shard(sharding.with_shard(ids, F.col("k"), light, "a"), F.col("k"), heavy, "b")
    rows = [(r.a, r.b) for r in moved.collect()]
    assert all(b < 8 for a, b in rows if a != b)
    assert 2.2 < sum(b == 0 for _, b in rows) / (len(rows) / 18) < 3.8
    counts = np.bincount([a for a, _ in rows], minlength=16)
    assert counts.min() > 180 and counts.max() < 330


def plain_png(image):
    """The samples of a grey image of 64 columns, read by the letter of the format."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(image[at + 4 : at + 8 + n])
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    rows = zlib.decompress(parts[b"IDAT"])
    assert int.from_bytes(parts[b"IHDR"][:4], "big") == 64 and parts[b"IHDR"][8:] == bytes([8, 0, 0, 0, 0]) and b"IEND" in parts
    assert int.from_bytes(parts[b"IHDR"][4:8], "big") * 65 == len(rows) and not any(rows[::65])
    return b"".join(rows[k + 1 : k + 65] for k in range(0, len(rows), 65))


def test_media(odd, documents):
    for df, rows in both(odd, documents):
        got = media.document_media(df).collect()
        want = []
        for i, text in rows:
            data = (text or "").encode()
            payload = data + bytes(-len(data) % 64 if data else 64)
            image = media.png(payload)
            assert plain_png(image) == payload
            shares = [sum(b >> 4 == k for b in payload) * 1000 // len(payload) for k in range(16)]
            feature = ",".join(map(str, shares)) + f";{sum(payload) * 1000 // len(payload)}"
            want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature))
        assert table(got) == table(want)
    assert media.document_media(odd.limit(0)).collect() == []


def test_media_sequences_keep_order_and_captions(spark):
    page = "<p>one</p><figure><img src='media:sha256:aa'><figcaption>cap <b>tion</b></figcaption></figure><p>two<br>three</p><img src='x:bb' alt='alt'><script>no</script>"
    df = spark.createDataFrame([(1, page), (2, None)], "id long, page string")
    found = {r.id: [tuple(x) for x in r["items"]] for r in media.interleaved(df, "id", "page").collect()}
    assert found == {1: [(0, "text", "one", None, None), (1, "media", None, "aa", "cap tion"), (2, "text", "two", None, None), (3, "text", "three", None, None), (4, "media", None, "bb", "alt")], 2: []}
    store = spark.createDataFrame([("aa", 7)], "digest string, size int")
    resolved = media.resolved(media.interleaved(df, "id", "page"), store).where("item.kind = 'media'")
    assert table((r.item.position, r["size"]) for r in resolved.collect()) == [(1, 7), (4, None)]


def test_toxicity_on_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scores(documents, toxicity.train(documents, labels)).collect()}
    assert len(got) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    right = [r.predicted == t for r, t in held]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95


def test_toxicity_learns_as_plain_ftrl(spark):
    """The weights of the sample, row after row, feature after feature, with plain numbers."""
    documents, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    texts, named = {}, {}
    for r in documents.union(documents.selectExpr("doc_id", "concat(text, ' z')", "lang", "source", "n_chars")).collect():
        texts[r.doc_id] = min(r.text, texts.get(r.doc_id, r.text))
    for r in labels.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts:
            named[r.doc_id] = r.toxic
    order = sorted(named, key=lambda i: (xxhash.xxh64_intdigest(str(i)), i))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        bound = toxicity.L1 if k else 0.0
        return 0.0 if abs(z[k]) <= bound else -(z[k] - (bound if z[k] > 0 else -bound)) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for i in order:
            at = toxicity.features(texts[i]).tolist()
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - named[i]
            for k in at:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * w[k]
                n[k] += g * g
    twice = documents.union(documents.selectExpr("doc_id", "concat(text, ' z')", "lang", "source", "n_chars"))
    at, w = toxicity.train(twice, labels)
    want = {k: weight(k) for k in n if weight(k)}
    got = dict(zip(at.tolist(), w.tolist()))
    assert got.keys() == want.keys() and len(want) > 3 and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.scores(odd, model).collect()
    assert len(got) == len(ROWS) and {r.score for r in got if r.doc_id in (3, 4, 5)} == {next(r.score for r in got if r.doc_id == 3)}
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.scores(odd.limit(0), model).collect() == []
    none = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.scores(odd, none).collect()} == {0.5}


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    alphabets = ["abcdefghij éß", "абвгдежзий ёщ", "的一是不了人我在有他这", "ab的я "]
    items = [(k, "".join(rng.choices(alphabets[k % 4], k=rng.randrange(11, 90)))) for k in range(16)] + [(90, "tiny"), (91, None), (92, ""), (93, "AB  cd\nefgh ijkl"), (94, "tiny"), (90, "tiny")]
    docs = []
    for n in range(160):
        letters = alphabets[n % 4]
        text = "".join(rng.choices(letters, k=rng.randrange(0, 150)))
        if n % 3:
            passage = list(rng.choice(items[:16])[1])
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["x"], ["y", passage[at]]])
            text += "".join(passage) + "".join(rng.choices(letters, k=40))
        docs.append((n, text, 1))
    docs += [(200, "Tiny", 2), (201, "a tiny thing", 2), (202, None, None), (203, "x ab cd\n\nEFGH ijkl y", 1), (None, items[0][1], 1), (None, items[0][1], 1), (204, "", 1)]
    # A long text of few letters, with a passage near its end: many hits on many diagonals.
    docs.append((300, "".join(rng.choices("ab", k=3000)) + items[0][1] + "ab" * 200, 1))
    items.append((95, "ab" * 40 + "ba" * 20))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text, _ in docs:
        text = decontaminate.normalized(text or "")
        for i, passage in items:
            passage = decontaminate.normalized(passage or "")
            if passage and (e := brute_edits(passage, text)) <= decontaminate.budget(len(passage)):
                want.append((d, i, e))
    leaked = {d for d, _, _ in want}
    for hits, block in ((decontaminate.HITS, decontaminate.BLOCK), (50, 200)):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = decontaminate.leaks(df, bench).collect()
        assert table((r.doc_id, r.item_id, r.edits) for r in got) == table(want) and len(want) > 60
        texts = {d: decontaminate.normalized(t or "") for d, t, _ in docs}
        passages = {i: decontaminate.normalized(t or "") for i, t in items}
        assert all(edits(passages[r.item_id], texts[r.doc_id][r.start : r.end]) == r.edits for r in got)
        kept = decontaminate.without_leaks(df, bench)
        assert kept.columns == df.columns and table((r.doc_id, r.text) for r in kept.collect()) == table((d, t) for d, t, _ in docs if d not in leaked)
    assert decontaminate.leaks(df, bench.limit(0)).collect() == [] and decontaminate.leaks(df.limit(0), bench).collect() == []
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(docs) and decontaminate.without_leaks(df.limit(0), bench).collect() == []


def test_decontamination_of_hard_texts_ends_soon():
    rng = random.Random(4)
    words = ["".join(rng.choices("абвгдежзиклмн", k=rng.randrange(2, 9))) for _ in range(2000)]
    stem = "какое из следующих утверждений верно "
    items = [(k, stem + " ".join(rng.choices(words, k=12)), 1) for k in range(10_000)]
    text = " ".join([*rng.choices(words, k=1500), items[77][1].replace("верно", "верн0"), *rng.choices(words, k=1500), stem])
    index = decontaminate.Index(items)
    began = time.perf_counter()
    assert [(i, e) for i, e, _, _ in index.matches(text)] == [(77, 1)]
    long = "".join(rng.choices("абвгд ", k=6000))
    assert decontaminate.Index([(1, long, 1)]).matches("x " + long[:3000] + "щ" + long[3001:])[0][:2] == (1, 1)
    decontaminate.Index([(1, "a" * 999 + "b", 1)]).matches("a" * 20_000)
    assert time.perf_counter() - began < 30


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert table(warc.archived(pages).collect()) == table(brute_warc(rows))
    odd = [(5, "u", "x" * 1000), (4, "u\r\nv", "x" * 1000), (4, "u\r\nv", "x" * 1000), (1, None, None), (2, "w", ""), (None, "w", "ünï" * 50), (None, "w", "x" * 1000)]
    df = spark.createDataFrame([(*x, "clash", 0) for x in odd], "page_id long, url string, html string, digest string, chunk_no int")
    for size in (7, 64, 1 << 18):
        assert table(warc.archived(df, size).collect()) == table(brute_warc([(i, h) for i, _, h in odd]))
    assert warc.archived(df.limit(0)).collect() == []


def test_warc_bytes_are_a_warc_file(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>é</p>" * 10), (2, "http://b/", "<p>é</p>" * 10)], "page_id long, url string, html string").coalesce(1)
    rows = sorted(warc.chunks(df, 16).collect(), key=lambda r: (r.record_id, r.chunk_no))
    data = b"".join(bytes(r.data) for r in rows)
    at = seen = 0
    while at < len(data):
        head = data[at : data.index(b"\r\n\r\n", at)].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        length = int(next(x for x in head if x.startswith("Content-Length")).split(": ")[1])
        at = data.index(b"\r\n\r\n", at) + 4 + length
        assert data[at : at + 4] == b"\r\n\r\n"
        at, seen = at + 4, seen + 1
    assert seen == 2


@pytest.mark.parametrize("crowd", [32, 1])
def test_linededup_matches_brute_force(spark, odd, monkeypatch, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcde fé", k=rng.randrange(3, 40))) for _ in range(40)]
    rows = []
    for n in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(line) + 1)
                line[at : at + 1] = rng.choice([[], ["z"], ["q", "r"]])
            lines.append("".join(line))
        rows.append((n, "\n".join(lines)))
    # A very common line, short ones with one edit, and columns with inner names.
    rows += [(100 + n, "the same line in every text\nabcdef" + "gh"[n % 2]) for n in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, dkey int, gone string")
    for frame, all_rows in ((df, rows), (odd, [r[:2] for r in ROWS])):
        got = linededup.line_report(frame).collect()
        want = brute_lines(all_rows)
        assert table(got) == table(want)
        gone = {(i, t or ""): set(e) | set(c) for (i, t), (_, _, e, c, _) in zip(all_rows, want)}
        kept = [(i, t if not gone[i, t or ""] else "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i, t or ""])) for i, t in all_rows]
        out = linededup.without_repeats(frame)
        assert out.columns == frame.columns
        assert table((r.doc_id, r.text) for r in out.collect()) == table(kept)
    assert any(r[3] for r in brute_lines(rows))
    assert linededup.line_report(df.limit(0)).collect() == []


@pytest.mark.parametrize("words", [3, 5])
def test_simhash_matches_brute_force(odd, documents, words):
    for df, rows in both(odd, documents):
        want = brute_components(rows, words)
        assert table(simhash.clustered(df, words=words).collect()) == table(want)
    assert simhash.clustered(odd.limit(0)).collect() == []


def test_similar_texts_meet(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(3000)]
    texts = []
    for n in range(150):
        base = rng.choices(vocabulary, k=rng.randrange(60, 400))
        texts.append(base)
        for _ in range(rng.randrange(0, 3)):
            near = list(base)
            for _ in range(max(1, len(base) // 100)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(near)
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)] + [(1000, rows_ := " ".join(texts[0])), (1000, rows_), (1001, None), (1002, ""), (None, " ".join(texts[1])), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in simhash.similar(df).collect():
        got.setdefault(r.doc_id, r.component_id)
    sets = {i: shingles(t or "") for i, t in rows if i is not None}
    near = far = met = wrong = 0
    for a, b in __import__("itertools").combinations(sets, 2):
        similarity = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
        near, met = near + (similarity >= 0.8), met + (similarity >= 0.8 and got[a] == got[b])
        far, wrong = far + (similarity < 0.5), wrong + (similarity < 0.5 and got[a] == got[b])
    assert near > 50 and met >= 0.95 * near and wrong == 0 and far > 1000
    clash = simhash.deduplicated(df.selectExpr("doc_id", "text", "1 AS key", "2 AS id", "3 AS row"))
    assert clash.columns == ["doc_id", "text", "key", "id", "row"]
    kept = [r.doc_id for r in clash.collect()]
    assert {i for i in kept} == {c for c in got.values()} | {None} and kept.count(None) == 1
    assert simhash.similar(df.limit(0)).collect() == [] and simhash.deduplicated(df.limit(0)).collect() == []


def edited(rng, base, changes, vocabulary):
    near = list(base)
    for k in rng.sample(range(len(near)), changes):
        near[k] = rng.choice(vocabulary)
    return near


def test_similar_texts_with_a_common_template_meet(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(50_000)]
    template = rng.choices(vocabulary, k=100)
    own = [rng.choices(vocabulary, k=50) for _ in range(2000)]
    own += [edited(rng, own[k], 1, vocabulary) for k in range(0, 200)] + [edited(rng, own[k], 2, vocabulary) for k in range(200, 400)]
    rng.shuffle(own)
    rows = [(n, " ".join(template + x)) for n, x in enumerate(own)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = exact_similar(rows)
    assert got == want and sum(i != c for i, c in want.items()) > 350


def test_similar_is_exact_about_the_bound(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(20_000)]
    rows = []
    for n in range(400):
        base = rng.choices(vocabulary, k=200)
        # One phrase repeated in a line weighs nothing beyond its shingles.
        line = ["again", "and", "once", "more", "then"] * 60 if n % 4 == 0 else []
        rows += [base + line, edited(rng, base, rng.randrange(3, 7), vocabulary) + line]
    rows = [(n, " ".join(x)) for n, x in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = exact_similar(rows)
    assert got == want and 100 < sum(i != c for i, c in want.items()) < 350


def test_blocks_grow_with_the_number_of_texts():
    sizes = [simhash.block_places(n).shape for n in (0, 1000, 1 << 20, 1 << 24, 1 << 30)]
    assert sizes[0] == sizes[1] == (126, 24) and sizes[3][1] == 29 and sizes[4][1] == 35
    for count, length in sizes[2:]:
        assert 0.85 < count * 0.871**length / (126 * 0.871**24) < 1.15


def test_simhash_links_and_components(spark):
    rng = random.Random(2)
    values = [0]
    while len(values) < 300:
        v = rng.choice(values[-40:])
        for _ in range(rng.choice([1, 3, 3, 5])):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = list(dict.fromkeys(v - (1 << 64) if v >> 63 else v for v in values))
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    assert {tuple(r) for r in links.collect()} == want
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    assert {tuple(r) for r in components.components(chain).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}


def test_repeats_match_brute_force(spark, odd, documents, monkeypatch):
    for df, rows in both(odd, documents):
        assert table(repeats.without_repeats(df).collect()) == table(brute_repeats(rows))
    rng = random.Random(9)
    rows = []
    for n in range(80):
        text = "".join(rng.choices("ab", k=rng.randrange(0, 160)))
        if rows and rng.random() < 0.7:
            other = rng.choice(rows)[1]
            at = rng.randrange(len(other) + 1)
            text = text[:30] + other[at : at + rng.randrange(45, 120)] + text[30:]
        rows.append((rng.choice([n, n, None, 3]), text))
    monkeypatch.setattr(repeats, "CHUNK", 900)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(repeats.without_repeats(df).collect()) == table(brute_repeats(rows))
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_suffix_classes():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([2, 3, 256])
        segments = list(dict.fromkeys(bytes(rng.randrange(letters) for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 8))))
        found = [(segments[a][b : b + 5], c) for a, b, c in zip(*repeats.suffix_classes(segments, 5))]
        strings = [s[k : k + 5] for s in segments for k in range(len(s) - 4)]
        assert [x for x, _ in found] == sorted(strings) and len(set(found)) == len(set(strings))


def test_anchors_of_long_documents_are_the_same_in_pieces(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 101, 5000, np.uint8))
    whole = repeats.anchors(data)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2])])
    assert (covered == np.arange(len(data) - 49)).all()
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = repeats.anchors(data)
    expand = lambda x: np.repeat(x[0], x[2] - x[1] + 1)
    assert (expand(parts) == expand(whole)).all()


def test_html_main_text(spark):
    shell = "<html><head><title>T</title><style>x</style></head><body><nav><ul><li>menu</li></ul></nav>{}<footer>foot</footer></body></html>"
    pages = [
        (1, "http://a.com/x/1", shell.format("<article><h1>Head &amp; tail</h1><p>one\n  <b>two</b><br>three<p>four</p><div class='comments'><p>no</p></div></article><div class='ad'>buy</div>")),
        (2, "http://a.com/x/2", "<div>Site name</div><p>own text two</p><p>All rights</p>"),
        (3, "http://a.com/x/3", "<div>Site name</div><p>own text three</p><p>All rights</p>"),
        (4, "http://a.com/x/0", "<div>Site name</div><p>own text zero</p><p>All rights</p>"),
        (5, "http://b.com/", "<p>alone &eacute;&nbsp;x</p><script>if (a < b) {}</script>"),
        (6, None, None),
        (6, None, None),
        (7, "nonsense", "a < b <p>c"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got == {1: "Head & tail\none two three\nfour", 2: "own text two", 3: "own text three", 4: "own text zero", 5: "alone é x", 6: "", 7: "a < b\nc"}
    assert html.main_texts(df).count() == len(pages) and html.main_texts(df.limit(0)).collect() == []


def test_html_names_drop_no_article():
    kept = lambda page: [x for kind, x in html.lines_of(page) if kind == html.ARTICLE] or [x for kind, x in html.lines_of(page) if kind == html.FREE]
    for shell in ("<div class='page has-sidebar'>{}</div>", "<div class='content no-sidebar'>{}</div>", "<div class='sidebar'>{}</div>"):
        assert kept(shell.format("<article><p>text</p></article>")) == ["text"] and kept(shell.format("<p>text</p>")) == ["text"]
    page = "<article class='post related'><p class='notice'>one</p><table class='search-results'><tr><td>two</td></tr></table><div class='ad'>buy</div><p>three</p></article>"
    assert kept(page) == ["one", "two", "three"]
    assert kept("<div class='menu main'>a menu</div><p>text of the page</p>") == ["text of the page"]


def test_html_copies_keep_their_text(spark):
    page = "<div>Site name</div><p>{0} first passage of the article, long enough to be text.</p><p>{0} second passage, which is also long enough.</p><p>{0} third one, which ends the article after some words.</p>{1}<div>All rights</div>"
    pages = [(k, f"http://a.com/x/{k}", page.format("Own" if k < 4 else "Other", "")) for k in range(5)]
    # A near copy, and a shared line that stands again where the neighbour lacks it.
    pages += [(10, "http://b.com/1", page.format("Own", "")), (11, "http://b.com/2", page.format("Own", "<p>print</p>"))]
    pages += [(20, "http://c.com/1", "<p>Refrain</p><p>a verse of page one of this site</p><p>Refrain</p>"), (21, "http://c.com/2", "<p>Refrain</p><p>a verse of page two of this site</p>")]
    got = {r.page_id: r.text.split("\n") for r in html.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(len(got[k]) == 3 and got[k][0].startswith("Own" if k < 4 else "Other") for k in range(5))
    assert all(any("third" in x for x in got[k]) for k in (10, 11))
    assert got[20] == ["a verse of page one of this site", "Refrain"] and got[21] == ["a verse of page two of this site"]


def test_html_pairs_are_the_same_for_any_ranges(spark):
    pages = [(k, f"http://h{k % 3}.com/p/{k:03d}", f"<div>site {k % 3}</div><p>text {k}</p><p>part {k // 6}</p>") for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(table(html.main_texts(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert all("site" not in r[2] and f"text {r[0]}" in r[2] for r in results[0])


def brute_pages(rows):
    """Texts by page, with all pages of a host in one list; test_lcs() proves the alignment."""
    hosts, parsed = defaultdict(dict), {}

    def site(url, lines):
        at = re.match(r"(?:[a-zA-Z][\w+.-]*://([^/?#]*))?([^?#]*)", url or "")
        return ((at[1] or "").lower(), any(k in (html.ARTICLE, html.DOUBTFUL) for k, _ in lines)), at[2]

    for _, url, page in rows:
        lines = parsed[page or ""] = html.lines_of(page or "")
        name, path = site(url, lines)
        hosts[name].setdefault(tuple(lines), set()).add(path)
    out = []
    for i, url, page in rows:
        lines = parsed[page or ""]
        name, _ = site(url, lines)
        ordered = sorted(hosts[name], key=lambda x: min(hosts[name][x]))
        at, less, alone = ordered.index(tuple(lines)), set(), True
        for other in ([ordered[at - 1]] if at else []) + ordered[at + 1 : at + 2]:
            met = {x for x, _ in html.common([t for _, t in lines], [t for _, t in other]) if lines[x][0] != html.OTHER}
            if sum(len(lines[x][1]) for x in met) <= html.VERSION * sum(len(t) for k, t in lines if k != html.OTHER):
                alone, less = False, less | met
        kept = [t for x, (k, t) in enumerate(lines) if k == html.ARTICLE or x not in less and (k == html.DOUBTFUL or k == html.FREE and not (alone and name[1]))]
        out.append((i, url, "\n".join(kept), len("\n".join(kept))))
    return out


def test_html_matches_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert table(html.main_texts(pages).collect()) == table(brute_pages(rows))
    # Pages with and without a marked article, with notices beside it and in it.
    rng, odd = random.Random(8), []
    notices = [f"<p>notice {k} of the site</p>" for k in range(6)]
    for k in range(160):
        shell = rng.choice(["<article>{}</article>", "{}", "{}", "<div>{}</div>", "<main>{}</main>"])
        texts = [f"<p>own text {k} {n} which is fairly long</p>" for n in range(rng.randrange(1, 5))] + rng.sample(notices, rng.randrange(4))
        rng.shuffle(texts)
        beside = "".join(f"<aside>{x}</aside>" for x in rng.sample(notices, rng.randrange(3)))
        odd.append((k, f"https://h{rng.randrange(4)}.org/p/{k:03d}?q={k}", beside + shell.format("".join(texts)) + "".join(rng.sample(notices, rng.randrange(3)))))
    odd += [(500, None, None), (501, "", ""), (502, "https://h1.org", "<a "), (502, "https://h1.org", "<a ")]
    odd += [(503, "https://lone.org/x", "<p>free</p><article>own</article>"), (504, "https://lone.net/x", "<p>free</p>")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in odd], "page_id long, url string, html string, host string, k1 int").repartition(5)
    want = brute_pages(odd)
    assert table(html.main_texts(df).collect()) == table(want)
    untouched = {i: "\n".join(t for k, t in html.lines_of(p or "") if k != html.OTHER) for i, _, p in odd}
    assert sum(untouched[i] != t for i, _, t, _ in want) > 60 and {t for i, _, t, _ in want if i > 502} == {"own", "free"}


def test_html_malformed_pages_end_soon():
    began = time.perf_counter()
    assert html.lines_of("<a " * 300_000) and html.lines_of('<a "' * 200_001) and html.lines_of("<a '\">" * 100_000) == []
    assert html.lines_of("<div>" * 100_000 + "x" + "</p>" * 100_000) == [(html.FREE, "x")]
    assert len(html.common([1] * 20_000, [1] * 20_000)) == 20_000 and len(html.common([1] * 20_000, [2, *[1] * 15_000, 3])) == 15_000
    assert time.perf_counter() - began < 20


def test_html_details():
    text = lambda page: [x for _, x in html.lines_of(page)]
    assert text("&#6<b>0;</b>&lt;") == ["\x060;<"] or text("&#6<b>0;</b>&lt;") == ["0;<"]
    assert text("<article class='post has-sidebar'><header><h1>Head</h1></header><p>x</p></article>") == ["Head", "x"]
    assert [k for k, _ in html.lines_of("<article><header><h1>H</h1></header><p>x</p></article>")] == [html.ARTICLE] * 2
    assert text("a < b <!-- c --> d <? e ?> <!x> f <a title='>'>g</a> <br/> h") == ["a < b d f g h"]


def test_lcs(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        for cells in (html.CELLS, 3):
            monkeypatch.setattr(html, "CELLS", cells)
            found = html.common(a, b)
            assert len(found) == table_[-1][-1] and all(a[i] == b[j] for i, j in found)
            assert all(x < y and v < w for (x, v), (y, w) in zip(found, found[1:]))
