"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from brute import table
from kestrel.llm import variants

SF = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def odd_rows():
    rng = random.Random(5)
    base = ["straße", "Ärger", "flugzeug", "NAÏVETÉ", "colour", "color", "colors", "x" * 300, "x" * 301, "x" * 299 + "y", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa"]
    times = [400, 80, 16, 3, 1]
    rows = [(k, (w + " ") * times[(k + j) % 5], 1, "w") for k, w in enumerate(base * 3) for j in range(3)]
    for w in ("vergleich", "handlung", "colours"):  # a word, and what single edits make of it
        for _ in range(60):
            at, c = rng.randrange(len(w)), rng.choice("aeiouéß")
            other = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            rows.append((rng.randrange(40), f"{other}, " * rng.choice([1, 5, 6, 40]), 1, None))
        rows.append((1, f"{w}; " * 900, 1, None))
    rows += [(7, "kapitel " * 900 + "kapitels " * 90 + "kapitelsx " * 9, 1, None)]
    rows += [(None, "ohneid " * 9, 1, "w"), (3, None, 1, "w"), (3, "", 1, "w"), (4, "12 __ !", 1, "w"), (5, "double double " * 4, 1, "w"), (5, "double double " * 4, 1, "w")]
    return rows


def test_variants(spark):
    rows = odd_rows()
    odd = spark.createDataFrame(rows, "doc_id long, text string, n int, word string").repartition(3)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df, plain in ((odd, [r[:2] for r in rows]), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        want = brute(plain)
        assert any(w[1] and w[1] != w[2] for w in want) or df is documents  # chains of forms
        assert table(variants.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()) == table(want)
    assert variants.grouped(odd.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [2, 64])
def test_pairs_when_blocks_are_crowded(spark, crowd):
    """Thousands of words under one prefix and one suffix: every pair once, by subdivision."""
    rng = random.Random(6)
    made = {"inter" + "".join(rng.choices("abc", k=rng.randrange(1, 7))) + "ation" for _ in range(900)}
    made |= {w[:3] + w[4:] for w in list(made)[:60]} | {"a", "b", "ab", "", "ba", "é", "zzzzzz"}
    words = sorted(made)
    got = variants.near_pairs(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), crowd).collect()
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    # Words of no or one character have no part to share; one edit apart they are all alike.
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in want if min(map(len, p)) > 0}
    assert all(r.a_n == len(r.a) and r.b_n == len(r.b) and (len(r.a), r.a) < (len(r.b), r.b) for r in got)
