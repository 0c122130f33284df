"""Features and scores of the toxicity operator in plain numbers, and columns with its inner names."""

import math
import random
import re

import pytest
import xxhash

from brute import table
from kestrel.llm import toxicity

MASK = (1 << 64) - 1


def plain_features(text):
    """The bias, words, stems of four and five letters, and pairs with none to two words between."""
    hashed = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8"))
    words, found = re.findall(r"\w+", text.lower()), set()
    for i, word in enumerate(words):
        found.add(hashed(word))
        found.update(hashed("^" + word[:n]) for n in (4, 5) if len(word) >= n)
        for gap, multiplier in enumerate(toxicity.MIX, 1):
            if i + gap < len(words):
                found.add((hashed(word) * multiplier + hashed(words[i + gap])) * toxicity.MIX[0] & MASK)
    return sorted({0, *(x >> 64 - toxicity.BITS for x in found)})


def texts():
    rng = random.Random(9)
    known = ["a", "be", "the", "four", "fives", "sixers", "Straße", "ΑΣ", "日本語", "under_score", "x" * 70, "42", "İ"]
    made = [rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(known, k=rng.randrange(12))) for _ in range(300)]
    return ["", " \t\n", "!?", *known, *made, "word " * 5000, " ".join(f"w{k}" for k in range(20_000))]


def test_features_are_those_of_a_plain_form(monkeypatch):
    for cache in (toxicity.CACHE, 3):
        monkeypatch.setattr(toxicity, "CACHE", cache)
        for text in texts():
            assert toxicity.features(text).tolist() == plain_features(text), text[:80]


def test_scores_are_sums_of_the_weights_of_plain_features(spark):
    rng, rows = random.Random(10), [*enumerate(texts()), (None, None), (3, None), (3, None)]
    numbers = sorted({k for _, t in rows for k in plain_features(t or "")})
    weights = {k: rng.gauss(0, 1) for k in [0, *rng.sample(numbers[1:], len(numbers) // 2)]}
    model = toxicity.np.array(sorted(weights)), toxicity.np.array([weights[k] for k in sorted(weights)])
    names = "doc_id long, text string, k long, item string, label int, sample string, at long, t int, held_out string"
    df = spark.createDataFrame([(*r, 1, "i", 1, "s", 2, 3, "h") for r in rows], names).repartition(3)
    margins = [(i, t, sum(weights.get(k, 0.0) for k in plain_features(t or ""))) for i, t in rows]
    got = {(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.scores(df, model).collect()}
    assert got == {(i, round(1 / (1 + math.exp(-m)), 9), int(m >= 0)) for i, _, m in margins}
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and table((r.text, r.doc_id) for r in kept.collect()) == table((t, i) for i, t, m in margins if m < 0)


def test_training_ignores_columns_with_inner_names(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    want = toxicity.train(documents, labels)
    clash = documents.selectExpr("*", "0 AS label", "'x' AS sample", "1L AS at", "2 AS t", "3 AS toxic")
    got = toxicity.train(clash, labels.selectExpr("*", "'y' AS label", "'z' AS text", "4 AS sample"))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == pytest.approx(want[1].tolist(), rel=1e-12)
