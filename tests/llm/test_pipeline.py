"""The pipeline's stages against the operators' brute-force forms."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import brute_lines, exact_similar, plain_edits
from kestrel.llm import decontaminate, toxicity
from kestrel.llm.common import table, written

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_toxic_documents_go(spark, docs):
    model = toxicity.train(docs, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.predicted}
    clean = STAGES["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and toxic
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic


def test_repeated_lines_go(spark, docs):
    small = docs.where("n_chars < 1500 and doc_id < 90")
    rows = [(r.doc_id, r.text) for r in small.collect()]
    lines = STAGES["line dedup"](spark, small, SF)
    gone = {r[0]: {*r[2], *r[3]} for r in brute_lines(rows)}
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == docs.columns


def test_one_of_each_group_stays(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, least in exact_similar(rows).items() if i == least}
    assert {r.doc_id for r in STAGES["simhash"](spark, docs, SF).collect()} == want and len(want) < len(rows)


def test_leaks_go(spark, docs):
    items = [decontaminate.normalized(r.text) for r in table(spark, SF, "benchmark").collect()]
    few = docs.where("n_chars < 1500")
    leaked = set()
    for r in few.collect():
        text = decontaminate.normalized(r.text)
        if any(p and plain_edits(p, text) <= decontaminate.budget(len(p)) for p in items):
            leaked.add(r.doc_id)
    assert {r.doc_id for r in STAGES["decontamination"](spark, few, SF).collect()} == {r.doc_id for r in few.collect()} - leaked and leaked


def test_run_is_its_stages(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, left, SF), "test")
        assert left.columns == docs.columns
    want = {}
    for r in left.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), ids, hashlib.sha256(decoded.encode()).hexdigest())
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == len(want) < docs.count()
    assert {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in out} == want


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, docs, name):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, clashing columns."""
    rows = [
        (1, "one line of text\nand another one", "en", "a", 1), (None, "one line of text\nand another one", None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0),
        (4, "", "en", "a", 0), (5, "word " * 50_000, "en", "a", 250_000), (None, None, None, None, None), (6, "only here", "en", "a", 9), (6, "only here", "en", "a", 9),
    ]
    odd = spark.createDataFrame(rows, docs.schema).repartition(3)
    out = STAGES[name](spark, odd, SF)
    found = out.collect()
    # Without labels of these ids nothing is toxic; repeated rows and rows without an id stay or go together.
    ids = [r.doc_id for r in found]
    assert ids.count(6) == 2 and (1 in ids or None in ids)
    if name in ("toxicity", "line dedup", "bpe", "decontamination"):
        assert len(found) == len(rows)
    assert STAGES[name](spark, odd.limit(0), SF).collect() == []
    if name != "bpe":
        assert out.columns == docs.columns
        clash = odd.withColumns({c: F.lit(k) for k, c in enumerate(("row", "key", "gone", "t", "doc", "dkey", "set", "label"))})
        again = STAGES[name](spark, clash, SF)
        assert again.columns == clash.columns and again.count() == len(found)
