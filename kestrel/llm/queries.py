"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from kestrel.llm import bpe, decontaminate, html, linededup, media, middle, packing, repeats, sharding, simhash, toxicity, variants, warc
from kestrel.llm.common import table

VOCABULARY = os.environ.get("KESTREL_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = os.environ.get("KESTREL_BYTE_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), VOCABULARY, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_media(spark, sf_dir):
    return media.document_media(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.scores(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_linededup(spark, sf_dir):
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.clustered(table(spark, sf_dir, "documents"))


def op9_repeats(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op10_html(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op11_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op12_middle(spark, sf_dir):
    return middle.transformed(table(spark, sf_dir, "documents"), outputs=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


def op13_variants(spark, sf_dir):
    return variants.grouped(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_sharding, op3_media, op4_toxicity, op5_decontaminate, op6_warc, op7_linededup, op8_simhash, op9_repeats, op10_html,
        op11_packing, op12_middle, op13_variants,
    )
}
ORACLES = {
    "op2_sharding": sharding.sharded_sql(),
    "op6_warc": warc.archived_sql(),
    "op9_repeats": repeats.without_repeats_sql(),
    "op12_middle": middle.transformed_sql(),
    "op13_variants": variants.grouped_sql(),
}
