"""A corpus pipeline in five stages, from documents to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, decontaminate, linededup, simhash, toxicity
from kestrel.llm.common import discarded, table, written
from kestrel.llm.queries import VOCABULARY


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one."""
    return linededup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a similarity of 0.8 or more of shingles of
    five words."""
    return simhash.deduplicated(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    return bpe.encoded(docs, VOCABULARY, keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_deduplicated),
    ("simhash", near_copies_out),
    ("decontamination", leaks_out),
    ("bpe", tokens),
]

#: SQL expresses neither the trained model nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discarded(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
