"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word stems (first letters), pairs of
neighbouring words and pairs of words with one or two words between. Training runs on a
bounded sample of labelled rows, whose features all tasks extract; one learner goes through
the sample with per-coordinate rates and an L1 bound, which leaves a few hundred non-zero
weights. These go out with the scoring function.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_arrow, slices, texts_of

#: Features are numbered by this many bits of their hash; feature 0 is the bias.
BITS = 20
STEMS = (4, 5)
#: The most labelled rows that are trained on: the ones with the smallest hash of their id.
SAMPLE = 10_000
PASSES = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01
#: Odd multipliers that mix the hashes of two words, by the words between them.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CACHE = 60_000

_word = re.compile(r"\w+").findall


class _Hashes(dict):
    """Packed hashes of a word and of its stems (of a short word, of the last there is again), in
    two generations: when the younger is full, it becomes the older."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            parts = [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]
            found = [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for p in parts]
            value = b"".join((found + found[-1:] * len(STEMS))[: 1 + len(STEMS)])
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = value
        return value


_hashes = _Hashes()


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    words = _word(text.lower())
    if not words:
        return np.zeros(1, np.int32)
    table = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), "<u8").reshape(len(words), -1)
    h, parts = table[:, 0], [table.ravel()]
    for gap, m in enumerate(MIX, 1):
        if len(words) > gap:
            parts.append((h[:-gap] * np.uint64(m) + h[gap:]) * np.uint64(MIX[0]))
    found = np.concatenate(parts) >> np.uint64(64 - BITS)
    return np.concatenate([np.zeros(1, np.int64), np.unique(found[found > 0]).astype(np.int64)]).astype(np.int32)


class Ftrl:
    """FTRL-proximal for the logistic loss; the bias, coordinate 0, has no L1 bound."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        bound = np.where(np.asarray(at) == 0, 0.0, L1)
        w = -(z - np.sign(z) * bound) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= bound, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from training: its id's CRC-32 as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights learned from at most `sample` labelled rows that are not
    held out. Rows without an id or label teach nothing; of several labels the largest holds, of
    several texts of an id the smallest.
    Without labels all weights are empty, and every score is one half."""
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null")
    named = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most `sample` rows of two numbers, whatever the size of the labels.
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("t").alias("t"))

    def number(batch):
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "at": [features(t).tobytes() for t in texts_of(batch, "t")]}

    rows = map_arrow(texts.select(F.col("doc_id").cast("long"), F.col("label").cast("double"), "t"), number, "doc_id long, label double, at binary")
    rows = rows.withColumn("sample", F.lit(0))

    def learn(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["doc_id"].to_numpy(), np.array([xxhash.xxh64_intdigest(str(i)) for i in group["doc_id"].to_pylist()], np.uint64)))
        ats = [np.frombuffer(b, np.int32) for b in group["at"].to_pylist()]
        named, model = group["label"].to_pylist(), Ftrl()
        for _ in range(PASSES):
            for i in order.tolist():
                model.learn(ats[i], float(named[i] >= 1))
        w = model.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        return pa.table({"at": at.astype(np.int32), "w": w[at]})

    found = rows.groupBy("sample").applyInArrow(learn, "at int, w double").toArrow()
    return found["at"].to_numpy(), found["w"].to_numpy()


def scores(df: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of df. Null and empty texts score by
    the bias alone; repeated rows stay repeated; other columns are never looked at."""
    sparse = (model[0].astype(np.int32), model[1])
    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batch):
        dense = _dense(sparse)
        made = [sigmoid(float(dense[features(t)].sum())) for t in texts_of(batch, "t")]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": made, "predicted": [int(s >= 0.5) for s in made]}

    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


_last: list = [None, None]


def _dense(sparse) -> np.ndarray:
    if _last[0] is not sparse:
        dense = np.zeros(1 << BITS)
        dense[sparse[0]] = sparse[1]
        _last[:] = sparse, dense
    return _last[1]


def without_toxic(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """df's rows whose text scores under one half, with df's columns; all rows if nothing was learned,
    where every score is one half."""
    if not len(model[0]):
        return df
    sparse, at = (model[0].astype(np.int32), model[1]), df.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            dense = _dense(sparse)
            yield batch.filter(pa.array([dense[features(t or "")].sum() < 0 for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
