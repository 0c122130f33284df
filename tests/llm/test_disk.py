"""What the near-duplicate stage leaves on disk, and the bound that sorts out its candidates."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import simhash
from kestrel.llm.common import CLEANUP, discarded, shared_dir, table, written

SF = "/root/testdata/sf0.001"


def held(folder: str) -> dict[str, int]:
    return {name: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(f"{folder}/{name}") for f in files) for name in os.listdir(folder)}


def test_only_small_tables_stay(spark):
    """One row of digests a document and the last links: no fingerprints, prefixes, candidates or sets."""
    docs, folder = table(spark, SF, "documents"), shared_dir(spark).removeprefix("file://")
    before = held(folder)
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    left = {k: v for k, v in held(folder).items() if k not in before}
    assert {k.rsplit("-", 1)[0] for k in left} == {"similar", "edges"}
    assert sum(v for k, v in left.items() if k.startswith("similar")) < 100 * docs.count() and 0 < len(kept) < docs.count()


def test_shuffles_go_with_their_action(spark):
    """Written tables leave no shuffle files, keep the session's setting and can be deleted."""
    had, disk = spark.conf.get(CLEANUP, "false"), spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffles()
    rows = spark.range(100_000).groupBy((F.col("id") % 7777).alias("k")).count()
    out = written(rows, "counts")
    until = time.time() + 10  # they go in the background
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(CLEANUP, "false") == had
    assert out.count() == 7777 and os.path.exists(out._written_at.removeprefix("file:"))
    discarded(out)
    assert not os.path.exists(out._written_at.removeprefix("file:"))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
def test_parities_never_overstate_a_difference(n):
    """So no pair of a similarity of 0.8 is lost, whatever the sizes; of sets that share nothing most is seen."""
    rng = np.random.default_rng(n)
    draw = lambda k: np.unique(rng.integers(0, 1 << 64, k, dtype=np.uint64))
    one = draw(n)
    for share in (1.0, 0.95, 0.9, 0.85, 0.5, 0.0):
        for extra in (0, n // 20, n // 9, n // 4, 3 * n):
            two = np.union1d(rng.permutation(one)[: int(share * len(one))], draw(extra))
            common, size = len(np.intersect1d(one, two)), len(one) + len(two)
            least = simhash.differing(simhash.parities(one), simhash.parities(two))
            assert least <= size - 2 * common and least == simhash.differing(simhash.parities(two), simhash.parities(one))
            assert not 9 * common >= 4 * size or 9 * least <= size
    if n > 60:
        assert 9 * simhash.differing(simhash.parities(one), simhash.parities(draw(n))) > 2 * n
