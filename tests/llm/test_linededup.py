"""The bit-parallel edit distance of line dedup, and documents that are long or have the last id."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brute import brute_lines, edits, table
from kestrel.llm import linededup


def test_bit_parallel_distance_is_the_edit_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(3000):
        # Few letters, so that many alignments tie; characters of one to four bytes.
        a = rng.choices("abé\u4e00\U0001f600", k=rng.randrange(1, 40))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["z"], ["q", "a"]])
        rows.append(("".join(a), "".join(b)))
    rows += [("", ""), ("", "ab"), ("", "abc"), ("ab", ""), ("a" * 3000, "a" * 2998), ("a" * 3000, "a" * 2997), ("ab" * 2000, "ba" * 2000), ("ab" * 2000 + "cd", "b" + "ab" * 1999 + "acd")]
    df = spark.createDataFrame(rows, "a string, b string")
    within = [linededup._within("a", "b", F.lit(k)).alias(f"w{k}") for k in range(linededup.K + 1)]
    got = df.select("a", "b", *within).collect()
    far = [edits(r.a, r.b) for r in got[:-4]]
    for r, n in zip(got, far):
        assert [r.w0, r.w1, r.w2] == [n <= 0, n <= 1, n <= 2], (r.a, r.b)
    assert [r.w2 for r in got[-4:]] == [True, False, True, True] and [r.w1 for r in got[-4:]] == [False, False, False, False]


def test_no_python_decides(spark):
    df = spark.createDataFrame([(1, "one line of text"), (2, "one line of texts")], "doc_id long, text string")
    documents = linededup._documents(df, "doc_id", "text")
    links = linededup.near_links(documents, linededup._firsts(linededup._occurrences(documents)))
    assert "Python" not in links._jdf.queryExecution().toString() and links.count() == 1


@pytest.mark.parametrize("crowd", [32, 1])
def test_long_documents_and_last_ids(spark, monkeypatch, crowd):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    rng, last = random.Random(6), (1 << 63) - 1
    base = ["".join(rng.choices("abcdefgh ", k=rng.randrange(8, 30))).strip() or "x" for _ in range(120)]

    def line():
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice([[], ["z"]])
        return "".join(text)

    rows = [(i, "\n".join(line() for _ in range(n))) for i, n in ((1, 150), (2, 3), (last, 90), (None, 90))]
    # The last id and none, with equal texts: the row with an id comes first.
    rows += [(last, "only these two rows say so\nand this"), (None, "only these two rows say so\nand this"), (None, "only these two rows say so\nand this")]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "doc_id long, text string, unknown boolean, first string").repartition(3)
    got, want = linededup.line_report(df).collect(), brute_lines(rows)
    assert table(got) == table(want) and max(len(t) for _, t in rows) > 1500
    kept = [("\n".join(x for n, x in enumerate(t.split("\n")) if n not in {*e, *c}), i) for (i, t), (_, _, e, c, _) in zip(rows, want)]
    out = linededup.without_repeats(df)
    assert out.columns == df.columns and table((r.text, r.doc_id) for r in out.collect()) == table(kept)


def test_code_is_compiled_and_not_interpreted(spark, monkeypatch):
    """The JVM never compiles a method of more than 8000 bytes."""
    sizes, write = {}, linededup.written

    def measured(df, name):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes[name] = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan)))
        return write(df, name)

    monkeypatch.setattr(linededup, "written", measured)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([(1, "one line of text"), (2, "one line of texts")], "doc_id long, text string")
        documents = linededup._documents(df, "doc_id", "text")
        links = linededup.near_links(documents, linededup._firsts(linededup._occurrences(documents)))
        assert measured(links, "links").count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert {"line-pairs", "links"} < sizes.keys() and max(sizes.values()) < 8000, sizes


def test_pieces_keep_near_lines_and_common_ends_do_not_count(spark):
    rng, rows = random.Random(8), []
    for _ in range(1500):
        a = rng.choices("abé\u4e00\U0001f600", k=rng.randrange(linededup.EVERY, 60))
        b = list(a)
        for _ in range(rng.randrange(1, 4)):
            at = rng.choice([0, len(b), rng.randrange(len(b) + 1)])
            b[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["z"]])
        rows.append(("".join(a), "".join(b)))
    begun = "".join(rng.choices("abcdefgh ", k=70_000))
    far = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(2)]
    rows += [(begun + "xy", begun + "z"), (begun + "xyz", begun + "uvw"), ("xy" + begun, "z" + begun), (begun, begun)]
    rows += [(begun[:30] + far[0], begun[:30] + far[1])]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup._holds("a", "b").alias("holds"), linededup._near("a", "b").alias("near")).collect()
    for r in got[:-5]:
        near = edits(r.a, r.b) <= min(linededup.K, min(len(r.a), len(r.b)) // linededup.EVERY)
        assert r.near == near and (r.holds or not near), (r.a, r.b)
    assert [r.near for r in got[-5:]] == [True, False, True, True, False] and not got[-1].holds
