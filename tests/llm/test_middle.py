"""Fill-in-middle against a plain form with the units in a list."""

import hashlib
import random
import re

import pytest

from brute import table
from kestrel.llm import middle

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "one\ntwo\nthree", 1, "x"),
    (2, "\n\n\n", 2, "x"),
    (3, None, 3, None),
    (4, "", 4, "x"),
    (5, "has <S> inside\nand more", 5, "x"),
    (6, "ends with <\n<P\n<M\n", 6, "x"),
    (None, "no id\nat all\n", 7, "x"),
    (8, "日本\r\nß x\u0085y\x00z\n𝒳\n" * 50, 8, "x"),
    (8, "日本\r\nß x\u0085y\x00z\n𝒳\n" * 50, 8, "x"),
    (9, "line\n" * 200_000, 9, "x"),
    (10, "x" * 2_000_000, 9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n int, form string").repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, mid, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 100:
        return i, len(units), "plain", None, None, sha(text), sha(text)
    spm = h4 % 100 < 50
    output = f"<S>{suffix}<P>{prefix}<M>{mid}" if spm else f"<P>{prefix}<S>{suffix}<M>{mid}"
    return i, len(units), "spm" if spm else "psm", len(prefix), len(mid), sha(output), sha(text)


def test_middle(spark, odd):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((odd, [r[:2] for r in ROWS]), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got = middle.transformed(df, outputs=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")).collect()
        assert table(got) == table(plain(i, t) for i, t in rows)
    assert {r[2] for r in map(lambda r: plain(r[0], r[1]), [(i, "a\nb\n") for i in range(50)])} == {"psm", "spm"}
    assert middle.transformed(odd.limit(0)).collect() == []


def test_outputs_are_rebuilt_by_built_in_functions(odd):
    made = middle.transformed(odd)
    assert "prefix_chars" in made.columns and "output" in made.columns
    got = middle.restored(made).select("doc_id", "text").collect()
    assert table(got) == table((i, t or "") for i, t, *_ in ROWS)


def test_random_texts_rates_and_units():
    rng = random.Random(4)
    for units in (middle.LINES, r"\w+\W*|\W+", r"."):
        pattern = re.compile(units)
        for case in range(3000):
            text = "".join(rng.choices("ab \n<PSM>é", k=rng.randrange(30)))
            n, form, prefix, mid, output = middle.transformed_text(text, str(case), pattern, rate=80)
            assert middle.restored_text(output, form) == text and n == len(pattern.findall(text))
            assert (prefix is None) == (form == "plain")
    forms = [middle.transformed_text("a\nb", str(i), re.compile(middle.LINES), rate=30, suffix_first=25)[1] for i in range(4000)]
    assert 0.66 < forms.count("plain") / 4000 < 0.74 and 0.05 < forms.count("spm") / 4000 < 0.1


def test_units_are_never_stored():
    """The matcher holds one match at a time, however many units there are."""
    import tracemalloc

    text = "a\n" * 2_000_000
    pattern = re.compile(middle.LINES)
    tracemalloc.start()
    middle.cuts(text, pattern, 1_234_567_890, 3_456_789_012)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000
