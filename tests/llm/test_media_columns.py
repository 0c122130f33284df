"""Media columns on tables whose columns have the operator's inner names."""

from brute import table
from kestrel.llm import media

ROWS = [(1, "a text"), (2, None), (2, ""), (None, "a text"), (5, "ü" * 40), (5, "ü" * 40), (6, "line\n" * 5000)]


def test_inner_names_make_no_difference(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    names = "doc_id long, text string, k string, item int, digest string, media string, t int, n_bytes string, page string"
    clash = spark.createDataFrame([(*r, "k", 1, "d", "m", 2, "n", "p") for r in ROWS], names).repartition(3)
    want, got = media.document_media(plain), media.document_media(clash)
    assert got.schema == want.schema and table(got.collect()) == table(want.collect())
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert len(got.collect()) == len(ROWS) and len(by_text) == 4 and all(len(x) == 1 for x in by_text.values())
