"""Fill-in-middle transformation by a streaming matcher in two passes.

A text is cut at two of its units, such as lines: the prefix comes first, and the middle goes
to the end, behind the suffix. The first pass of the matcher counts the units; the ranks of
both cuts follow from the count. The second advances a fresh lazy match iterator to the
smaller and then to the larger rank. Units are matched one at a time and none is kept, so that
memory beyond the text itself does not grow with the number of units.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import map_arrow, texts_of

#: Units: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Hundredths of the texts that are transformed, and of these with the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def numbers(id_text: str, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers that follow from id and seed."""
    digest = hashlib.sha256(f"{seed}:{id_text}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def _ends(text: str, units: re.Pattern) -> Iterator[int]:
    return (m.end() for m in units.finditer(text))


def cuts(text: str, units: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """The number of units, and where prefix and middle end: both numbers, modulo the possible
    cuts, are counts of units."""
    n = sum(1 for _ in _ends(text, units))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    ends = _ends(text, units)
    start = next(itertools.islice(ends, low - 1, None)) if low else 0
    stop = next(itertools.islice(ends, high - low - 1, None)) if high > low else start
    return n, start, stop


def transformed_text(text: str, id_text: str, units: re.Pattern, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and of middle, and the output."""
    h1, h2, h3, h4 = numbers(id_text, seed)
    n, start, stop = cuts(text, units, h1, h2)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    if h4 % 100 < suffix_first:
        return n, "spm", start, stop - start, "".join((SUFFIX, text[stop:], PREFIX, text[:start], MIDDLE, text[start:stop]))
    return n, "psm", start, stop - start, "".join((PREFIX, text[:start], SUFFIX, text[stop:], MIDDLE, text[start:stop]))


def restored_text(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    before, after = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, middle = output.removeprefix(before).partition(MIDDLE)
    one, _, two = head.partition(after)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


#: The columns that transformed() can make, their types, and how they follow from text and result.
OUTPUTS = {
    "n": ("long", lambda text, r: r[0]),
    "form": ("string", lambda text, r: r[1]),
    "prefix_chars": ("long", lambda text, r: r[2]),
    "middle_chars": ("long", lambda text, r: r[3]),
    "output": ("string", lambda text, r: r[4]),
    "output_sha256": ("string", lambda text, r: _sha256(r[4])),
    "restored_sha256": ("string", lambda text, r: _sha256(restored_text(r[4], r[1]))),
}


def transformed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = LINES, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, outputs: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")
) -> DataFrame:
    """doc_id and the outputs for each row of df: n, form (plain, psm or spm), prefix_chars and
    middle_chars (null if plain), the output itself or its SHA-256, and the SHA-256 of the text
    rebuilt from output and form.

    Texts that are null (as empty), empty or hold a sentinel stay plain. Where the units leave
    characters unmatched, these belong to the unit that follows, and those at the end to the
    suffix. Rows without an id are cut as one with an empty id would be; repeated rows are cut
    alike; other columns are ignored. An empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batch):
        pattern = re.compile(units)
        out = {name: [] for name in outputs}
        for id_text, text in zip(texts_of(batch, "i"), texts_of(batch, "t")):
            made = transformed_text(text, id_text, pattern, seed, rate, suffix_first)
            for name in outputs:
                out[name].append(OUTPUTS[name][1](text, made))
        return {"doc_id": batch.column("doc_id")} | out

    return map_arrow(rows, run, f"doc_id {kind}, " + ", ".join(f"{name} {OUTPUTS[name][0]}" for name in outputs))


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """df with the texts rebuilt from outputs and forms, in built-in functions."""
    output, form = F.col(output_col), F.col(form_col)
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(head) + len(MIDDLE) + 1)

    def parts(before: str, after: str) -> tuple[Column, Column]:
        one = F.substring_index(F.substr(head, F.lit(len(before) + 1)), after, 1)
        return one, F.substr(head, F.length(one) + len(before) + len(after) + 1)

    prefix, suffix = parts(PREFIX, SUFFIX)
    last, first = parts(SUFFIX, PREFIX)
    return df.withColumn(name, F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(first, middle, last)))


def transformed_sql() -> str:
    """DuckDB SQL for the query: lines by splitting at the line ends."""
    return """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    h AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts,
            ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
            ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
    n AS (SELECT *, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END AS n FROM h),
    u AS (SELECT *, list_transform(range(1, n + 1), lambda i: parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END) AS units,
            least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                 WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
    p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
            array_to_string(units[high + 1:n], '') AS suffix FROM u)
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
             ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM p"""
