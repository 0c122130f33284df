"""Column expressions for names, lists in cells and dirty numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c, kind: str = "double") -> Column:
    """A cell as a number; anything that is none, such as "NA" or an empty cell, is null."""
    return F.trim(text_column(c).cast("string")).try_cast(kind)


def number_or_zero(c, kind: str = "double") -> Column:
    return F.coalesce(number(c, kind), F.lit(0).cast(kind))


def null_if_nan(c) -> Column:
    """NaN marks a missing value in the sources; null does here."""
    c = text_column(c)
    return F.when(~F.isnan(c), c)


def null_if_blank(c) -> Column:
    c = text_column(c)
    return F.when(F.trim(c) != "", c)


def int_list(c, separator: str = ",") -> Column:
    """Integers of a comma-joined cell. Null, blank and a cell with any other token are the
    empty list."""
    c = text_column(c)
    parsed = F.transform(F.split(c, separator), lambda x: F.trim(x).try_cast("int"))
    empty = F.array().cast("array<int>")
    bad = F.coalesce(F.trim(c) == "", F.lit(True)) | F.exists(parsed, lambda x: x.isNull())
    return F.when(bad, empty).otherwise(parsed)


def bracketed_lists(c) -> Column:
    """The integer lists of a line such as "name,[1,2],[5,6]", in order."""
    inner = F.regexp_extract_all(text_column(c), F.lit(r"\[(.*?)\]"), F.lit(1))
    return F.transform(inner, lambda x: int_list(x))


def session_of(path) -> Column:
    """The session in a file name: date, time and trial, up to the trial's two-letter suffix."""
    return F.regexp_extract(text_column(path), r"(\d{4}(?:_\d{2}){5}_trial_\d+_[A-Z]{2})", 1)


def region_of(path) -> Column:
    """The region x1_y1_x2_y2 in a file name, "" if there is none."""
    return F.regexp_extract(text_column(path), r"regions_(\d+_\d+_\d+_\d+)", 1)


def region_corner(region, k: int) -> Column:
    return F.get(F.split(text_column(region), "_"), F.lit(k - 1)).try_cast("int")


def condition_of(session) -> Column:
    """TP for sessions that end in _TP, else TC."""
    return F.when(F.endswith(text_column(session), F.lit("_TP")), "TP").otherwise("TC")


def frame_range(name) -> Column:
    """Struct of start and end of the frames that a mask's name tells, half-open; an error if
    it tells none."""
    name = text_column(name)
    first, last = (F.regexp_extract(name, r"_(\d+)_(\d+)\.npz$", k) for k in (1, 2))
    checked = F.when(first == "", F.raise_error(F.concat(F.lit("no frame range in "), name))).otherwise(first)
    return F.struct(checked.cast("int").alias("start"), last.try_cast("int").alias("end"))


def video_key(name) -> Column:
    """A scored video's key: without "Video_" and trailing slashes."""
    return F.regexp_replace(F.replace(text_column(name), F.lit("Video_"), F.lit("")), "/+$", "")


def has_any(c, parts, how: str = "contains") -> Column:
    """Whether the text contains, starts or ends with any of the parts; null counts as no. No
    parts: no."""
    test = {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}[how]
    out = F.lit(False)
    for p in [parts] if isinstance(parts, str) else parts or ():
        out = out | test(text_column(c), F.lit(p))
    return F.coalesce(out, F.lit(False))


def matched_part(c, parts) -> Column:
    """The first of the parts that the text contains, else null."""
    found = F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(text_column(c), p))
    return F.try_element_at(found, F.lit(1))


def natural(c) -> Column:
    """The first number in a text, for ordering; texts without one come last."""
    return F.regexp_extract(text_column(c), r"(\d+)", 1).try_cast("long")


def bayes_label(bf01) -> Column:
    """What a Bayes factor for the null says, by the usual steps."""
    # The steps of the scale.
    steps = [(100, "extreme", 0), (30, "very strong", 0), (10, "strong", 0), (3, "moderate", 0), (1, "anecdotal", 0), (1 / 3, "anecdotal", 1), (1 / 10, "moderate", 1), (1 / 30, "strong", 1)]
    c = text_column(bf01)
    out = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "not computable")
    for least, word, side in steps:
        out = out.when(c >= least, f"{word} evidence for H{side}")
    return out.otherwise("very strong evidence for H1")
