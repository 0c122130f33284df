"""Grouping of spelling variants by a forward and a reversed sorted dictionary.

Two words differ by one edit. If the shorter one has m characters and p is the number of
characters that both have in common at the beginning, they have all but the edited one in
common after it: at least m - 1 - p characters at the end. So for low <= p < high both words
share their first `low` and their last m - high characters, which makes them neighbours in one
of two sorted dictionaries:

- p in the second half of the range: a shared prefix, a block of the forward dictionary;
- p in the first half: a shared suffix, a block of the reversed dictionary.

Spark's sort-merge join on the shared characters is the scan of these blocks. A block with more
words than CROWD is not scanned but subdivided: its range of p is cut in two, and both halves
share more characters than the whole. A range of one place leaves a single character open (two
in the longer word), so that the alphabet bounds the block. Each pair has one p and so is met
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written
from kestrel.llm.sharding import crc32_sql, crc_table_sql

#: Runs of letters, those of Latin-1 included.
RUNS = r"[A-Za-zÀ-ÿ]"
#: One run in so many loses a character.
NOISE = 199
SHORTEST, LEAST, RATIO = 6, 5, 5
#: Words of a block that is scanned as it is.
CROWD = 64
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _noisy(id_text: Column, run: Column) -> Column:
    """The run, without one character if its hash says so."""
    h = F.crc32(F.encode(F.concat(id_text, F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(NOISE)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word and n: the words of all texts with `shortest` characters and `least` occurrences or more.
    Shorter runs cannot become words and are not taken out of the texts."""
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    runs = df.select(id_text.alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUNS}{{{shortest},}}"), F.lit(0))).alias("run"))
    # Only A to Z change; of ASCII runs that is their lower case.
    lower = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL))
    found = runs.select("i", lower.alias("run")).select(_noisy(F.col("i"), F.col("run")).alias("word"))
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _shared(low: Column, high: Column, m: Column) -> Column:
    """What words have in common for p from low to below high: the first characters, and the last
    ones, reversed."""
    last = F.greatest(F.lit(0), m - high)
    return F.struct(m.alias("m"), low.alias("low"), high.alias("high"), F.substr("word", F.lit(1), low).alias("first"), F.reverse(F.substr("word", F.length("word") - last + 1, last)).alias("last"))


def _halves(ranges: DataFrame) -> DataFrame:
    """word, m, n and the two halves of the range from low to below high."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    return ranges.select("word", "n", "m", F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))).alias("r")).select("word", "n", "m", "r.*")


def near_pairs(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, a_n, b and b_n for each pair of words (word, n) that differ by exactly one inserted,
    deleted or replaced character; a is the shorter one, or the smaller one of equal length.

    Blocks are counted before they are scanned; crowded ones are subdivided round by round, at most
    as often as the logarithm of the longest word's length.
    """
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    ranges = vocabulary.select("word", "n", sizes.alias("m")).where("m > 0").select("word", "n", "m", F.lit(0).alias("low"), (F.col("m") + 1).alias("high"))
    found = None
    while True:
        filed = written(_halves(ranges).withColumn("block", _shared(F.col("low"), F.col("high"), F.col("m"))), "word-blocks")
        counts = filed.groupBy("block").agg(F.count("*").alias("size"), F.sum((F.length("word") == F.col("m")).cast("long")).alias("short"))
        # Lone words, and words one longer among themselves, have no partner in a block.
        counts = written(counts.where("size > 1 and short > 0").select("block", ((F.col("size") > crowd) & (F.col("block.high") - F.col("block.low") > 1)).alias("crowded")), "word-block-counts")
        filed = filed.join(counts, "block")
        scanned = filed.where("not crowded")
        a = scanned.where(F.length("word") == F.col("m")).select("block", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = scanned.select("block", F.col("word").alias("b"), F.col("n").alias("b_n"))
        apart = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        near = F.levenshtein("a", "b", 1) == 1
        first = lambda word: F.substr(word, F.lit(1), F.col("block.high"))  # noqa: E731  p is below high if these differ
        pairs = a.hint("merge").join(b, "block").where(apart & (first("a") != first("b")) & near).select("a", "a_n", "b", "b_n")
        pairs = written(pairs, "word-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if counts.where("crowded").isEmpty():
            return found
        ranges = filed.where("crowded").select("word", "n", "m", "low", "high")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for the pairs word and form: the end of the chain of forms. Each round doubles the
    length of the steps; chains end, as each form is more frequent than its word."""
    steps = written(forms.select("word", F.col("form").alias("root")), "word-steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        joined = written(joined, "word-steps")
        steps = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return steps


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of all texts.

    form is the near word with the most occurrences (of equals the smallest), if these are `ratio` times the
    word's or more; root is the word at the end of the chain of forms. Null and empty texts have no
    words; rows without an id count as of the id "null"; repeated rows count as often as they
    occur; other columns are ignored. An empty table gives an empty table.
    """
    vocabulary = written(words(df, id_col, text_col), "words")
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    kept = F.col("best.m") <= -ratio * F.col("n")
    known = vocabulary.join(best, "word", "left").select("word", F.when(kept, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, -F.col("best.m")).alias("form_n"))
    known = written(known, "word-forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped_sql() -> str:
    """DuckDB SQL for grouped(documents). Letters of Latin-1 stand as one byte each where edits are
    counted, since DuckDB counts bytes."""
    letters, bytes_ = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97))).replace("'", "''")
    return f"""
    WITH RECURSIVE crc_table AS ({crc_table_sql()}),
    r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS i, unnest(regexp_extract_all(text, '{RUNS}{{{SHORTEST},}}')) AS run FROM documents),
    l AS (SELECT i, translate(run, '{CAPITALS}', '{SMALL}') AS run, count(*) AS times FROM r GROUP BY ALL),
    k AS (SELECT run, times, hex(encode(i || ':' || run)) AS h, t FROM l, crc_table),
    c AS (SELECT run, times, {crc32_sql("h")} AS crc FROM k),
    d AS (SELECT CASE WHEN crc % {NOISE} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM c),
    w AS (SELECT word, sum(times)::BIGINT AS n, length(word) AS size, translate(word, '{letters}', '{bytes_}') AS plain
          FROM d WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {LEAST}),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM w a JOIN w b
             ON abs(a.size - b.size) <= 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
    named AS (SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND other_n = m GROUP BY near.word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * w.n THEN other END AS form,
            CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n
          FROM w LEFT JOIN best ON w.word = best.word LEFT JOIN named ON w.word = named.word),
    chain AS (SELECT word, word AS root, 0 AS steps FROM f
              UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, form, (SELECT max_by(root, steps) FROM chain WHERE chain.word = f.word) AS root, n, n_near::BIGINT AS n_near, form_n
    FROM f"""
