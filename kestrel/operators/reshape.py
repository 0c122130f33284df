"""Wide and long forms, ranks and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.operators import ranks


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value", drop_null: bool = True) -> DataFrame:
    """One row for each of the columns; null cells are dropped unless asked for."""
    out = df.select(*ids, *columns).unpivot(ids, columns, name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, names: list, label: str = "{}", order: str | None = None) -> DataFrame:
    """One row for each ids with a column for each of the names: its first value that is not
    null, in the order of the given column, or of the value itself."""
    first = F.min(value) if order is None else F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(order, value)))
    out = df.groupBy(*ids).pivot(name, names).agg(first)
    return out.withColumnsRenamed({str(n): label.format(n) for n in names})


def split_name(df: DataFrame, name: str, first: str, rest: str, separator: str = "_") -> DataFrame:
    """Splits a name at its first separator."""
    parts = F.split(F.col(name), separator, 2)
    return df.withColumns({first: F.get(parts, F.lit(0)), rest: F.get(parts, F.lit(1))})


def rank_in(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers from 1 the rows of each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def filled_down(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Nulls of the columns as the last value before them within the keys."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    descending = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(descending)).where("__n = 1").drop("__n")


def earliest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ascending = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(ascending)).where("__n = 1").drop("__n")


def looked_up(df: DataFrame, dimension: DataFrame, left: str, right: str, order: list[Column], first: bool = False) -> DataFrame:
    """df with the dimension's columns; of dimension rows with equal keys the last holds, or the
    first, rows without a match get nulls. Spark broadcasts the dimension if its size allows."""
    one = (earliest if first else latest)(dimension.where(F.col(right).isNotNull()), [right], order)
    return df.join(one, df[left] == one[right], "left")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of existing ones with equal keys; other columns in order of name."""
    rest = sorted({*existing.columns, *new.columns} - {*keys})
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*keys, *rest)


def updated(template: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The template with the columns of values where they have a value for the keys."""
    named = values.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = template.join(named, keys, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def notes_joined(df: DataFrame, keys: list[str], order: str, note: Column, name: str = "notes") -> DataFrame:
    """The notes of each key in order, joined by "; "; null and blank ones are left out. Rows are sorted by
    range and joined within the ranges; only those parts, in few cells, meet by key."""
    rows = df.select(*keys, F.col(order).alias("__order"), note.alias("__note")).where("trim(__note) <> ''")
    by = [*keys, "__order", "__note"]
    # Lists that come sorted are sorted again in one pass.
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    listed = lambda place, text: F.sort_array(F.collect_list(F.struct(place, text))).alias("__l")
    parts = ranged.groupBy(*keys, "__part").agg(listed("__order", "__note")).select(*keys, "__part", F.array_join("__l.__note", "; ").alias("__text"))
    return parts.groupBy(*keys).agg(listed("__part", "__text")).select(*keys, F.array_join("__l.__text", "; ").alias(name))


def top_fraction(df: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """df's rows of the keys with the largest means: the fraction, rounded down, one at least; of equal
    means the first keys. Keys are ranked by ranges, so that they never meet in one task."""
    means = df.groupBy(key).agg(F.avg(value).alias("__mean")).withColumn("__one", F.lit(1))
    ranked = ranks.placed(means, [], [F.col("__mean").isNull(), -F.col("__mean"), F.col(key)], "__one")
    kept = ranked.where(F.col("before") < F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(fraction)))))
    return df.join(kept.select(key), key, "left_semi")


def draw(*parts) -> Column:
    """A long from 0 on, drawn by the MD5 of the parts, joined with "|"."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sampled(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n of df's rows, chosen by a draw from the seed and the keys: the same ones however df is
    partitioned."""
    return df.orderBy(draw(seed, *map(F.col, keys)), *keys).limit(n)


#: Parts in which words are numbered.
PARTS = 256


def numbered(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """place and word of the distinct words, numbered from 0 by their MD5's first two digits and
    then by word, and their number n in one row. Each part is numbered on its own, so no task
    sees all words; the parts' sizes are at most PARTS rows."""
    parts = words.select("word").where("word is not null").distinct().withColumn("part", F.substring(F.md5("word"), 1, 2))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("word")) - 1
    placed = parts.withColumn("within", within).join(F.broadcast(before), "part").select((F.col("before") + F.col("within")).alias("place"), "word")
    return placed, sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def anonymized(df: DataFrame, key: str, adjectives: DataFrame, nouns: DataFrame, seed: int = 0) -> DataFrame:
    """key and name, Video_adjective_adjective_noun with two different adjectives, drawn from the
    seed and the key; names that repeat get _2, _3... in the order of the key. adjectives and
    nouns have the column word; without two adjectives and a noun there are no names."""
    (first, na), (noun, nn) = numbered(adjectives), numbered(nouns)
    counts = F.broadcast(na.select(F.col("n").alias("__na")).crossJoin(nn.select(F.col("n").alias("__nn"))).where("__na > 1 and __nn > 0"))
    k = F.col(key)
    rows = df.select(key).distinct().crossJoin(counts)
    rows = rows.withColumns({"__a": F.pmod(draw(seed, "a", k), F.col("__na")), "__c": F.pmod(draw(seed, "n", k), F.col("__nn"))})
    # The second adjective is one of the others: so many places after the first.
    rows = rows.withColumn("__b", F.pmod(F.col("__a") + 1 + F.pmod(draw(seed, "b", k), F.col("__na") - 1), F.col("__na")))
    for at, words in (("__a", first), ("__b", first), ("__c", noun)):
        rows = rows.join(words.select(F.col("place").alias(at), F.col("word").alias(f"{at}_word")), at)
    named = rows.select(key, F.concat_ws("_", F.lit("Video"), "__a_word", "__b_word", "__c_word").alias("__base"))
    at = F.row_number().over(W.partitionBy("__base").orderBy(key))
    return named.select(key, F.when(at == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", at.cast("string"))).alias("name"))
