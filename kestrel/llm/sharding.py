"""Sharding by a hierarchical weighted hash tree.

A row descends the levels region, rack and shard. At each node every child draws
ln(u) / weight, with u in (0, 1] from a hash of child and key, and the largest draw wins.
A child's draw depends on its own name and weight alone, so that changing the weights of
one subtree moves rows only into or out of that subtree. A new shard comes in a rack and
region of its own; the other weights stay, and rows move only into it.

DataFrame functions only. A row's place follows from its key and the tree alone, so a
frequent key costs no more than any other; its rows share a shard by definition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kestrel.llm.common import payload, written

#: region -> rack -> shard -> weight; a node's weight is the sum of its shards' weights.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
#: Hexadecimal digits of the hash in a draw: 52 bits, which a double holds exactly.
DIGITS = 13
#: Slots are dealt by bucket: the largest window holds a shard's share of one bucket.
BUCKETS = 4096


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> dict:
    """A tree of equal weights with shards numbered from 0."""
    number = iter(range(regions * racks * shards))
    return {f"region{r}": {f"region{r}/rack{k}": {next(number): 1.0 for _ in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree, weight: float = 1.0) -> dict:
    """The tree with one more shard, in a region and rack of its own."""
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    region = f"region{len(tree)}"
    return {**tree, region: {f"{region}/rack0": {shard: weight}}}


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, child, w: float) -> Column:
    digest = F.md5(F.concat(F.lit(f"{child}|"), key))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 1) / F.lit(float(16**DIGITS))
    return F.ln(u) / F.lit(w)


def _pick(key: Column, children: Mapping) -> Column:
    """The name of the child with the largest draw; of equal draws the first name's."""
    names = sorted(children)
    if len(names) == 1:
        return F.lit(names[0])
    draws = F.array(*[_draw(key, n, weight(children[n])) for n in names])
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(draws, F.array_max(draws)).cast("int"))


def with_shard(df: DataFrame, key: Column, tree: Tree, name: str = "shard") -> DataFrame:
    """df with the shard (int) that the string column key falls to; null keys count as the
    string "null"."""
    k, r, c = f"__{name}_key", f"__{name}_region", f"__{name}_rack"
    df = df.withColumn(k, F.coalesce(key, F.lit("null"))).withColumn(r, _pick(F.col(k), tree))
    rack = shard = None
    for region, racks in tree.items():
        choice = _pick(F.col(k), racks)
        rack = F.when(F.col(r) == region, choice) if rack is None else rack.when(F.col(r) == region, choice)
    df = df.withColumn(c, rack)
    for racks in tree.values():
        for n, shards in racks.items():
            choice = _pick(F.col(k), shards)
            shard = F.when(F.col(c) == n, choice) if shard is None else shard.when(F.col(c) == n, choice)
    return df.withColumn(name, shard.cast("int")).drop(k, r, c)


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """Rows of df as doc_id, size, text_crc32, law, shard, slot and grown_shard.

    law is "key": id and tree decide the shard. size is the text's UTF-8 bytes (null: none)
    plus 1, text_crc32 its CRC-32 (null as empty). slot numbers a shard's rows from 0 without
    gaps. Repeated rows each get a slot of the same shard; rows without an id share one shard;
    other columns are ignored. Equal rows are counted before the shuffle and spread out after
    it, so neither copies nor one frequent id make a large group.
    """
    tree = tree or even_tree()
    data = payload(F.col(text_col))
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = with_shard(rows, F.col("doc_id").cast("string"), tree)
    rows = with_shard(rows, F.col("doc_id").cast("string"), grown(tree), "grown_shard")
    rows = rows.withColumn("bucket", (F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col("text_crc32").cast("string")), "UTF-8")) % BUCKETS).cast("int"))
    keys = ["shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard"]
    counted = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "shards")
    totals = counted.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most BUCKETS rows for each shard, whatever the size of the table.
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), ["shard", "bucket"])
    first = F.col("offset") + F.col("start")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard",
    )


def _pick_sql(key: str, children: Mapping) -> str:
    names = sorted(children)
    quoted = [f"'{n}'" if isinstance(n, str) else str(n) for n in names]
    if len(names) == 1:
        return quoted[0]
    draws = ", ".join(f"ln((('0x' || substr(md5('{n}|' || {key}), 1, {DIGITS}))::BIGINT::DOUBLE + 1) / {float(16**DIGITS)!r}::DOUBLE) / {weight(children[n])}" for n in names)
    return f"(list_value({', '.join(quoted)}))[list_position(list_value({draws}), greatest({draws}))]"


def shard_sql(tree: Tree, key: str, name: str, source: str) -> str:
    """DuckDB SQL that adds the shard of key, a string, to the relation source."""
    rack = " ".join(f"WHEN '{r}' THEN {_pick_sql(key, racks)}" for r, racks in tree.items())
    shard = " ".join(f"WHEN '{c}' THEN {_pick_sql(key, s)}" for racks in tree.values() for c, s in racks.items())
    return (
        f"(SELECT * EXCLUDE (_r, _c), (CASE _c {shard} END)::INTEGER AS {name} FROM (SELECT *, CASE _r {rack} END AS _c "
        f"FROM (SELECT *, {_pick_sql(key, tree)} AS _r FROM {source})))"
    )


def crc32_sql(hexadecimal: str) -> str:
    """DuckDB SQL for the CRC-32 of bytes given in hexadecimal; `t` is the table of crc_table."""
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    values = f"list_transform(range(0, len({hexadecimal}) // 2), lambda i: ('0x' || substr({hexadecimal}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), {step}), 4294967295)"


def crc_table_sql() -> str:
    """DuckDB SQL for a row with the table `t` of the CRC-32."""
    bits = "n"
    for _ in range(8):
        bits = f"(CASE WHEN {bits} & 1 = 1 THEN xor({bits} >> 1, 3988292384) ELSE {bits} >> 1 END)" if bits == "n" else f"list_reduce([{bits}, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"SELECT list_transform(range(0, 256), lambda n: {bits}) AS t"


def sharded_sql() -> str:
    """DuckDB SQL for sharded(documents)."""
    tree = even_tree()
    source = shard_sql(grown(tree), "k", "grown_shard", shard_sql(tree, "k", "shard", "u"))
    return f"""
    WITH crc_table AS ({crc_table_sql()}),
    d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
    e AS (SELECT doc_id, k, len(h) // 2 + 1 AS size, {crc32_sql("h")} AS text_crc32, t FROM d, crc_table),
    u AS (SELECT doc_id, k, size, text_crc32, {crc32_sql("hex(encode(k || '|' || text_crc32))")} % {BUCKETS} AS bucket FROM e)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM {source}"""
