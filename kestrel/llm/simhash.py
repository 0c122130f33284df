"""SimHash near-duplicates: fingerprints, pigeonhole blocks and connected components.

Fingerprints at most 3 bits apart agree in at least three of six blocks, so each is filed
under its twenty triples of blocks (about 32 bits each), rows of a triple meet in a join,
and the Hamming distance decides. Only distinct fingerprints join; copies are membership.

That finds texts that hardly differ. For a similarity of 0.8 or more of the shingles, where
about 15 bits in a hundred differ, fingerprints have 1024 bits and are cut into blocks of 24
bits (longer ones beyond a million different texts). Each fingerprint links to the nearest of
the least ones in its blocks, so that a large group gives as many candidates as it has members.

These links only join groups early. A prefix join then finds every other pair: with the
shingles of each text in one order, the rare ones first, two sets of a similarity of 0.8 share
one among the first fifth of the larger and the first ninth of the smaller. All pairs that so
meet and are not yet in one component are compared. Texts that share no more than a passage or
template have their own words first and do not meet. Of the candidates of either way those go
whose sets differ in too many shingles by their parities alone (a bit a shingle, not 64). The
exact similarity of the sets decides on each of the others.

Tables on the way are deleted as soon as what reads them is written.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm.common import discarded, map_arrow, shuffles_dropped, texts_of, written
from kestrel.llm.components import components

DISTANCE = 3
BLOCKS = 6
SEED = 42
#: Hashes whose bits are counted at a time.
ROWS = 4096


#: 64-bit words of a wide fingerprint, bits of its blocks and orders in which it is cut (at least),
#: and the bits in which candidates differ at most: 15.2 % are expected at a similarity of 0.8.
WIDE, BLOCK, ORDERS, WIDE_DISTANCE = 16, 24, 3, 200
STEPS = np.array([k * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(1, WIDE + 1)], np.uint64)
#: The probability that near texts agree in a bit, at a similarity of 0.85.
AGREE = 0.871
#: Parts of a block's fingerprints that are linked each on its own, then to one another.
SALTS = 16
#: One text in so many is read for the frequent shingles, of which so many at most are ordered by
#: their number, and a number of texts from which texts are left out. Any order gives all pairs;
#: a good one gives few candidates.
SAMPLED, FREQUENT, ALL_SAMPLED = 8, 100_000, 1000
#: Text keys that are broadcast at most.
BROADCAST = 500_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included."""
    tokens = text.encode("utf-8").lower().split()  # bytes: A-Z only; white space 0x20, 0x09-0x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = [0, *ends[: len(tokens) - words].tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))


def majority(words: np.ndarray) -> np.ndarray:
    """Of the bits of each column of 64-bit words, lowest first, whether they are set in over half
    the rows."""
    counts = np.zeros(64 * words.shape[1], np.int64)
    for a in range(0, len(words), ROWS):
        part = np.ascontiguousarray(words[a : a + ROWS].astype("<u8")).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts * 2 > len(words)


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, words)
    return sum(1 << k for k in np.flatnonzero(majority(hashes[:, None])).tolist()) if len(hashes) else 0


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits of a SimHash of WIDE times 64 bits of a text's hashed shingles; none is set without
    any. Each word of the fingerprint has hashes of its own, by the splitmix64 finalizer."""
    z = hashes[:, None] + STEPS
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return majority(z ^ z >> np.uint64(31))


def block_places(texts: int) -> np.ndarray:
    """The bits of each block for a number of different texts: the fingerprint's, in some fixed
    orders, cut into runs of the least length at which sixteen times as many values as texts
    are there. Orders make up for longer runs, which near texts share less often."""
    length = max(BLOCK, max(1, texts).bit_length() + 4)
    n = WIDE * 64 // length
    orders = round(ORDERS * (WIDE * 64 // BLOCK) / n * AGREE ** (BLOCK - length))
    rng = np.random.default_rng(SEED)
    return np.concatenate([rng.permutation(WIDE * 64)[: n * length].reshape(n, length) for _ in range(orders)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits) of each row's whole text; null as empty."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))

    def run(batch):
        prints = np.array([fingerprint(t, words) for t in texts_of(batch, "t")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fingerprint": prints.view(np.int64)}

    return map_arrow(rows, run, "doc_id long, fingerprint long")


def _blocks() -> list[int]:
    """Masks of the blocks: 64 bits in BLOCKS runs of nearly equal length."""
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of prints.fingerprint within the distance."""
    masks = []
    for triple in combinations(_blocks(), BLOCKS - distance):
        m = 0
        for block in triple:
            m |= block
        masks.append(m)
    filed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("triple", "value"))
    a, b = filed.withColumnRenamed("fingerprint", "a"), filed.withColumnRenamed("fingerprint", "b")
    pairs = a.join(b, ["triple", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return pairs.select("a", "b").distinct()


def clustered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 lowercase hex digits) and
    component_id, the smallest doc_id reachable over links of at most `distance` bits.

    Null texts count as empty; rows without words have fingerprint zero and link like any
    other. Repeated rows stay repeated and share a component. A null doc_id stays null and
    counts only where its component has no other id (component_id is then null). Other
    columns are ignored.
    """
    prints = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    found = components(links(distinct.select("fingerprint"), distance))
    # The smallest id of each component, counting all its fingerprints.
    joined = distinct.join(found, distinct.fingerprint == found.node, "left").withColumn("component", F.coalesce("component", "fingerprint"))
    firsts = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.select("fingerprint", "component").join(firsts, "component").select("fingerprint", "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _text_key(text):
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, in rising order, and the number of each."""
    if rows.limit(ALL_SAMPLED + 1).count() > ALL_SAMPLED:
        rows = rows.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0)

    def run(batch):
        found = [np.unique(shingle_hashes(t, words)) for t in texts_of(batch, "t")]
        return {"shingle": np.concatenate(found).view(np.int64)}

    counts = map_arrow(rows.select("t"), run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 3")
    with shuffles_dropped(rows.sparkSession):
        top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas().sort_values("shingle")
    return top["shingle"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a text's different shingles that a set of a similarity of 0.8 has not all missed:
    the first n // 5 + 1 in the order of their number, then of their value."""
    numbers = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        numbers = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, numbers))][: len(shingles) // 5 + 1]


def parities(shingles: np.ndarray) -> bytes:
    """Whether an odd number of a text's different shingles falls into each of at least as many parts
    of their values, a power of two of them and 64 at least."""
    parts = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A number of shingles in which two sets differ at least, by their parities: one in each part in
    which these differ. The longer is folded to the shorter, as its parts are parts of the other's."""
    short, long = sorted((np.frombuffer(x, "<u8") for x in (a, b)), key=len)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def _near(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a similarity of 0.8 or more, as a written table."""
    ends = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("parities").alias(f"{x}_parities")) for x in "ab")

    def maybe(batch):
        # 4 (n + m) / 9 in common leaves (n + m) / 9 that are in one set alone.
        a, b, size = (batch.column(c).to_pylist() for c in ("a_parities", "b_parities", "size"))
        return {**{c: batch.column(c) for c in "ab"}, "maybe": [9 * differing(x, y) <= n for x, y, n in zip(a, b, size)]}

    for x, end in zip("ab", ends):
        pairs = pairs.join(end, x)
    pairs = map_arrow(pairs.select("a", "b", "a_parities", "b_parities", (F.col("a_n") + F.col("b_n")).alias("size")), maybe, "a long, b long, maybe boolean")
    pairs = written(pairs.where("maybe").select("a", "b"), "candidates")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = written(ends.join(nodes.select("node", "text_key"), "node"), "candidate-texts")
    keys = needed.select("text_key", "node")
    if needed.count() <= BROADCAST:
        keys = F.broadcast(keys)
    texts = rows.select("text_key", "t").join(keys, "text_key").groupBy("node").agg(F.any_value("t").alias("t"))

    def run(batch):
        return {"node": batch.column("node"), "shingles": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts_of(batch, "t")]}

    sets = written(map_arrow(texts, run, "node long, shingles array<long>"), "candidate-sets")
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "ab")

    def compare(batch):
        near = []
        for a, b in zip(batch.column("a_set"), batch.column("b_set")):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            near.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
        return {**{c: batch.column(c) for c in "ab"}, "near": near}

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "a_set", "b_set")
    near = written(map_arrow(met, compare, "a long, b long, near boolean").where("near").select("a", "b"), "near-texts")
    discarded(pairs, needed, sets)
    return near


def _rest(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes in different components that can have a similarity of 0.8, as a written table.

    A pair of n and m shingles needs 4 (n + m) / 9 in common, which are at and after the first
    common one's places in the two.
    """
    filed = nodes.select("node", "n", F.posexplode("prefix").alias("i", "key"))
    by_key = W.partitionBy("key")
    filed = filed.withColumns({"low": F.min("node").over(by_key), "high": F.max("node").over(by_key)}).where("low <> high").drop("low", "high")
    placed = filed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.withColumns({"low": F.min("component").over(by_key), "high": F.max("component").over(by_key)}).where("low <> high").drop("low", "high")
    placed = written(placed, "prefixes")
    a = placed.where("n >= 9 * i").select("key", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "i", "component")])
    b = placed.select("key", *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "i", "component")])
    meet = a.join(b, "key").where("a_component <> b_component and (a_n < b_n or a_n = b_n and a_node < b_node) and 9 * least(a_n - a_i, b_n - b_i) >= 4 * (a_n + b_n)")
    pairs = written(meet.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "met")
    discarded(placed)
    return pairs


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = WIDE_DISTANCE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and component_id for each row: as clustered(), but for a
    similarity of 0.8 or more of the sets of shingles. `distance` bounds the fingerprints' early
    links alone."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    held = df.sparkSession.sparkContext.broadcast(_frequent(rows, words))

    def run(batch):
        prints, sizes, sets, odd, prefixes = [], [], [], [], []
        for t in texts_of(batch, "t"):
            hashes = shingle_hashes(t, words)
            shingles = np.unique(hashes)
            prints.append(np.packbits(wide_fingerprint(hashes), bitorder="little").view("<i8"))
            sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            sizes.append(len(shingles))
            odd.append(parities(shingles))
            prefixes.append(prefix(shingles.view(np.int64), *held.value))
        return {**{c: batch.column(c) for c in ("doc_id", "text_key")}, "set": sets, "n": sizes, "parities": odd, "fingerprint": prints, "prefix": prefixes}

    prints = written(map_arrow(rows, run, "doc_id long, text_key binary, set binary, n long, parities binary, fingerprint array<long>, prefix array<long>"), "wide-fingerprints")
    one_of = F.any_value(F.struct("text_key", "n", "parities", "fingerprint", "prefix")).alias("x")
    # Different sets of shingles get numbers, which hold once they are written.
    nodes = prints.groupBy("set").agg(F.min("doc_id").alias("first"), one_of)
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "first", "x.*"), "wide-nodes")
    members = written(prints.select("doc_id", "text_key", "set"), "text-sets")
    discarded(prints)
    places = block_places(nodes.count())
    places = places[: WIDE * 64 // places.shape[1]]  # the first order: the prefix join finds what one misses
    powers, numbers = 1 << np.arange(places.shape[1], dtype=np.int64), np.arange(len(places), dtype=np.int64) << places.shape[1]

    def cut(batch):
        bits = (np.unpackbits(np.array(p, "<i8").view(np.uint8), bitorder="little") for p in batch.column("fingerprint").to_pylist())
        return {"node": batch.column("node"), "keys": [(numbers + b[places] @ powers).tolist() for b in bits]}

    filed = map_arrow(nodes.select("node", "fingerprint"), cut, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    filed = filed.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    inner = filed.withColumn("least", F.min("node").over(W.partitionBy("key", "salt")))
    leaders = inner.where("node = least").select("key", "node")
    outer = leaders.withColumn("least", F.min("node").over(W.partitionBy("key")))
    met = inner.select("least", "node").union(outer.select("least", "node")).where("least <> node").distinct()
    one, two = (nodes.select(F.col("node").alias(n), F.col("fingerprint").alias(f"{n}_bits")) for n in ("least", "node"))
    differ = F.aggregate(F.zip_with("least_bits", "node_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    nearest = met.join(one, "least").join(two, "node").select("least", "node", differ.alias("differ")).where(F.col("differ") <= distance)
    nearest = nearest.groupBy("node").agg(F.min_by("least", F.struct("differ", "least")).alias("least"))
    early = _near(nearest.select(F.col("least").alias("a"), F.col("node").alias("b")), nodes, rows, words)
    linked = components(early)
    pairs = _rest(nodes, linked)
    rest = _near(pairs, nodes, rows, words)
    found = components(linked.where("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b")).union(rest))
    joined = nodes.select("node", "set", "first").join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("component", F.coalesce("component", "node"))
    firsts = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.select("set", "component").join(firsts, "component").select("set", "component_id")
    out = written(members.join(labels, "set").select("doc_id", "text_key", "component_id"), "similar")
    discarded(early, pairs, rest, nodes, members)
    return out


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """df's rows that stay: of each component of similar() the row with the smallest id. Rows that
    repeat this id stay together; rows without an id stay where their component has no other
    id."""
    found = similar(df, id_col, text_col, words)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct()
    rows = df.select(F.struct(*df.columns).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), _text_key(F.col(f"row.`{text_col}`")).alias("key"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi").select("row.*")
