"""Queries of names, cells, filters, sets and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import text
from kestrel.operators import intervals, reshape, scores
from kestrel.plans.registry import query, rounded, table


@query("""WITH c AS (SELECT event_id, event_id % 50 || ', ' || user_id || ',' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '3' END AS cell FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN []::INTEGER[] ELSE [(event_id % 50)::INTEGER, (split_part(cell, ',', 2))::INTEGER, 3] END AS times FROM c""")
def q_parse_lists(spark, sf_dir):
    """Integers of a comma-joined cell; one bad token empties the list."""
    cell = F.expr("concat(event_id % 50, ', ', user_id, ',', IF(event_id % 7 = 0, 'x', '3'))")
    return table(spark, sf_dir, "events").select("event_id", text.int_list(cell).alias("times"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [{'start': 0, 'end': 1799}] WHEN 1 THEN [{'start': (o_orderkey % 100)::INTEGER, 'end': (o_orderkey % 100 + 50)::INTEGER}, {'start': 200, 'end': 260}]
ELSE [{'start': (o_orderkey % 100)::INTEGER, 'end': 499}, {'start': 500, 'end': 1799}] END AS intervals FROM orders""")
def q_split_intervals(spark, sf_dir):
    """Intervals of a split list's lines: two lists, the old form with one, or none."""
    line = F.expr("concat('video', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ',[]' WHEN 1 THEN concat(',[', o_orderkey % 100, ',200],[', o_orderkey % 100 + 50, ',260]') ELSE concat(',[', o_orderkey % 100, ',500]') END)")
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.split_intervals(text.bracketed_lists(line)).alias("intervals"))


@query("""SELECT event_type, count(*) AS n, sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 END) AS present, sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 ELSE 0 END) AS with_zero,
count(CASE WHEN event_id % 5 < 2 THEN 1 END) AS n_present FROM events GROUP BY event_type""".replace("sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 END)", "round(sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 END), 4)").replace("sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 ELSE 0 END)", "round(sum(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 3 ELSE 0 END), 4)"))
def q_coerce_numeric(spark, sf_dir):
    """Cells as numbers: "NA", "Q" and blanks are missing in one kind of sheet, 0 in another."""
    cell = F.expr("CASE event_id % 5 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN ' 3 ' WHEN 2 THEN 'NA' WHEN 3 THEN 'Q' ELSE '' END")
    rows = table(spark, sf_dir, "events").withColumns({"a": text.number(cell), "b": text.number_or_zero(cell)})
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("a").alias("present"), F.sum("b").alias("with_zero"), F.count("a").alias("n_present")), "present", "with_zero", digits=4)


_NAME_SQL = """n AS (SELECT o_orderkey, strftime(o_orderdate, '%Y_%m_%d') || '_10_20_58_trial_' || (o_orderkey % 9 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN '_TC' ELSE '_TP' END AS session, (o_custkey % 900) || '_248_' || (o_custkey % 900 + 218) || '_1170' AS region FROM orders)"""


def _names(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("name", F.expr(
        "concat('/data/', date_format(o_orderdate, 'yyyy_MM_dd'), '_10_20_58_trial_', o_orderkey % 9 + 1, IF(o_orderkey % 2 = 0, '_TC', '_TP'), '_regions_', o_custkey % 900, '_248_', o_custkey % 900 + 218, '_1170_FINAL_Feature_vector.npy')"
    ))


@query(f"WITH {_NAME_SQL} SELECT o_orderkey, session, region, split_part(region, '_', 1)::INTEGER AS x1, CASE WHEN session LIKE '%TP' THEN 'TP' ELSE 'TC' END AS condition, 'W' || lpad((o_orderkey % 7)::VARCHAR, 5, '0') AS padded FROM n")
def q_name_keys(spark, sf_dir):
    """Session, region, corner and condition from a file's name."""
    region, session = text.region_of("name"), text.session_of("name")
    return _names(spark, sf_dir).select("o_orderkey", session.alias("session"), region.alias("region"), text.region_corner(region, 1).alias("x1"), text.condition_of(session).alias("condition"), F.format_string("W%05d", F.col("o_orderkey") % 7).alias("padded"))


@query("SELECT event_id, (event_id % 100)::INTEGER AS start, (event_id % 100 + 40)::INTEGER AS end FROM events")
def q_frame_range(spark, sf_dir):
    """The frames that a mask's name tells."""
    name = F.expr("concat('video_', user_id, '_mask_', event_id % 100, '_', event_id % 100 + 40, '.npz')")
    return table(spark, sf_dir, "events").select("event_id", text.frame_range(name).alias("r")).select("event_id", "r.start", "r.end")


@query("SELECT event_id, 'Ahead_' || user_id AS video FROM events")
def q_text_keys(spark, sf_dir):
    """Video keys without their mark and trailing slashes."""
    return table(spark, sf_dir, "events").select("event_id", text.video_key(F.expr("concat('Video_Ahead_', user_id, repeat('/', CAST(event_id % 3 AS INT)))")).alias("video"))


@query("SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS place, 'frame_' || o_orderkey || '.jpg' AS name FROM orders")
def q_natural_order(spark, sf_dir):
    """File names in the order of their numbers."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.expr("concat('frame_', o_orderkey, '.jpg')").alias("name"))
    return reshape.rank_in(rows, ["o_custkey"], [text.natural("name"), F.col("name")], "place")


@query("SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, json_extract(props, '$.k')::INTEGER * 2 AS twice FROM events")
def q_json_fields(spark, sf_dir):
    """Numbers of a nested document, and one assembled and read back."""
    rows = table(spark, sf_dir, "events").withColumn("doc", F.from_json("props", "k int"))
    made = rows.withColumn("out", F.to_json(F.struct(F.struct((F.col("doc.k") * 2).alias("twice")).alias("result"))))
    return made.select("event_id", "doc.k", F.get_json_object("out", "$.result.twice").cast("int").alias("twice"))


@query("""SELECT o_orderkey, label, trial_num FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c'] WHEN 3 THEN ['d', 'e', 'f'] ELSE [] END) AS label, generate_subscripts(CASE o_orderkey % 4 WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c'] WHEN 3 THEN ['d', 'e', 'f'] ELSE [] END, 1)::INTEGER AS trial_num FROM orders)""")
def q_map_lookup(spark, sf_dir):
    """Trial labels of a session's block, by a fixed table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("block"))
    return scores.labels_of_blocks(rows, {1: ["a", "b"], 2: ["c"], 3: ["d", "e", "f"]}).drop("block")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') AS stamp, year(o_orderdate)::INTEGER AS y FROM orders")
def q_date_parts(spark, sf_dir):
    """Time stamps as names, and a date's part back from the name."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"), F.split(stamp, "-")[0].cast("int").alias("y"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%gear%' THEN 'gear' END AS matched FROM part
WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND NOT coalesce(p_brand LIKE 'Brand#1%', false) AND (p_name LIKE 'small%' OR p_name LIKE 'red%' OR p_name LIKE 'big%') AND p_size IS NOT NULL""")
def q_filters(spark, sf_dir):
    """Rows by membership, prefixes and parts of names, with the part that matched."""
    rows = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).na.drop("any", subset=["p_size"])
    rows = rows.where(~text.has_any("p_brand", "Brand#1", "prefix") & text.has_any("p_name", ["small", "red", "big"], "prefix"))
    return rows.select("p_partkey", text.matched_part("p_name", ["ring", "gear"]).alias("matched"))


@query("""WITH d AS (SELECT s_nationkey % 10 AS k, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey % 10 ORDER BY s_suppkey DESC) AS r FROM supplier) SELECT c_custkey, s_suppkey, s_name FROM customer LEFT JOIN d ON c_nationkey = d.k AND r = 1""")
def q_log_lookup(spark, sf_dir):
    """A lookup whose keys repeat: the last row of a key holds, rows without one get nulls."""
    dimension = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 10).alias("k"), "s_suppkey", "s_name")
    return reshape.looked_up(table(spark, sf_dir, "customer"), dimension, "c_nationkey", "k", [F.col("s_suppkey")]).select("c_custkey", "s_suppkey", "s_name")


@query("""WITH d AS (SELECT s_nationkey % 10 AS k, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey % 10 ORDER BY s_suppkey) AS r FROM supplier) SELECT c_custkey, s_suppkey, s_name FROM customer LEFT JOIN d ON c_nationkey = d.k AND r = 1""")
def q_first_lookup(spark, sf_dir):
    """The same lookup where the first row of a key holds."""
    dimension = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 10).alias("k"), "s_suppkey", "s_name")
    return reshape.looked_up(table(spark, sf_dir, "customer"), dimension, "c_nationkey", "k", [F.col("s_suppkey")], first=True).select("c_custkey", "s_suppkey", "s_name")


@query("""SELECT l_orderkey, l_linenumber, o_orderdate AS since FROM lineitem ASOF LEFT JOIN (SELECT DISTINCT o_custkey % 50 AS k, o_orderdate FROM orders) o ON l_suppkey % 50 = k AND l_shipdate >= o_orderdate""")
def q_last_start(spark, sf_dir):
    """For each row the last start of an interval that is not after it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("k"), "l_shipdate")
    starts = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_orderdate").distinct()
    return intervals.last_start(rows, starts, ["k"], "l_shipdate", "o_orderdate", "since").select("l_orderkey", "l_linenumber", "since")


@query("""SELECT c_custkey, c_name, c_acctbal, 'old' AS origin FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, c_name, c_acctbal + 1, 'new' FROM customer WHERE c_custkey % 10 = 3
UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, 'new' FROM customer WHERE c_custkey % 50 = 0""")
def q_upsert(spark, sf_dir):
    """Rows replaced or added by key."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = customer.where("c_custkey % 10 = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    added = customer.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    new = changed.union(added).withColumn("origin", F.lit("new"))
    return reshape.upserted(customer.withColumn("origin", F.lit("old")), new, ["c_custkey"])


@query("""WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag <> 'R'), i AS (SELECT DISTINCT k FROM a), j AS (SELECT DISTINCT k FROM b)
SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS all_rows, (SELECT count(*) FROM (FROM i UNION FROM j)) AS either, (SELECT count(*) FROM i ANTI JOIN j USING (k)) AS only_a, (SELECT count(*) FROM i SEMI JOIN j USING (k)) AS both_""")
def q_union_except_distinct(spark, sf_dir):
    """Unions, differences and common keys of two lists."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    return rows.agg(F.sum(F.col("a") + F.col("b")).alias("all_rows"), F.count("*").alias("either"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both_"))


@query("SELECT o_custkey, max_by(o_orderkey, o_orderdate)::BIGINT AS last_order, min_by(o_orderkey, o_orderdate)::BIGINT AS first_order FROM (SELECT o_custkey, o_orderkey, (o_orderdate, o_orderkey) AS o_orderdate FROM orders) GROUP BY o_custkey")
def q_first_last(spark, sf_dir):
    """First and last row of each key."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("last_order"), F.min_by("o_orderkey", at).alias("first_order"))


@query("""WITH i AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 10 END AS start, (o_orderkey % 1000)::INTEGER AS end FROM orders) SELECT o_custkey, 0 AS start, max("end") AS end FROM i WHERE start = 0 GROUP BY o_custkey""")
def q_max_by_interval(spark, sf_dir):
    """Of intervals that start at 0 the longest."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "IF(o_orderkey % 2 = 0, 0, 10) AS start", "CAST(o_orderkey % 1000 AS INT) AS end")
    return intervals.base_interval(rows, ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_suppkey % 20, l_linenumber) IN ((1, 1), (2, 3), (0, 2))""")
def q_interval_semijoin(spark, sf_dir):
    """Rows whose pair of numbers is in a list."""
    allowed = spark.createDataFrame([(1, 1), (2, 3), (0, 2)], "a long, l_linenumber int")
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.col("l_suppkey") % 20)
    return rows.join(F.broadcast(allowed), ["a", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey AS folder, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL HAVING count(*) > 2""")
def q_unfinished(spark, sf_dir):
    """Inputs of more than two files for which no output exists."""
    from kestrel.sources.tables import unfinished

    orders = table(spark, sf_dir, "orders").withColumn("folder", F.col("o_custkey"))
    known = orders.join(table(spark, sf_dir, "customer"), orders.o_custkey == F.col("c_custkey"), "left_semi")
    return unfinished(known, orders.where("o_orderstatus = 'P'"), "folder", 2)


@query("""WITH b AS (SELECT c_nationkey AS id, (c_custkey % 12)::INTEGER AS x, (c_custkey % 12) || '_box' AS box FROM customer), d AS (SELECT DISTINCT id, x, box FROM b) SELECT id, x, box, row_number() OVER (PARTITION BY id ORDER BY x, box)::INTEGER AS worm, count(*) OVER (PARTITION BY id) AS n_boxes FROM d""")
def q_boxes_numbered(spark, sf_dir):
    """Distinct boxes of a session numbered from the left."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS id", "CAST(c_custkey % 12 AS INT) AS x", "concat(c_custkey % 12, '_box') AS box")
    return scores.boxes_numbered(rows, "id", "box", "x")


@query("""SELECT c_custkey, 'old' AS source, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new', NULL, c_acctbal FROM customer WHERE c_custkey % 2 = 1""")
def q_union_by_name(spark, sf_dir):
    """Sheets of different columns under one another."""
    rows = table(spark, sf_dir, "customer")
    one = rows.where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("source"), F.col("c_mktsegment").alias("segment"))
    two = rows.where("c_custkey % 2 = 1").select("c_custkey", F.lit("new").alias("source"), F.col("c_acctbal").alias("balance"))
    return one.unionByName(two, allowMissingColumns=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_head(spark, sf_dir):
    """The ten largest."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


def _draw_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


@query(f"SELECT o_orderkey FROM orders ORDER BY {_draw_sql("'7|' || o_orderkey")}, o_orderkey LIMIT 20")
def q_sample(spark, sf_dir):
    """Twenty random videos, the same for a seed."""
    return reshape.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 20, seed=7)


@query(f"""WITH a AS (SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 2), word) - 1 AS place FROM (SELECT DISTINCT 'A' || p_partkey AS word FROM part)), n AS (SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 2), word) - 1 AS place FROM (SELECT DISTINCT 'N' || p_partkey AS word FROM part)),
c AS (SELECT count(*) AS c FROM a), v AS (SELECT DISTINCT o_orderkey AS video FROM orders), d AS (SELECT video, c, {_draw_sql("'3|a|' || video")} % c AS i, {_draw_sql("'3|n|' || video")} % c AS k FROM v, c), e AS (SELECT *, (i + 1 + {_draw_sql("'3|b|' || video")} % (c - 1)) % c AS j FROM d),
b AS (SELECT video, 'Video_' || x.word || '_' || y.word || '_' || n.word AS base FROM e JOIN a x ON x.place = i JOIN a y ON y.place = j JOIN n ON n.place = k), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY video) AS r FROM b) SELECT video, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS name FROM r""")
def q_anonymous_names(spark, sf_dir):
    """A random name for each video, repeated ones numbered."""
    words = table(spark, sf_dir, "part")
    adjectives = words.select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("word"))
    nouns = words.select(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("word"))
    return reshape.anonymized(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video")), "video", adjectives, nouns, seed=3)


@query("""SELECT c_custkey FROM customer ANTI JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (c_custkey)""")
def q_already_done(spark, sf_dir):
    """Videos not yet annotated."""
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")
