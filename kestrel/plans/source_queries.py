"""Queries through the readers and writers: a file in the experiment's form is written from the test
tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import intervals, reshape
from kestrel.plans.registry import query, table
from kestrel.sources import sinks, tables
from kestrel.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _typed(df: DataFrame, order: str, path: str) -> str:
    """One person's sheet, in the order of its lines: the nations, of which there are 25."""
    sinks.csv(df.coalesce(1).sortWithinPartitions(order).drop(order), path)
    return path


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_csv_appended(spark, sf_dir):
    """A CSV written in two parts, the second appended."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _folder(spark, "csv")
    sinks.csv(rows.where("c_custkey % 2 = 0"), path)
    sinks.csv(rows.where("c_custkey % 2 = 1"), path, "append")
    return tables.csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def q_json_nested(spark, sf_dir):
    """Nested results as lines of JSON."""
    path = _folder(spark, "json")
    sinks.json(table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderstatus").alias("r")), path)
    return spark.read.schema("o_orderkey long, r struct<o_totalprice:double,o_orderstatus:string>").json(path).select("o_orderkey", "r.*")


@query("""SELECT row_number() OVER (ORDER BY n_nationkey)::INTEGER AS trial_num, n_nationkey * 1e4 AS white_light_on, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey * 1e4 + 0.5 END AS uv_light_on, CASE WHEN n_regionkey > 0 THEN n_nationkey * 1e4 + 29.25 END AS shock_on FROM nation""")
def q_stimuli_file(spark, sf_dir):
    """A log of stimuli, NaN for those that were not given, its lines numbered."""
    at, nan = "n_nationkey * 10000.0D", "CAST('NaN' AS DOUBLE)"
    rows = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", f"{nan} AS ev_stimtimes", f"{nan} AS ev_labels", f"{at} AS white_light_on", f"{at} + 30 AS white_light_off", f"IF(n_nationkey % 2 = 1, {at} + 0.5D, {nan}) AS UV_light_on", f"{nan} AS UV_light_off",
        f"IF(n_regionkey > 0, {at} + 29.25D, {nan}) AS shock_on", f"{nan} AS shock_off",
    )
    return tables.stimuli(spark, _typed(rows, "n_nationkey", _folder(spark, "stimuli"))).select("trial_num", "white_light_on", "uv_light_on", "shock_on")


@query("SELECT (1796 + n_nationkey)::INTEGER AS frames, n_nationkey / 2 AS framerate, n_name AS model FROM nation")
def q_camera_file(spark, sf_dir):
    """Camera settings as nested JSON that spans lines."""
    cameras = F.struct((F.col("n_nationkey") + 1796).cast("int").alias("frames"), F.struct((F.col("n_nationkey") / 2).alias("framerate"), F.col("n_name").alias("model")).alias("camera"))
    path = _folder(spark, "camera")
    text = F.to_json(F.collect_list(cameras), {"pretty": "true"})
    table(spark, sf_dir, "nation").agg(text.alias("value")).write.text(path)
    return tables.camera(spark, path).select("frames", "camera.framerate", "camera.model")


@query("""SELECT o_orderkey::VARCHAR AS video, 2 AS n_turns, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN [] ELSE [(o_orderkey % 50)::INTEGER, (o_custkey % 70)::INTEGER] END AS turns, 0 AS n_contractions, [(o_orderkey % 9)::INTEGER] AS contractions FROM orders""")
def q_blind_file(spark, sf_dir):
    """A scorer's sheet with lists in cells, bad and empty ones, and a header among the rows."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('Video_', o_orderkey, '/') AS Video_filename", "'' AS TimestampID", "'2' AS Number_turns", "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '1,x' ELSE concat(o_orderkey % 50, ', ', o_custkey % 70) END AS Turn_timestamps",
        "'' AS Number_contractions", "string(o_orderkey % 9) AS Contraction_timestamps", "'two\\nlines, one note' AS Notes",
    )
    header = spark.createDataFrame([tuple(rows.columns)], rows.schema)
    path = _folder(spark, "blind")
    sinks.csv(rows.union(header), path)
    return tables.blind_scores(spark, path).select("video", "n_turns", "turns", "n_contractions", "contractions")


_KEYS_SQL = "k AS (SELECT n_nationkey AS k, n_regionkey AS r, 'run' || max(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey END) OVER (ORDER BY n_nationkey) AS run, max(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey END) OVER (ORDER BY n_nationkey)::INTEGER AS head FROM nation)"


@query(f"""WITH {_KEYS_SQL} SELECT run, 'T' || r AS troupe, 1 AS day, k::INTEGER AS trial, 'CRturn' AS behavior, 'W1' AS worm, (k % 4)::DOUBLE AS score FROM k WHERE k % 6 > 0 UNION ALL SELECT run, 'T' || r, 1, k::INTEGER, 'UCRcon', 'W6', k / 2 FROM k""")
def q_tidy_file(spark, sf_dir):
    """A wide sheet as rows: runs filled down, stray columns and cells without a number left out."""
    rows = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "IF(n_nationkey % 5 = 0, concat('run', n_nationkey), '') AS Run", "concat('T', n_regionkey) AS Troupe", "1 AS Day", "2 AS Block", "n_nationkey AS Trial",
        "IF(n_nationkey % 6 = 0, 'NA', string(n_nationkey % 4)) AS CRturn_W1", "n_nationkey / 2 AS UCRcon_W6", "7 AS CRturn_W7", "'x' AS Notes",
    )
    return tables.tidy_scores(spark, _typed(rows, "n_nationkey", _folder(spark, "tidy"))).drop("block")


@query(f"""WITH {_KEYS_SQL} SELECT run, 'T' || head AS troupe, head AS day, head + 1 AS block, k::INTEGER AS trial, 'W' || w AS worm, (k * w)::DOUBLE AS score FROM k, (SELECT unnest(range(1, 7)) AS w) WHERE w <> 2 OR k % 2 = 0""")
def q_block_file(spark, sf_dir):
    """A sheet whose keys stand on the first row of each block only."""
    head = lambda c: f"IF(n_nationkey % 5 = 0, {c}, '')"
    rows = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", f"{head('concat(\"run\", n_nationkey)')} AS Run", f"{head('concat(\"T\", n_nationkey)')} AS Troupe", f"{head('string(n_nationkey)')} AS Day", f"{head('string(n_nationkey + 1)')} AS BlockNum", "n_nationkey AS `Trial `",
        *[f"IF({w} = 2 AND n_nationkey % 2 = 1, 'Q', string(n_nationkey * {w})) AS W{w}" for w in range(1, 7)], "'' AS Notes",
    )
    return tables.block_scores(spark, _typed(rows, "n_nationkey", _folder(spark, "block")))


@query(f"""WITH {_KEYS_SQL} SELECT 'T' || head AS troupe, (1 + head / 5)::INTEGER AS day, (1 + k % 5)::INTEGER AS trial, 'W' || w AS worm, CASE WHEN w = 2 AND k % 2 = 1 THEN 0 ELSE k * w END::DOUBLE AS score, (1 + k % 5 + 21 * (head / 5))::INTEGER AS abs_trial FROM k, (SELECT unnest(range(1, 7)) AS w)""")
def q_pheno_file(spark, sf_dir):
    """A sheet of responses: what is no number is no response, trials run on over the days."""
    head = lambda c: f"IF(n_nationkey % 5 = 0, {c}, '')"
    rows = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", f"{head('concat(\"run\", n_nationkey)')} AS Run", f"{head('concat(\"T\", n_nationkey)')} AS Troupe", f"{head('string(1 + n_nationkey DIV 5)')} AS Day", "string(1 + n_nationkey % 5) AS Trial",
        *[f"IF({w} = 2 AND n_nationkey % 2 = 1, 'Q', string(n_nationkey * {w})) AS W{w}" for w in range(1, 7)], "'' AS Notes",
    )
    return tables.pheno_scores(spark, _typed(rows, "n_nationkey", _folder(spark, "pheno"))).drop("subject")


def _splits(spark, sf_dir) -> str:
    path = _folder(spark, "splits")
    a = "s_suppkey % 100"
    line = f"concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN concat(',[', {a}, ', ', {a} + 20, '],[', {a} + 9, ',', {a} + 30, ']') WHEN 1 THEN concat(',[', {a}, ',', {a} + 40, ']') ELSE ',[]' END)"
    table(spark, sf_dir, "supplier").selectExpr(f"{line} AS value").write.text(path)
    return path


_TWO_LISTS_SQL = "SELECT s_name AS video, a AS start, a + 9 AS end FROM s WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_name, a + 20, a + 30 FROM s WHERE s_suppkey % 3 = 0"


@query(f"""WITH s AS (SELECT s_name, s_suppkey, (s_suppkey % 100)::INTEGER AS a FROM supplier) {_TWO_LISTS_SQL} UNION ALL SELECT s_name, a, a + 39 FROM s WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_name, a + 40, 1799 FROM s WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_name, 0, 1799 FROM s WHERE s_suppkey % 3 = 2""")
def q_splits_file(spark, sf_dir):
    """A ragged list of splits, asked for each of its videos."""
    videos = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("video"))
    return intervals.required(videos, tables.video_splits(spark, _splits(spark, sf_dir))).select("video", F.inline("intervals"))


@query(f"""WITH s AS (SELECT s_name, s_suppkey, (s_suppkey % 100)::INTEGER AS a FROM supplier) {_TWO_LISTS_SQL}""")
def q_splits_strict(spark, sf_dir):
    """The same without defaults: only both lists give intervals."""
    return tables.video_splits(spark, _splits(spark, sf_dir), defaults=False).select("video", F.inline("intervals"))


@query("""SELECT DISTINCT 'adjective' AS kind, p_brand AS word FROM part UNION ALL SELECT DISTINCT 'noun', p_type FROM part WHERE p_partkey % 3 = 2""")
def q_dictionary_file(spark, sf_dir):
    """A dictionary's words, without blanks and "None"."""
    rows = table(spark, sf_dir, "part").selectExpr("concat(p_brand, ' ') AS Adjective", "CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN ' ' ELSE p_type END AS Noun")
    path = _folder(spark, "dictionary")
    sinks.csv(rows, path)
    return tables.dictionary(spark, path)


@query("SELECT lpad(p_partkey::VARCHAR, 15, '0') AS pixels FROM part")
def q_raw_frames(spark, sf_dir):
    """Raw bytes cut into frames, of 16 by 1 pixels here."""
    path = _folder(spark, "raw")
    table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 15, "0").alias("value")).write.text(path)
    return tables.video_frames(spark, path, 16, 1).select(F.substr(F.decode("pixels", "UTF-8"), F.lit(1), F.lit(15)).alias("pixels"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM part)
SELECT '2025_10_15_10_20_58_trial_' || k || '_TC' AS session, '1_2_3_' || k AS region, (row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1)::INTEGER AS frame,
  p_size::DOUBLE AS first, CASE WHEN p_size <> 5 THEN p_size * 2.0 END::DOUBLE AS second, p_partkey / 4 AS third FROM p""")
def q_features_file(spark, sf_dir):
    """Feature matrices, a row a feature, read by ranges of frames."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('2025_10_15_10_20_58_trial_', p_partkey % 3, '_TC_regions_1_2_3_', p_partkey % 3, '_FINAL_Feature_vector.npy') AS file",
        "array(double(p_size), IF(p_size <> 5, double(p_size * 2), double('NaN')), p_partkey / 4) AS row",
    )
    path = _folder(spark, "features")
    sinks.arrays(rows, path, "file", "p_partkey", "row", transposed=True)
    return tables.feature_matrices(spark, f"{path}/*.npy", ("first", "second", "third"))


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 2 AS k, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY p_partkey) - 1 AS i FROM part)
SELECT 'v' || k || '_100_9000.npz' AS file, (100 + i)::INTEGER AS frame, 2 AS height, 3 AS width,
  '1' || (p_size % 2) || (p_size // 2 % 2) || '0' || (p_size // 4 % 2) || (p_size // 8 % 2) AS mask FROM p""")
def q_masks_file(spark, sf_dir):
    """Mask arrays of an archive, a row a frame."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('v', p_partkey % 2, '_100_9000.npz') AS file",
        "transform(array(1, p_size % 2, p_size DIV 2 % 2, 0, p_size DIV 4 % 2, p_size DIV 8 % 2), x -> double(x)) AS row",
    )
    path = _folder(spark, "masks")
    sinks.arrays(rows, path, "file", "p_partkey", "row", "masks", (1, 2, 3), dtype="u1")
    bits = F.concat(*[F.conv(F.hex(F.substr("mask", F.lit(k + 1), F.lit(1))), 16, 10) for k in range(6)])
    return tables.masks(spark, f"{path}/*.npz").withColumn("mask", bits)


@query("""WITH k AS (SELECT s_suppkey, s_suppkey % 4 AS f, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_suppkey % 4) AS n FROM supplier)
SELECT 'worm' || f || '.pickle' AS file, i::INTEGER AS frame, [s_suppkey / 8, s_suppkey + 0.5::DOUBLE] AS theta FROM k WHERE n = (SELECT max(n) FROM k) AND f <> 3""")
def q_shape_file(spark, sf_dir):
    """Shape series from pickles: files of models and of another length are passed over."""
    suppliers = table(spark, sf_dir, "supplier")
    most = suppliers.groupBy(F.col("s_suppkey") % 4).count().agg(F.max("count")).first()[0]
    rows = suppliers.selectExpr("s_suppkey", "IF(s_suppkey % 4 = 3, 'PCA_NAN.pickle', concat('worm', s_suppkey % 4, '.pickle')) AS file", "array(s_suppkey / 8, s_suppkey + double(0.5)) AS theta")
    path = _folder(spark, "shapes")
    sinks.pickled(rows, path, "file", "s_suppkey", "theta")
    return tables.shape_series(spark, path, most)


@query("""SELECT 'boxes' || (p_partkey % 2) || '.npy' AS file, p_size AS frame, (row_number() OVER (PARTITION BY p_partkey % 2, p_size ORDER BY p_partkey) - 1)::INTEGER AS place,
  [p_partkey, p_partkey + 1, p_size, p_size + 2]::DOUBLE[] AS box FROM part""")
def q_boxes_file(spark, sf_dir):
    """Boxes by frame from side files of a dict."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "concat('boxes', p_partkey % 2, '.npy') AS file", "transform(array(p_partkey, p_partkey + 1, p_size, p_size + 2), x -> double(x)) AS box")
    path = _folder(spark, "boxes")
    sinks.pickled(rows, path, "file", "p_partkey", "box", "p_size")
    return tables.frame_boxes(spark, path)


@query("""WITH n AS (SELECT n_nationkey AS k, 'f' || (n_nationkey % 7) AS data_folder FROM nation), l AS (SELECT data_folder, max(k) AS k FROM n GROUP BY 1)
SELECT data_folder, 'run' || k AS run_name, CASE WHEN k % 2 = 0 THEN k::INTEGER END AS day, (18 + k)::INTEGER AS n_worms FROM l""")
def q_log_file(spark, sf_dir):
    """The experiment log: numbers among words, of rows with equal folders the last."""
    names = ["run_date", "start_time", "run_name", "species", "grp", "troupe", "block", "worms_day", "block_type", "data_folder", "n_worms", "trough", "runner"]
    cells = {"run_name": "concat('run', n_nationkey)", "worms_day": "IF(n_nationkey % 2 = 0, string(n_nationkey), 'tbd')", "data_folder": "concat('f', n_nationkey % 7)", "n_worms": "concat('~', 18 + n_nationkey)"}
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", *[f"{cells.get(n, chr(39) + n + chr(39))} AS {n}" for n in names])
    log = tables.experiment_log(spark, _typed(rows, "n_nationkey", _folder(spark, "log")))
    return reshape.latest(log, ["data_folder"], [F.col("pos")]).select("data_folder", "run_name", "day", "n_worms")


@query("SELECT r_regionkey, r_name, 'one' AS source FROM region UNION ALL SELECT r_regionkey + 10, r_name, 'two' FROM region")
def q_configured_sources(spark, sf_dir):
    """Sheets by name from a list of files, one of which is missing."""
    rows, one, two = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), _folder(spark, "one"), _folder(spark, "two")
    sinks.csv(rows, one)
    sinks.csv(rows.withColumn("r_regionkey", F.col("r_regionkey") + 10), two)
    return tables.sources(spark, {"one": one, "two": two, "three": _folder(spark, "none")}, lambda s, p: tables.csv(s, p, "r_regionkey int, r_name string"))


@query("""SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_name FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer WHERE c_custkey % 10 <> 3""")
def q_upsert_versions(spark, sf_dir):
    """A table replaced by key, as a new version."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _folder(spark, "versions")
    sinks.upsert(rows, path, ["c_custkey"], 0)
    return spark.read.parquet(sinks.upsert(rows.where("c_custkey % 10 = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1), path, ["c_custkey"], 1))


@query("""SELECT 'N' || o_orderkey AS anonymous_name, '2025_10_15_' || o_orderkey || '_TC' AS original_file, '2025_10_15' AS session_date, 'TC' AS trial_type FROM orders""")
def q_lookup_appended(spark, sf_dir):
    """The table of anonymous names, made empty and added to, with what the file's name tells."""
    named = table(spark, sf_dir, "orders").selectExpr("concat('N', o_orderkey) AS anonymous_name", "concat('2025_10_15_', o_orderkey, '_TC') AS original_file", "'1_2_3_4' AS box_coordinates", "1 AS trial_number", "'18-291' AS trial_frames")
    path = _folder(spark, "lookup")
    sinks.created(spark, path, tables.LOOKUP)
    sinks.append(sinks.lookup_records(named, "2026-01-01"), path)
    return sinks.created(spark, path, tables.LOOKUP).select("anonymous_name", "original_file", "session_date", "trial_type")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def q_snapshot(spark, sf_dir):
    """A stamped snapshot, and a folder for each status."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = sinks.snapshot(rows, _folder(spark, "snapshots"), "orders", "2026_01_01")
    by = _folder(spark, "by-status")
    sinks.parquet(spark.read.parquet(path), by, ["o_orderstatus"])
    return spark.read.schema(rows.schema).parquet(by).select(*rows.columns)
