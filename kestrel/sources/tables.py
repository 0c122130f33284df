"""Readers of the experiment's files, each under an explicit schema.

Paths may name a file, a folder or a glob pattern of any store that Spark reads. NaN, the
files' mark of a missing value, becomes null. Readers whose rows depend on earlier rows add
`pos`, which rises in the order of a file's rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import text
from kestrel.operators import intervals, reshape
from kestrel.sources import pickles, ranged

STIMULI = "ev_stimtimes double, ev_labels double, white_light_on double, white_light_off double, uv_light_on double, uv_light_off double, shock_on double, shock_off double"
TRIALS = "trial_num int, start_frame int, end_frame int"
CAMERA = "frames int, display boolean, planaria string, folder string, camera struct<buffer_count:int,framerate:double,model:string,buffer_mode:string,exposure:double,trigger:string>, runtime double, stimulus string"
LOG = "run_date string, start_time string, run_name string, species string, grp string, troupe string, block string, worms_day string, block_type string, data_folder string, n_worms string, trough string, runner string"
BLIND = "video_filename string, timestamp_id string, number_turns string, turn_timestamps string, number_contractions string, contraction_timestamps string, notes string"
LOOKUP = "anonymous_name string, original_file string, box_coordinates string, trial_number int, trial_frames string, session_date string, trial_type string, timestamp_created string"
#: The features of a series, in the order of a matrix's rows.
FEATURES = ("areas", "area_percentages", "perimeters", "area_perimeter_ratios", "centroidxs", "centroidys", "circularities", "angles", "hull_areas", "concavities", "pc1", "pc2")
SUBJECTS = 6


def csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A CSV with a header; without a schema all columns are strings, named as in the header."""
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_position(df: DataFrame) -> DataFrame:
    """df with pos: rises with a file's rows, as Spark numbers a file's splits in order."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def file_name(depth: int = 0) -> Column:
    """The name of a row's file, or with depth 1, 2... of the folder so far above it."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)


def stimuli(spark: SparkSession, path: str) -> DataFrame:
    """session (the file's folder), trial_num (from 1, in file order) and the log's columns."""
    raw = spark.read.option("header", True).schema(STIMULI).csv(path).select(file_name(1).alias("session"), "*", F.monotonically_increasing_id().alias("pos"))
    clean = raw.withColumns({c.split()[0]: text.null_if_nan(c.split()[0]) for c in STIMULI.split(", ")})
    return reshape.rank_in(clean, ["session"], [F.col("pos")], "trial_num").drop("pos")


def trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(TRIALS).csv(path).select(file_name(1).alias("session"), *[x.split()[0] for x in TRIALS.split(", ")])


def camera(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(CAMERA).json(path)


def divergences(spark: SparkSession, path: str) -> DataFrame:
    """Result rows, with kl_per_feature as an array, and the region from the video's name."""
    raw = csv(spark, path, multiLine=True)
    values = F.transform(F.regexp_extract_all("KL_per_feature", F.lit(r"(-?\d[\d.eE+-]*)"), F.lit(1)), lambda x: x.try_cast("double"))
    return raw.select(
        "video", text.session_of("session").alias("session"), text.region_of("video").alias("region"), "Troupe", "Day", "Block",
        text.number("n_CSon_frames", "int").alias("n_on"), text.number("n_CSoff_frames", "int").alias("n_off"), text.number("KL").alias("kl"), values.alias("kl_per_feature"),
        *[text.number(c).alias(c.lower()) for c in raw.columns if c.endswith("_KL")],
    )


def divergence_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with pos; day and n_worms as numbers where they are such; the last row of a
    data_folder is the one that holds (reshape.looked_up)."""
    raw = with_position(spark.read.option("header", True).schema(LOG).csv(path))
    return raw.withColumns({"day": text.number("worms_day", "int"), "block": text.number("block", "int"), "n_worms": F.regexp_extract("n_worms", r"(\d+)", 1).try_cast("int")})


def blind_scores(spark: SparkSession, path: str) -> DataFrame:
    """video and turns, contractions (int lists) and notes of a scorer's sheet. Header rows
    within the data are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).schema(BLIND).csv(path).where(F.coalesce(F.col("video_filename"), F.lit("")) != "Video_filename")
    return raw.select(
        text.video_key("video_filename").alias("video"), "timestamp_id", F.coalesce(text.number("number_turns", "int"), F.lit(0)).alias("n_turns"), text.int_list("turn_timestamps").alias("turns"),
        F.coalesce(text.number("number_contractions", "int"), F.lit(0)).alias("n_contractions"), text.int_list("contraction_timestamps").alias("contractions"), "notes",
    )


def scorers(sheets: dict[str, DataFrame]) -> DataFrame:
    """video and <scorer>_<column> for the videos that all the scorers' sheets have."""
    out = None
    for name, sheet in sheets.items():
        named = sheet.select("video", *[F.col(c).alias(f"{name}_{c}") for c in sheet.columns if c != "video"])
        out = named if out is None else out.join(named, "video")
    return out


def sources(spark: SparkSession, paths: dict[str, str], read) -> DataFrame:
    """The tables that read(spark, path) finds at paths that exist, with their name as source."""
    out = None
    for name, path in paths.items():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            part = read(spark, path).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


def _sheets(spark: SparkSession, path: str, **options) -> DataFrame:
    """csv() with sheet, the row's file."""
    return csv(spark, path, **options).select("*", F.col("_metadata.file_path").alias("sheet"))


def tidy_scores(spark: SparkSession, path: str) -> DataFrame:
    """run, troupe, day, block, trial, behavior, worm and score of a wide sheet: a row for each
    cell with a number, for the subjects W1 to W6. Runs are filled down."""
    raw = with_position(_sheets(spark, path, multiLine=True))
    raw = raw.withColumn("run", text.null_if_blank("Run"))
    filled = raw.withColumn("run", F.last("run", ignorenulls=True).over(_file_order()))
    cells = [c for c in raw.columns if "_W" in c and int(c.rpartition("_W")[2]) <= SUBJECTS]
    ids = filled.select("run", F.col("Troupe").alias("troupe"), *[text.number(c, "int").alias(c.lower()) for c in ("Day", "Block", "Trial")], *[text.number(c).alias(c) for c in cells])
    long = reshape.to_long(ids, ["run", "troupe", "day", "block", "trial"], cells, "cell", "score")
    return reshape.split_name(long, "cell", "behavior", "worm").drop("cell")


def _file_order():
    from pyspark.sql import Window as W

    # A score sheet is one person's typing, so a file's rows fit one task; files fill down apart.
    return W.partitionBy("sheet").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)


def block_scores(spark: SparkSession, path: str) -> DataFrame:
    """run, troupe, day, block, trial, worm and score of a sheet whose keys stand on the first
    row of each block only; anything that is no number is null and left out."""
    raw = _sheets(spark, path, multiLine=True)
    raw = with_position(raw.toDF(*[c.strip() for c in raw.columns]))
    keys = {"Run": "run", "Troupe": "troupe", "Day": "day", "BlockNum": "block"}
    keyed = raw.withColumns({n: F.last(text.null_if_blank(c), ignorenulls=True).over(_file_order()) for c, n in keys.items()})
    worms = [f"W{k}" for k in range(1, SUBJECTS + 1)]
    ids = keyed.select("run", "troupe", text.number("day", "int").alias("day"), text.number("block", "int").alias("block"), text.number("Trial", "int").alias("trial"), *[text.number(w).alias(w) for w in worms])
    return reshape.to_long(ids, ["run", "troupe", "day", "block", "trial"], worms, "worm", "score")


def pheno_scores(spark: SparkSession, path: str, trials_a_day: int = 21) -> DataFrame:
    """troupe, day, trial, worm, subject, score and abs_trial (over days). Here anything that is
    no number means no response and scores 0; rows without any value are left out."""
    raw = with_position(_sheets(spark, path)).na.drop("all", subset=["Run", "Troupe", "Day", "Trial"])
    filled = raw.withColumns({c: F.last(text.null_if_blank(c), ignorenulls=True).over(_file_order()) for c in ("Run", "Troupe", "Day", "Trial")})
    worms = [f"W{k}" for k in range(1, SUBJECTS + 1)]
    ids = filled.select(F.col("Troupe").alias("troupe"), text.number("Day", "int").alias("day"), text.number("Trial", "int").alias("trial"), *[text.number_or_zero(w).alias(w) for w in worms])
    long = reshape.to_long(ids, ["troupe", "day", "trial"], worms, "worm", "score")
    return long.withColumns({"subject": F.concat_ws("_", "troupe", "worm"), "abs_trial": F.col("trial") + trials_a_day * (F.col("day") - 1)})


def video_splits(spark: SparkSession, path: str, defaults: bool = True) -> DataFrame:
    """video and intervals (array of inclusive start and end) for each line of a split list; of
    lines with equal names the first holds. Defaults as in intervals.split_intervals();
    intervals.required() makes a missing video an error."""
    raw = with_position(spark.read.text(path)).where("trim(value) <> ''")
    rows = raw.select(F.trim(F.split("value", ",")[0]).alias("video"), intervals.split_intervals(text.bracketed_lists("value"), defaults=defaults).alias("intervals"), "pos")
    return reshape.latest(rows, ["video"], [-F.col("pos")]).drop("pos")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """kind (adjective or noun) and word, blanks and "None" left out."""
    raw = csv(spark, path).withColumnsRenamed({"Adjective": "adjective", "Noun": "noun"})
    words = reshape.to_long(raw.select("adjective", "noun"), [], ["adjective", "noun"], "kind", "word")
    return words.select("kind", F.trim("word").alias("word")).where("word <> '' and word <> 'None'").distinct()


def video_frames(spark: SparkSession, path: str, width: int = 2048, height: int = 2048) -> DataFrame:
    """file, frame and pixels of raw 8-bit videos of any size and number: each file is cut into whole
    frames, what is left over is dropped, and a file under one frame is an error. Conditions on
    frame decide which bytes are read."""
    return ranged.registered(spark).format("frames").options(width=width, height=height).load(path)


def masks(spark: SparkSession, path: str, key: str = "masks") -> DataFrame:
    """file, frame, height, width and mask (a byte a pixel) of mask arrays; a file's frames are
    numbered from the start that its name tells. An axis of one between frame and height is dropped."""
    raw = ranged.registered(spark).format("arrays").options(key=key, values="bytes").load(path)
    return raw.select("file", (F.col("at") + text.frame_range("file")["start"]).cast("int").alias("frame"), F.element_at("shape", -2).alias("height"), F.element_at("shape", -1).alias("width"), F.col("values").alias("mask"))


def feature_matrices(spark: SparkSession, path: str, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """session, region, frame and a column for each feature, from arrays of a row a feature."""
    raw = ranged.registered(spark).format("arrays").options(axis=1).load(path)
    columns = [text.null_if_nan(F.get("values", F.lit(k))).alias(f) for k, f in enumerate(features)]
    return raw.select(text.session_of("file").alias("session"), text.region_of("file").alias("region"), F.col("at").cast("int").alias("frame"), *columns)


def _arrays(frame_rows, function):
    for batch in frame_rows:
        for row in batch.itertuples(index=False):
            yield from function(row.path.rpartition("/")[2], row.content)


#: Files beside the shape series that hold models.
MODELS = ("PCA_NAN", "SCALING", "PCA_", "SCALING_NAN")


def shape_series(spark: SparkSession, path: str, frames: int = 1799) -> DataFrame:
    """file, frame and theta (an array) of shape arrays of a row a frame, the first entry of files
    that hold several. Files of models, hidden ones and arrays of another number of frames are
    left out. Files are NumPy's own (.npy, .npz) or pickles (.pickle) of plain values and arrays, which
    are interpreted and never run; any other pickle is an error."""

    def run(batches):
        def rows(name, content):
            data = pickles.loads(content) if name.endswith(".pickle") else np.load(io.BytesIO(content), allow_pickle=False)
            data = data[data.files[0]] if hasattr(data, "files") else data[0] if isinstance(data, (tuple, list)) else data
            if len(data) == frames:
                yield pd.DataFrame({"file": name, "frame": np.arange(frames, dtype=np.int32), "theta": [x.tolist() for x in np.asarray(data, float).reshape(frames, -1)]})

        yield from _arrays(batches, rows)

    stem = F.regexp_extract("path", r"([^/]*?)\.(np[yz]|pickle)$", 1)
    raw = spark.read.format("binaryFile").load(path).where((stem != "") & ~stem.startswith(".") & ~stem.isin(*MODELS)).select("path", "content")
    return raw.mapInPandas(run, "file string, frame int, theta array<double>")


def frame_boxes(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, place (from 0) and box (an array of numbers) of side files: a dict of frame to boxes as
    NumPy saves it (.npy), interpreted and never run. A frame's one box counts as a list of one."""

    def run(batches):
        def rows(name, content):
            for frame, boxes in pickles.loads_npy(content).items():
                listed = np.atleast_2d(np.asarray(boxes, float)) if len(boxes) else []
                yield pd.DataFrame([[name, int(frame), k, b.tolist()] for k, b in enumerate(listed)], columns=["file", "frame", "place", "box"])

        yield from _arrays(batches, rows)

    raw = spark.read.format("binaryFile").load(path).where("path like '%.npy'").select("path", "content")
    return raw.mapInPandas(run, "file string, frame long, place int, box array<double>")


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, folder and length of files, without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    parts = F.split("path", "/")
    return reader.load(path).select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "length")


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str = "folder", least: int = 100) -> DataFrame:
    """key and n of the inputs of more than `least` rows for which no output exists."""
    counted = inputs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return counted.join(outputs.select(key).distinct(), key, "left_anti")


def ordered_by_numbers(df: DataFrame, name: str = "name") -> DataFrame:
    """df in the order of the numbers in a name (trial, then the region's corners); names without
    them come last, by name."""
    trial = F.regexp_extract(name, r"trial_(\d+)", 1).try_cast("int")
    region = text.region_of(name)
    corners = [text.region_corner(region, k) for k in (1, 2, 3, 4)]
    return df.orderBy(trial.asc_nulls_last(), *[c.asc_nulls_last() for c in corners], name)
