"""Trial windows, gaps, labels and interval overwrites of frame series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames a second, the frame of the first light, frames before the light that
#: count as trial, and the length of a trial without shock.
FPS, FIRST_LIGHT, LEAD, LENGTH = 10, 23, 5, 274


def trial_windows(stimuli: DataFrame, condition: str = "TC", session: str = "session", order: str = "trial_num") -> DataFrame:
    """session, trial_num, start_frame and end_frame (inclusive) from a log of white_light_on and
    shock_on in milliseconds, NaN or null where missing.

    Trials without light are skipped, and in TC those without shock; the first trial left tells
    when the video began. TC trials end before the shock, TP trials after a fixed length.
    """
    light, shock = (F.when(~F.isnan(c), F.col(c)) for c in ("white_light_on", "shock_on"))
    rows = stimuli.withColumns({"light": light, "shock": shock}).where("light is not null")
    if condition == "TC":
        rows = rows.where("shock is not null")
    first = F.first("light").over(W.partitionBy(session).orderBy(order))
    began = first - FIRST_LIGHT * 1000.0 / FPS
    frame = lambda c: ((F.col(c) - began) / 1000.0 * FPS).cast("int")
    start = frame("light") - LEAD
    end = frame("shock") - 1 if condition == "TC" else start + LENGTH - 1
    return rows.select(session, F.col(order).alias("trial_num"), start.alias("start_frame"), end.alias("end_frame"))


def fixed_windows(spark, trials: dict[int, tuple[int, int]], lead: int = LEAD) -> DataFrame:
    """trial_num, start_frame and end_frame of given trials, starts moved ahead by `lead`."""
    return spark.createDataFrame([(n, a - lead, b) for n, (a, b) in trials.items()], "trial_num int, start_frame int, end_frame int")


def outside(start, end, n_frames) -> Column:
    """Whether a window (inclusive) leaves a series of n_frames."""
    start, end, n_frames = (F.col(c) if isinstance(c, str) else c for c in (start, end, n_frames))
    return (start < 0) | (end >= n_frames)


def checked_windows(trials: DataFrame, frames: DataFrame, session: str = "session") -> DataFrame:
    """trials, with an error at a trial that begins before 0 or ends after the series; frames
    has n_frames by session."""
    bad = outside("start_frame", "end_frame", "n_frames")
    message = F.concat(F.lit("trial outside the series: "), F.col("trial_num").cast("string"))
    out = trials.join(frames.select(session, "n_frames"), session)
    return out.withColumn("start_frame", F.when(bad, F.raise_error(message)).otherwise(F.col("start_frame"))).drop("n_frames")


def gaps(trials: DataFrame, lengths: DataFrame, session: str = "session") -> DataFrame:
    """The intervals after each trial up to the next one or the end of the series (inclusive):
    session, after_trial, start_frame, end_frame; empty ones are left out. lengths has n_frames
    by session."""
    following = F.lead("start_frame").over(W.partitionBy(session).orderBy("start_frame"))
    rows = trials.withColumn("next", following).join(lengths.select(session, "n_frames"), session)
    end = F.coalesce(F.col("next"), F.col("n_frames")) - 1
    out = rows.select(session, F.col("trial_num").alias("after_trial"), (F.col("end_frame") + 1).alias("start_frame"), end.alias("end_frame"))
    return out.where("end_frame >= start_frame")


def labelled(frames: DataFrame, trials: DataFrame, session: str = "session", frame: str = "frame", before_is_off: bool = False) -> DataFrame:
    """frames with cs_on: true in a trial, false after one, null before the first trial (or
    false, with before_is_off).

    The trials of a session are few and go along as one array, so the range join is an equality
    join on the session and the frames stay in their partitioning.
    """
    listed = trials.groupBy(session).agg(F.collect_list(F.struct("start_frame", "end_frame")).alias("__trials"))
    on = F.exists("__trials", lambda t: F.col(frame).between(t["start_frame"], t["end_frame"]))
    started = F.exists("__trials", lambda t: F.col(frame) >= t["start_frame"])
    off = F.lit(False) if before_is_off else F.when(started, False)
    return frames.join(listed, session, "left").withColumn("cs_on", F.when(F.col("__trials").isNotNull(), F.when(on, True).otherwise(off))).drop("__trials")


def overwritten(base: DataFrame, segments: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """base with the value of the last listed segment row of equal keys, where there is one."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    last = segments.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, F.col(value).alias("__value"))
    return base.join(last, keys, "left").withColumn(value, F.coalesce("__value", value)).drop("__value")


def nulled(frames: DataFrame, splits: DataFrame, columns: list[str], session: str = "session", frame: str = "frame") -> DataFrame:
    """frames with nulls in the columns inside the splits' start to end (inclusive)."""
    listed = splits.groupBy(session).agg(F.collect_list(F.struct("start", "end")).alias("__cut"))
    inside = F.coalesce(F.exists("__cut", lambda t: F.col(frame).between(t["start"], t["end"])), F.lit(False))
    return frames.join(listed, session, "left").withColumns({c: F.when(~inside, F.col(c)) for c in columns}).drop("__cut")


def split_intervals(lists: Column, last: int = 1799, defaults: bool = True) -> Column:
    """Intervals (inclusive) of a split line's lists: starts and ends; one list alone gives
    starts whose intervals end before the next; none gives the whole series. Without defaults
    only both lists give intervals, else there are none."""
    starts, ends = F.get(lists, F.lit(0)), F.get(lists, F.lit(1))
    pairs = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    alone = F.transform(starts, lambda s, i: F.struct(s.alias("start"), (F.coalesce(F.get(starts, i + 1), F.lit(last + 1)) - 1).alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(last).alias("end")))
    if not defaults:
        return F.coalesce(pairs, F.array().cast("array<struct<start:int,end:int>>"))
    return F.when(F.coalesce(F.size(starts), F.lit(0)) < 1, whole).when(ends.isNull(), alone).otherwise(pairs)


def last_start(rows: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, out: str) -> DataFrame:
    """rows with the last of the starts of equal keys that is not after `at`; null if none is. Starts
    and rows of the keys go by in one sorted pass, so no pairs are made."""
    known = starts.select(*keys, F.col(start).alias("__at"), F.col(start).alias("__start"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__row"))
    asked = rows.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(dict(starts.dtypes)[start]).alias("__start"), F.lit(1).alias("__kind"), F.struct(*rows.columns).alias("__row"))
    w = W.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0)
    met = known.unionByName(asked).withColumn("__last", F.last("__start", ignorenulls=True).over(w)).where("__kind = 1")
    return met.select("__row.*", F.col("__last").alias(out))


def required(rows: DataFrame, splits: DataFrame, key: str = "video") -> DataFrame:
    """rows with the splits' intervals of equal key; a row without any is an error."""
    found = rows.join(splits.select(key, "intervals"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no split for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn("intervals", F.coalesce("intervals", missing.cast(dict(splits.dtypes)["intervals"])))


def base_interval(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the intervals that start at 0 the one with the largest end, by keys."""
    return df.where("start = 0").groupBy(*keys).agg(F.max_by(F.struct("start", "end"), "end").alias("base")).select(*keys, "base.*")
