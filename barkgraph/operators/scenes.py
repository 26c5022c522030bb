"""Static scenes near a video's ends, and the tracks that live in them.

samples: video_id, i (ordinal), time_sec, frame, gray (mean difference to the sample before, as measured)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import overlapping, points_in_intervals, within
from .rows import islands

STEP = 0.5


def boundary_samples(samples: DataFrame, videos: DataFrame, window: float = 20.0) -> DataFrame:
    """Samples of the first and last `window` seconds; a sample is intro if it lies in the first."""
    df = samples.join(videos.select("video_id", "video_duration_sec"), "video_id")
    near = (F.col("time_sec") <= window) | (F.col("time_sec") >= F.greatest(F.lit(0.0), F.col("video_duration_sec") - window))
    return df.where(near).withColumn("boundary_side", F.when(F.col("time_sec") <= window, "intro").otherwise("outro")).drop("video_duration_sec")


def guarded_difference(samples: DataFrame, value: str = "gray", step: float = STEP) -> DataFrame:
    """frame_difference: value, where the sample before is at most 1.5 steps away; else null."""
    w = Window.partitionBy("video_id").orderBy("time_sec")
    return samples.withColumn("frame_difference", F.when(F.col("time_sec") - F.lag("time_sec").over(w) <= 1.5 * step, F.col(value)))


def with_active_tracks(samples: DataFrame, tracks: DataFrame, tolerance: int = 3) -> DataFrame:
    """Distinct tracks seen within tolerance frames of each sample."""
    near = within(samples.select("video_id", F.col("frame").alias("at")), tracks.select("video_id", "frame", "track_id"), ["video_id"], "at", "frame", tolerance)
    n = near.groupBy("video_id", F.col("at").alias("frame")).agg(F.count_distinct("track_id").alias("active_track_count"))
    return samples.join(n, ["video_id", "frame"], "left").withColumn("active_track_count", F.coalesce("active_track_count", F.lit(0)))


def recent_cut(samples: DataFrame, threshold: float = 20.0, rows: int = 3) -> DataFrame:
    """Whether a cut happened at the sample or one of the `rows` before it."""
    w = Window.partitionBy("video_id", "boundary_side").orderBy("time_sec").rowsBetween(-rows, 0)
    cut = F.coalesce(F.col("frame_difference") >= threshold, F.lit(False))
    return samples.withColumn("recent_cut", F.max(cut).over(w))


def static_intervals(samples: DataFrame, threshold: float = 3.0, least: float = 3.0, step: float = STEP) -> DataFrame:
    """Runs of still samples that last at least `least` seconds, with their statistics."""
    still = islands(samples, ["video_id", "boundary_side"], "time_sec", F.col("frame_difference") <= threshold)
    runs = still.groupBy("video_id", "boundary_side", "island").agg(
        F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("samples"), F.median("frame_difference").alias("median_difference"), F.max("active_track_count").alias("max_active_tracks"), F.median("active_track_count").alias("median_active_tracks")
    )
    return runs.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec") + step).where(F.col("duration_sec") >= least).drop("island")


def static_share(tracks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of each track within any static interval, and their share."""
    rows = tracks.select("video_id", "track_id", "frame", "time_sec")
    inside = points_in_intervals(rows, intervals.select("video_id", "start_sec", "end_sec"), ["video_id"], "time_sec", "start_sec", "end_sec").select("video_id", "track_id", "frame").distinct()
    n = inside.groupBy("video_id", "track_id").agg(F.count("*").alias("static_rows"))
    all_ = rows.groupBy("video_id", "track_id").agg(F.count("*").alias("track_rows"))
    return all_.join(n, ["video_id", "track_id"], "left").withColumn("static_rows", F.coalesce("static_rows", F.lit(0))).withColumn("static_fraction", F.col("static_rows") / F.col("track_rows"))


def touching(tracks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Tracks whose span overlaps a static interval, with the sides."""
    span = tracks.groupBy("video_id", "track_id").agg(F.min("time_sec").alias("t0"), F.max("time_sec").alias("t1"))
    met = overlapping(span, intervals.select("video_id", "boundary_side", "start_sec", "end_sec", "median_difference"), ["video_id"], ("t0", "t1"), ("start_sec", "end_sec"), 10.0)
    return met.groupBy("video_id", "track_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("boundary_side"))).alias("matching_sides"), F.count("*").alias("matching_intervals"), F.median("median_difference").alias("median_scene_motion"))


def removals(tracks: DataFrame, intervals: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Each track's share, sides and whether it goes."""
    df = static_share(tracks, intervals).join(touching(tracks, intervals), ["video_id", "track_id"], "left")
    df = df.withColumn("matching_sides", F.coalesce("matching_sides", F.lit(""))).withColumn("matching_intervals", F.coalesce("matching_intervals", F.lit(0)))
    return df.withColumn("remove", F.col("static_fraction") >= least_share)


def without(tracks: DataFrame, removals: DataFrame) -> DataFrame:
    return tracks.join(removals.where("remove").select("video_id", "track_id"), ["video_id", "track_id"], "left_anti")
