"""Bark events: normalisation, candidates, sliding windows, scores and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal as T
from .joins import TIME_TOLERANCE, by_length, expanded_frames, points_in_intervals
from .rows import keep_one, ranked, suffixed_ids

WINDOW = 2.0


def normalized_events(raw: DataFrame, duration: Column, slack: float = 0.25) -> DataFrame:
    """Ids from event_id, the audio file's stem, or bark_%03d; repeated ids are suffixed; rows with bad times go;
    ends within slack after the audio's end are cut to it. raw: row_no, event_id, audio_file, start, end, video_id."""
    stem = F.regexp_extract(F.coalesce("audio_file", F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    given = F.nullif(F.trim(F.coalesce("event_id", F.lit(""))), F.lit(""))
    df = raw.withColumn("event_id", F.coalesce(given, F.nullif(F.trim(stem), F.lit("")), F.format_string("bark_%03d", "row_no")))
    df = df.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & ~F.isnan("start") & ~F.isnan("end") & (F.col("start") < duration) & (F.col("end") <= duration + slack))
    return suffixed_ids(df.withColumn("end", F.least(F.col("end"), duration)), "event_id", [F.col("row_no")])


def catalog_timestamps(catalog: DataFrame) -> DataFrame:
    """Distinct valid intervals in order, with file names bark_000.wav and on. catalog: video_id, start, end."""
    valid = catalog.where("start >= 0 and end > start").select("video_id", "start", "end").distinct()
    return ranked(valid, ["video_id"], [F.col("start"), F.col("end")], "n").select("video_id", "start", "end", F.format_string("bark_%03d.wav", F.col("n") - 1).alias("audio_file"))


def candidates(tracks: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, track_id) of the tracks that are seen during an event."""
    return points_in_intervals(tracks.select("video_id", "track_id", "time_sec"), events.select("video_id", "event_id", "start", "end"), ["video_id"], "time_sec", "start", "end").select("video_id", "event_id", "track_id").distinct()


def offscreen(events: DataFrame, candidates: DataFrame) -> DataFrame:
    return events.join(candidates, ["video_id", "event_id"], "left_anti")


def windows(events: DataFrame, stride: float = 1.0) -> DataFrame:
    """One row for each sliding window of each event."""
    out = events.select("video_id", "event_id", "start", "end", F.posexplode(T.window_starts(F.col("start"), F.col("end"), WINDOW, stride)).alias("window_index", "window_start"))
    return out.withColumn("window_index", F.col("window_index").cast("long")).withColumn("window_end", F.least(F.col("end"), F.col("window_start") + WINDOW))


def seen_windows(windows: DataFrame, tracks: DataFrame) -> DataFrame:
    """(event_id, track_id, window_index) of the windows in which a track has a row. An event's rows lie together, so what is grouped
    or ordered by event afterwards isn't shuffled again."""
    out = ["video_id", "event_id", "track_id", "window_index", "window_start"]
    joined = by_length(tracks.select("video_id", "track_id", "time_sec"), windows, ["video_id"], "time_sec", "window_start", "window_end")
    once = joined.select(*out, "__class", "__bin").distinct().select(*out)
    return once.repartition("video_id", "event_id").distinct()


def source_frames(start: Column, end: Column, video_fps: Column, crop_fps: float, last_frame: Column) -> Column:
    """The frames of a window at crop_fps, clamped to the video; short windows repeat their last frame."""
    want = int(round(WINDOW * crop_fps))
    have = F.greatest(F.lit(1), F.least(F.lit(want), F.ceil(F.greatest(F.lit(0.0), end - start) * crop_fps).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.greatest(F.lit(0).cast("long"), F.least(last_frame, F.rint((start + F.least(i, have - 1) / crop_fps) * video_fps).cast("long"))))


def candidate_scores(scored: DataFrame) -> DataFrame:
    """Mean and maximum over windows, with the windows in order. scored: event_id, track_id, window_index,
    window_start, score."""
    each = F.array_sort(F.collect_list(F.struct("window_index", "window_start", "score")))
    return scored.groupBy("video_id", "event_id", "track_id").agg(F.round(F.avg("score"), 9).alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("window_count"), each.alias("w")).select(
        "video_id", "event_id", "track_id", "mean_score", "max_score", "window_count", F.transform("w", lambda s: s["score"]).alias("window_scores"), F.transform("w", lambda s: s["window_start"]).alias("window_starts_sec")
    )


def visibility(tracks: DataFrame, events: DataFrame, fps: Column) -> DataFrame:
    """Distinct frames in which each candidate is seen, of those that the event's length lets expect. A frame with several times counts
    at the first of them within the event, so frames are counted as they are met, without a shuffle of the pairs."""
    seen = tracks.select("video_id", "track_id", "frame", "time_sec").distinct()
    seen = seen.withColumn("__before", F.lag("time_sec").over(Window.partitionBy("video_id", "track_id", "frame").orderBy("time_sec")))
    joined = by_length(seen, events.select("video_id", "event_id", "start", "end").distinct(), ["video_id"], "time_sec", "start", "end")
    first = F.col("frame").isNotNull() & F.coalesce(F.col("__before") < F.col("start") - TIME_TOLERANCE, F.lit(True))
    expected = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) * fps)).cast("long")
    out = joined.groupBy("video_id", "__class", "__bin", "event_id", "track_id", "start", "end").agg(F.count_if(first).alias("visible_frames")).drop("__class", "__bin").withColumn("expected_frames", expected)
    return out.withColumn("visible_fraction", F.least(F.lit(1.0), F.col("visible_frames") / F.col("expected_frames"))).drop("start", "end")


def rankings(scores: DataFrame) -> DataFrame:
    return ranked(scores, ["video_id", "event_id"], [F.desc("mean_score"), F.asc("track_id")])


def predictions(events: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row for each event: winner, runner-up, margin, all candidates in order and their scores."""
    order = F.array_sort(F.collect_list(F.struct("rank", "track_id", F.round("mean_score", 8).alias("s"))))
    best = ranks.groupBy("video_id", "event_id").agg(
        F.count("*").alias("num_candidates"), F.max(F.when(F.col("rank") == 1, F.col("track_id"))).alias("predicted_track_id"), F.max(F.when(F.col("rank") == 1, F.col("mean_score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("mean_score"))).alias("second_score"), order.alias("o")
    )
    df = events.join(best, ["video_id", "event_id"], "left")
    df = df.withColumn("status", F.when(F.col("num_candidates").isNull(), "outside_or_offscreen").otherwise("predicted")).withColumn("num_candidates", F.coalesce("num_candidates", F.lit(0)).cast("long"))
    df = df.withColumn("margin", F.col("top_score") - F.col("second_score")).withColumn("all_candidate_ids", F.transform("o", lambda s: s["track_id"]))
    return df.withColumn("all_scores", F.map_from_entries(F.transform(F.sort_array(F.transform("o", lambda s: F.struct(s["track_id"].cast("string").alias("k"), s["s"].alias("v")))), lambda e: e))).drop("o")


def frame_events(predictions: DataFrame, fps: Column) -> DataFrame:
    """The event shown on each frame: of overlapping ones that with the higher score, then the earlier."""
    frames = expanded_frames(predictions, "start", "end", fps)
    return keep_one(frames, ["video_id", "frame"], [F.desc(F.coalesce("top_score", F.lit(-1.0))), F.col("start"), F.col("end"), F.col("event_id")]).select("video_id", "frame", "event_id", "predicted_track_id")


def tracking_fps(tracks: DataFrame) -> DataFrame:
    """1 / median positive step between distinct times, 10 where there is none."""
    from pyspark.sql import Window

    t = tracks.select("video_id", "time_sec").distinct()
    step = t.withColumn("d", F.col("time_sec") - F.lag("time_sec").over(Window.partitionBy("video_id").orderBy("time_sec")))
    return step.groupBy("video_id").agg(F.coalesce(1 / F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(10.0)).alias("tracking_fps"))


def inferred_fps(tracks: DataFrame) -> DataFrame:
    """Median of frame / time where it exceeds 1, 30 where there is none."""
    ratio = F.when(F.col("time_sec") > 0, F.col("frame") / F.when(F.col("time_sec") > 0, F.col("time_sec")))
    return tracks.groupBy("video_id").agg(F.coalesce(F.median(F.when(ratio > 1, ratio)), F.lit(30.0)).alias("fps"))
