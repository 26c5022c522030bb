"""Evaluation roll-ups: localisation, identity, counts, per-video and overall results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import number, safe_divide
from .rows import keep_one, numbered

LOCALIZED = 0.30


def fps_of(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Median of start_frame / start in (1, 240), else of the tracks' frame / time, else 30."""
    start = F.when(F.col("start") != 0, F.col("start"))
    ratio = F.col("start_frame") / start
    a = events.groupBy("video_id").agg(F.median(F.when((ratio > 1) & (ratio < 240), ratio)).alias("a"))
    seen = F.col("frame") / F.when(F.col("time_sec") > 0, F.col("time_sec"))
    b = tracks.groupBy("video_id").agg(F.median(F.when(seen > 1, seen)).alias("b"))
    return a.join(b, "video_id", "full").select("video_id", F.coalesce("a", "b", F.lit(30.0)).alias("fps"))


def clip_frame(at: Column, first: Column, last: Column, clip_first: Column, clip_last: Column) -> Column:
    """The clip's frame that stands where `at` stands in the event."""
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - first) / F.greatest(last - first, F.lit(1))))
    return F.rint(clip_first + alpha * (clip_last - clip_first)).cast("long")


def best_annotation(boxes: DataFrame, truth: DataFrame) -> DataFrame:
    """For each predicted box the annotation of its frame with the highest IoU; the first identity of equals.
    boxes: video_id, event_id, at, frame, x1..y2; truth: video_id, ident, frame, x1..y2."""
    g = truth.select("video_id", "frame", "ident", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = boxes.join(g, ["video_id", "frame"]).withColumn("iou", F.round(G.iou(G.box(), G.box("g_")), 9))
    return keep_one(pairs, ["event_id", "at"], [F.desc("iou"), F.asc("ident")]).select("video_id", "event_id", "at", "ident", "iou")


def localization(asked: DataFrame, best: DataFrame, threshold: float = LOCALIZED) -> DataFrame:
    df = asked.select("video_id", "event_id", "at").join(best.select("video_id", "event_id", "at", "iou"), ["video_id", "event_id", "at"], "left")
    out = df.groupBy("video_id", "event_id").agg(F.count("*").alias("sampled"), F.count("iou").alias("evaluable"), F.avg("iou").alias("mean_iou"), F.max("iou").alias("max_iou"))
    return out.withColumn("localized", F.coalesce(F.col("max_iou") >= threshold, F.lit(False)))


def in_every(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    all_ = df.agg(F.count_distinct(group).alias("__all"))
    return df.groupBy(item).agg(F.count_distinct(group).alias("__n")).join(F.broadcast(all_), F.col("__n") == F.col("__all")).select(item)  # __all is one row


def video_results(tracks: DataFrame, profiles: DataFrame, predictions: DataFrame) -> DataFrame:
    t = tracks.groupBy("video_id").agg(F.count_distinct("track_id").alias("tracks"))
    p = profiles.groupBy("video_id").agg(F.count_distinct("persistent_profile_id").alias("p"))
    e = predictions.groupBy("video_id").agg(F.count("*").alias("e"), F.count("predicted_track_id").alias("a"))
    status = F.when(F.col("p").isNull(), "missing_visual").when(F.col("e").isNull(), "no_bark_events").when(F.col("a") == 0, "unassigned").otherwise("complete")
    df = t.join(p, "video_id", "left").join(e, "video_id", "left").withColumn("evaluation_status", status)
    zero = {n: F.coalesce(c, F.lit(0)) for n, c in (("profiles", "p"), ("bark_events", "e"), ("assigned", "a"))}
    df = df.withColumns(zero).drop("p", "e", "a").withColumn("track_fragments_merged", F.col("tracks") - F.col("profiles"))
    return df.withColumn("reduction_rate", safe_divide(F.col("track_fragments_merged"), F.col("tracks"))).withColumn("assignment_rate", safe_divide(F.col("assigned"), F.col("bark_events")))


def aggregate_results(results: DataFrame) -> DataFrame:
    done = F.col("evaluation_status") == "complete"
    df = results.agg(
        F.count("*").alias("videos"), F.count_if(done).alias("complete"), F.sum("tracks").alias("tracks"), F.sum("profiles").alias("profiles"), F.sum("track_fragments_merged").alias("m"), F.avg("profiles").alias("mean_profiles"), F.sum(F.when(done, F.col("assigned"))).alias("a"), F.sum(F.when(done, F.col("bark_events"))).alias("e")
    )
    return df.withColumn("reduction_rate", safe_divide(F.col("m"), F.col("tracks"))).withColumn("assignment_rate", safe_divide(F.col("a"), F.col("e"))).drop("m", "a", "e")


def shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("__total"))
    return n.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")  # one row


def micro_macro(by_video: DataFrame) -> DataFrame:
    right, all_ = F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return by_video.agg(safe_divide(F.sum(right), F.sum(all_)).alias("micro_accuracy"), F.avg(F.nanvl("accuracy", F.lit(None))).alias("macro_accuracy"))


def count_errors(df: DataFrame) -> DataFrame:
    """Bias, absolute error, exact and over rates of guess against truth."""
    d = F.col("guess") - F.col("truth")
    return df.agg(F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.avg((d == 0).cast("double")).alias("exact_rate"), F.avg((d > 0).cast("double")).alias("over_rate"))


def annotation_summary(truth: DataFrame) -> DataFrame:
    df = truth.groupBy("video_id", "ident").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_distinct("frame").alias("frames"), F.avg(F.col("x2") - F.col("x1")).alias("mean_width"))
    return df.withColumn("density", F.col("frames") / (F.col("last_frame") - F.col("first_frame") + 1))


def annotation_statistics(truth: DataFrame) -> DataFrame:
    each = truth.groupBy("video_id", "ident").agg(F.count("*").alias("n"))
    tracks = each.groupBy("video_id").agg(F.count("*").alias("tracks"), F.avg("n").alias("mean_track_length"), F.max("n").alias("max_track_length"))
    df = truth.groupBy("video_id").agg(F.count("*").alias("boxes"), F.count_distinct("frame").alias("frames")).join(tracks, "video_id")
    return df.withColumn("boxes_per_frame", F.col("boxes") / F.col("frames"))


def nearest_valid(df: DataFrame, keys: list[str], index: str, valid: Column) -> DataFrame:
    """source: the row's own index if it is valid, else the nearest valid one (the lower of equals)."""
    w, i = Window.partitionBy(*keys).orderBy(index), F.when(valid, F.col(index))
    prev = F.last(i, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(i, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    here = F.col(index)
    pick = F.when(valid, here).when(prev.isNull(), following).when(following.isNull(), prev).when(here - prev <= following - here, prev).otherwise(following)
    return df.withColumn("source", pick)


# --- inputs of the evaluators ------------------------------------------------------------------------------------

#: Accepted names of the columns, the first that is there counts; the video of inputs that name none.
EVENT = ("event_id", "barkseq_id", "bark_id", "id")
START = ("start_time_sec", "start_time", "start_sec", "start")
END = ("end_time_sec", "end_time", "end_sec", "end")
TRACK = ("predicted_track_id", "track_id", "predicted_id")
STATUS = ("status", "prediction_status")
VIDEO = ("video_id", "video_identifier", "video")
DOG = ("dog_id", "annotated_dog_id", "identity", "barking_dog_id", "label")
PROFILE = ("all_dog_profile_id", "persistent_profile_id", "profile_id")
SINGLE = "__single_video__"


def pick(df: DataFrame, names: tuple[str, ...], required: bool = True) -> Column | None:
    """The first column of these names, whatever their case; a required one that is missing is an error."""
    have = {c.lower(): c for c in reversed(df.columns)}
    found = next((have[n] for n in names if n in have), None)
    if found is None and required:
        raise KeyError(f"none of {', '.join(names)} in {', '.join(df.columns)}")
    return None if found is None else F.col(f"`{found}`")


def _identified(df: DataFrame, names: tuple[str, ...], prefix: str, row_no: str) -> tuple[DataFrame, Column]:
    """df and its events' ids: as given, else prefix_000000 and on in the order of row_no."""
    own = pick(df, names, False)
    if own is not None:
        return df, own.cast("string")
    return numbered(df, row_no, "__row"), F.format_string(f"{prefix}_%06d", F.col("__row"))


def localized_predictions(raw: DataFrame, row_no: str, track: str = "predicted_track_id", start: str = "start_time_sec", end: str = "end_time_sec") -> DataFrame:
    """(event_id, pred_track_id, start, end) of predictions that name a track and both times; all others go."""
    df, event = _identified(raw, ("event_id",), "event", row_no)
    out = df.select(event.alias("event_id"), number(F.col(track)).cast("long").alias("pred_track_id"), number(F.col(start)).alias("start"), number(F.col(end)).alias("end"))
    return out.dropna(subset=["pred_track_id", "start", "end"])


def event_predictions(raw: DataFrame) -> DataFrame:
    """(event_id, start, end, predicted_track_id, status): all events stay, those off screen without a track; times that are
    no numbers are an error, a missing status is `predicted`."""
    track, status = pick(raw, TRACK, False), pick(raw, STATUS, False)
    return raw.select(
        pick(raw, EVENT).cast("string").alias("event_id"),
        pick(raw, START).cast("double").alias("start"),
        pick(raw, END).cast("double").alias("end"),
        (F.lit(None).cast("double") if track is None else number(track)).alias("predicted_track_id"),
        (F.lit("predicted") if status is None else status.cast("string")).alias("status"),
    )


def identity_events(raw: DataFrame, prefix: str, who: tuple[str, ...], row_no: str) -> DataFrame:
    """(video_id, event_id, start, end, who) of an identity evaluation's input; prefix is gt or pred. Rows without times or
    identity go; without a video column all belong to one unnamed video."""
    video = pick(raw, VIDEO, False)
    df, event = _identified(raw, ("event_id", "bark_id", "id"), prefix, row_no)
    out = df.select(
        (F.lit(SINGLE) if video is None else video.cast("string")).alias("video_id"),
        event.alias("event_id"),
        number(pick(raw, ("start_time_sec", "start_time", "start"))).alias("start"),
        number(pick(raw, ("end_time_sec", "end_time", "end"))).alias("end"),
        pick(raw, who).cast("string").alias("who"),
    )
    return out.dropna(subset=["start", "end", "who"])


def same_video(events: DataFrame, others: DataFrame) -> DataFrame:
    """events, whose unnamed video takes the name of the only one that the others name."""
    named = F.when(F.col("video_id") != SINGLE, F.col("video_id"))
    mine = events.agg(F.coalesce(F.bool_and(F.col("video_id") == SINGLE), F.lit(False)).alias("__unnamed"))
    name = others.agg(F.when(F.min(named) == F.max(named), F.min(named)).alias("__name"))
    one = mine.join(F.broadcast(name))  # one row each
    video = F.when(F.col("__unnamed"), F.coalesce("__name", "video_id")).otherwise(F.col("video_id"))
    return events.join(F.broadcast(one)).withColumn("video_id", video).drop("__unnamed", "__name")


# --- what a renderer draws ---------------------------------------------------------------------------------------

#: Widths of a box and of the winner's, and the frames for which that flashes.
NORMAL_WIDTH, WINNER_WIDTH, FLASH = 2, 6, 6


def draw_list(tracks: DataFrame, shown: DataFrame, scores: DataFrame, max_gap: int, frames: int, width: int, height: int, colors: int = 7) -> DataFrame:
    """(video_id, frame, track_id, x1..y2, winner, score, label, line, color): every box to draw on every frame.

    Between observations up to 2 max_gap apart boxes are interpolated; beyond that, and at the ends, the nearest one is held
    for max_gap frames. shown: the event of each frame with predicted_track_id; scores: mean_score by event and track."""
    box, key = ("x1", "y1", "x2", "y2"), ["video_id", "track_id"]
    w = Window.partitionBy(*key).orderBy("frame")
    t = tracks.select(*key, F.col("frame").alias("p"), *box, F.lag("frame").over(w).alias("before"), F.lead("frame").over(w).alias("n"), *[F.lead(c).over(w).alias(f"n{c}") for c in box])
    p, n = F.col("p"), F.col("n")
    none, near = F.array().cast("array<bigint>"), (n - p) <= 2 * max_gap
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    ahead = F.when(n.isNull(), run(p, F.least(p + max_gap, F.lit(frames - 1).cast("long")))).when(near, run(p, n - 1))
    ahead = ahead.otherwise(F.concat(run(p, p + max_gap), run(n - max_gap, n - 1)))
    first = F.when(F.col("before").isNull(), run(F.greatest(F.lit(0).cast("long"), p - max_gap), p - 1)).otherwise(none)
    t = t.select("*", F.explode(F.concat(first, ahead)).alias("frame"))
    frame = F.col("frame")
    share = (frame - p) / F.when(n > p, n - p)
    between, late = (frame > p) & near, (frame > p) & ~near & (frame >= n - max_gap)
    at = lambda c: F.when(between, F.col(c) * (1 - share) + F.col(f"n{c}") * share).when(late, F.col(f"n{c}")).otherwise(F.col(c))
    within = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.rint(c))).cast("long")
    boxes = [within(at(c), width if c[0] == "x" else height).alias(c) for c in box]
    df = t.select("video_id", "frame", "track_id", *boxes)
    df = df.join(shown.select("video_id", "frame", "event_id", "predicted_track_id"), ["video_id", "frame"], "left")
    df = df.join(scores.select("video_id", "event_id", "track_id", F.col("mean_score").alias("score")), ["video_id", "event_id", "track_id"], "left")
    winner = F.coalesce(F.col("predicted_track_id") == F.col("track_id"), F.lit(False))
    name = F.concat(F.when(winner, F.lit("BARKING | ")).otherwise(F.lit("")), F.lit("dog #"), F.col("track_id").cast("string"))
    label = F.concat(name, F.when(F.col("score").isNotNull(), F.format_string(" | %.3f", F.col("score"))).otherwise(F.lit("")))
    line = F.when(winner & (F.floor(frame / FLASH) % 2 == 0), WINNER_WIDTH).otherwise(NORMAL_WIDTH)
    return df.select("video_id", "frame", "track_id", *box, winner.alias("winner"), "score", label.alias("label"), line.alias("line"), F.pmod("track_id", F.lit(colors)).alias("color"))
