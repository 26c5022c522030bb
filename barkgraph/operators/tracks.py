"""Track tables: summaries, quality, pair metrics and decisions.

A track table has video_id, track_id, frame, time_sec, x1..y2 and confidence, one row for each
(video_id, track_id, frame)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FROZEN, ProfileConfig
from ..functions import geometry as G
from ..functions import vectors as V
from ..session import written

KEY = ["video_id", "track_id"]


def info(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*KEY).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("time_sec").alias("first_time_sec"), F.max("time_sec").alias("last_time_sec"), F.count("*").alias("track_rows"), F.avg(F.nanvl("confidence", F.lit(None))).alias("mean_confidence")
    )


def quality(tracks: DataFrame, config: ProfileConfig = FROZEN) -> DataFrame:
    """Path length of the centres, median diagonal, span, density, duration, motion and the two suspicions."""
    b, w = G.box(), Window.partitionBy(*KEY).orderBy("frame")
    cx, cy = G.center_x(b), G.center_y(b)
    steps = tracks.select(*KEY, "frame", "time_sec", G.diagonal(G.Box(b.x1, b.y1, F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))).alias("diag"), F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)).alias("step"))
    q = steps.groupBy(*KEY).agg(
        (F.max("time_sec") - F.min("time_sec")).alias("duration_sec"), F.greatest(F.lit(1), F.max("frame") - F.min("frame") + 1).alias("frame_span"), F.count("*").alias("rows"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_center_movement"), F.median("diag").alias("median_box_diagonal")
    )
    q = q.withColumn("observation_density", F.col("rows") / F.col("frame_span")).withColumn("normalized_motion", F.col("total_center_movement") / F.greatest(F.col("median_box_diagonal"), F.lit(G.EPS)))
    static = (F.col("duration_sec") >= config.static_min_duration_sec) & (F.col("normalized_motion") <= config.static_max_motion)
    sparse = (F.col("observation_density") <= config.sparse_max_density) & (F.col("rows") <= config.sparse_max_rows)
    return q.withColumn("static_suspect", static).withColumn("sparse_suspect", sparse)


def classified(quality: DataFrame, infos: DataFrame, motion: DataFrame, videos: DataFrame, config: ProfileConfig = FROZEN) -> DataFrame:
    """Adds boundary flags and the five-way class. motion: median_internal_motion by track; videos: duration_sec by
    video as video_duration_sec."""
    df = quality.join(infos.select(*KEY, "first_time_sec", "last_time_sec"), KEY).join(motion, KEY, "left").join(videos.select("video_id", "video_duration_sec"), "video_id", "left")
    window, length = F.lit(config.boundary_window_sec), F.coalesce("video_duration_sec", F.lit(0.0))
    df = df.withColumn("intro_only", F.col("last_time_sec") <= window).withColumn("outro_only", (length > 0) & (F.col("first_time_sec") >= F.greatest(F.lit(0.0), length - window)))
    df = df.withColumn("boundary_only", F.col("intro_only") | F.col("outro_only")).withColumn("nearly_pixel_static", F.coalesce(F.col("median_internal_motion") <= config.internal_motion, F.lit(False)))
    static, still = F.col("static_suspect"), F.col("nearly_pixel_static")
    df = df.withColumn("likely_image_or_screen", F.col("boundary_only") & static & still)
    label = F.when(F.col("likely_image_or_screen"), "likely_intro_outro_image").when(static & ~still, "static_real_candidate").when(static, "static_uncertain").when(F.col("sparse_suspect"), "sparse_candidate").otherwise("active_real_candidate")
    return df.withColumn("track_classification", label).drop("first_time_sec", "last_time_sec", "video_duration_sec")


def internal_motion(differences: DataFrame) -> DataFrame:
    """Mean, median and maximum of consecutive crop differences by track."""
    return differences.groupBy(*KEY).agg(F.count("difference").alias("internal_motion_pairs"), F.avg("difference").alias("mean_internal_motion"), F.median("difference").alias("median_internal_motion"), F.max("difference").alias("max_internal_motion"))


def pairs(tracks: DataFrame) -> DataFrame:
    """Unordered pairs of a video's tracks, smaller id left."""
    t = tracks.select(*KEY).distinct()
    return t.select("video_id", F.col("track_id").alias("l")).join(t.select("video_id", F.col("track_id").alias("r")), "video_id").where("l < r")


def cooccurring(tracks: DataFrame) -> DataFrame:
    """Boxes of two tracks in one frame. The key is (video, frame): only visible pairs meet."""
    l, r = (tracks.select("video_id", "frame", F.col("track_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")]) for s in ("l", "r"))
    return l.join(r, ["video_id", "frame"]).where("l < r")


def common_metrics(tracks: DataFrame) -> DataFrame:
    a, b = G.box("l_"), G.box("r_")
    each = cooccurring(tracks).select("video_id", "l", "r", G.iou(a, b).alias("iou"), G.normalized_edge_gap(a, b).alias("gap"), G.normalized_center_distance(a, b).alias("dist"), G.intersection_over_smaller(a, b).alias("ios"), G.area_ratio(a, b).alias("ratio"))
    return each.groupBy("video_id", "l", "r").agg(
        F.count("*").alias("common_observed_frames"), F.median("iou").alias("median_bbox_iou"), F.avg("iou").alias("mean_bbox_iou"), F.median("gap").alias("median_normalized_edge_gap"), F.median("dist").alias("median_normalized_center_distance"), F.median("ios").alias("median_intersection_over_smaller"), F.median("ratio").alias("median_area_ratio")
    )


def frame_gaps(tracks: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """Smallest distance between observed frames for each pair of a video's tracks. First and last frames decide for
    tracks that follow each other, and a common frame for those that meet; only pairs whose spans cross without a common
    frame bring their frames, in one sorted pass over both. common: the pairs that have one, if they are known."""
    pair = ["video_id", "l", "r"]
    spans = tracks.groupBy(*KEY).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    l, r = (spans.select("video_id", F.col("track_id").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s in ("l", "r"))
    apart = F.greatest(F.col("llo") - F.col("rhi"), F.col("rlo") - F.col("lhi"))
    both = l.join(r, "video_id").where("l < r").withColumn("apart", apart)
    follow = both.where("apart > 0").select(*pair, F.col("apart").alias("nearest_frame_gap"))
    met = (cooccurring(tracks).select(*pair).distinct() if common is None else common.select(*pair)).withColumn("met", F.lit(True))
    crossing = both.where("apart <= 0").select(*pair).join(met, pair, "left")
    obs = tracks.select("video_id", "track_id", "frame")
    rest = crossing.where("met is null").select(*pair)
    rows = rest.join(obs.withColumnRenamed("track_id", "l"), ["video_id", "l"]).select(*pair, "frame", F.lit(0).alias("side"))
    rows = rows.unionByName(rest.join(obs.withColumnRenamed("track_id", "r"), ["video_id", "r"]).select(*pair, "frame", F.lit(1).alias("side")))
    w = Window.partitionBy(*pair).orderBy("frame", "side")
    step = F.when(F.lag("side").over(w) != F.col("side"), F.col("frame") - F.lag("frame").over(w))
    between = rows.select(*pair, step.alias("gap")).groupBy(*pair).agg(F.min("gap").alias("nearest_frame_gap"))
    together = crossing.where("met").select(*pair, F.lit(0).cast("long").alias("nearest_frame_gap"))
    return follow.unionByName(together).unionByName(between)


def appearance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine similarity of the tracks' vectors (column v); null without one."""
    l, r = (vectors.select("video_id", F.col("track_id").alias(s), F.col("v").alias(f"{s}v")) for s in ("l", "r"))
    return pairs.join(l, ["video_id", "l"], "left").join(r, ["video_id", "r"], "left").select("video_id", "l", "r", F.round(V.cosine(F.col("lv"), F.col("rv")), 9).alias("appearance_similarity"))


def pair_metrics(tracks: DataFrame, vectors: DataFrame, videos: DataFrame) -> DataFrame:
    """The pair diagnostics that decisions need. Boxes of a frame meet once: what comes of it is a row for each pair, which is
    written and then tells which pairs met."""
    common = written(common_metrics(tracks))
    p, size = pairs(tracks), tracks.groupBy(*KEY).count()
    l, r = (size.select("video_id", F.col("track_id").alias(s), F.col("count").alias(f"{s}n")) for s in ("l", "r"))
    df = p.join(common, ["video_id", "l", "r"], "left").join(frame_gaps(tracks, common), ["video_id", "l", "r"]).join(appearance(p, vectors), ["video_id", "l", "r"], "left")
    df = df.join(l, ["video_id", "l"]).join(r, ["video_id", "r"]).join(videos.select("video_id", "fps"), "video_id", "left")
    df = df.withColumn("common_observed_frames", F.coalesce("common_observed_frames", F.lit(0)))
    df = df.withColumn("overlap_fraction_of_shorter_track", F.col("common_observed_frames") / F.greatest(F.lit(1), F.least("ln", "rn")))
    return df.withColumn("nearest_time_gap_sec", F.col("nearest_frame_gap") / F.coalesce("fps", F.lit(30.0))).drop("ln", "rn", "fps")


def decided(metrics: DataFrame, config: ProfileConfig = FROZEN) -> DataFrame:
    """Adds pair_decision and the candidates' sort values: priority, primary, secondary."""
    n, iou, sim = F.col("common_observed_frames"), F.round("median_bbox_iou", 9), F.col("appearance_similarity")
    no = F.lit(False)
    different = F.coalesce((n >= config.substantial_frames) & (iou < config.different_dog_iou), no)
    duplicate = F.coalesce((n >= config.min_common_frames) & (iou >= config.duplicate_iou) & (sim >= config.duplicate_appearance), no)
    close = (iou >= config.part_min_iou) | (F.round("median_intersection_over_smaller", 9) >= config.part_min_ios)
    part = F.coalesce((n >= config.min_common_frames) & (sim >= config.part_appearance) & (F.round("median_normalized_center_distance", 9) <= config.part_max_center_distance) & close, no)
    again = ~different & F.coalesce((n < config.substantial_frames) & (F.col("nearest_time_gap_sec") <= config.max_reid_gap_sec) & (sim >= config.visual_similarity), no)
    decision = F.when(duplicate, "candidate_duplicate_overlap").when(part, "candidate_part_based_duplicate").when(again, "candidate_fragment_reid").when(different, "blocked_simultaneous_different_dogs").otherwise("below_merge_threshold")
    d = F.col("pair_decision")
    return (
        metrics.withColumn("pair_decision", decision)
        .withColumn("blocks", different)
        .withColumn("priority", F.when(d == "candidate_part_based_duplicate", 3).when(d == "candidate_duplicate_overlap", 2).when(d == "candidate_fragment_reid", 1))
        .withColumn("primary_score", F.when(F.col("priority") == 2, iou).when(F.col("priority").isNotNull(), sim))
        .withColumn("secondary_score", F.when(F.col("priority") == 2, sim).when(F.col("priority") == 3, F.coalesce(-F.round("median_normalized_edge_gap", 9), F.lit(-999.0))).when(F.col("priority") == 1, F.coalesce(iou, F.lit(-1.0))))
    )


def centroids(vectors: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """Unit-length mean of the vectors of each key, element by element."""
    each = vectors.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    mean = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return mean.withColumn("v", V.normalized(F.col("v")))


def representative_frames(tracks: DataFrame, merges: DataFrame) -> DataFrame:
    """For each merge (video_id, l, r) the frames to look at: the middle common frame, else the closest two frames."""
    common = cooccurring(tracks).join(merges.select("video_id", "l", "r"), ["video_id", "l", "r"]).groupBy("video_id", "l", "r").agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    middle = common.select("video_id", "l", "r", F.element_at("frames", (F.size("frames") / 2).cast("int") + 1).alias("left_frame")).withColumn("right_frame", F.col("left_frame"))
    rest = merges.select("video_id", "l", "r").join(common, ["video_id", "l", "r"], "left_anti")
    obs = tracks.select("video_id", "track_id", "frame")
    rows = rest.join(obs.withColumnRenamed("track_id", "l"), ["video_id", "l"]).select("video_id", "l", "r", "frame", F.lit(0).alias("side")).unionByName(rest.join(obs.withColumnRenamed("track_id", "r"), ["video_id", "r"]).select("video_id", "l", "r", "frame", F.lit(1).alias("side")))
    w = Window.partitionBy("video_id", "l", "r").orderBy("frame", "side")
    near = rows.select("*", F.lag("frame").over(w).alias("pf"), F.lag("side").over(w).alias("ps")).where("side <> ps")
    left, right = F.when(F.col("side") == 0, F.col("frame")).otherwise(F.col("pf")), F.when(F.col("side") == 1, F.col("frame")).otherwise(F.col("pf"))
    closest = near.groupBy("video_id", "l", "r").agg(F.min(F.struct(F.abs(F.col("frame") - F.col("pf")).alias("d"), left.alias("a"), right.alias("b"))).alias("m"))
    return middle.unionByName(closest.select("video_id", "l", "r", F.col("m.a").alias("left_frame"), F.col("m.b").alias("right_frame")))


def flag(c: str) -> Column:
    return F.col(c).cast("boolean")
