"""From pair decisions to persistent profiles: constrained merging, suppression, numbering."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FROZEN, ProfileConfig
from .runs import by_group

SCHEMA = "video_id long, labels map<long,long>, merges array<struct<l:long,r:long,reason:string>>"


class Partition:
    """Tracks in clusters, with the clusters that each may not join: the smaller set of vetoes moves to the larger."""

    def __init__(self, blocked: Iterable[tuple[int, int]]):
        self.root: dict[int, int] = {}
        self.least: dict[int, int] = {}
        self.vetoes: dict[int, set[int]] = {}
        for a, b in blocked:
            self.vetoes.setdefault(a, set()).add(b)
            self.vetoes.setdefault(b, set()).add(a)

    def find(self, x: int) -> int:
        top = x
        while self.root.get(top, top) != top:
            top = self.root[top]
        while self.root.get(x, x) != top:
            self.root[x], x = top, self.root[x]
        return top

    def apart(self, a: int, b: int) -> bool:
        return b in self.vetoes.get(a, ())

    def join(self, a: int, b: int) -> None:
        least = min(self.label(a), self.label(b))
        if len(self.vetoes.get(a, ())) < len(self.vetoes.get(b, ())):
            a, b = b, a
        moved, kept = self.vetoes.pop(b, set()), self.vetoes.setdefault(a, set())
        for other in moved - {a}:
            self.vetoes[other].discard(b)
            self.vetoes[other].add(a)
            kept.add(other)
        kept.discard(b)
        self.root[b], self.least[a] = a, least

    def label(self, x: int) -> int:
        top = self.find(x)
        return self.least.get(top, top)


def merged(decisions: DataFrame, tracks: DataFrame, isolate: bool = False) -> DataFrame:
    """(video_id, labels, merges): labels maps each track to its cluster's smallest track; merges lists the accepted
    candidates in order.

    Candidates are taken in descending order of all their sort values (nulls last). One is skipped if its ends are
    together already, or if it isn't part-based and any two tracks across the clusters block each other. A group is a
    video's candidates and blocked pairs, never its detections; a candidate costs a look-up, and a veto moves a
    logarithmic number of times. Every rule depends on the partition alone, so any root does.
    A pair of a track with itself is an error of its video. isolate: a video that fails gives a row with its error."""
    order = ["priority", "primary_score", "secondary_score", "negative_gap", "nearest_time_gap_sec", "pair_decision", "l", "r"]
    wanted = decisions.where("priority is not null or blocks").withColumn("negative_gap", -F.col("nearest_frame_gap")).select(F.col("video_id").alias("video"), *order, "blocks")
    ids = tracks.select("video_id", "track_id").distinct()

    def run(ids: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        if any(r["l"] == r["r"] for r in rows):
            raise ValueError("a pair of a track with itself")
        state, log = Partition((r["l"], r["r"]) for r in rows if r["blocks"]), []
        rank = lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in order]
        for c in sorted((r for r in rows if r["priority"] is not None), key=rank, reverse=True):
            a, b = state.find(c["l"]), state.find(c["r"])
            if a != b and (c["pair_decision"] == "candidate_part_based_duplicate" or not state.apart(a, b)):
                state.join(a, b)
                log.append({"l": c["l"], "r": c["r"], "reason": c["pair_decision"]})
        labels = [(t, state.label(t)) for t in sorted(ids["track_id"].to_pylist())]
        entry = pa.struct([("l", pa.int64()), ("r", pa.int64()), ("reason", pa.string())])
        return pa.table({"video_id": ids["video_id"][:1], "labels": pa.array([labels], pa.map_(pa.int64(), pa.int64())), "merges": pa.array([log], pa.list_(entry))})

    return by_group(ids, ["video_id"], run, SCHEMA, isolate, (wanted, ["video"]))


def clusters(merged: DataFrame) -> DataFrame:
    return merged.select("video_id", F.explode("labels").alias("track_id", "cluster"))


def merge_log(merged: DataFrame) -> DataFrame:
    return merged.select("video_id", F.posexplode("merges").alias("seq", "m")).select("video_id", F.col("seq").cast("long").alias("merge_seq"), F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.reason").alias("merge_reason"))


def suppressed(clusters: DataFrame, quality: DataFrame, config: ProfileConfig = FROZEN) -> DataFrame:
    """Clusters with their fate: suppress_reason is null for those that stay."""
    df = clusters.join(quality.select("video_id", "track_id", "sparse_suspect", "likely_image_or_screen"), ["video_id", "track_id"])
    c = df.groupBy("video_id", "cluster").agg(F.bool_and("sparse_suspect").alias("all_sparse"), F.bool_and("likely_image_or_screen").alias("all_images"), F.count("*").alias("tracks"))
    return c.withColumn("suppress_reason", F.when(F.col("all_sparse"), "standalone_sparse_track").when(F.lit(config.suppress_likely_images) & F.col("all_images"), "likely_intro_outro_image"))


def numbered(clusters: DataFrame, fates: DataFrame, infos: DataFrame) -> DataFrame:
    """(video_id, track_id, cluster, persistent_profile_id): dog_1, dog_2, ... by first time, then smallest track."""
    kept = clusters.join(fates.where("suppress_reason is null").select("video_id", "cluster"), ["video_id", "cluster"], "left_semi")
    first = kept.join(infos, ["video_id", "track_id"]).groupBy("video_id", "cluster").agg(F.min("first_time_sec").alias("t"), F.min("track_id").alias("least"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "least"))
    return kept.join(first.select("video_id", "cluster", F.concat(F.lit("dog_"), n.cast("string")).alias("persistent_profile_id")), ["video_id", "cluster"])


def rollup(profiles: DataFrame, infos: DataFrame, classes: DataFrame) -> DataFrame:
    """One row for each profile: its time, members, classes and whether it is uncertain."""
    df = profiles.join(infos, ["video_id", "track_id"]).join(classes.select("video_id", "track_id", "track_classification", "likely_image_or_screen"), ["video_id", "track_id"])
    return df.groupBy("video_id", "persistent_profile_id").agg(
        F.min("first_time_sec").alias("first_seen_time"), F.max("last_time_sec").alias("last_seen_time"), F.array_sort(F.collect_set("track_id")).alias("track_ids"), F.count("*").alias("track_fragments"), F.array_sort(F.collect_set("track_classification")).alias("classifications"), F.bool_or("likely_image_or_screen").alias("uncertain")
    )
