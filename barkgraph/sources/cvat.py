"""CVAT annotation XML: one row for each box, with its track, label and vocal state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import state

SCHEMA = (
    "_id string, _label string, box array<struct<_frame:bigint,_outside:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,"
    "attribute:array<struct<_name:string,_VALUE:string>>>>"
)


def read_cvat(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of the files below path, as the XML source gives them."""
    return spark.read.format("xml").option("rowTag", "track").schema(SCHEMA).load(path)


def boxes(tracks: DataFrame, attribute: str = "Vocalization", offset: int | Column = 0, keys: Iterable[str] = ()) -> DataFrame:
    """All visible boxes with their state: the first attribute of that name, whatever its case. offset shifts a clip's
    frames to the whole video's. keys: columns of tracks that every box keeps."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    b = tracks.select(*keys, shift.alias("__shift"), F.col("_id").alias("ident"), F.col("_label").alias("label"), F.explode("box").alias("b"))
    named = F.filter("b.attribute", lambda a: F.lower(a["_name"]) == attribute.lower())
    value = F.get(named, F.lit(0))["_VALUE"]
    return b.where("coalesce(b._outside, 0) <> 1").select(*keys, "ident", "label", (F.col("b._frame") + F.col("__shift")).alias("frame"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"), value.alias("value"), state(F.coalesce(value, F.lit(""))).alias("state"))


def barking_boxes(tracks: DataFrame, value: str = "Barking") -> DataFrame:
    """Visible boxes whose state is exactly the given value; none at all is an error."""
    found = boxes(tracks).where(F.col("value") == value)
    if found.isEmpty():
        raise ValueError(f"no visible box with {value}")
    return found


def truth_rows(tracks: DataFrame, label: str = "dog") -> DataFrame:
    """MOT ground truth: visible boxes of the label, frames from 1."""
    b = boxes(tracks).where(F.lower("label") == label)
    return b.select((F.col("frame") + 1).alias("frame"), F.col("ident").cast("long").alias("track_id"), "x1", "y1", "x2", "y2")


def clip_of(events: DataFrame, clips: DataFrame) -> DataFrame:
    """The clip folder of each event by the last number in its id: two digits, as it is, three digits.
    clips: folder. Events without one are dropped."""
    from ..functions.text import last_number
    from ..operators.rows import keep_one

    n = last_number(F.col("event_id"))
    names = F.array(F.format_string("%02d", n), n.cast("string"), F.format_string("%03d", n))
    tried = events.withColumn("__n", n).where("__n is not null").select("*", F.posexplode(names).alias("__k", "folder")).join(clips.select("folder").distinct(), "folder")
    return keep_one(tried, ["event_id"], [F.col("__k")]).drop("__k", "__n")


def manifest_clips(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events with the clip that a manifest gives them; an event with two is an error, one with none is dropped."""
    n = manifest.groupBy("event_id").agg(F.count("*").alias("__n"), F.first("clip_start_frame").alias("clip_start_frame"))
    start = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two clips for "), F.col("event_id").cast("string")))).otherwise(F.col("clip_start_frame"))
    return events.join(n.withColumn("clip_start_frame", start).drop("__n"), "event_id")


#: Of a clip's file: the video, and the event that the clip's folder names.
CLIP = r"video_id=([0-9]+)/clip=([0-9]+)_[^/]*/[^/]*$"


def annotated_clips(spark: SparkSession, root: str, events: DataFrame, pattern: str = CLIP) -> DataFrame:
    """(video_id, event_id, file) of the annotation files of these events (video_id, event_id), from the names of all files below
    root, none of which is opened. Events without one are left out; one with files in two folders is an error."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("file"))
    part = lambda k: F.regexp_extract("file", pattern, k).try_cast("long")
    known = names.select(part(1).alias("video_id"), part(2).alias("event_id"), "file").where("event_id is not null")
    mine = known.join(events.select("video_id", "event_id").distinct(), ["video_id", "event_id"], "left_semi")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    found = mine.groupBy("video_id", "event_id").agg(F.count_distinct(folder).alias("n"), F.min("file").alias("file"))
    said = F.concat(F.lit("two clips for video "), F.col("video_id").cast("string"), F.lit(", event "), F.col("event_id").cast("string"))
    return found.select("video_id", "event_id", F.when(F.col("n") > 1, F.raise_error(said)).otherwise(F.col("file")).alias("file"))


def ground_truth(spark: SparkSession, root: str, events: DataFrame, pattern: str = CLIP) -> DataFrame:
    """The boxes of events (video_id, event_id, clip_start_frame), keyed by both, with frames of the whole video. Only the annotation files
    of these events are read: their names, which Spark's reader lists on the driver in any case, are picked before. Events that
    nobody annotated have no boxes."""
    clips = annotated_clips(spark, root, events, pattern)
    paths = [r.file for r in clips.select("file").distinct().toLocalIterator()]
    keys = ["video_id", "event_id"]
    if not paths:
        tracks = spark.createDataFrame([], f"video_id long, event_id long, clip_start_frame long, {SCHEMA}")
    else:
        read = spark.read.format("xml").option("rowTag", "track").schema(SCHEMA).load(paths).withColumn("file", F.col("_metadata.file_path"))
        path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        starts = clips.join(events.select(*keys, "clip_start_frame").distinct(), keys).withColumn("file", path("file"))
        tracks = read.withColumn("file", path("file")).join(starts, "file")
    return boxes(tracks, offset=F.col("clip_start_frame"), keys=keys)
