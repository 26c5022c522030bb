"""Tolerant file sources, discovery, and sinks. Spark's readers find and open the files, so any store will do."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """CSV with a header, matched to the schema by name. tolerant: a missing or empty file is an empty table."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        if not tolerant:
            raise
        return spark.createDataFrame([], schema)
    have = {c.strip().lower(): c for c in raw.columns}
    columns = [F.nullif(F.trim(F.col(f"`{have[f.name.lower()]}`")), F.lit("")).try_cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return raw.select(*columns)


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays; other elements go; a file that isn't an array is an error."""
    text = spark.read.text(path, wholetext=True)
    start = lambda c: F.ltrim(c, F.lit(" \t\r\n"))
    whole = F.when(start("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.raise_error(F.lit("not a JSON list")))
    parts = text.select(F.explode(whole).alias("item")).where(start("item").startswith("{"))
    return parts.select(F.from_json("item", schema).alias("o")).select("o.*")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each document; missing files and malformed documents give none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return text.select(F.from_json("value", schema).alias("o")).where("o is not null").select("o.*")


def work_items(spark: SparkSession, path: str, pattern: str = r"([0-9]+)_[^/]*/[^/]*$") -> DataFrame:
    """(item, file) of the files whose folder carries a number, ordered by it."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return files.select(F.regexp_extract("file", pattern, 1).try_cast("long").alias("item"), "file").where("item is not null").orderBy("item", "file")


def first_existing(candidates: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Of the paths that exist, the one with the smallest priority for each key."""
    from ..operators.rows import keep_one

    return keep_one(candidates.where("exists"), keys, [F.col(priority), F.col("path")])


def lookup_video(catalog: DataFrame, identifier: str) -> DataFrame:
    """The first catalog row of the video whose id has the same digits."""
    from ..operators.rows import keep_one

    wanted = "".join(filter(str.isdigit, identifier)).lstrip("0") or "0"
    number = F.coalesce(F.nullif(F.ltrim(F.regexp_replace("video_id", "[^0-9]", ""), F.lit("0")), F.lit("")), F.lit("0"))
    return keep_one(catalog.where(number == wanted).withColumn("__one", F.lit(1)), ["__one"], [F.col("row_no")]).drop("__one")


class Folder:
    """A folder in whatever store its path names, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.path = self._new(path.rstrip("/"))
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def beside(self, ending: str) -> Folder:
        """A folder next to this one, whose name Spark's readers pass over."""
        out = object.__new__(Folder)
        out._new, out.fs, out.path = self._new, self.fs, self._new(self.path.getParent(), f".{self.path.getName()}{ending}")
        return out

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move(self, to: Folder) -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"{self} can't be moved to {to}")

    def __str__(self) -> str:
        return self.path.toString()


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What write makes in a folder of its own takes the place of path once it is whole. Whatever fails before, the old result
    stays; write may read path. If the swap itself is cut off between its two moves, the next call puts the old result back."""
    target = Folder(spark, path)
    target.fs.mkdirs(target.path.getParent())
    old, new = target.beside(".old"), target.beside(f".{uuid.uuid4().hex}.new")
    if old.exists():
        old.delete() if target.exists() else old.move(target)
    try:
        write(str(new))
        if target.exists():
            target.move(old)
        try:
            new.move(target)
        except BaseException:
            if old.exists() and not target.exists():
                old.move(target)
            raise
    finally:
        new.delete()
    old.delete()


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header; nulls are empty. A failed write leaves the old result as it was."""
    replace(df.sparkSession, path, lambda to: df.select(*(columns or df.columns)).write.option("header", True).csv(to))


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line, nulls included. A failed write leaves the old result as it was."""
    replace(df.sparkSession, path, lambda to: df.write.option("ignoreNullFields", False).json(to))


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Track rows as Parquet by video, in order of frame. Only the videos at hand are replaced, each whole."""
    tracks.sortWithinPartitions("video_id", "track_id", "frame").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def report(row: DataFrame, template: str, *columns: str) -> DataFrame:
    """One line of text for each row."""
    return row.select(F.format_string(template, *columns).alias("value"))


def video_meta(videos: DataFrame) -> DataFrame:
    """videos (fps, width, height, frames) with valid and duration_sec, which is null for invalid ones."""
    valid = F.coalesce((F.col("fps") > 0) & (F.col("width") > 0) & (F.col("height") > 0) & (F.col("frames") > 0), F.lit(False))
    return videos.withColumn("valid", valid).withColumn("duration_sec", F.when(valid, F.col("frames") / F.when(F.col("fps") > 0, F.col("fps"))))


def checked_meta(videos: DataFrame) -> DataFrame:
    """As video_meta; an invalid video is an error."""
    said = F.concat(F.lit("invalid video metadata of "), F.col("video_id").cast("string"))
    df = video_meta(videos)
    return df.withColumn("duration_sec", F.when(F.col("valid"), F.col("duration_sec")).otherwise(F.raise_error(said).cast("double"))).drop("valid")


def embedding_table(vectors: DataFrame, prefix: str = "track") -> DataFrame:
    """(video_id, name, vector) of vectors (video_id, track_id, v): one named array of floats for each track."""
    return vectors.select("video_id", F.format_string(f"{prefix}_%d", F.col("track_id")).alias("name"), F.col("v").cast("array<float>").alias("vector"))


def write_embeddings(vectors: DataFrame, path: str, prefix: str = "track") -> None:
    """The embedding table as compressed Parquet, one folder for each video. Only the videos at hand are replaced, when all
    is written."""
    embedding_table(vectors, prefix).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("video_id").parquet(path)
