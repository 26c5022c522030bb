"""MOT text: reading with repair, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rows import dense_by_first_seen, keep_one

COLUMNS = ["frame", "id", "x", "y", "w", "h", "conf", "cls", "vis"]


def parse_mot(lines: DataFrame) -> DataFrame:
    """lines: file, row_no, value. Tabs count as commas and empty tokens go; fewer than six tokens are an error;
    missing tails are 1; a file whose first frame is 0 is shifted by 1; ids that aren't numbers become dense numbers
    by first appearance; of rows with one (frame, id) the most confident stays, the first of equals."""
    tokens = F.filter(F.transform(F.split(F.translate("value", "\t", ","), ","), lambda s: F.trim(s)), lambda s: s != "")
    df = lines.select("file", "row_no", tokens.alias("t")).where(F.size("t") > 0)
    t = F.when(F.size("t") < 6, F.raise_error(F.concat(F.lit("fewer than six values in row "), F.col("row_no").cast("string")))).otherwise(F.col("t"))
    at = lambda i: F.get(F.col("t"), F.lit(i))
    df = df.withColumn("t", t).select("file", "row_no", F.rint(at(0).cast("double")).cast("long").alias("frame"), at(1).alias("text"), *[F.coalesce(at(i).cast("double"), F.lit(1.0)).alias(c) for i, c in enumerate(COLUMNS) if i >= 2])
    df = df.withColumn("frame", F.col("frame") + F.when(F.min("frame").over(Window.partitionBy("file")) == 0, 1).otherwise(0))
    odd = df.withColumn("number", F.rint(F.col("text").try_cast("double")).cast("long")).withColumn("plain", F.min(F.col("number").isNotNull()).over(Window.partitionBy("file")))
    dense = dense_by_first_seen(odd, "text", "row_no", ["file"], "dense")
    df = dense.withColumn("id", F.when(F.col("plain"), F.col("number")).otherwise(F.col("dense")))
    return keep_one(df, ["file", "frame", "id"], [F.desc("conf"), F.asc("row_no")]).select("file", *COLUMNS)


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOT files below path; the line number is the row's place in its file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("row_no", "value"))
    return parse_mot(raw)


def mot_lines(rows: DataFrame, truth: bool = False, keys: list[str] | tuple = ()) -> DataFrame:
    """(*keys, value) lines of track rows with integer or double boxes; truth rows end in 1,1,1, others in confidence and -1s."""
    tail = [F.lit("1"), F.lit("1"), F.lit("1")] if truth else [F.col("confidence").cast("string"), F.lit("-1"), F.lit("-1"), F.lit("-1")]
    box = [F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    return rows.select(*keys, F.concat_ws(",", *[c.cast("string") for c in (F.col("frame"), F.col("track_id"), *box)], *tail).alias("value"))


def write_mot(rows: DataFrame, path: str, truth: bool = False) -> None:
    ordered = rows.orderBy("frame", "track_id")
    mot_lines(ordered, truth).write.mode("overwrite").text(path)
