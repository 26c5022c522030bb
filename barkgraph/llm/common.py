"""Helpers that the corpus operators share: tables, shared scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows of a few numbers each up to which a table is sent to all tasks.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch between Spark and a Python worker, unless the session's own setting says otherwise.
BATCH_BYTES = "8m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor shares.

    Only a local session, whose executor is the driver, may do without that setting: a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/barkgraph-{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="barkgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def cut(df: DataFrame, **counts: Column) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: later stages neither
    recompute it nor depend on the executors that made it. Once it is written, Spark drops the shuffle files of its plan.
    `seen` holds the number of rows and the given aggregates, which are taken while it is written."""
    spark = df.sparkSession
    path, observed = scratch(spark), Observation()
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.observe(observed, F.count("*").alias("rows"), *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path, out.seen = path, observed.get
    return out


def sent(table: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """df, a selection of a table that cut() wrote, with a broadcast hint if that table has at most BROADCAST_ROWS rows;
    otherwise joins shuffle. A row of df holds a few numbers."""
    df = table if df is None else df
    return F.broadcast(df) if table.seen["rows"] <= BROADCAST_ROWS else df


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing will read again: disk then holds a step's data, not the sum of all
    steps'."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which has a few numbers a row, with a broadcast hint if it has at most so many rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker process gives the memory of its arrays back: Spark keeps it for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def map_batches(df: DataFrame, schema: T.StructType | str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list | None]]) -> DataFrame:
    """mapInArrow with per-task state: start() runs once in each task and returns the function
    applied to every batch; that function yields nothing, one batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield from out if isinstance(out, list) else [out]

    return arrow_map(df, run, schema)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, once the executors have this package. Functions take columns by place: names may hold dots,
    which mapInArrow itself doesn't resolve."""
    spark = df.sparkSession
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH_BYTES):  # texts and media are long: rows alone bound nothing
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    if any("." in c or "`" in c for c in df.columns):
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.mapInArrow(released(run), schema)
