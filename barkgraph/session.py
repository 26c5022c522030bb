"""Session defaults for local runs and tests; on a cluster the caller's session is used as it is."""

import atexit
import functools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context: their Python needs it to run the
    functions that the Arrow and pandas operators hand to it."""
    context = spark.sparkContext
    if getattr(context, "_barkgraph_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="barkgraph-")) / "barkgraph.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, source.relative_to(here.parent))
    context.addPyFile(str(target))
    context._barkgraph_shipped = True


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor shares. Only a local session may do without that
    setting: its executor is the driver, so a temporary folder takes its place."""
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


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared scratch folder and read back: what reads it several times makes it once, and
    doesn't depend on the executors that made it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
