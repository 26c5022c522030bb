"""Runs over many items (videos): what is left to do, what can be used again, failures apart from results, and metadata.

Results are tables with one partition of rows for each item, so resuming is an anti-join on the items that a table
holds, never a look at single files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship, written
from ..sources.files import Folder, replace

FINGERPRINT = ("path", "size_bytes", "mtime_ns")


def remaining(items: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Items without a finished result; force: all of them."""
    return items if force else items.join(done.select(*keys).distinct(), keys, "left_anti")


def reusable(items: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """items with reusable: whether a complete run saw an input of the same path, size and time of change.
    items: keys and FINGERPRINT; runs: the same and status."""
    same = runs.where(F.col("status") == "complete").select(*keys, *FINGERPRINT).distinct().withColumn("__same", F.lit(True))
    return items.join(same, [*keys, *FINGERPRINT], "left").withColumn("reusable", F.coalesce("__same", F.lit(False))).drop("__same")


def missing_inputs(items: DataFrame, files: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(keys, error, details): items that lack a required file. files: keys and name."""
    wanted = items.select(*keys).distinct().withColumn("name", F.explode(F.array(*[F.lit(r) for r in required])))
    lacking = wanted.join(files.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")
    names = F.array_join(F.array_sort(F.collect_list("name")), ";")
    return lacking.groupBy(*keys).agg(F.lit("missing_required_files").alias("error"), names.alias("details"))


def by_group(df: DataFrame, keys: list[str], function: Callable[..., pa.Table | pd.DataFrame], schema: str, isolate: bool = False, beside: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """function for each group of rows with equal keys, as an Arrow table; beside: a second table with its keys, whose group is
    function's second argument. Every stage that goes through a video in order runs by this.

    isolate: the result has error and details besides. A group whose function raises gives one row with the keys, the error's name
    and what it says, and the others are not touched; otherwise an error fails the job. schema: the result's columns, among them
    the keys."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    said = [T.StructField("error", T.StringType()), T.StructField("details", T.StringType())]
    out_type = T.StructType([*fields, *said]) if isolate else fields
    arrow, plain = to_arrow_schema(out_type), to_arrow_schema(fields)

    def run(key: tuple, *tables: pa.Table) -> pa.Table:
        try:
            out = function(*tables)
            out = pa.Table.from_pandas(out, schema=plain, preserve_index=False) if isinstance(out, pd.DataFrame) else out.select(plain.names).cast(plain)
            if isolate:
                for f in said:
                    out = out.append_column(f.name, pa.nulls(out.num_rows, pa.string()))
            return out
        except Exception as e:
            if not isolate:
                raise
            known = {k: v.as_py() for k, v in zip(keys, key, strict=True)} | {"error": type(e).__name__, "details": str(e)[:2000]}
            return pa.table({c: pa.array([known.get(c)], arrow.field(c).type) for c in arrow.names}, schema=arrow)

    ship(df.sparkSession)
    groups = df.groupBy(*keys)
    if beside:
        return groups.cogroup(beside[0].groupBy(*beside[1])).applyInArrow(lambda key, a, b: run(key, a, b), out_type)
    return groups.applyInArrow(lambda key, a: run(key, a), out_type)


def vector_rows(lists: pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """The rows of a column of number lists, as parts of one array."""
    for chunk in lists.chunks:
        flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        yield from (flat[a:b] if known else None for a, b, known in zip(at[:-1], at[1:], chunk.is_valid().to_pylist(), strict=True))


def isolated(groups: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """by_group for a function of data frames, with errors apart."""
    return by_group(groups, keys, lambda table: function(table.to_pandas()), schema, isolate=True)


def results(isolated_rows: DataFrame) -> DataFrame:
    return isolated_rows.where("error is null").drop("error", "details")


def failures(isolated_rows: DataFrame, keys: list[str]) -> DataFrame:
    return isolated_rows.where("error is not null").select(*keys, "error", "details")


class Store:
    """Results of a stage by item, from which a run goes on where the last one stopped.

    A run writes its items' rows, and then a commit: a row for each item with its fingerprint, status, number of rows and
    error. The commit appears by one move, so a run that is cut off leaves nothing that counts, and its items are done again. An
    item counts by its last commit; those that are complete under the same fingerprint are left out of later runs, and a run
    without items to do starts no stage. Failed items are tried again."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = T.StructType.fromDDL(schema)
        key_fields = [f for f in self.schema if f.name in keys]
        self._commit = T.StructType([*key_fields, *T.StructType.fromDDL("fingerprint string, status string, rows long, error string, details string")])

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        with_run = T.StructType([*schema, T.StructField("run", T.StringType())])
        if not Folder(self.spark, f"{self.path}/{name}").exists():
            return self.spark.createDataFrame([], with_run)
        return self.spark.read.schema(with_run).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """Each item's last commit."""
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("run")))
        return self._table("commits", self._commit).withColumn("__n", last).where("__n = 1").drop("__n")

    def remaining(self, items: DataFrame, force: bool = False) -> DataFrame:
        """items (keys, and a fingerprint if there is one) that are not complete."""
        mark = F.col("fingerprint").cast("string") if "fingerprint" in items.columns else F.lit(None).cast("string")
        items = items.select(*self.keys, mark.alias("fingerprint")).distinct()
        if force:
            return items
        done = self.commits().where("status = 'complete'").select(*self.keys, F.col("fingerprint").alias("__done"))
        same = [items[k].eqNullSafe(done[k]) for k in self.keys] + [items["fingerprint"].eqNullSafe(done["__done"])]
        return items.join(done, same, "left_anti")

    def run(self, items: DataFrame, stage: Callable[[DataFrame], DataFrame], force: bool = False) -> dict:
        """stage takes the items to do (keys, fingerprint) and returns their rows, with error and details as by_group isolates
        them. The record has the run, and how many items were done, failed and skipped."""
        todo = written(self.remaining(items, force))
        n, whole = todo.count(), items.select(*self.keys).distinct().count()
        if not n:
            return {"run": None, "complete": 0, "failed": 0, "skipped": whole}
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        stage(todo).select(*self.schema.names, "error", "details").write.parquet(f"{self.path}/rows/run={run}")
        made = self.spark.read.parquet(f"{self.path}/rows/run={run}")
        made = made.groupBy(*self.keys).agg(F.count_if(F.col("error").isNull()).alias("rows"), F.max("error").alias("error"), F.max("details").alias("details"))
        on = [todo[k].eqNullSafe(made[k]) for k in self.keys]
        status = F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status")
        commit = todo.join(made, on, "left").select(*[todo[k] for k in self.keys], "fingerprint", status, F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "error", "details")
        replace(self.spark, f"{self.path}/commits/run={run}", lambda to: commit.write.parquet(to))
        failed = self._table("commits", self._commit).where((F.col("run") == run) & (F.col("status") == "failed")).count()
        return {"run": run, "complete": n - failed, "failed": failed, "skipped": whole - n}

    def results(self) -> DataFrame:
        """The rows of all items whose last commit is complete."""
        good = self.commits().where("status = 'complete'").select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("run").alias("__run"))
        rows = self._table("rows", T.StructType([*self.schema, *T.StructType.fromDDL("error string, details string")])).where("error is null")
        on = [rows[k].eqNullSafe(good[f"__{k}"]) for k in self.keys] + [rows["run"] == good["__run"]]
        return rows.join(good, on, "left_semi").select(*self.schema.names)

    def failures(self) -> DataFrame:
        return self.commits().where("status = 'failed'").select(*self.keys, "error", "details")


def only(rows: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of these items: what a resumed stage reads."""
    return rows.join(items.select(*keys).distinct(), keys, "left_semi")


class Stage:
    """One stage of a run: the write of a table, how long it took, and counts that are taken on the way."""

    def __init__(self, name: str, counts: dict[str, Column] | None = None):
        self.name, self.counts, self.record = name, {"rows": F.count("*"), **(counts or {})}, {}

    def run(self, df: DataFrame, write: Callable[[DataFrame], None]) -> dict:
        """Write df; the record has stage, status, seconds and the counts, or the error."""
        seen, began = Observation(), time.monotonic()
        self.record = {"stage": self.name, "status": "complete", "error": None}
        try:
            write(df.observe(seen, *[c.alias(n) for n, c in self.counts.items()]))
            self.record |= seen.get
        except Exception as e:
            self.record |= {"status": "failed", "error": type(e).__name__}
            raise
        finally:
            self.record["seconds"] = round(time.monotonic() - began, 3)
        return self.record
