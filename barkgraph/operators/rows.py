"""Choosing, numbering and counting rows. Every order must be total: files have one, DataFrames don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: keep first, keep last and keep best are orders."""
    return ranked(df, keys, order, "__rank").where("__rank = 1").drop("__rank")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return ranked(df, keys, order).where(F.col("rank") <= k)


def least_rows(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows of the keys that have at least count rows."""
    enough = df.groupBy(*keys).count().where(F.col("count") >= count).select(*keys)
    return df.join(enough, keys, "left_semi")


def suffixed_ids(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """Repeated ids become id__2, id__3 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.withColumn(column, F.when(n == 1, F.col(column)).otherwise(F.concat_ws("__", F.col(column), n.cast("string"))))


def dense_by_first_seen(df: DataFrame, column: str, order: str, keys: list[str], name: str) -> DataFrame:
    """1, 2, ... for each value in the order in which it first appears."""
    first = df.groupBy(*keys, column).agg(F.min(order).alias("__first"))
    ids = first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("__first")).cast("long")).drop("__first")
    return df.join(ids, [*keys, column])


def numbered(df: DataFrame, order: str, name: str, width: int = 100_000) -> DataFrame:
    """0, 1, ... in the order of a whole-number column without repeats. Rows are counted by classes of it, so no task holds
    more than a class: only the classes' counts meet."""
    classed = df.withColumn("__class", F.floor(F.col(order) / width))
    before = Window.orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    base = classed.groupBy("__class").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__class").orderBy(order)) - 1
    return classed.withColumn("__n", within).join(base, "__class").withColumn(name, (F.col("__base") + F.col("__n")).cast("long")).drop("__class", "__n", "__base")


def majority(df: DataFrame, keys: list[str], label: str, tie: Column) -> DataFrame:
    """(keys, label, n, total, distinct): the most frequent label of each key; tie orders equals."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(tie).alias("__tie"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("distinct", F.count("*").over(w))
    return keep_one(n, keys, [F.desc("n"), F.asc("__tie")]).drop("__tie")


def long_metrics(df: DataFrame) -> DataFrame:
    """(metric, value): one row for each column of a one-row table."""
    return df.unpivot([], df.columns, "metric", "value")


def sampled_rows(df: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """At most count rows of each key, evenly spaced in order, both ends included."""
    from ..functions.temporal import evenly

    w = Window.partitionBy(*keys)
    numbered = df.withColumn("__i", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("__n", F.count("*").over(w))
    return numbered.where(F.array_contains(evenly(F.col("__n"), F.lit(count)), F.col("__i"))).drop("__i", "__n")


def islands(df: DataFrame, keys: list[str], order: str, accepted: Column) -> DataFrame:
    """Runs of accepted rows: adds island, the number of rejected rows before; keeps accepted rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.coalesce(accepted, F.lit(False))).withColumn("island", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(w)).where("__ok").drop("__ok")


def confusion(df: DataFrame, truth: Column, guess: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and the rates that follow; a rate without cases is null."""
    from ..functions.text import safe_divide

    tp, fp, fn, tn = (F.count_if(c).alias(n) for c, n in ((truth & guess, "tp"), (~truth & guess, "fp"), (truth & ~guess, "fn"), (~truth & ~guess, "tn")))
    out = (df.groupBy(*keys) if keys else df).agg(tp, fp, fn, tn)
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = safe_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("accuracy", accuracy)
