"""Interval, nearest and interpolating joins.

Spark has no range join, so ranges are cut into bins that become an equi-join key; the exact condition
follows. Bins are as wide as the range that is searched, so each row meets a few bins, and hot keys
spread over their bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIME_TOLERANCE = 1e-9


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, tolerance: float = TIME_TOLERANCE, width: float = 1.0) -> DataFrame:
    """Each point with each interval of its key that holds it, ends included."""
    lo, hi = F.floor((F.col(start) - tolerance) / width), F.floor((F.col(end) + tolerance) / width)
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("__bin", F.explode(F.sequence(lo, hi)))
    joined = points.withColumn("__bin", F.floor(F.col(time) / width)).join(spread, [*keys, "__bin"])
    return joined.where((F.col(time) >= F.col(start) - tolerance) & (F.col(time) <= F.col(end) + tolerance)).drop("__bin")


def by_length(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, tolerance: float = TIME_TOLERANCE) -> DataFrame:
    """As points_in_intervals, with each interval in one place: lengths fall into classes by powers of two, and bins of a class are
    as wide as its longest, so the points are spread over classes and bins in place of the intervals. The places (__class, __bin)
    stay in the result: grouping by them and an interval's columns needs no further shuffle."""
    lo, hi = F.col(start) - tolerance, F.col(end) + tolerance
    wide = lambda c: F.pow(F.lit(2.0), c)
    placed = intervals.where(F.col(end) >= F.col(start)).withColumn("__class", F.greatest(F.lit(-3), F.ceil(F.log2(hi - lo))).cast("int"))
    classes = placed.agg(F.collect_set("__class").alias("__classes"))  # one row
    placed = placed.withColumn("__bin", F.floor(lo / wide(F.col("__class"))))
    at = points.join(F.broadcast(classes)).withColumn("__class", F.explode("__classes")).drop("__classes")
    # a class's width may be rounded: a bin before covers it
    here = F.floor(F.col(time) / wide(F.col("__class")))
    at = at.withColumn("__bin", F.explode(F.array(here - 2, here - 1, here)))
    joined = at.join(placed.hint("merge"), [*keys, "__class", "__bin"])  # a broadcast would lose the places
    return joined.where((F.col(time) >= lo) & (F.col(time) <= hi))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of closed intervals that overlap. The bin where the later one starts holds a pair once."""

    def spread(df, lo, hi):
        return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    pairs = spread(a, *a_range).join(spread(b, *b_range), [*keys, "__bin"])
    met = (F.col(a_range[1]) >= F.col(b_range[0])) & (F.col(a_range[0]) <= F.col(b_range[1]))
    return pairs.where(met & (F.col("__bin") == F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width))).drop("__bin")


def meeting(intervals: DataFrame, keys: list[str], id: str, start: str, end: str, width: float, measure: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """Pairs of a table's closed intervals that overlap, once each: columns a and b, a the smaller id, with as, ae, bs and be, or with
    value: measure of them, which doesn't depend on which is a. The later one lies in the bin of its start alone, so candidates are
    little more than the pairs there are; with narrow bins no task gets many of them. Equal intervals are one row with their ids until
    their pairs are written out, and are measured once."""
    at = intervals.groupBy(*keys, F.col(start).alias("__s"), F.col(end).alias("__e")).agg(F.collect_list(id).alias("__i"))
    here = at.select(*keys, F.floor(F.col("__s") / width).alias("__bin"), *[F.col(f"__{c}").alias(f"__l{c}") for c in "ise"])
    over = at.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / width), F.floor(F.col("__e") / width))))
    same = (F.col("__ls") == F.col("__s")) & (F.col("__le") == F.col("__e"))
    later = (F.col("__ls") > F.col("__s")) | (F.col("__ls") == F.col("__s")) & (F.col("__le") >= F.col("__e"))
    # few bytes may have many pairs: a broadcast would leave them to the tasks that read the table
    pairs = over.join(here.hint("merge"), [*keys, "__bin"]).where(later & (F.col("__ls") <= F.col("__e")))
    if measure:
        pairs = pairs.select(*keys, "__i", "__li", same.alias("__same"), measure(*[F.col(f"__{c}") for c in ("s", "e", "ls", "le")]).alias("value"))
    else:
        pairs = pairs.withColumn("__same", same)
    pairs = pairs.withColumn("__i", F.explode("__i")).withColumn("__li", F.explode("__li")).where((F.col("__i") < F.col("__li")) | ~F.col("__same") & (F.col("__i") > F.col("__li")))
    if measure:
        return pairs.select(*keys, F.least("__i", "__li").alias("a"), F.greatest("__i", "__li").alias("b"), "value")
    turned = F.col("__i") > F.col("__li")
    sides = [F.when(turned, F.col(f"__l{c}")).otherwise(F.col(f"__{c}")) for c in "ise"] + [F.when(turned, F.col(f"__{c}")).otherwise(F.col(f"__l{c}")) for c in "ise"]
    return pairs.select(*keys, *[c.alias(n) for c, n in zip(sides, ("a", "as", "ae", "b", "bs", "be"), strict=True)])


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, frame: str, tolerance: int) -> DataFrame:
    """left rows with all right rows of the key whose frame is at most tolerance from left's `at`."""
    width = 2 * tolerance + 1
    bins = F.array_distinct(F.array(F.floor((F.col(at) - tolerance) / width), F.floor((F.col(at) + tolerance) / width)))
    joined = left.withColumn("__bin", F.explode(bins)).join(right.withColumn("__bin", F.floor(F.col(frame) / width)), [*keys, "__bin"])
    return joined.where(F.abs(F.col(frame) - F.col(at)) <= tolerance).drop("__bin")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, frame: str, tolerance: int, per: list[str]) -> DataFrame:
    """Of within(), the row nearest to each `per`; ties go to the smaller frame. It is looked for once for each key and `at`, however
    many rows of left ask for it."""
    from .rows import keep_one

    order = [F.abs(F.col(frame) - F.col(at)), F.col(frame)]
    found = within(left.select(*keys, at).distinct(), right, keys, at, frame, tolerance)
    found = keep_one(found, [*keys, at, *[c for c in per if c not in left.columns]], order)
    return keep_one(left.join(found, [*keys, at]), per, order)


def bracketed(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, frame: str, values: list[str]) -> DataFrame:
    """queries with prev and next: the nearest rows of the key at or before, and at or after, `at`, as structs of
    frame and values (null where there is none). Two sorts of the rows and of what is asked, once for each key and `at`: a key's
    task holds no more of the queries than their distinct times."""
    payload = F.struct(F.col(frame).alias("frame"), *[F.col(v) for v in values])
    obs = rows.select(*keys, F.col(frame).alias("__at"), payload.alias("__row"), F.lit(False).alias("__q"))
    asks = queries.select(*keys, F.col(at).alias("__at")).distinct().select("*", F.lit(None).cast(_type(rows, frame, values)).alias("__row"), F.lit(True).alias("__q"))
    both = obs.unionByName(asks)
    # Range frames take in rows of the same frame on either side. Both run from the partition's beginning, which costs
    # one step a row; a frame that ends at the partition's end would be read anew for every row.
    prev, following = (F.last("__row", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) for o in (F.asc("__at"), F.desc("__at")))
    found = both.withColumn("prev", prev).withColumn("next", following).where("__q").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__at").alias("__asked"), "prev", "next")
    same = queries[at].eqNullSafe(F.col("__asked"))
    for k in keys:
        same &= queries[k].eqNullSafe(F.col(f"__{k}"))
    return queries.join(found, same).select(*[queries[c] for c in queries.columns], "prev", "next")


def _type(rows: DataFrame, frame: str, values: list[str]) -> str:
    return rows.select(F.struct(F.col(frame).alias("frame"), *[F.col(v) for v in values]).alias("s")).schema["s"].dataType.simpleString()


BOX = ("x1", "y1", "x2", "y2")


def _blend(c: str, alpha: Column) -> Column:
    return F.col(f"prev.{c}") * (1 - alpha) + F.col(f"next.{c}") * alpha


def interpolated(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, frame: str, max_gap: int, extra: list[str] | None = None) -> DataFrame:
    """queries with the key's box at `at`: exact; else linear if the frames around are at most 2 max_gap apart;
    else the nearest within max_gap (the earlier of equals); else null."""
    df = bracketed(queries, rows, keys, at, frame, [*BOX, *(extra or [])])
    t, p, n = F.col(at), F.col("prev.frame"), F.col("next.frame")
    between = p.isNotNull() & n.isNotNull() & (p < n) & (n - p <= 2 * max_gap)
    alpha = (t - p) / F.when(n > p, n - p)
    to_p, to_n = t - p, n - t
    use_p = p.isNotNull() & (n.isNull() | (to_p <= to_n)) & (to_p <= max_gap)
    use_n = n.isNotNull() & (p.isNull() | (to_n < to_p)) & (to_n <= max_gap)
    boxes = [F.when(p == t, F.col(f"prev.{c}")).when(between, _blend(c, alpha)).when(use_p, F.col(f"prev.{c}")).when(use_n, F.col(f"next.{c}")).alias(c) for c in BOX]
    return df.select(*queries.columns, *boxes)


def annotated_at(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, frame: str, max_bracket: int | None = None) -> DataFrame:
    """queries with an annotation's box and state at `at`: exact or linear between its neighbours, never beyond them.
    The state needs both ends to agree; with max_bracket a wider gap, or a disagreement, gives no box."""
    df = bracketed(queries, rows, keys, at, frame, [*BOX, "state"])
    t, p, n = F.col(at), F.col("prev.frame"), F.col("next.frame")
    exact, between = p == t, (p < t) & (t < n)
    same = F.col("prev.state") == F.col("next.state")
    if max_bracket is not None:
        between = between & (n - p <= max_bracket) & same
    alpha = (t - p) / F.when(n > p, n - p)
    boxes = [F.when(exact, F.col(f"prev.{c}")).when(between, _blend(c, alpha)).alias(c) for c in BOX]
    state = F.when(exact, F.col("prev.state")).when(between & same, F.col("prev.state")).otherwise(F.lit(""))
    return df.select(*queries.columns, *boxes, state.alias("state"))


def expanded_frames(events: DataFrame, start: str, end: str, fps: Column) -> DataFrame:
    """One row for each frame that an event touches."""
    return events.withColumn("frame", F.explode(F.sequence(F.floor(F.col(start) * fps).cast("long"), F.ceil(F.col(end) * fps).cast("long"))))
