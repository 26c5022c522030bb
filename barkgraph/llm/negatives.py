"""Hard-negative mining with a pivot table: exact scores for what the stored pivot distances can't rule out.

Components become whole numbers, floor(256 x), and a row's score is its inner product with the anchor. With M the largest norm, a
row x gets one more component, sqrt(M^2 - |x|^2), and an anchor a gets 0. Inner products then follow from Euclidean distances,
    <a, x> = (|a|^2 + M^2 - d(a, x)^2) / 2,
and for every pivot p the triangle inequality brackets the distance, |d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p),
and with it the score.

  * Pivot table: the distances of all rows and anchors to PIVOTS rows, chosen farthest first from SAMPLE rows.
  * Cells: rows sorted by label, nearest pivot and vec_id are cut into cells of CELL rows, anchors into cells of ANCHORS. A
    cell's smallest and largest distances bracket all its scores, so pairs of cells without a candidate are never read.
  * Floors: each anchor cell first meets the cell of the highest bracket; the scores found there are floors for the rest.
  * In a pair of cells, rows that the brackets of single rows leave are scored exactly, in blocks. A cell pair gives the best
    few of each anchor; a ranking over all pairs keeps the best.
  * Positives are searched for first; each fixes the window of its negatives, searched for in the same way.
Whatever the pivots, results are exact; how much they rule out depends on the data.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose squared norm reaches
2^56 (a long couldn't hold what the windows compare). A shorter vector ends in zeros, an empty one is all zeros. A null vec_id is no
anchor and comes last among ties. Rows that repeat a vec_id are rows of their own, as anchors too; only the anchor's own row
isn't its positive. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_map, bounded, cut, forget

#: Every so many vec_ids is an anchor.
ANCHOR_EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: Of a positive's score a negative has at least and at most so many percent.
LEAST, MOST = 30, 90
PIVOTS = 16
#: Rows that the pivots are chosen from.
SAMPLE = 4096
#: Rows and anchors of a cell; a task holds one cell of each.
CELL, ANCHORS = 16_384, 2_048
#: Rows and anchors scored at once.
BLOCK, BESIDE = 2_048, 256
#: Squared norms stay below; 90 times a score fits a long.
LIMIT = 2.0**56
#: Below every score, and above.
NONE, ALL = -(1 << 62), 1 << 62

_ROW = "row long, vec_id long, label long, q array<long>, norm double, near int, dist array<double>"


def _whole(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, q, norm) of the rows that take part: whole components, and the squared norm."""
    vec_id, label, v = F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(label.isNotNull() & v.isNotNull() & good)
    rows = rows.select(vec_id.alias("vec_id"), moved.alias("label"), F.transform(v, lambda x: F.floor(256 * x)).alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.withColumn("norm", norm).where(F.col("norm") < LIMIT).select(F.monotonically_increasing_id().alias("row"), "*")


def _matrix(lists: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """One row for each list, with zeros after its end."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(sizes), width), kind)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(base: DataFrame, width: int, top: float) -> np.ndarray:
    """Augmented rows, each the farthest from those before it, of a sample that depends on vec_ids alone."""
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("q", "norm").collect()
    x = np.array([[*r["q"], *[0] * (width - len(r["q"])), np.sqrt(max(top - r["norm"], 0.0))] for r in some], np.float64)
    chosen, away = [0], np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(away.argmax()))
    return x[chosen]


def _measured(rows: DataFrame, pivots: np.ndarray, top: float, anchors: bool) -> DataFrame:
    """With the nearest pivot and the distances to all of them. Anchors have no augmented component."""
    width = pivots.shape[1] - 1

    def run(batches):
        for batch in batches:
            q, norm = _matrix(batch.column(3), width), batch.column(4).to_numpy()
            more = 0.0 if anchors else np.sqrt(np.maximum(top - norm, 0.0))[:, None] * pivots[:, -1]
            square = (norm if anchors else max(top, 0.0)) + (pivots**2).sum(axis=1)[:, None] - 2 * (q @ pivots[:, :-1].T + more).T
            dist = np.sqrt(np.maximum(square, 0.0)).T.copy()
            offsets = pa.array(np.arange(len(dist) + 1, dtype=np.int32) * len(pivots))
            near = dist.argmin(axis=1).astype(np.int32) if len(dist) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.ListArray.from_arrays(offsets, pa.array(dist.ravel()))], [*batch.schema.names, "near", "dist"])

    return arrow_map(rows, run, _ROW)


def _cells(rows: DataFrame, count: int, size: int) -> DataFrame:
    """With a cell number: neighbours by label, nearest pivot and vec_id, at most `size` of them. Sorting by vec_id splits
    groups of equal vectors."""
    place = F.monotonically_increasing_id()
    cell = F.shiftright(place, 33) * (1 << 32) + F.floor((place % (1 << 33)) / size)
    keys = ["label", "near", "vec_id", "row"]
    return cut(rows.repartitionByRange(max(1, count // (4 * size)), *keys).sortWithinPartitions(*keys).withColumn("cell", cell))


def _brackets(rows: DataFrame, pivots: int, **more: Column) -> DataFrame:
    """A row for each cell: the ranges of its labels, norms and pivot distances."""
    ends = [f(F.col("dist")[p]).alias(f"{k}{p}") for p in range(pivots) for k, f in (("lo", F.min), ("hi", F.max))]
    ends += [F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("norm").alias("n0"), F.max("norm").alias("n1")]
    cells = rows.groupBy("cell").agg(*ends, *[c.alias(k) for k, c in more.items()])
    lo, hi = (F.array(*[f"{k}{p}" for p in range(pivots)]).alias(k) for k in ("lo", "hi"))
    return cells.select("cell", lo, hi, "l0", "l1", "n0", "n1", *more)


def _pairs(queries: DataFrame, table: DataFrame, pivots: int, top: float, same: bool) -> DataFrame:
    """(a, b, most) for each anchor cell and cell of rows that may hold a candidate, by what their brackets say; most: no score of
    the pair is higher."""
    a = _brackets(queries, pivots, low=F.min(F.array_min("low")), high=F.max(F.array_max("high")))
    a = a.toDF(*[f"a_{c}" for c in a.columns])
    b = _brackets(table, pivots)
    labels = (F.col("a_l0") <= F.col("l1")) & (F.col("l0") <= F.col("a_l1"))
    if not same:
        labels = ~((F.col("a_l0") == F.col("a_l1")) & (F.col("l0") == F.col("l1")) & (F.col("l0") == F.col("a_l0")))
    gaps = [F.greatest(F.col("a_lo")[p] - F.col("hi")[p], F.col("lo")[p] - F.col("a_hi")[p], F.lit(0.0)) for p in range(pivots)]
    sums = [F.col("a_hi")[p] + F.col("hi")[p] for p in range(pivots)]
    near, far = (F.greatest(*gaps), F.least(*sums)) if pivots > 1 else (gaps[0], sums[0])
    slack = 1e-6 * (top + F.col("a_n1") + 1)
    both = bounded(a).join(b, labels)  # a row for each cell, on either side
    both = both.withColumn("most", (F.col("a_n1") + top - near * near) / 2 + slack).withColumn("least", (F.col("a_n0") + top - far * far) / 2 - slack)
    return both.where("most >= a_low AND least <= a_high").select(F.col("a_cell").alias("a"), F.col("cell").alias("b"), "most")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor's slot, with their place from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _found(pairs: DataFrame, queries: DataFrame, table: DataFrame, width: int, top: float, same: bool, k: int) -> DataFrame:
    """(anchor, slot, row, vec_id, score): in each pair of cells the k best rows of each anchor's slot within [low, high]."""
    exact = top < 2.0**52  # products of doubles are then whole numbers without rounding

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if not left.num_rows or not right.num_rows:
            left, right = left.slice(0, 0), right.slice(0, 0)
        column = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        x, xd, xl, xr, xn = _matrix(right["q"], width, np.float64 if exact else np.int64), None, column(right, "label"), column(right, "row"), right["vec_id"].combine_chunks()
        pivots = len(right["dist"][0]) if right.num_rows else 1
        xd, ad = _matrix(right["dist"], pivots), _matrix(left["dist"], pivots)
        xi = xn.fill_null(np.iinfo(np.int64).max).to_numpy()  # nulls last among ties
        a, al, ar, an = _matrix(left["q"], width, x.dtype), column(left, "label"), column(left, "row"), column(left, "norm")
        slots = len(left["low"][0]) if left.num_rows else 1
        low, high = _matrix(left["low"], slots, np.int64), _matrix(left["high"], slots, np.int64)
        for i in range(0, len(a), BESIDE):
            these = slice(i, i + BESIDE)
            floor, base = low[these].copy(), (an[these] + top)[:, None] / 2
            slack = 1e-6 * (an[these] + top + 1)[:, None]
            best: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(slots)]
            for j in range(0, len(x), BLOCK):
                some = slice(j, j + BLOCK)
                near, far = np.zeros((len(base), len(x[some]))), np.full((len(base), len(x[some])), np.inf)
                for p in range(pivots):
                    near = np.maximum(near, np.abs(ad[these, p][:, None] - xd[some, p]))
                    far = np.minimum(far, ad[these, p][:, None] + xd[some, p])
                most, least = base - near * near / 2 + slack, base - far * far / 2 - slack
                left_over = ((al[these][:, None] == xl[some]) == same) & (ar[these][:, None] != xr[some])
                left_over &= (most >= floor.min(axis=1)[:, None]) & (least <= high[these].max(axis=1)[:, None])
                if not left_over.any():
                    continue
                if left_over.mean() > 0.05:
                    r, c = None, None
                    score = (a[these] @ x[some].T).astype(np.int64)
                else:
                    r, c = np.nonzero(left_over)
                    score = (a[these][r] * x[some][c]).sum(axis=1).astype(np.int64)
                for s in range(slots):
                    f, h = floor[:, s], high[these][:, s]
                    if r is None:
                        row, col = np.nonzero(left_over & (score >= f[:, None]) & (score <= h[:, None]))
                        value = score[row, col]
                    else:
                        good = (score >= f[r]) & (score <= h[r])
                        row, col, value = r[good], c[good], score[good]
                    if not len(row):
                        continue
                    best[s].append((row, col + j, value))
                    row, col, value = (np.concatenate(z) for z in zip(*best[s], strict=True))
                    order = np.lexsort((xr[col], xi[col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    kth = place == k - 1
                    f[row[kth]] = np.maximum(f[row[kth]], value[kth])
                    best[s] = [tuple(z[place < k] for z in (row, col, value))]
            for s in range(slots):
                for row, col, value in best[s]:
                    out.append((ar[these][row], np.full(len(row), s), xr[col], col, value))
        anchor, slot, row, col, value = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
        return pa.table({"anchor": pa.array(anchor, pa.int64()), "slot": pa.array(slot, pa.int32()), "row": pa.array(row, pa.int64()), "vec_id": xn.take(pa.array(col, pa.int64())), "score": pa.array(value, pa.int64())})

    ship(pairs.sparkSession)
    pair = F.struct("a", "b").alias("pair")
    a = queries.join(pairs.select("a", "b"), queries["cell"] == pairs["a"]).select(pair, "row", "label", "q", "norm", "dist", "low", "high")
    b = table.join(pairs.select("a", "b"), table["cell"] == pairs["b"]).select(pair, "row", "vec_id", "label", "q", "dist")
    return a.groupBy("pair").cogroup(b.groupBy("pair")).applyInArrow(run, "anchor long, slot int, row long, vec_id long, score long")


def _searched(queries: DataFrame, table: DataFrame, width: int, top: float, pivots: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, place, row, vec_id, score): the k best of each anchor's slot, from 1. queries: anchors with their cell, and an array of
    windows, low and high."""
    first = Window.partitionBy("a").orderBy(F.desc("most"), "b")
    seeds = cut(_pairs(queries, table, pivots, top, same).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"))
    early = cut(_ranked(_found(seeds, queries, table, width, top, same, k), k).drop("place"))
    floors = early.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    floors = floors.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("floors"))  # one for each slot
    known = queries.join(floors.withColumnRenamed("anchor", "row"), "row", "left")
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.col("floors")[i], x)))
    known = cut(known.withColumn("low", raised).drop("floors"))
    rest = _pairs(known, table, pivots, top, same).join(seeds.select("a", "b"), ["a", "b"], "left_anti")
    late = _found(cut(rest), known, table, width, top, same, k)
    out = cut(_ranked(early.unionByName(late), k))
    forget(known)
    return out


def _down(x: str) -> str:
    """x div 100, rounding down, in whole numbers."""
    return f"(({x}) - pmod({x}, 100L)) div 100L"


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    POSITIVES rows of the same label the first NEGATIVES rows of another label whose score is LEAST to MOST percent of the positive's."""
    spark = embeddings.sparkSession
    base = cut(_whole(embeddings), top=F.max("norm"), width=F.max(F.size("q")))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not base.seen["rows"]:
        return spark.createDataFrame([], schema)
    top, width = float(base.seen["top"]), max(1, base.seen["width"])
    pivots = _pivots(base, width, top)
    table = _cells(_measured(base, pivots, top, False), base.seen["rows"], CELL)
    anchors = _cells(_measured(base.where(F.col("vec_id") % ANCHOR_EVERY == 0), pivots, top, True), base.seen["rows"] // ANCHOR_EVERY, ANCHORS)
    ends = {"low": F.array(F.lit(NONE)), "high": F.array(F.lit(ALL))}
    near = _searched(anchors.withColumns(ends), table, width, top, len(pivots), True, POSITIVES)
    near = near.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # an anchor has at most POSITIVES of them; a slot without one has an empty window
    pos = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("s"))
    low = F.array(*[F.expr(f"coalesce(-({_down(f'-{LEAST} * s[{p}]')}), {ALL}L)") for p in range(1, POSITIVES + 1)])
    high = F.array(*[F.expr(f"coalesce({_down(f'{MOST} * s[{p}]')}, {NONE}L)") for p in range(1, POSITIVES + 1)])
    queries = cut(anchors.join(pos.withColumnRenamed("anchor", "row"), "row").withColumn("low", low).withColumn("high", high).drop("s"))
    far = _searched(queries, table, width, top, len(pivots), False, NEGATIVES)
    far = far.select("anchor", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return near.join(far, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB.
ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.k <> b.k),
p AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id NULLS LAST, s.b)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
