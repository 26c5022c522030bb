"""Optimal assignment, and the matchings built on it. Groups are one video's rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import by_group


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of a minimum-cost assignment of min(rows, columns) pairs, by shortest augmenting paths
    with potentials. Equal costs go to the smaller column."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        best, via, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            done[col] = True
            i = owner[col]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~done[1:] & (slack < best[1:])
            best[1:][better], via[1:][better] = slack[better], col
            open_ = np.flatnonzero(~done[1:]) + 1
            following = open_[np.argmin(best[open_])]
            step = best[following]
            u[owner[done]] += step
            v[done] -= step
            best[~done] -= step
            col = following
        while col:
            owner[col], col = owner[via[col]], via[col]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def sparse_assignment(at: np.ndarray, columns: np.ndarray, gain: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Row-column pairs of the largest total gain, of the pairs that are listed: row i has columns[at[i]:at[i + 1]], with
    positive gains."""
    return assigned(lambda i: (columns[at[i] : at[i + 1]], gain[at[i] : at[i + 1]]), len(at) - 1, width)


def assigned(edges: Callable[[int], tuple[np.ndarray, np.ndarray]], n: int, width: int) -> list[tuple[int, int]]:
    """sparse_assignment over pairs that are made when they are looked at: edges(row) gives a row's columns and positive gains, so memory
    goes with rows and columns, not with pairs."""
    return [(i, j) for i, j, _ in carried(edges, np.ones(n, int), np.ones(width, int))]


def carried(edges: Callable[[int], tuple[np.ndarray, np.ndarray]], supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for rows and columns that stand for several equal ones, supply and demand of them: (row, column, how many of its pairs).
    Exact: shortest augmenting paths, which stay within a connected group and mostly near their row. A path carries as many as it
    can, so equal rows cost no more than one."""
    n, width = len(supply), len(demand)
    u, v = np.zeros(n), np.zeros(width)
    left, room, best, via = supply.tolist(), demand.copy(), np.full(width, np.inf), np.full(width, -1)
    owners: list[dict[int, int]] = [{} for _ in range(width)]
    for i in range(n):
        c, gain = edges(i)
        if len(c):
            u[i] = -gain.max()
            for j in c[(-gain == u[i]) & (room[c] > 0)].tolist():
                owners[j][i] = k = min(left[i], int(room[j]))
                left[i] -= k
                room[j] -= k
                if not left[i]:
                    break
    for first in [i for i in range(n) if left[i] and u[i] < 0]:
        while left[first] and u[first] < 0:
            far, rows, entered, done, touched, heap = 0.0, [], {first: -1}, {}, [], []
            bound, last, col, fresh = np.inf, -1, -1, [first]  # the shortest path known: to a column with room, or to last, of which some stay without
            while True:
                for row in fresh:
                    rows.append((row, far))
                    if far - u[row] < bound:
                        bound, last = far - u[row], row
                    c, gain = edges(row)
                    d = np.maximum(far - gain - u[row] - v[c], far)
                    nearer = (d < best[c]) & (d < bound)
                    d, c = d[nearer], c[nearer]
                    best[c], via[c] = d, row
                    touched.append(c)
                    for x, y, free in zip(d.tolist(), c.tolist(), (room[c] > 0).tolist(), strict=True):
                        if y not in done:
                            heapq.heappush(heap, (x, y))
                            if free:
                                bound = min(bound, np.nextafter(x, np.inf))
                while heap and heap[0][1] in done:
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= bound:
                    col = -1
                    break
                far, col = heapq.heappop(heap)
                if room[col]:
                    bound = far
                    break
                done[col] = far
                fresh = [r for r in owners[col] if r not in entered]
                entered.update(dict.fromkeys(fresh, col))
            for r, x in rows:
                u[r] += bound - x
            for y, x in done.items():
                v[y] -= bound - x
            for c in touched:
                best[c] = np.inf
            if col < 0 and last == first:
                break  # the rest stays without
            end, gets, gives, most = col, [], [], left[first]
            if col < 0:
                col = entered[last]
                gives.append((last, col))
            else:
                most = min(most, int(room[col]))
            while (row := int(via[col])) != first:
                gets.append((row, col))
                col = entered[row]
                gives.append((row, col))
            gets.append((first, col))
            most = min(most, *(owners[j][i] for i, j in gives)) if gives else most
            for i, j in gives:
                owners[j][i] -= most
                if not owners[j][i]:
                    del owners[j][i]
            for i, j in gets:
                owners[j][i] = owners[j].get(i, 0) + most
            left[first] -= most
            if end < 0:
                left[last] += most
            else:
                room[end] -= most
    return sorted((i, j, k) for j, of in enumerate(owners) for i, k in of.items())


def _meeting(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """For a row of the first intervals, the columns of the second that overlap it, and their IoU; s2 is sorted."""
    reach = np.maximum.accumulate(e2) if len(e2) else e2
    lo, hi = np.searchsorted(reach, s1, "right"), np.searchsorted(s2, e1, "left")

    def edges(i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = lo[i], hi[i]
        shared = np.minimum(e1[i], e2[a:b]) - np.maximum(s1[i], s2[a:b])
        k = np.flatnonzero(shared > 0)
        return k + a, shared[k] / (np.maximum(e1[i], e2[a:b][k]) - np.minimum(s1[i], s2[a:b][k]))

    return edges


def _overlaps(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, columns, IoU) of all pairs that overlap, for few intervals; s2 is sorted."""
    edges = _meeting(s1, e1, s2, e2)
    columns, values = zip(*(edges(i) for i in range(len(s1))), strict=True) if len(s1) else ((), ())
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(int), join(columns, int), join(values, float)


#: Seconds in which the islands of one stretch begin, rows of stretches that one call of Python goes through, and tasks for them.
STRETCH, TOGETHER, TASKS = 600.0, 5_000, 1000
#: Intervals on each side up to which all assignments are tried.
FEW = 3


def _few(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, IoU) of the best assignment of at most FEW intervals; of equal ones the first in order."""
    a, b = list(zip(s1.tolist(), e1.tolist(), strict=True)), list(zip(s2.tolist(), e2.tolist(), strict=True))
    iou = [[(min(e, f) - max(s, t)) / (max(e, f) - min(s, t)) if min(e, f) > max(s, t) else 0.0 for t, f in b] for s, e in a]
    if len(a) <= len(b):
        choices = (list(enumerate(c)) for c in permutations(range(len(b)), len(a)))
    else:
        choices = ([(i, j) for j, i in enumerate(c)] for c in permutations(range(len(a)), len(b)))
    best = max(choices, key=lambda pairs: sum(iou[i][j] for i, j in pairs))
    return [(i, j, iou[i][j]) for i, j in best]


def _many(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> list[tuple[int, int, float, int]]:
    """The same for any number of intervals, which stand for n1 and n2 equal ones, by pairs that are made when they are looked at;
    s2 is sorted. (i, j, IoU, how many)."""
    edges, out = _meeting(s1, e1, s2, e2), []
    for i, j, k in carried(edges, n1, n2):
        columns, iou = edges(i)
        out.append((i, j, float(iou[columns == j][0]), k))
    return out


def _running_max(key: str, value: Column, before: bool) -> Column:
    """The largest value of the rows up to this one, or before it, by start within a key: within the row's bin, and over all earlier
    bins, of which there is one row each. So no key needs to be one task's."""
    here = Window.partitionBy(key, "bin").orderBy("start", "end", "side", "id").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.max(value).over(here)


def islands(intervals: DataFrame, key: str = "video_id", bin_length: float = 600.0) -> DataFrame:
    """intervals (key, side, id, start, end) with island: the start of the first one of its run of intervals that overlap each
    other or are bridged by others. Intervals that only touch are apart."""
    df = intervals.withColumn("bin", F.floor(F.col("start") / bin_length))

    def earlier(df: DataFrame, value: str, name: str) -> DataFrame:
        bins = df.groupBy(key, "bin").agg(F.max(value).alias("__top"))
        w = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.select(F.col(key).alias("__key"), F.col("bin").alias("__bin"), F.max("__top").over(w).alias(name))
        return df.join(bins, df[key].eqNullSafe(F.col("__key")) & df["bin"].eqNullSafe(F.col("__bin"))).drop("__key", "__bin")

    df = earlier(df, "end", "__reach").withColumn("__near", _running_max(key, F.col("end"), True))
    new = F.coalesce(F.col("start") >= F.greatest("__reach", "__near"), F.lit(True))
    df = df.withColumn("__new", F.when(new, F.col("start")))
    df = earlier(df, "__new", "__first").withColumn("__here", _running_max(key, F.col("__new"), False))
    return df.withColumn("island", F.coalesce("__here", "__first")).drop("bin", "__reach", "__near", "__new", "__first", "__here")


def matched_events(truth: DataFrame, guesses: DataFrame, threshold: float = 0.1, isolate: bool = False) -> DataFrame:
    """Assign first, by temporal IoU over all pairs of a video, then drop pairs under the threshold, which is above 0.
    Pairs that don't overlap add nothing to an assignment, so a video falls apart into islands of intervals; a stretch is the islands
    that begin within STRETCH of each other, and a group is whole stretches, about TOGETHER rows or one stretch. Equal intervals of a side
    are one row with their ids. truth, guesses: video_id, id, start, end. An event without a start or end, or that ends
    before it starts, is an error of its stretch. isolate: a stretch that fails gives a row with its error."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    both = truth.select("video_id", F.lit(0).alias("side"), "id", "start", "end").unionByName(guesses.select("video_id", F.lit(1).alias("side"), "id", "start", "end"))
    # structs, as a list of plain values leaves out nulls
    both = both.groupBy("video_id", "side", "start", "end").agg(F.sort_array(F.collect_list(F.struct("id"))).alias("ids"), F.min("id").alias("id"))

    def run(table: pa.Table) -> pa.Table:
        lists = table["ids"].combine_chunks()
        at, ids = lists.offsets.to_numpy(), lists.values.field("id")
        videos, pdf = table["video_id"].to_pylist(), table.drop_columns(["ids"]).to_pandas()
        own = pd.factorize(pdf.video_id, use_na_sentinel=False)[0] * len(pdf) + pd.factorize(pdf.stretch, use_na_sentinel=False)[0]
        order = np.lexsort((pdf.id, pdf.end, pdf.start, pdf.side, own))
        start, end, side, own = pdf.start.to_numpy(float)[order], pdf.end.to_numpy(float)[order], pdf.side.to_numpy()[order], own[order]
        used, n = at[:-1][order].copy(), np.diff(at)[order]  # the first id of an interval that has no pair yet
        first = np.flatnonzero(np.diff(own, prepend=-1))
        wrong = np.logical_or.reduceat(~(end >= start), first)
        split, stop = first + np.add.reduceat(side == 0, first), np.append(first[1:], len(own))
        rows, errors = [], []
        for a, b, c, bad in zip(first.tolist(), split.tolist(), stop.tolist(), wrong.tolist(), strict=True):
            try:
                if bad:
                    raise ValueError("an event that has no end, or ends before it starts")
                if b - a <= FEW and c - b <= FEW and n[a:c].max() == 1:
                    pairs = [(*p, 1) for p in _few(start[a:b], end[a:b], start[b:c], end[b:c])]
                else:
                    pairs = _many(start[a:b], end[a:b], start[b:c], end[b:c], n[a:b], n[b:c])
                for i, j, x, k in pairs:
                    if x >= threshold:
                        rows.append((order[a + i], used[a + i], used[b + j], x, k))
                        used[a + i] += k
                        used[b + j] += k
            except Exception as e:
                if not isolate:
                    raise
                errors.append((videos[order[a]], None, None, None, type(e).__name__, str(e)[:2000]))
        row, gt, pred, iou, many = (np.array(x) for x in zip(*rows, strict=True)) if rows else [np.empty(0, int)] * 5
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # 0, 1, ... in each row
        each = lambda x: pa.array(np.repeat(x, many))
        columns = [table["video_id"].take(each(row)), ids.take(pa.array(np.repeat(gt, many) + step)), ids.take(pa.array(np.repeat(pred, many) + step)), each(iou), pa.nulls(len(step)), pa.nulls(len(step))]
        types = {"video_id": pa.int64(), "gt_id": pa.int64(), "pred_id": pa.int64(), "iou": pa.float64(), "error": pa.string(), "details": pa.string()}
        found = pa.table({k: c.cast(t) for (k, t), c in zip(types.items(), columns, strict=True)})
        failed = list(zip(*errors, strict=True)) if errors else [[]] * 6
        return pa.concat_tables([found, pa.table({k: pa.array(c, t) for (k, t), c in zip(types.items(), failed, strict=True)})])

    parts = max(1, both.count() // TOGETHER)
    stretches = islands(both).withColumn("stretch", F.floor(F.col("island") / STRETCH))
    dealt = stretches.withColumn("part", F.pmod(F.xxhash64("video_id", "stretch"), F.lit(parts)))
    # few bytes may be long work: left to itself, Spark would put them into one task
    dealt = dealt.repartition(min(parts, TASKS), "part")
    return by_group(dealt, ["part"], run, "video_id long, gt_id long, pred_id long, iou double" + (", error string, details string" if isolate else ""))


def aligned_identities(counts: DataFrame, isolate: bool = False) -> DataFrame:
    """The one-to-one alignment with the largest total count; pairs without count stay unmapped (null).
    counts: video_id, profile, identity, n. A null profile or identity is an error of its video. isolate: a video that fails gives a
    row with its error."""

    def run(table: pa.Table) -> pd.DataFrame:
        pdf = table.to_pandas()
        p, g = sorted(pdf.profile.unique()), sorted(pdf.identity.unique())
        m = np.zeros((max(len(p), len(g)),) * 2)
        for r in pdf.itertuples(index=False):
            m[p.index(r.profile), g.index(r.identity)] += r.n
        pick = dict(hungarian(-m))
        rows = [(pdf.video_id.iloc[0], x, g[pick[i]] if pick[i] < len(g) and m[i, pick[i]] > 0 else None, int(m[i, pick[i]])) for i, x in enumerate(p)]
        return pd.DataFrame(rows, columns=["video_id", "profile", "identity", "n"])

    return by_group(counts, ["video_id"], run, "video_id long, profile string, identity string, n long", isolate)
