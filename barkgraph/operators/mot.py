"""Multi-object-tracking metrics: HOTA, CLEAR and identity, from the papers that define them.

Rows are (sequence, frame, id, x, y, w, h), an id once a frame. Two passes over blocks of frames, so that a long sequence is many tasks:
  1. Each block gives what its pairs of ids add to the association potential and to the frames that they share, which sum
     over blocks to the sequence's alignment scores.
  2. With these, each block matches its frames. HOTA's frames stand alone. CLEAR prefers the pairs of the frame before; but in a
     frame where no id could choose, the pairs are what they are, so second blocks begin at such frames and need nothing of
     the block before. Changes of identity from one block to the next follow from each id's first and last partner.
What blocks give are sums; the identity figures are one assignment over a sequence's pairs of ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .assign import hungarian, sparse_assignment
from .runs import by_group, failures, results

ALPHAS = np.arange(1, 20) / 20


def boxes_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU matrix of xywh boxes."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    inter = np.prod(np.maximum(hi - lo, 0), axis=2)
    union = np.prod(a[:, 2:], axis=1)[:, None] + np.prod(b[:, 2:], axis=1)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


#: Frames of a block of the first pass; a block of the second begins where the first frame of such a block stands alone.
BLOCK = 512
_NOTHING = pa.table({c: pa.array([], t) for c, t in (('sequence', pa.int64()), ('block', pa.int64()), ('kind', pa.int32()), ('g', pa.int64()), ('p', pa.int64()), ('v', pa.list_(pa.float64())))})
_XYWH = ["x", "y", "w", "h"]


class Overlaps:
    """The overlapping boxes of a block's frames: pair by pair the frame, the place of the truth's and the guess's row, and the IoU."""

    def __init__(self, table: pa.Table):
        side, frame = (table[c].to_numpy() for c in ("side", "frame"))
        ids, boxes = table["id"].to_numpy(), np.column_stack([table[c].to_numpy() for c in _XYWH]).astype(float)
        self.frame, self.id, box = [], [], []
        for s in (0, 1):
            rows = np.flatnonzero(side == s)
            rows = rows[np.lexsort((ids[rows], frame[rows]))]
            self.frame.append(frame[rows])
            self.id.append(ids[rows])
            box.append(boxes[rows])
            if ((self.frame[s][1:] == self.frame[s][:-1]) & (self.id[s][1:] == self.id[s][:-1])).any():
                raise ValueError("an id twice in a frame")
        lo, hi = (np.searchsorted(self.frame[1], self.frame[0], e) for e in ("left", "right"))
        n = hi - lo
        g = np.repeat(np.arange(len(n)), n)
        p = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        a, b = box[0][g], box[1][p]
        wide = np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
        high = np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
        inter = np.maximum(wide, 0) * np.maximum(high, 0)
        union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - inter
        hit = (inter > 0) & (union > 0)
        self.g, self.p, self.iou = g[hit], p[hit], inter[hit] / union[hit]

    def frames(self) -> np.ndarray:
        return np.union1d(*self.frame)

    def undecided(self, some: np.ndarray) -> np.ndarray:
        """Of these pairs, those with an end that another of them shares. Rows are of one frame each, so the frames keep apart."""
        g, p = self.g[some], self.p[some]
        return (np.bincount(g, minlength=1)[g] > 1) | (np.bincount(p, minlength=1)[p] > 1) if len(g) else np.zeros(0, bool)


def _measured(table: pa.Table, threshold: float) -> pa.Table:
    """(g, p, potential, together) by pair of ids, and the first frame whose pairs at the threshold have no end in common."""
    x = Overlaps(table)
    rows, columns = (np.bincount(k, x.iou, minlength=len(f)) for k, f in ((x.g, x.frame[0]), (x.p, x.frame[1])))
    share = rows[x.g] + columns[x.p] - x.iou
    near = x.iou >= threshold - 1e-12
    torn = x.frame[0][x.g[near]][x.undecided(near)]
    calm = np.setdiff1d(x.frames(), torn)[:1]
    pairs, slot = np.unique(np.column_stack([x.id[0][x.g], x.id[1][x.p]]), axis=0, return_inverse=True)
    total = [np.bincount(slot.ravel(), w, minlength=len(pairs)) for w in (x.iou / share, x.iou >= threshold)]
    n, k = len(pairs), len(calm)
    columns = {"sequence": table["sequence"][0].as_py(), "part": table["part"][0].as_py()}
    lead = {c: pa.array([v] * (n + k), pa.int64()) for c, v in columns.items()}
    none = [None] * k
    return pa.table({
        **lead, "g": pa.array([*pairs[:, 0].tolist(), *none], pa.int64()), "p": pa.array([*pairs[:, 1].tolist(), *none], pa.int64()),
        "potential": pa.array([*total[0].tolist(), *none], pa.float64()), "together": pa.array([*map(int, total[1]), *none], pa.int64()), "calm": pa.array([None] * n + calm.tolist(), pa.int64()),
    })


def _best(g: np.ndarray, p: np.ndarray, gain: np.ndarray, torn: np.ndarray) -> np.ndarray:
    """Places of the pairs of the largest total gain; pairs that aren't torn share no end with others."""
    kept = np.flatnonzero(~torn)
    if torn.any():
        some = np.flatnonzero(torn)
        rows, i = np.unique(g[some], return_inverse=True)
        columns, j = np.unique(p[some], return_inverse=True)
        matrix, place = np.zeros((len(rows), len(columns))), np.full((len(rows), len(columns)), -1)
        matrix[i, j], place[i, j] = gain[some], some
        kept = np.concatenate([kept, [place[a, b] for a, b in hungarian(-matrix) if place[a, b] >= 0 and matrix[a, b] > 0]]).astype(int)
    return kept


def _matched(table: pa.Table, scores: pa.Table, threshold: float) -> pa.Table:
    """A block's rows by kind: 0 its sums (CLEAR's hits, changes of identity, HOTA's hits and their IoU by alpha), 1 the hits of a pair of
    ids by alpha, 2 an id's first and last partner."""
    x = Overlaps(table)
    known = dict(zip(zip(scores["g"].to_pylist(), scores["p"].to_pylist(), strict=True), scores["align"].to_pylist(), strict=True))
    gid, pid, frame = x.id[0][x.g], x.id[1][x.p], x.frame[0][x.g]
    align = np.array([known[k] for k in zip(gid.tolist(), pid.tolist(), strict=True)])
    near = x.iou >= threshold - 1e-12
    torn, split = x.undecided(np.ones(len(x.g), bool)), np.zeros(len(x.g), bool)
    split[near] = x.undecided(near)
    bounds = np.searchsorted(frame, x.frames(), "left"), np.searchsorted(frame, x.frames(), "right")
    hits, clear_tp, idsw = [], 0, 0
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    now: dict[int, int] = {}
    for s, e in zip(*(b.tolist() for b in bounds), strict=True):
        held: dict[int, int] = {}
        if s < e:
            hits.append(s + _best(x.g[s:e], x.p[s:e], align[s:e] * x.iou[s:e], torn[s:e]))
            some = s + np.flatnonzero(near[s:e])
            keep = np.array([now.get(a) == b for a, b in zip(gid[some].tolist(), pid[some].tolist(), strict=True)], float)
            for k in some[_best(x.g[some], x.p[some], 1000 * keep + x.iou[some], split[some])].tolist():
                a, b = int(gid[k]), int(pid[k])
                clear_tp += 1
                idsw += a in last and last[a] != b
                first.setdefault(a, b)
                last[a] = held[a] = b
        now = held
    hit = np.concatenate(hits).astype(int) if hits else np.zeros(0, int)
    reached = x.iou[hit][:, None] >= ALPHAS - 1e-12
    sums = [clear_tp, idsw, *reached.sum(axis=0), *np.where(reached, x.iou[hit][:, None], 0).sum(axis=0)]
    rows = [(0, None, None, [float(v) for v in sums])]
    pairs, slot = np.unique(np.column_stack([gid[hit], pid[hit]]), axis=0, return_inverse=True)
    counts = np.zeros((len(pairs), len(ALPHAS)))
    np.add.at(counts, slot.ravel(), reached)
    rows += [(1, int(a), int(b), c.tolist()) for (a, b), c in zip(pairs, counts, strict=True)]
    rows += [(2, a, b, [float(last[a])]) for a, b in first.items()]
    kind, g, p, values = zip(*rows, strict=True)
    lead = {c: pa.array([table[c][0].as_py()] * len(rows), pa.int64()) for c in ("sequence", "block")}
    return pa.table({**lead, "kind": pa.array(kind, pa.int32()), "g": pa.array(g, pa.int64()), "p": pa.array(p, pa.int64()), "v": pa.array(values, pa.list_(pa.float64()))})


def _identity(table: pa.Table) -> pa.Table:
    """Frames that the best one-to-one pairing of a sequence's ids shares."""
    g, i = np.unique(table["g"].to_numpy(), return_inverse=True)
    p, j = np.unique(table["p"].to_numpy(), return_inverse=True)
    order = np.lexsort((j, i))
    i, j, gain = i[order], j[order], table["together"].to_numpy()[order].astype(float)
    value = dict(zip(zip(i.tolist(), j.tolist(), strict=True), gain.tolist(), strict=True))
    total = sum(value[x] for x in sparse_assignment(np.searchsorted(i, np.arange(len(g) + 1)), j, gain, len(p)))
    return pa.table({"sequence": pa.array([table["sequence"][0].as_py()], pa.int64()), "idtp": pa.array([int(total)], pa.int64())})


def sequence_stats(truth: pd.DataFrame, guess: pd.DataFrame, threshold: float = 0.5) -> dict:
    """Sufficient statistics of one sequence at hand (frame, id, x, y, w, h), as one block."""
    lead = {"sequence": 0, "part": 0, "block": -1}
    table = pa.Table.from_pandas(pd.concat([d[["frame", "id", *_XYWH]].assign(side=s, **lead) for s, d in enumerate((truth, guess))]), preserve_index=False)
    pairs = _measured(table, threshold).to_pandas().query("calm != calm")
    ng, npr = (d.groupby("id").size() for d in (truth, guess))
    both = pairs.g.map(ng) + pairs.p.map(npr)
    rows = _matched(table, pa.Table.from_pandas(pairs.assign(align=pairs.potential / (both - pairs.potential)), preserve_index=False), threshold).to_pylist()
    sums, k = rows[0]["v"], len(ALPHAS)
    shared = pairs[pairs.together > 0]
    idtp = _identity(pa.Table.from_pandas(shared.astype({"g": int, "p": int, "together": int}), preserve_index=False))["idtp"][0].as_py() if len(shared) else 0
    hits = [(np.array(r["v"]), ng[r["g"]] + npr[r["p"]]) for r in rows if r["kind"] == 1]
    n_gt, n_pred, tp = len(truth), len(guess), np.array(sums[2 : 2 + k])
    return {
        "gt_dets": n_gt, "pred_dets": n_pred, "clear_tp": int(sums[0]), "fp": n_pred - int(sums[0]), "fn": n_gt - int(sums[0]), "idsw": int(sums[1]), "idtp": idtp, "idfp": n_pred - idtp, "idfn": n_gt - idtp,
        "hota_tp": tp.tolist(), "hota_fn": (n_gt - tp).tolist(), "hota_fp": (n_pred - tp).tolist(), "hota_ass": list(sum((c * c / np.maximum(1, n - c) for c, n in hits), np.zeros(k))), "hota_loc": sums[2 + k :],
    }


def statistics(truth: DataFrame, guesses: DataFrame, threshold: float = 0.5, isolate: bool = False) -> DataFrame:
    """One row of sufficient statistics for each sequence (long). An id twice in a frame is an error of its sequence. isolate: a
    sequence that fails gives a row with its error."""
    cols = ["sequence", "frame", "id", *_XYWH]
    both = truth.select(F.lit(0).alias("side"), *cols).unionByName(guesses.select(F.lit(1).alias("side"), *cols))
    boxes = written(both.select("side", *[F.col(c).cast("long").alias(c) for c in cols[:3]], *[F.col(c).cast("double").alias(c) for c in _XYWH]).withColumn("part", F.floor(F.col("frame") / BLOCK)))
    wrong = []

    def good(rows: DataFrame) -> DataFrame:
        if not isolate:
            return rows
        wrong.append(failures(rows, ["sequence"]))
        return results(rows)

    schema = "sequence long, part long, g long, p long, potential double, together long, calm long"
    measured = good(written(by_group(boxes, ["sequence", "part"], lambda t: _measured(t, threshold), schema, isolate)))
    if wrong:  # a sequence that failed once is left out of what follows
        boxes = boxes.join(wrong[0].select("sequence").distinct(), "sequence", "left_anti")
        measured = measured.join(wrong[0].select("sequence").distinct(), "sequence", "left_anti")
    seen = written(boxes.groupBy("sequence", "side", "id").agg(F.count("*").alias("n")))
    g, p = (seen.where(F.col("side") == s).select("sequence", F.col("id").alias(c), F.col("n").alias(f"n{c}")) for s, c in ((0, "g"), (1, "p")))
    pairs = measured.where("calm is null").groupBy("sequence", "g", "p").agg(F.sum("potential").alias("potential"), F.sum("together").alias("together"))
    scored = written(pairs.join(g, ["sequence", "g"]).join(p, ["sequence", "p"]).withColumn("align", F.col("potential") / F.greatest(F.lit(1e-12), F.col("ng") + F.col("np") - F.col("potential"))))

    earlier = Window.partitionBy("sequence").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = boxes.select("sequence", "part").distinct().join(measured.where("calm is not null").select("sequence", "part", "calm"), ["sequence", "part"], "left")
    parts = parts.withColumn("before", F.coalesce(F.last("calm", True).over(earlier), F.lit(-1).cast("long")))
    block = F.when(F.col("frame") >= F.col("calm"), F.col("calm")).otherwise(F.col("before")).alias("block")
    blocks = boxes.join(parts, ["sequence", "part"]).select("sequence", block, "side", "frame", "id", *_XYWH)
    ways = measured.where("calm is null").select("sequence", "part", "g", "p").join(parts, ["sequence", "part"])
    ways = ways.select("sequence", "g", "p", F.explode(F.array_compact(F.array_distinct(F.array("before", "calm")))).alias("block")).distinct()
    known = ways.join(scored.select("sequence", "g", "p", "align"), ["sequence", "g", "p"])
    run = lambda a, b: _matched(a, b, threshold) if a.num_rows else _NOTHING
    schema = "sequence long, block long, kind int, g long, p long, v array<double>"
    matched = good(written(by_group(blocks, ["sequence", "block"], run, schema, isolate, (known, ["sequence", "block"]))))

    k = len(ALPHAS)
    at = lambda i: F.sum(F.get("v", F.lit(i)))
    sums = matched.where("kind = 0").groupBy("sequence").agg(at(0).cast("long").alias("clear_tp"), at(1).cast("long").alias("inside"), F.array(*[at(2 + i) for i in range(k)]).alias("hota_tp"), F.array(*[at(2 + k + i) for i in range(k)]).alias("hota_loc"))
    hits = matched.where("kind = 1").groupBy("sequence", "g", "p").agg(*[at(i).alias(f"c{i}") for i in range(k)]).join(g, ["sequence", "g"]).join(p, ["sequence", "p"])
    ass = hits.groupBy("sequence").agg(F.array(*[F.sum(F.col(f"c{i}") * F.col(f"c{i}") / F.greatest(F.lit(1.0), F.col("ng") + F.col("np") - F.col(f"c{i}"))) for i in range(k)]).alias("hota_ass"))
    by_block = Window.partitionBy("sequence", "g").orderBy("block")
    across = matched.where("kind = 2").select("sequence", (F.lag(F.get("v", F.lit(0))).over(by_block) != F.col("p")).cast("long").alias("x")).groupBy("sequence").agg(F.sum("x").alias("across"))
    idtp = good(by_group(scored.where("together > 0").select("sequence", "g", "p", "together"), ["sequence"], _identity, "sequence long, idtp long", isolate))
    size = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0))
    df = seen.groupBy("sequence").agg(size(0).alias("gt_dets"), size(1).alias("pred_dets"))
    for more in (sums, ass, across, idtp):
        df = df.join(more, "sequence", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    tp, ident = zero("clear_tp"), zero("idtp")
    none = F.array(*[F.lit(0.0)] * k)
    hota = F.coalesce("hota_tp", none)
    out = df.select(
        "sequence", "gt_dets", "pred_dets", tp.alias("clear_tp"), (F.col("pred_dets") - tp).alias("fp"), (F.col("gt_dets") - tp).alias("fn"), (zero("inside") + zero("across")).alias("idsw"), ident.alias("idtp"),
        (F.col("pred_dets") - ident).alias("idfp"), (F.col("gt_dets") - ident).alias("idfn"), hota.alias("hota_tp"), F.transform(hota, lambda x: F.col("gt_dets") - x).alias("hota_fn"), F.transform(hota, lambda x: F.col("pred_dets") - x).alias("hota_fp"),
        F.coalesce("hota_ass", none).alias("hota_ass"), F.coalesce("hota_loc", none).alias("hota_loc"),
    )
    if not isolate:
        return out
    failed = wrong[0]
    for more in wrong[1:]:
        failed = failed.unionByName(more)
    failed = failed.groupBy("sequence").agg(F.min("error").alias("error"), F.min("details").alias("details"))
    return out.join(failed.select("sequence"), "sequence", "left_anti").unionByName(failed, allowMissingColumns=True)


def metrics(stats: DataFrame) -> DataFrame:
    """Metrics in percent for each sequence and, with a null sequence, over all of them."""
    scalars = ["gt_dets", "pred_dets", "clear_tp", "fp", "fn", "idsw", "idtp", "idfp", "idfn"]
    arrays = ["hota_tp", "hota_fn", "hota_fp", "hota_ass", "hota_loc"]
    total = stats.agg(*[F.sum(c).alias(c) for c in scalars], *[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(len(ALPHAS))]).alias(c) for c in arrays])
    df = stats.select("sequence", *scalars, *arrays).unionByName(total.withColumn("sequence", F.lit(None).cast("long")))

    def ratio(a, b):
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))

    at = [(F.get("hota_tp", F.lit(i)), F.get("hota_fn", F.lit(i)), F.get("hota_fp", F.lit(i)), F.get("hota_ass", F.lit(i))) for i in range(len(ALPHAS))]
    det, ass = [ratio(t, t + n + p) for t, n, p, _ in at], [ratio(a, t) for t, _, _, a in at]

    def mean(xs):
        return F.round(100 * sum(xs[1:], xs[0]) / len(xs), 3)

    return df.select(
        "sequence", mean([F.sqrt(d * a) for d, a in zip(det, ass, strict=True)]).alias("HOTA"), mean(det).alias("DetA"), mean(ass).alias("AssA"), F.round(100 * ratio(F.col("clear_tp") - F.col("fp") - F.col("idsw"), F.col("gt_dets")), 3).alias("MOTA"), F.round(100 * ratio(2 * F.col("idtp"), 2 * F.col("idtp") + F.col("idfp") + F.col("idfn")), 3).alias("IDF1"), "fp", "fn", "idsw"
    )
