"""Trackers over detections, frame by frame within a video: a registry of classes with one protocol.

step(boxes, scores, features, frame, ids) -> list of (row, track id) for one frame; boxes are xyxy arrays. features are
unit vectors, a zero vector where a detection has none, or None if no detection has one. frame is the frame's number
(null: one after the last), ids are the detector's own ids or None."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from .assign import hungarian
from .mot import boxes_iou
from .runs import by_group, vector_rows

_BOX = ("x1", "y1", "x2", "y2")
SCHEMA = "video_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, confidence double"


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU matrix of xyxy boxes."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    wh = lambda x: np.column_stack([x[:, :2], np.maximum(x[:, 2:] - x[:, :2], 0)])
    return boxes_iou(wh(a), wh(b))


def assigned(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of the best total score, those under least dropped afterwards."""
    return [(i, j) for i, j in hungarian(-score) if score[i, j] >= least] if score.size else []


def seen(feature: np.ndarray | None) -> np.ndarray | None:
    """The vector, or None for a zero vector."""
    return feature if feature is not None and feature.any() else None


def likeness(features: np.ndarray, tracks: list[_Track]) -> np.ndarray:
    """Cosine matrix of detections and tracks; nan where either has no vector."""
    known = np.array([t.feature if t.feature is not None else np.zeros(features.shape[1]) for t in tracks]).reshape(-1, features.shape[1])
    return np.where(features.any(axis=1)[:, None] & known.any(axis=1)[None], features @ known.T, np.nan)


class Kalman:
    """A linear filter that keeps its state before and after a measurement apart: a correction without a prediction
    starts from the state that was predicted last."""

    def __init__(self, move: np.ndarray, process: float | np.ndarray, noise: np.ndarray, spread: float, state: np.ndarray):
        n = len(state)
        self.move, self.seen = move, np.eye(4, n)
        self.process, self.noise = process * np.eye(n), noise
        self.state, self.cov = state, spread * np.eye(n)
        self.ahead, self.ahead_cov = state, np.zeros((n, n))

    def predict(self) -> np.ndarray:
        self.state = self.ahead = self.move @ self.state
        self.cov = self.ahead_cov = self.move @ self.cov @ self.move.T + self.process
        return self.state

    def correct(self, z: np.ndarray) -> None:
        gain = self.ahead_cov @ self.seen.T @ np.linalg.inv(self.seen @ self.ahead_cov @ self.seen.T + self.noise)
        self.state = self.ahead + gain @ (z - self.seen @ self.ahead)
        self.cov = self.ahead_cov - gain @ self.seen @ self.ahead_cov


#: Shortest side, area and aspect; process noise of positions and of velocities, noise of position and of
#: shape, first spread of the filter over area and aspect; process noise, noise and spread of that over width and height.
TINY = 1e-3
SHAPE_PROCESS, SHAPE_NOISE, SHAPE_SPREAD = (1.0, 0.01), (1.0, 10.0), 10.0
SIZE_PROCESS, SIZE_NOISE, SIZE_SPREAD = 0.5, 0.05, 1.0


class ShapeFilter(Kalman):
    """Centre, area and aspect with velocities of all but the aspect."""

    def __init__(self, box: np.ndarray):
        process = np.repeat(SHAPE_PROCESS, (4, 3))
        super().__init__(np.eye(7) + np.eye(7, k=4), process, np.diag(np.repeat(SHAPE_NOISE, 2)), SHAPE_SPREAD, np.concatenate([self.measure(box), np.zeros(3)]))

    @staticmethod
    def measure(b: np.ndarray) -> np.ndarray:
        w, h = max(b[2] - b[0], TINY), max(b[3] - b[1], TINY)
        return np.array([b[0] + w / 2, b[1] + h / 2, w * h, w / h])

    def box(self) -> np.ndarray:
        x, y, area, aspect = self.state[:4]
        area = max(area, TINY)
        w = np.sqrt(area * max(aspect, TINY))
        return np.array([x - w / 2, y - area / w / 2, x + w / 2, y + area / w / 2])


class SizeFilter(Kalman):
    """Centre, width and height; the vertical velocity also moves width and height."""

    def __init__(self, box: np.ndarray):
        move = np.eye(6)
        move[0, 4] = move[1, 5] = move[2, 5] = move[3, 5] = 1
        super().__init__(move, SIZE_PROCESS, SIZE_NOISE * np.eye(4), SIZE_SPREAD, np.concatenate([self.measure(box), np.zeros(2)]))

    @staticmethod
    def measure(b: np.ndarray) -> np.ndarray:
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])

    def box(self) -> np.ndarray:
        x, y, w, h = self.state[:4]
        return np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2])


class _Track:
    def __init__(self, ident: int, filter: Kalman, box: np.ndarray, feature: np.ndarray | None):
        self.id, self.filter, self.streak, self.missed, self.feature, self.last = ident, filter, 0, 0, seen(feature), box

    def predict(self) -> np.ndarray:
        self.filter.predict()
        self.streak = 0 if self.missed else self.streak
        self.missed += 1
        return self.filter.box()

    def see(self, box: np.ndarray, feature: np.ndarray | None, alpha: float = 0.30) -> None:
        self.filter.correct(self.filter.measure(box))
        self.streak, self.missed, self.last = self.streak + 1, 0, box
        feature = seen(feature)
        if feature is not None:
            blend = feature if self.feature is None else (1 - alpha) * self.feature + alpha * feature
            n = np.linalg.norm(blend)
            self.feature = blend / n if n > 0 else blend


class _Tracker:
    def __init__(self, max_age: int, min_hits: int):
        self.tracks: list[_Track] = []
        self.max_age, self.min_hits, self.next_id, self.frame, self.first_frame = max_age, min_hits, 1, 0, None

    def begin(self, frame: int | None) -> np.ndarray:
        """The tracks' boxes as they are expected in this frame."""
        self.frame = self.frame + 1 if frame is None else int(frame)
        self.first_frame = self.frame if self.first_frame is None else self.first_frame
        return np.array([t.predict() for t in self.tracks]).reshape(-1, 4)

    def start(self, box: np.ndarray, feature: np.ndarray | None) -> _Track:
        t = _Track(self.next_id, ShapeFilter(box), box, feature)
        t.see(box, feature)
        self.next_id += 1
        self.tracks.append(t)
        return t

    def finish(self, hits: list[tuple[int, _Track]]) -> list[tuple[int, int]]:
        """Old tracks go; those seen in this frame count after min_hits frames in a row, or among the first frames."""
        self.tracks = [t for t in self.tracks if t.missed <= self.max_age]
        young = self.frame <= self.first_frame + self.min_hits
        return sorted((int(i), t.id) for i, t in hits if young or t.streak >= self.min_hits)


class Sort(_Tracker):
    """One stage of IoU assignment."""

    def __init__(self, max_age: int = 20, min_hits: int = 3, iou_threshold: float = 0.3):
        super().__init__(max_age, min_hits)
        self.iou_threshold = iou_threshold

    def step(self, boxes, scores, features, frame=None, ids=None):
        pairs = assigned(iou(boxes, self.begin(frame)), self.iou_threshold)
        hits = [(i, self.tracks[j]) for i, j in pairs]
        for i, t in hits:
            t.see(boxes[i], None)
        rest = sorted(set(range(len(boxes))) - {i for i, _ in pairs})
        return self.finish(hits + [(i, self.start(boxes[i], None)) for i in rest])


class Byte(_Tracker):
    """Confident detections first, then the others for the tracks that are left; only very confident ones start a track."""

    def __init__(self, high: float = 0.6, low: float = 0.1, new: float = 0.7, max_age: int = 30, min_hits: int = 1, iou_threshold: float = 0.3):
        super().__init__(max_age, min_hits)
        self.high, self.low, self.new, self.iou_threshold = high, low, new, iou_threshold

    def first_stage(self, boxes, features, predicted) -> list[tuple[int, int]]:
        return assigned(iou(boxes, predicted), self.iou_threshold)

    def step(self, boxes, scores, features, frame=None, ids=None):
        predicted = self.begin(frame)
        strong, weak = np.flatnonzero(scores >= self.high), np.flatnonzero((scores < self.high) & (scores >= self.low))
        feature = lambda i: None if features is None else features[i]
        pairs = [(strong[i], j) for i, j in self.first_stage(boxes[strong], feature(strong), predicted)]
        free = [j for j in range(len(self.tracks)) if j not in {j for _, j in pairs}]
        pairs += [(weak[i], free[j]) for i, j in assigned(iou(boxes[weak], predicted[free]), self.iou_threshold)]
        hits = [(i, self.tracks[j]) for i, j in pairs]
        for i, t in hits:
            t.see(boxes[i], feature(i))
        rest = [i for i in strong if i not in {i for i, _ in pairs} and scores[i] >= self.new]
        return self.finish(hits + [(i, self.start(boxes[i], feature(i))) for i in rest])


class BotSort(Byte):
    """As Byte; the first stage weighs overlap and appearance, and a like appearance can stand in for overlap. As many
    admitted pairs are made as there can be."""

    def __init__(self, high: float = 0.6, new: float = 0.6, max_age: int = 25, appearance: float = 0.70, weight: float = 0.60, **options):
        super().__init__(high=high, new=new, max_age=max_age, **options)
        self.appearance, self.weight = appearance, weight

    def first_stage(self, boxes, features, predicted):
        overlap = iou(boxes, predicted)
        if not overlap.size:
            return []
        cos = np.full_like(overlap, np.nan) if features is None else likeness(features, self.tracks)
        cost = np.where(np.isnan(cos), 1 - overlap, self.weight * (1 - overlap) + (1 - self.weight) * (1 - cos))
        admitted = (overlap >= self.iou_threshold) | (cos >= self.appearance)
        return [(i, j) for i, j in hungarian(np.where(admitted, cost, 1e6)) if admitted[i, j]]


class Stable:
    """Stable ids. First a detector's own id keeps its stable one while the boxes overlap; then IoU and appearance decide
    together, also about tracks that were lost, whose boxes are predicted; the rest are new. Lost tracks never go."""

    def __init__(self, same: float = 0.5, least_iou: float = 0.08, least_cos: float = 0.70, weight: float = 0.60, max_age: int = 20):
        self.same, self.least_iou, self.least_cos, self.weight, self.max_age = same, least_iou, least_cos, weight, max_age
        self.active: dict[int, _Track] = {}
        self.lost: dict[int, _Track] = {}
        self.known: dict[int, int] = {}  # detector's id to stable id
        self.next_id, self.frame = 1, 0

    @property
    def tracks(self) -> list[_Track]:
        return [*self.active.values(), *self.lost.values()]

    def _see(self, i, t, boxes, features, ids) -> tuple[int, int]:
        self.active[t.id] = self.lost.pop(t.id, t)
        t.see(boxes[i], None if features is None else features[i])
        t.seen_at, t.own = self.frame, None if ids is None else ids[i]
        if ids is not None:
            self.known[ids[i]] = t.id
        return i, t.id

    def step(self, boxes, scores, features, frame=None, ids=None):
        self.frame = self.frame + 1 if frame is None else int(frame)
        out, rest = [], []
        for i in range(len(boxes)):
            k = None if ids is None else self.known.get(ids[i])
            t = self.active.get(k)
            if t is not None and iou(boxes[i : i + 1], t.last[None])[0, 0] < self.same:
                self.known.pop(ids[i])
                k = None
            if k is None:
                rest.append(i)
            else:
                out.append(self._see(i, t or self.lost[k], boxes, features, ids))
        if rest:
            taken = {k for _, k in out}
            for t in self.lost.values():
                t.filter.predict()
            options = [t for k, t in self.active.items() if k not in taken] + list(self.lost.values())
            where = np.array([t.filter.box() if t.id in self.lost else t.last for t in options]).reshape(-1, 4)
            o = iou(boxes[rest], where)
            c = np.full_like(o, np.nan) if features is None else likeness(features[rest], options)
            matched = set()
            for i, j in hungarian(np.where(np.isnan(c), 1 - o, self.weight * (1 - o) + (1 - self.weight) * (1 - c))):
                if o[i, j] >= self.least_iou or c[i, j] >= self.least_cos:
                    self.known.pop(options[j].own, None)
                    out.append(self._see(rest[i], options[j], boxes, features, ids))
                    matched.add(rest[i])
            for i in rest:
                if i not in matched:
                    t = _Track(self.next_id, SizeFilter(boxes[i]), boxes[i], None)
                    self.next_id += 1
                    out.append(self._see(i, t, boxes, features, ids))
        for k in [k for k, t in self.active.items() if self.frame - t.seen_at > self.max_age]:
            self.lost[k] = self.active.pop(k)
        return sorted(out)


METHODS = {"sort": Sort, "bytetrack": Byte, "botsort": BotSort, "stable": Stable}


def register(name: str, tracker: type) -> None:
    METHODS[name] = tracker


def stepped(tracker, video: int, rows: list[tuple]) -> list[tuple]:
    """The rows that a tracker keeps, with their ids (SCHEMA), frame after frame. rows: frame, box, confidence, feature or None and
    the detector's id or None. Rows of a frame are in the order of their values, whatever order they come in."""
    if any(r[0] is None for r in rows):
        raise ValueError("a detection without a frame")
    size = max((len(r[6]) for r in rows if r[6] is not None), default=0)
    features = np.array([r[6] if r[6] is not None else [0.0] * size for r in rows]).reshape(len(rows), size)
    with_features, with_ids = any(r[6] is not None for r in rows), any(r[7] is not None for r in rows)
    numbers = np.array([[np.nan if x is None else x for x in r[:6]] for r in rows], float).reshape(-1, 6)
    own = np.array([-1 if r[7] is None else r[7] for r in rows], np.int64)
    order = np.lexsort((*features.T[::-1], own, numbers[:, 5], *numbers[:, 4:0:-1].T, numbers[:, 0]))
    frames, out = numbers[order, 0], []
    starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(frames) else []
    for s, e in zip(starts, [*starts[1:], len(frames)], strict=True):
        some = order[s:e]
        ids = [rows[i][7] for i in some] if with_ids else None
        hits = tracker.step(numbers[some, 1:5], numbers[some, 5], features[some] if with_features else None, int(frames[s]), ids)
        out += [(video, int(frames[s]), int(t), *numbers[some[i], 1:].tolist()) for i, t in hits]
    return out


def tracked(detections: DataFrame, method: str, vector: str | None = None, detector: str | None = None, isolate: bool = False, **options) -> DataFrame:
    """Detections with the ids that a tracker gives them; others go. detections: video_id, frame, x1..y2, confidence;
    vector names a column of appearance vectors (null: not known), detector one of the detector's own ids. A video is one
    group; its detections are its only state. isolate: a video that fails gives a row with its error."""
    make = METHODS[method]
    names = ["frame", *_BOX, "confidence", "feature", "own"]

    def run(table: pa.Table) -> pa.Table:
        read = lambda c: list(vector_rows(table[c])) if c == "feature" else table[c].to_pylist()
        columns = [read(c) if c in table.column_names else [None] * table.num_rows for c in names]
        done = stepped(make(**options), table["video_id"][0].as_py(), list(zip(*columns, strict=True)))
        kinds = [pa.int64()] * 3 + [pa.float64()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * 8, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    extra = [normalized(F.col(vector).cast("array<double>")).alias("feature")] if vector else []
    extra += [F.col(detector).cast("long").alias("own")] if detector else []
    numbers = [F.col(c).cast("long" if c in ("video_id", "frame") else "double").alias(c) for c in ("video_id", "frame", *_BOX, "confidence")]
    return by_group(detections.select(*numbers, *extra), ["video_id"], run, SCHEMA, isolate)
