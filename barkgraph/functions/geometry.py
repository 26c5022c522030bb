"""Boxes as Column expressions. A box is four columns x1, y1, x2, y2 with a common prefix or suffix."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")))


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y2 - b.y1)


def area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / F.when(union > 0, union)).otherwise(F.lit(0.0))


def diagonal(b: Box) -> Column:
    return F.hypot(b.x2 - b.x1, b.y2 - b.y1)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2


def edge_gap(a: Box, b: Box) -> Column:
    """Distance between the boxes' nearest edges; 0 where they touch or overlap."""
    dx = F.greatest(F.lit(0.0), a.x1 - b.x2, b.x1 - a.x2)
    dy = F.greatest(F.lit(0.0), a.y1 - b.y2, b.y1 - a.y2)
    return F.hypot(dx, dy)


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def smaller_diagonal(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(EPS), F.least(diagonal(a), diagonal(b)))


def normalized_edge_gap(a: Box, b: Box) -> Column:
    return edge_gap(a, b) / smaller_diagonal(a, b)


def normalized_center_distance(a: Box, b: Box) -> Column:
    return center_distance(a, b) / smaller_diagonal(a, b)


def intersection_over_smaller(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.lit(EPS), F.least(area(a), area(b)))


def area_ratio(a: Box, b: Box) -> Column:
    return F.least(area(a), area(b)) / F.greatest(F.lit(EPS), area(a), area(b))


def xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1


def clamp(b: Box, frame_width: Column, frame_height: Column) -> Box:
    """Floor the near and ceil the far edges, within the frame."""

    def within(c: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(c.cast("long"), most.cast("long"))).cast("long")

    return Box(within(F.floor(b.x1), frame_width), within(F.floor(b.y1), frame_height), within(F.ceil(b.x2), frame_width), within(F.ceil(b.y2), frame_height))


def padded_crop(b: Box, fraction: float, frame_width: Column, frame_height: Column, least: float = 2.0) -> Box:
    """The crop around a box with a margin of a share of its size, at least `least` pixels."""
    px, py = F.greatest(F.lit(least), (b.x2 - b.x1) * fraction), F.greatest(F.lit(least), (b.y2 - b.y1) * fraction)
    return clamp(Box(b.x1 - px, b.y1 - py, b.x2 + px, b.y2 + py), frame_width, frame_height)
