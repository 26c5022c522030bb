"""Times, frames and intervals as Column expressions. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_of(time: Column, fps: Column) -> Column:
    return F.rint(time * fps).cast("long")


def first_frame(start: Column, fps: Column) -> Column:
    return F.floor(start * fps).cast("long")


def last_frame(end: Column, fps: Column) -> Column:
    return F.ceil(end * fps).cast("long")


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull; 0 where the hull is empty."""
    overlap = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap / F.when(hull > 0, hull)).otherwise(F.lit(0.0))


def evenly(n: Column, count: Column) -> Column:
    """Distinct indices 0..n-1 of count evenly spaced samples, both ends included; ascending."""
    k = F.least(n, count)
    step = (n - 1) / F.greatest(k - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), lambda i: F.rint(i * step).cast("long")))


def window_starts(start: Column, end: Column, length: float = 2.0, stride: float = 1.0, tolerance: float = 1e-6) -> Column:
    """Starts of sliding windows over [start, end]; the last one ends at end, short events get one."""
    last = end - length
    count = F.floor((last - start) / stride + tolerance).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: start + i * stride)
    tail = F.when(F.element_at(grid, -1) < last - tolerance, F.array(last)).otherwise(F.array().cast("array<double>"))
    return F.when(last <= start + tolerance, F.array(start)).otherwise(F.concat(grid, tail))
