"""The model stage: batched, Arrow-fed scoring behind a small protocol, with a deterministic stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


class Encoder(Protocol):
    def encode(self, batch: pd.DataFrame) -> np.ndarray: ...


class HashEncoder:
    """Unit vectors that follow from a row's key alone."""

    def __init__(self, size: int = 16):
        self.size = size

    def encode(self, batch: pd.DataFrame) -> np.ndarray:
        rows = [np.frombuffer(hashlib.shake_128(repr(tuple(r)).encode()).digest(2 * self.size), "<i2") / 32768 for r in batch.itertuples(index=False)]
        v = np.array(rows).reshape(-1, self.size)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def encoded(df: DataFrame, keys: list[str], make: Callable[[], Encoder], size: int = 1024) -> DataFrame:
    """df's keys with a vector each. Filter first: Spark pushes nothing through this stage. The encoder is made once
    in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                yield part.assign(v=list(encoder.encode(part)))

    ship(df.sparkSession)
    rows = df.select(*keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{types}, v array<double>")
