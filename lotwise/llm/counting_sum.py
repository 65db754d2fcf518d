"""The sum of partial counting tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lotwise.llm.counting import PART


def table_sum(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of partial tables (part, counts), as 8 times the binary logarithm of 1 and the count: Spark adds them up part
    by part; the result has a fixed size of a byte for each counter."""
    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PART, np.int64)
        for f in frames:
            for raw in f["counts"]:
                total += np.frombuffer(zlib.decompress(raw), "<u4")
        scaled = np.minimum(np.round(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
        yield pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(scaled.tobytes(), 1)]})

    out = np.zeros(size, np.uint8)
    for r in parts.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return out
