"""Counting tables of fixed size: partial tables of tasks, cut into compressed parts."""

from __future__ import annotations

import zlib

import numpy as np

PART = 1 << 16


def table_parts(total: np.ndarray) -> list[tuple[int, bytes]]:
    """A counting table cut into compressed parts, empty ones left out."""
    cut = ((k, total[k * PART : (k + 1) * PART]) for k in range(len(total) // PART))
    return [(k, zlib.compress(c.astype("<u4").tobytes(), 1)) for k, c in cut if c.any()]
