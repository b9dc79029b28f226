"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of equally long arrays, in double precision."""
    return np.array(column.tolist(), np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, the same bits for the same vectors anywhere."""

    def plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = np.array([float((x * y).sum()) for x, y in zip(a, b, strict=True)])
        return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))

    with np.errstate(all="ignore"):
        out = plain(a, b)
    # vectors so long or short that their squares don't fit
    top = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
    odd = ~((top[0] > 1e-100) & (top[0] < 1e100) & (top[1] > 1e-100) & (top[1] < 1e100))
    if odd.any():
        out[odd] = plain(a[odd] / top[0][odd, None], b[odd] / top[1][odd, None])
    return out
