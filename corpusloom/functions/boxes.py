"""Location bins of boxes and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 1000


def quantised(value: Column, size: Column, bins: int = BINS) -> Column:
    """Bin of a coordinate, within the range of bins."""
    return F.least(F.greatest(F.floor(value / (size / F.lit(bins).cast("double"))), F.lit(0)), F.lit(bins - 1)).cast("int")


def quantised_all(points: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    """Bins of x, y, x, y ... coordinates."""
    return F.transform(points, lambda v, i: quantised(v, F.when(i % 2 == 0, width).otherwise(height), bins))


def dequantised(bin_: Column, size: Column, bins: int = BINS) -> Column:
    """Middle of a bin."""
    return (bin_ + 0.5) * (size / F.lit(bins).cast("double"))


def dequantised_all(locations: Column, width: Column, height: Column, bins: int = BINS) -> Column:
    """x, y, x, y ... of an array of bins."""
    return F.transform(locations, lambda b, i: dequantised(b, F.when(i % 2 == 0, width).otherwise(height), bins))


def quad_area(quad: Column, compat: bool = False) -> Column:
    """Shoelace area of x1, y1 ... x4, y4; with compat the closing edge is missing."""
    edge = lambda i, j: quad[2 * i] * quad[2 * j + 1] - quad[2 * j] * quad[2 * i + 1]
    total = edge(0, 1) + edge(1, 2) + edge(2, 3)
    return 0.5 * F.abs(total if compat else total + edge(3, 0))
