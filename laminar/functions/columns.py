"""Column expressions whose defaults differ between engines, written once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def truncated(x: Column) -> Column:
    """Towards zero, as a long."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def floor_div(x: Column, by: int) -> Column:
    """Floor of a quotient, for negative numbers too."""
    return F.floor(x / F.lit(by)).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def running_median(x: Column, frame: WindowSpec) -> Column:
    """Median over a row frame; even counts average the middle two."""
    sorted_ = F.array_sort(F.collect_list(x).over(frame))
    n = F.size(sorted_)
    low = F.element_at(sorted_, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(sorted_, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def closed_bucket(x: Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin from 0, the last one closed on the right; null outside.

    Values within 1e-9 bins of an edge count as on it."""
    k = F.floor(F.round((x - low) * bins / (high - low), 9)).cast("long")
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(bins - 1)))


def hue(k: Column) -> Column:
    """Golden-ratio hue in [0, 1) of an ordinal."""
    return F.pmod(k * 0.6180339887498949, F.lit(1.0))


def packed(parts: list[tuple[Column, int]]) -> Column:
    """Whole numbers packed into one long, first part highest; a number outside its bits (or null) is an error."""
    node = F.lit(0).cast("long")
    fits = F.lit(True)
    for value, bits in parts:
        fits = fits & value.between(0, (1 << bits) - 1)
        node = node * (1 << bits) + value
    return F.when(fits, node).otherwise(F.raise_error(F.lit("a number is too large for a packed id")).cast("long"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of numbers, null if either holds a null or they differ in length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(dot(a, a))
