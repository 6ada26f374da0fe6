"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(u="u", v="v") -> Column:
    u, v = (F.col(c) if isinstance(c, str) else c for c in (u, v))
    return F.sqrt(u * u + v * v)


def missing(*values) -> Column:
    """Whether any value is NULL or NaN; both mean that there is no measurement."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull() | F.coalesce(F.isnan(c), F.lit(False))
    return out


def at_least(value: Column, low) -> Column:
    """The larger of the two. ``greatest`` would put the bound in a missing value's place."""
    return F.when(~missing(value), F.greatest(value, low if isinstance(low, Column) else F.lit(float(low)))).otherwise(value)


def at_most(value: Column, high) -> Column:
    """The smaller of the two; a missing value stays as it is."""
    return F.when(~missing(value), F.least(value, high if isinstance(high, Column) else F.lit(float(high)))).otherwise(value)


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` within the bounds; a missing value stays as it is."""
    return F.when(~missing(value), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))).otherwise(value)


def floor_int(value: Column) -> Column:
    return F.floor(value).cast("int")


def array_median(values: Column, size: int) -> Column:
    """Median of an array of known length; an even length averages the middle two."""
    ordered = F.sort_array(values)
    if size % 2:
        return F.get(ordered, F.lit(size // 2))
    return (F.get(ordered, F.lit(size // 2 - 1)) + F.get(ordered, F.lit(size // 2))) / 2.0


def without(values: Column, position: int, size: int) -> Column:
    """The array without the element at ``position`` (0-based)."""
    return F.concat(F.slice(values, 1, position), F.slice(values, position + 2, size - position - 1))


def mix(identifier, seed: int) -> Column:
    """Reproducible pseudo-random integer in [0, 2**32) from an id and a seed.

    It depends on the two values only, never on partitioning or order, and
    stays inside 64 bits for every non-negative id and 0 <= seed < 2**31.
    """
    if not 0 <= seed < 2**31:
        raise ValueError(f"seed must be in [0, 2**31), got {seed}")
    ident = F.col(identifier) if isinstance(identifier, str) else identifier
    low = ident.cast("long") % F.lit(2147483648)
    return (low * F.lit(2654435761) + F.lit(seed).cast("long") * F.lit(40503)) % F.lit(4294967296)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised one-dimensional Gaussian; its outer product is the 2-D kernel."""
    if sigma <= 0 or truncate <= 0:
        raise ValueError("sigma and truncate must be positive")
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-(d * d) / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


# Moves values that lie exactly half-way between two roundings (fractions of
# powers of two and ten do) off the boundary, where engines would disagree.
NUDGE = 3.7e-9


def rounded(value, digits: int = 6) -> Column:
    """Rounded double with negative zero removed, for comparing results across engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(NUDGE), digits) + F.lit(0.0)
