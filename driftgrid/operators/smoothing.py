"""Spatial smoothing of vector fields; ``u`` and ``v`` are treated independently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import array_median, gaussian_weights
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, neighbourhoods, own, separable_within, spread

CHANNELS = ("u", "v")


# The ``*_within`` forms work on a table that is already spread over tiles, so
# that a chain of them shares one exchange whose halo is the sum of their radii.


def gaussian_radius(sigma: float, truncate: float = 4.0) -> int:
    return len(gaussian_weights(sigma, truncate)) // 2


def gaussian_within(tiled: DataFrame, sigma: float, truncate: float = 4.0, keys=FRAME) -> DataFrame:
    w = gaussian_weights(sigma, truncate)
    return separable_within(tiled, CHANNELS, w, w, keys, "zero")


def gaussian(field: DataFrame, sigma: float, truncate: float = 4.0, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Gaussian smoothing with zero padding, as two one-dimensional passes."""
    tiled = spread(field, gaussian_radius(sigma, truncate), keys, tile)
    return own(gaussian_within(tiled, sigma, truncate, keys), tile)


def average_within(tiled: DataFrame, radius: int, keys=FRAME) -> DataFrame:
    size = 2 * radius + 1
    w = [1.0 / size] * size
    return separable_within(tiled, CHANNELS, w, w, keys, "edge")


def average(field: DataFrame, radius: int, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Mean of the ``(2r+1)**2`` window with edge padding."""
    return own(average_within(spread(field, radius, keys, tile), radius, keys), tile)


def median_within(tiled: DataFrame, radius: int = 3, keys=FRAME) -> DataFrame:
    size = (2 * radius + 1) ** 2
    around = neighbourhoods(tiled, CHANNELS, radius, keys)
    smoothed = {c: array_median(F.col(f"{c}_nb"), size) for c in CHANNELS}
    return around.withColumns(smoothed).drop(*[f"{c}_nb" for c in CHANNELS])


def median(field: DataFrame, radius: int = 3, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Median of the ``(2r+1)**2`` window with zero padding."""
    return own(median_within(spread(field, radius, keys, tile), radius, keys), tile)
