"""Outlier detection. Every operator adds ``is_outlier`` (TRUE = outlier)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import array_median, magnitude, without
from driftgrid.scale import attach
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, box_sums, neighbourhoods, own, spread


def constant_threshold(field: DataFrame, vel_min: float, vel_max: float) -> DataFrame:
    m = magnitude()
    return field.withColumn("is_outlier", (m < F.lit(float(vel_min))) | (m > F.lit(float(vel_max))))


def adaptive_global(field: DataFrame, n_sigma: float, scope: str = "dataset", keys=FRAME) -> DataFrame:
    """Magnitude outside mean ± ``n_sigma`` population deviations of the scope.

    ``dataset`` pools all rows (two scalars, read by scalar subqueries);
    ``frame`` uses each frame's own statistics.
    """
    m, n = magnitude(), F.lit(float(n_sigma))
    if scope == "dataset":
        mean = field.agg(F.avg(m)).scalar()
        std = field.agg(F.stddev_pop(m)).scalar()
        return field.withColumn("is_outlier", (m < mean - n * std) | (m > mean + n * std))
    if scope != "frame":
        raise ValueError(f"scope must be 'dataset' or 'frame', got {scope!r}")
    stats = field.groupBy(*keys).agg(F.avg(m).alias("_mean"), F.stddev_pop(m).alias("_std"))
    low, high = F.col("_mean") - n * F.col("_std"), F.col("_mean") + n * F.col("_std")
    return attach(field, stats, keys).withColumn("is_outlier", (m < low) | (m > high)).drop("_mean", "_std")


# The ``*_within`` forms work on a table that is already spread over tiles.


def adaptive_local_within(tiled: DataFrame, n_sigma: float, radius: int = 1, keys=FRAME) -> DataFrame:
    area = float((2 * radius + 1) ** 2)
    tiled = tiled.withColumn("_m", magnitude())
    tiled = tiled.withColumns({"_s": F.col("_m"), "_ss": F.col("_m") * F.col("_m")})
    tiled = box_sums(tiled, ["_s", "_ss"], radius, keys)
    mean = F.col("_s") / area
    std = F.sqrt(F.greatest(F.col("_ss") / area - mean * mean, F.lit(0.0)))
    reach = F.lit(float(n_sigma)) * std
    flag = (F.col("_m") < mean - reach) | (F.col("_m") > mean + reach)
    return tiled.withColumn("is_outlier", flag).drop("_m", "_s", "_ss")


def adaptive_local(
    field: DataFrame, n_sigma: float, radius: int = 1, keys=FRAME, tile: int = TILE
) -> DataFrame:
    """Magnitude outside mean ± ``n_sigma`` deviations of its window.

    Pixels beyond the frame count as 0, so the window always has ``(2r+1)**2`` values.
    """
    return own(adaptive_local_within(spread(field, radius, keys, tile), n_sigma, radius, keys), tile)


def _scores_within(tiled: DataFrame, epsilon: float, radius: int, keys) -> DataFrame:
    size = (2 * radius + 1) ** 2
    tiled = neighbourhoods(tiled, ["u", "v"], radius, keys)
    for c in ("u", "v"):
        others = without(F.col(f"{c}_nb"), size // 2, size)
        tiled = tiled.withColumn(f"{c}_nb", others).withColumn(f"{c}_med", array_median(F.col(f"{c}_nb"), size - 1))
        residual = F.transform(f"{c}_nb", lambda z: F.coalesce(F.abs(z - F.col(f"{c}_med")), F.lit(float("nan"))))
        level = array_median(residual, size - 1) + F.lit(float(epsilon))
        tiled = tiled.withColumn(f"score_{c}", F.abs(F.col(c) - F.col(f"{c}_med")) / level)
    return tiled.drop("u_nb", "v_nb", "u_med", "v_med")


def median_scores(
    field: DataFrame, epsilon: float = 0.1, radius: int = 1, keys=FRAME, tile: int = TILE
) -> DataFrame:
    """Normalised median residual of both channels (``score_u``, ``score_v``)."""
    return own(_scores_within(spread(field, radius, keys, tile), epsilon, radius, keys), tile)


def median_test_within(
    tiled: DataFrame, r_threshold: float = 2.0, epsilon: float = 0.1, radius: int = 1, keys=FRAME
) -> DataFrame:
    if radius == 0:
        raise ValueError("the median test needs neighbours: radius must be at least 1")
    limit = F.lit(float(r_threshold))
    scored = _scores_within(tiled, epsilon, radius, keys)
    flag = (F.col("score_u") > limit) | (F.col("score_v") > limit)
    return scored.withColumn("is_outlier", flag).drop("score_u", "score_v")


def median_test(
    field: DataFrame,
    r_threshold: float = 2.0,
    epsilon: float = 0.1,
    radius: int = 1,
    keys=FRAME,
    tile: int = TILE,
) -> DataFrame:
    """Universal median test: outlier when either channel's score exceeds the threshold."""
    return own(median_test_within(spread(field, radius, keys, tile), r_threshold, epsilon, radius, keys), tile)
