"""Projections and filters that look at one pixel only (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import at_least, clip, magnitude
from driftgrid.scale import attach
from driftgrid.schema import FRAME

# Largest code of each quantised type (fixed values).
CODE_MAX = {"uint8": 255, "uint4": 15}


def background_suppression(image: DataFrame, threshold: float = 0.0) -> DataFrame:
    if threshold <= 0:
        return image
    return image.withColumn("i", at_least(F.col("i") - F.lit(float(threshold)), 0.0))


def crop(
    table: DataFrame,
    shape: tuple[int, int],
    target_height: int,
    target_width: int,
    fraction_v: float = 0.5,
    fraction_h: float = 0.5,
) -> DataFrame:
    """Keep a window of the frame and move its corner to (0, 0).

    The range test is on stored columns, so files sorted by ``y, x`` are skipped.
    """
    height, width = shape
    if target_height > height or target_width > width:
        raise ValueError("the crop is larger than the frame")
    top = int((height - target_height) * fraction_v)
    left = int((width - target_width) * fraction_h)
    kept = table.where(
        F.col("y").between(top, top + target_height - 1) & F.col("x").between(left, left + target_width - 1)
    )
    return kept.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def decimate(table: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel in both directions, re-indexed."""
    if factor < 1:
        raise ValueError("factor must be a positive integer")
    kept = table.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0))
    return kept.withColumns({a: F.floor(F.col(a) / factor).cast("int") for a in ("y", "x")})


def with_magnitude(field: DataFrame) -> DataFrame:
    return field.withColumn("mag", magnitude())


def normalized_magnitude(
    field: DataFrame, low: float | None = None, high: float | None = None, keys=FRAME
) -> DataFrame:
    """Magnitude scaled to [0, 1]; the default bounds are the frame's own extremes plus 1e-6."""
    sized = field.withColumn("mag", magnitude())
    if low is None or high is None:
        extremes = field.groupBy(*keys).agg(
            (F.min(magnitude()) + F.lit(1e-6)).alias("_lo"), (F.max(magnitude()) + F.lit(1e-6)).alias("_hi")
        )
        sized = attach(sized, extremes, keys)
    lo = F.lit(float(low)) if low is not None else F.col("_lo")
    hi = F.lit(float(high)) if high is not None else F.col("_hi")
    return sized.withColumn("mag", clip((F.col("mag") - lo) / (hi - lo), 0.0, 1.0)).drop("_lo", "_hi")


def quantize(field: DataFrame, min_val, max_val, dtype: str = "uint8") -> DataFrame:
    """Integer codes of ``u`` and ``v`` with bounds per channel; fractions are cut off."""
    if dtype not in CODE_MAX:
        raise ValueError(f"dtype must be one of {sorted(CODE_MAX)}")
    if len(min_val) != 2 or len(max_val) != 2:
        raise ValueError("min_val and max_val need one value per channel")

    def code(name: str, lo: float, hi: float) -> Column:
        share = (F.col(name) - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + 1e-22)
        return F.floor(clip(share, 0.0, 1.0) * CODE_MAX[dtype]).cast("smallint")

    return field.withColumns(
        {name: code(name, lo, hi) for name, lo, hi in zip(("u", "v"), min_val, max_val)}
    )


def nonzero_frames(image: DataFrame, keys=FRAME) -> DataFrame:
    """Whether a frame has any non-zero pixel."""
    return image.groupBy(*keys).agg(F.max(F.col("i") != 0.0).alias("nonzero"))


def drop_padding(table: DataFrame) -> DataFrame:
    return table.where(~F.col("is_padding"))
