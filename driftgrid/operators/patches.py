"""Overlapping windows, patch grids and overlap-add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import mix
from driftgrid.schema import FRAME


def frames_of(table: DataFrame, keys=FRAME) -> DataFrame:
    """One row per frame of a dense table, found without a shuffle."""
    return table.where((F.col("y") == 0) & (F.col("x") == 0)).select(*keys)


def grid_shape(shape: tuple[int, int], size: int, overlap: int) -> tuple[int, int]:
    """Number of interrogation windows along y and x."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    step = size - overlap
    return (shape[0] - size) // step + 1, (shape[1] - size) // step + 1


def window_grid(table: DataFrame, shape: tuple[int, int], size: int, overlap: int, keys=FRAME) -> DataFrame:
    """Window indices ``wy, wx`` and centres ``cy, cx`` for every frame."""
    ny, nx = grid_shape(shape, size, overlap)
    step = size - overlap
    grid = frames_of(table, keys)
    grid = grid.withColumn("wy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    grid = grid.withColumn("wx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return grid.withColumns({"cy": F.col("wy") * step + size * 0.5, "cx": F.col("wx") * step + size * 0.5})


def _covering(axis: str, size: int, step: int, count: int) -> Column:
    """Indices of the windows that contain a coordinate."""
    c = F.col(axis)
    first = F.greatest(F.ceil((c - (size - 1)) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(c / step), F.lit(count - 1)).cast("int")
    return F.when(first <= last, F.sequence(first, last))


def windows(
    table: DataFrame, columns: Sequence[str], shape: tuple[int, int], size: int, step: int, keys=FRAME
) -> DataFrame:
    """Pixels of overlapping windows: ``wy, wx`` name the window, ``py, px`` the place in it.

    Each pixel works out the windows covering it, so there is no join and no shuffle.
    """
    ny, nx = (shape[0] - size) // step + 1, (shape[1] - size) // step + 1
    out = table.withColumn("wy", F.explode(_covering("y", size, step, ny)))
    out = out.withColumn("wx", F.explode(_covering("x", size, step, nx)))
    return out.select(
        *keys,
        "wy",
        "wx",
        (F.col("y") - F.col("wy") * step).alias("py"),
        (F.col("x") - F.col("wx") * step).alias("px"),
        *columns,
    )


def centre_positions(length: int, stride: int) -> Column:
    """Multiples of the stride plus the last index."""
    return F.array_union(F.sequence(F.lit(0), F.lit(length - 1), F.lit(stride)), F.array(F.lit(length - 1)))


def patch_grid(table: DataFrame, shape: tuple[int, int], stride_y: int, stride_x: int, keys=FRAME) -> DataFrame:
    """Patch centres of every frame, numbered row by row."""
    grid = frames_of(table, keys)
    grid = grid.select(*keys, F.posexplode(centre_positions(shape[0], stride_y)).alias("_r", "cy"))
    grid = grid.select(*keys, "_r", "cy", F.posexplode(centre_positions(shape[1], stride_x)).alias("_c", "cx"))
    per_row = len(range(0, shape[1], stride_x)) + (1 if (shape[1] - 1) % stride_x else 0)
    return grid.select(*keys, (F.col("_r") * per_row + F.col("_c")).alias("patch_id"), "cy", "cx")


def triangle_weights(size: int) -> list[float]:
    """Triangular taper; its peak is 1 for odd sizes and just below 1 for even ones."""
    half = size / 2 if size % 2 == 0 else (size + 1) / 2
    return [1.0 - abs((n - (size - 1) / 2) / half) for n in range(size)]


def taper_weights(size: int, power: int = 2) -> list[float]:
    """Spline taper with mean 1: a parabola inside, its mirror image in the outer quarters."""
    if size < 4:
        raise ValueError("a taper needs a size of at least 4")
    quarter = size // 4
    raw = []
    for n, t in enumerate(triangle_weights(size)):
        outer = n < quarter or n >= size - quarter
        raw.append(abs(2 * t) ** power / 2 if outer else 1 - abs(2 * (t - 1)) ** power / 2)
    mean = sum(raw) / size
    return [w / mean for w in raw]


def taper(py: str, px: str, size: int, power: int = 2) -> Column:
    """Two-dimensional taper weight at a place in the window (outer product)."""
    table = F.array(*[F.lit(w) for w in taper_weights(size, power)])
    return F.get(table, F.col(py)) * F.get(table, F.col(px))


def fold(patches: DataFrame, columns: Sequence[str], step: int, keys=FRAME) -> DataFrame:
    """Overlap-add of window pixels back to the frame."""
    at = [(F.col(f"w{a}") * step + F.col(f"p{a}")).alias(a) for a in ("y", "x")]
    return patches.groupBy(*keys, *at).agg(*[F.sum(c).alias(c) for c in columns])


def fold_blend(patches: DataFrame, columns: Sequence[str], size: int, step: int, power: int = 2, keys=FRAME) -> DataFrame:
    """Tapered overlap-add divided by the summed weights."""
    w = taper("py", "px", size, power)
    weighted = patches.withColumns({"_w": w, **{c: F.col(c) * w for c in columns}})
    folded = fold(weighted, [*columns, "_w"], step, keys)
    return folded.withColumns({c: F.col(c) / F.col("_w") for c in columns}).drop("_w")


def random_patch(
    table: DataFrame, columns: Sequence[str], shape: tuple[int, int], size: int, stride: int, seed: int, frame: str = "frame_id"
) -> DataFrame:
    """One stride-aligned window per frame, chosen by the seeded mix of the frame id."""
    ny, nx = (shape[0] - size) // stride + 1, (shape[1] - size) // stride + 1
    top = (F.pmod(mix(frame, seed), F.lit(ny)) * stride).cast("int")
    left = (F.pmod(mix(frame, seed + 1), F.lit(nx)) * stride).cast("int")
    cut = table.withColumns({"_t": top, "_l": left}).where(
        F.col("y").between(F.col("_t"), F.col("_t") + size - 1) & F.col("x").between(F.col("_l"), F.col("_l") + size - 1)
    )
    return cut.select(frame, (F.col("y") - F.col("_t")).alias("py"), (F.col("x") - F.col("_l")).alias("px"), *columns)
