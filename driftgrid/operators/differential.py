"""Finite differences and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, along_x, along_y, box_sums, own, padded, shifted, spread


def _differences(tiled: DataFrame, columns: Sequence[str], keys) -> DataFrame:
    x, y = along_x(keys), along_y(keys)
    made = {}
    for c in columns:
        made[f"{c}_dx"] = (shifted(c, 1, x) - shifted(c, -1, x)) / 2.0
        made[f"{c}_dy"] = (shifted(c, 1, y) - shifted(c, -1, y)) / 2.0
    return tiled.withColumns(made)


def _interior(df: DataFrame, probe_x: str, probe_y: str) -> DataFrame:
    return df.where(F.col(probe_x).isNotNull() & F.col(probe_y).isNotNull())


def gradients(table: DataFrame, columns: Sequence[str] = ("u", "v"), keys=FRAME, tile: int = TILE) -> DataFrame:
    """Central differences ``<c>_dx, <c>_dy`` at interior pixels (original coordinates)."""
    out = own(_differences(spread(table, 1, keys, tile), columns, keys), tile)
    return _interior(out, f"{columns[0]}_dx", f"{columns[0]}_dy")


def div_vort(field: DataFrame, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Divergence and vorticity at interior pixels."""
    g = gradients(field, ("u", "v"), keys, tile)
    g = g.withColumns({"div": F.col("u_dx") + F.col("v_dy"), "vort": F.col("v_dx") - F.col("u_dy")})
    return g.drop("u_dx", "u_dy", "v_dx", "v_dy")


def laplacian(table: DataFrame, columns: Sequence[str] = ("u", "v"), keys=FRAME, tile: int = TILE) -> DataFrame:
    """Five-point Laplacian ``<c>_lap`` at interior pixels."""
    x, y = along_x(keys), along_y(keys)
    tiled = spread(table, 1, keys, tile)
    tiled = tiled.withColumns(
        {
            f"{c}_lap": shifted(c, 1, x) + shifted(c, -1, x) + shifted(c, 1, y) + shifted(c, -1, y) - 4.0 * F.col(c)
            for c in columns
        }
    )
    return own(tiled, tile).where(F.col(f"{columns[0]}_lap").isNotNull())


def sobel_within(tiled: DataFrame, column: str, keys, names=("ix", "iy")) -> DataFrame:
    """Sobel gradients of a table that is already spread (zero padding).

    The kernels are outer products of ``[1, 2, 1]`` and ``[-1, 0, 1]``, scaled by 1/8.
    """
    x, y = along_x(keys), along_y(keys)
    tiled = tiled.withColumns(
        {
            "_d": padded(column, 1, x, "zero") - padded(column, -1, x, "zero"),
            "_s": padded(column, -1, x, "zero") + 2.0 * F.col(column) + padded(column, 1, x, "zero"),
        }
    )
    return tiled.withColumns(
        {
            names[0]: 0.125 * (padded("_d", -1, y, "zero") + 2.0 * F.col("_d") + padded("_d", 1, y, "zero")),
            names[1]: 0.125 * (padded("_s", 1, y, "zero") - padded("_s", -1, y, "zero")),
        }
    ).drop("_d", "_s")


def sobel(image: DataFrame, column: str = "i", keys=FRAME, tile: int = TILE) -> DataFrame:
    """Sobel gradients ``ix`` and ``iy``."""
    return own(sobel_within(spread(image, 1, keys, tile), column, keys), tile)


def structure_tensor(image: DataFrame, patch_size: int, column: str = "i", keys=FRAME, tile: int = TILE) -> DataFrame:
    """Box means ``jxx, jxy, jyy`` of the gradient products (odd ``patch_size``)."""
    if patch_size % 2 == 0:
        raise ValueError("patch_size must be odd")
    radius = patch_size // 2
    tiled = sobel_within(spread(image, radius + 1, keys, tile), column, keys)
    tiled = tiled.withColumns(
        {"jxx": F.col("ix") * F.col("ix"), "jxy": F.col("ix") * F.col("iy"), "jyy": F.col("iy") * F.col("iy")}
    )
    sums = own(box_sums(tiled, ("jxx", "jxy", "jyy"), radius, keys), tile)
    area = float(patch_size * patch_size)
    return sums.withColumns({c: F.col(c) / area for c in ("jxx", "jxy", "jyy")}).drop("ix", "iy")


def patch_hessian(
    image: DataFrame,
    patch_size: int,
    stride: int,
    shape: tuple[int, int],
    eps: float = 1e-4,
    column: str = "i",
    keys=FRAME,
    tile: int = TILE,
) -> DataFrame:
    """Gradient product sums of strided windows and the inverse of the 2x2 matrix.

    One row per window; ``y, x`` is its top-left pixel. Windows lie inside the frame.
    """
    height, width = shape
    tiled = sobel_within(spread(image, patch_size, keys, tile), column, keys)
    tiled = tiled.withColumns(
        {"sxx": F.col("ix") * F.col("ix"), "sxy": F.col("ix") * F.col("iy"), "syy": F.col("iy") * F.col("iy")}
    )
    for line in (along_x(keys), along_y(keys)):
        ahead = line.rowsBetween(0, patch_size - 1)
        tiled = tiled.withColumns({c: F.sum(c).over(ahead) for c in ("sxx", "sxy", "syy")})
    corners = own(tiled, tile).where(
        (F.col("y") % stride == 0)
        & (F.col("x") % stride == 0)
        & (F.col("y") <= height - patch_size)
        & (F.col("x") <= width - patch_size)
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy") + F.lit(float(eps))
    return corners.select(
        *keys,
        "y",
        "x",
        "sxx",
        "sxy",
        "syy",
        (F.col("syy") / det).alias("h00"),
        (-F.col("sxy") / det).alias("h01"),
        (F.col("sxx") / det).alias("h11"),
    )
