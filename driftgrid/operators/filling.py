"""Replacement of invalid vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.grids import edge_neighbour_mean, ring_mean
from driftgrid.operators.iterate import iterate
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, box_sums, own, spread


def tile_average_within(tiled: DataFrame, radius: int, keys=FRAME) -> DataFrame:
    ok = F.col("valid")
    tiled = tiled.withColumns(
        {
            "_n": ok.cast("double"),
            "_u": F.when(ok, F.col("u")).otherwise(0.0),
            "_v": F.when(ok, F.col("v")).otherwise(0.0),
        }
    )
    summed = box_sums(tiled, ("_n", "_u", "_v"), radius, keys)
    n = F.greatest(F.col("_n"), F.lit(1.0))
    filled = {c: F.when(ok, F.col(c)).otherwise(F.col(f"_{c}") / n) for c in ("u", "v")}
    return summed.withColumns({**filled, "valid": ok | (F.col("_n") > 0)}).drop("_n", "_u", "_v")


def tile_average(field: DataFrame, radius: int, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Invalid vectors become the mean of the valid ones in their window.

    A pixel without any valid neighbour becomes 0 and stays invalid.
    """
    return own(tile_average_within(spread(field, radius, keys, tile), radius, keys), tile)


def laplace(
    field: DataFrame,
    num_iter: int = 512,
    halo: int = 64,
    tile: int = 512,
    keys=FRAME,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Jacobi relaxation of the invalid vectors; valid ones stay fixed."""

    def relax(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: np.where(g["valid"], g[c], edge_neighbour_mean(g[c])) for c in ("u", "v")}

    done = iterate(field, relax, ("u", "v"), ("valid",), num_iter, 1, min(halo, num_iter), tile, keys, shape)
    return done.withColumn("valid", F.lit(True))


def neighbor_mean(
    field: DataFrame,
    n_iter: int,
    radius: int,
    flag: str = "is_outlier",
    tile: int = 512,
    keys=FRAME,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Flagged vectors become the mean of their window without the centre, ``n_iter`` times.

    Missing components start as 0; pixels outside the frame count as 0.
    """
    start = field.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("u", "v")})

    def replace(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: np.where(g[flag], ring_mean(g[c], radius), g[c]) for c in ("u", "v")}

    halo = max(radius, min(64, n_iter * radius) // radius * radius)
    return iterate(start, replace, ("u", "v"), (flag,), n_iter, radius, halo, max(tile, halo), keys, shape)
