"""Neighbourhood operators through one halo exchange.

A stencil needs the pixels around each pixel. Frames may be of any size and a
single frame may hold most of the data, so the unit of work is a tile, never a
frame: pixels near a tile border are copied to the neighbouring tile ("halo")
and one shuffle on ``(keys, tile)`` brings a tile together. Row-wise and
column-wise windows inside the tile then reuse that shuffle, because their
partition keys contain its keys. At most ``(tile + 2*halo)**2`` rows meet.

The grid must be dense (see ``schema.sparse_frames``). Inside a tile the first
and last halo rows look like frame borders; what they spoil lies further out
than ``halo`` from the tile's own pixels and is dropped by ``own``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.schema import FRAME

TILE = 128
TY, TX = "_ty", "_tx"


def _tile_of(coordinate: Column, tile: int) -> Column:
    return F.floor(coordinate / F.lit(tile)).cast("int")


def _covering(axis: str, halo: int, tile: int) -> Column:
    first = F.greatest(_tile_of(F.col(axis) - halo, tile), F.lit(0))
    last = F.greatest(_tile_of(F.col(axis) + halo, tile), F.lit(0))
    return F.explode(F.sequence(first, last))


def assign(df: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Add the tile coordinates; pixels within ``halo`` of a border are copied."""
    if halo == 0:
        return df.withColumns({TY: _tile_of(F.col("y"), tile), TX: _tile_of(F.col("x"), tile)})
    return df.withColumn(TY, _covering("y", halo, tile)).withColumn(TX, _covering("x", halo, tile))


def spread(df: DataFrame, halo: int, keys: Sequence[str] = FRAME, tile: int = TILE) -> DataFrame:
    """Bring each tile and its halo together: the one shuffle of a stencil."""
    return assign(df, halo, tile).repartition(*keys, TY, TX)


def own(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep each tile's own pixels and forget the tiling."""
    mine = (F.col(TY) == _tile_of(F.col("y"), tile)) & (F.col(TX) == _tile_of(F.col("x"), tile))
    return df.where(mine).drop(TY, TX)


def along_x(keys: Sequence[str] = FRAME):
    return Window.partitionBy(*keys, TY, TX, "y").orderBy("x")


def along_y(keys: Sequence[str] = FRAME):
    return Window.partitionBy(*keys, TY, TX, "x").orderBy("y")


def shifted(column: str | Column, k: int, line) -> Column:
    """Value ``k`` places further along ``line``; NULL beyond its end."""
    if k == 0:
        return F.col(column) if isinstance(column, str) else column
    return F.lead(column, k).over(line) if k > 0 else F.lag(column, -k).over(line)


def padded(column: str, k: int, line, pad: str) -> Column:
    """``shifted`` with zero or edge padding at the ends of the line."""
    if k == 0:
        return F.col(column)
    if pad == "zero":
        return F.coalesce(shifted(column, k, line), F.lit(0.0))
    if pad != "edge":
        raise ValueError(f"unknown padding {pad!r}")
    if abs(k) == 1:
        return F.coalesce(shifted(column, k, line), F.col(column))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.last(column).over(whole) if k > 0 else F.first(column).over(whole)
    return F.coalesce(shifted(column, k, line), end)


def weighted(column: str, weights: Sequence[float], line, pad: str) -> Column:
    """One-dimensional correlation with an odd number of weights."""
    radius = len(weights) // 2
    total = None
    for k, w in zip(range(-radius, radius + 1), weights):
        if w != 0.0:
            term = padded(column, k, line, pad) * F.lit(float(w))
            total = term if total is None else total + term
    return total


def separable_within(
    tiled: DataFrame,
    columns: Iterable[str],
    weights_y: Sequence[float],
    weights_x: Sequence[float],
    keys: Sequence[str] = FRAME,
    pad: str = "zero",
) -> DataFrame:
    """Replace ``columns`` of a spread table by their correlation with an outer-product kernel."""
    columns = list(columns)
    tiled = tiled.withColumns({c: weighted(c, weights_x, along_x(keys), pad) for c in columns})
    return tiled.withColumns({c: weighted(c, weights_y, along_y(keys), pad) for c in columns})


def box_sums(tiled: DataFrame, columns: Iterable[str], radius: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """``(2r+1)**2`` window sums of an already spread table; absent pixels count 0."""
    columns = list(columns)
    for line in (along_x(keys), along_y(keys)):
        reach = line.rowsBetween(-radius, radius)
        tiled = tiled.withColumns({c: F.sum(c).over(reach) for c in columns})
    return tiled


def neighbourhoods(
    tiled: DataFrame, columns: Iterable[str], radius: int, keys: Sequence[str] = FRAME, after: int | None = None
) -> DataFrame:
    """Add ``<column>_nb``: the zero-padded row-major window of every pixel.

    The window reaches ``radius`` back and ``after`` (default ``radius``) ahead.
    Rows are gathered along x first and then along y, so each window function
    moves whole rows and no pixel is exploded.
    """
    columns = list(columns)
    steps = range(-radius, (radius if after is None else after) + 1)
    zeros = F.array_repeat(F.lit(0.0), len(steps))
    # a missing value inside the frame is NaN: arrays without NULL are sorted as primitives
    missing = F.lit(float("nan"))
    rows, cols = along_x(keys), along_y(keys)
    tiled = tiled.withColumns(
        {f"{c}_row": F.array(*[F.coalesce(padded(c, k, rows, "zero"), missing) for k in steps]) for c in columns}
    )
    tiled = tiled.withColumns(
        {
            f"{c}_nb": F.flatten(F.array(*[F.coalesce(shifted(f"{c}_row", k, cols), zeros) for k in steps]))
            for c in columns
        }
    )
    return tiled.drop(*[f"{c}_row" for c in columns])


def mirror(df: DataFrame, radius: int, shape: tuple[int, int]) -> DataFrame:
    """Add the reflected border pixels (edge not repeated) as rows of their own.

    Afterwards plain shifts see a reflect-padded frame; rows outside the frame
    have coordinates below 0 or beyond the shape. Only border pixels are copied.
    """
    for axis, length in zip(("y", "x"), shape):
        if radius >= length:
            raise ValueError(f"reflect padding of {radius} needs a frame larger than {length}")
        c = F.col(axis)
        low = F.when((c >= 1) & (c <= radius), -c)
        high = F.when((c >= length - 1 - radius) & (c <= length - 2), 2 * (length - 1) - c)
        places = F.filter(F.array(c, low, high), lambda p: p.isNotNull())
        df = df.withColumn(axis, F.explode(places))
    return df


def zero_ring(df: DataFrame, columns: Sequence[str], before: tuple[int, int], after: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Grow every frame by rows and columns of zeros and move its corner to (0, 0).

    ``before`` and ``after`` are (rows, columns); only border pixels are copied.
    """
    for axis, length, low, high in zip(("y", "x"), shape, before, after):
        c = F.col(axis)
        none = F.array().cast("array<struct<p:int,k:double>>")

        def extra(edge: int, first: int, last: int, c=c, none=none):
            if last < first:
                return none
            span = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda p: F.struct(p.alias("p"), F.lit(0.0).alias("k")))
            return F.when(c == edge, span).otherwise(none)

        here = F.array(F.struct(c.cast("int").alias("p"), F.lit(1.0).alias("k")))
        places = F.concat(here, extra(0, -low, -1), extra(length - 1, length, length + high - 1))
        df = df.withColumn("_at", F.explode(places))
        df = df.withColumns({axis: F.col("_at.p") + low, **{n: F.col(n) * F.col("_at.k") for n in columns}}).drop("_at")
    return df


def inside(df: DataFrame, shape: tuple[int, int]) -> DataFrame:
    h, w = shape
    return df.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
