"""Window cross-correlation and the displacement field made from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship
from driftgrid.functions.grids import list_column, stacks
from driftgrid.operators.filling import neighbor_mean
from driftgrid.operators.patches import grid_shape
from driftgrid.operators.resample import resize_bilinear
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, TX, TY, along_x, along_y, own, shifted, spread

#: Windows transformed at a time in a task.
AT_ONCE = 256
#: Bytes of maps that a task hands over at a time.
RUN_BYTES = 4 << 20


def _normalised(w: np.ndarray) -> np.ndarray:
    """Zero mean and unit deviation per window, negative values cut off."""
    mean = w.mean(axis=(1, 2), keepdims=True)
    std = w.std(axis=(1, 2), keepdims=True)
    safe = np.where(std == 0, 1.0, std)
    return np.maximum(np.where(std == 0, 0.0, (w - mean) / safe), 0.0)


def correlate(first: np.ndarray, second: np.ndarray, window_size: int) -> np.ndarray:
    """Circular correlation of windows (n, s, s), zero shift in the middle; of the first only the inner window counts."""
    s = first.shape[-1]
    margin = (s - window_size) // 2
    mask = np.zeros((s, s))
    mask[margin : s - margin, margin : s - margin] = 1.0
    # both sides are normalised twice, which is part of the measure's definition
    first = _normalised(_normalised(first * mask))
    second = _normalised(_normalised(second))
    spectrum = np.conj(np.fft.rfft2(first)) * np.fft.rfft2(second)
    corr = np.fft.fftshift(np.fft.irfft2(spectrum, s=(s, s)), axes=(1, 2)) / (s * s)
    return np.clip(corr, 0.0, 1.0)


def window_tiles(table: DataFrame, shape: tuple[int, int], size: int, step: int, per_side: int) -> DataFrame:
    """Copies every pixel to the tiles (``_ty, _tx``) of ``per_side`` by ``per_side`` windows that need it.

    Tiles overlap by what the last window reaches beyond the next tile's start, so a pixel belongs to
    one tile, or to a few near their borders.
    """
    for name, axis, count in zip((TY, TX), ("y", "x"), grid_shape(shape, size, size - step)):
        c = F.col(axis)
        first = F.greatest(F.ceil((c - (size - 1)) / step), F.lit(0)).cast("int")
        last = F.least(F.floor(c / step), F.lit(count - 1)).cast("int")
        tiles = F.sequence(F.floor(first / per_side).cast("int"), F.floor(last / per_side).cast("int"))
        table = table.withColumn(name, F.explode(F.when(first <= last, tiles)))
    return table


def window_correlation(
    pair: DataFrame, shape: tuple[int, int], window_size: int, search_size: int, overlap: int, keys=("pair_id",), tile: int = TILE
) -> DataFrame:
    """One row per window: ``corr``, the row-major correlation map of ``search_size**2`` values.

    The unit of work is a tile of windows: one exchange brings its pixels together, its windows are views of them.
    """
    if search_size < window_size:
        raise ValueError("search_size must not be smaller than window_size")
    grid_shape(shape, search_size, overlap)
    ship(pair.sparkSession)
    size, step = search_size, search_size - overlap
    per_side = max(1, tile // step)
    sides = ("prev", "curr")
    tiled = window_tiles(pair.select(*keys, "y", "x", *(F.col(c).cast("double").alias(c) for c in sides)), shape, size, step, per_side)
    types = [tiled.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("wy", "wx")] + [T.StructField("corr", T.ArrayType(T.DoubleType()))]
    packed = (
        tiled.groupBy(*keys, TY, TX)
        .agg(F.collect_list(F.struct("y", "x", *sides)).alias("_px"))
        .select(*keys, *[F.col(f"_px.{c}").alias(c) for c in ("y", "x", *sides)])
    )
    at_once = max(AT_ONCE, RUN_BYTES // (8 * size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for stack in stacks(batch, sides):
                views = [np.lib.stride_tricks.sliding_window_view(stack.grids[c], (size, size), axis=(1, 2))[:, ::step, ::step] for c in sides]
                many = views[0].shape[:3]
                for k in range(0, int(np.prod(many)), at_once):
                    # the windows of many small tiles leave together
                    n, i, j = np.unravel_index(np.arange(k, min(k + at_once, int(np.prod(many)))), many)
                    a, b = (v[n, i, j] for v in views)
                    maps = [correlate(a[m : m + AT_ONCE], b[m : m + AT_ONCE], window_size) for m in range(0, len(n), AT_ONCE)]
                    arrays = [batch.column(c).take(pa.array(stack.rows[n])) for c in keys]
                    arrays += [pa.array((at // step + w).astype(np.int32)) for at, w in ((stack.y0[n], i), (stack.x0[n], j))]
                    yield pa.RecordBatch.from_arrays([*arrays, list_column(np.concatenate(maps), pa.float64())], names=[*keys, "wy", "wx", "corr"])

    return packed.mapInArrow(run, T.StructType(types))


def correlation_cells(correlated: DataFrame, search_size: int, keys=("pair_id",)) -> DataFrame:
    """The maps in long form: shift ``di`` (rows), ``dj`` (columns) and value."""
    long = correlated.select(*keys, "wy", "wx", F.posexplode("corr").alias("_p", "value"))
    half = search_size // 2
    return long.select(
        *keys,
        "wy",
        "wx",
        (F.floor(F.col("_p") / search_size).cast("int") - half).alias("di"),
        (F.col("_p") % search_size - half).alias("dj"),
        "value",
    )


def first_peak(correlated: DataFrame, search_size: int) -> DataFrame:
    """Add ``peak_i, peak_j``: the maximum, the first in row-major order on ties."""
    at = (F.array_position("corr", F.array_max("corr")) - 1).cast("int")
    return correlated.withColumns({"peak_i": F.floor(at / search_size).cast("int"), "peak_j": (at % search_size).cast("int")})


def subpixel(peaks: DataFrame, search_size: int, mask_width: int = 1) -> DataFrame:
    """Displacement ``u, v`` by three-point fits around the peak.

    A fit through the logarithms is used unless one of the five values is not
    positive; peaks within ``mask_width`` of the map's border give NULL.
    """
    s = search_size
    i, j = F.col("peak_i"), F.col("peak_j")

    def value(di: int, dj: int) -> Column:
        return F.get("corr", (i + di) * s + (j + dj))

    table = peaks.withColumns({"_c": value(0, 0), "_n": value(-1, 0), "_s": value(1, 0), "_w": value(0, -1), "_e": value(0, 1)})
    border = (
        (i < mask_width) | (i > s - mask_width - 1) | (j < mask_width) | (j > s - mask_width - 1)
    )
    plain = F.least("_c", "_n", "_s", "_w", "_e") <= 0

    def offset(before: str, after: str) -> Column:
        low, mid, high = F.col(before), F.col("_c"), F.col(after)
        bend = 2.0 * F.ln(low) - 4.0 * F.ln(mid) + 2.0 * F.ln(high)
        log_fit = F.when(bend != 0, (F.ln(low) - F.ln(high)) / bend).otherwise(0.0)
        curve = 2.0 * low - 4.0 * mid + 2.0 * high
        # a flat top has no parabola: NULL like any other missing vector
        return F.when(plain, F.try_divide(low - high, curve)).otherwise(log_fit)

    half = s // 2
    moved = {
        "v": F.when(~border, offset("_n", "_s") + i - half),
        "u": F.when(~border, offset("_w", "_e") + j - half),
    }
    return table.withColumns(moved).drop("_c", "_n", "_s", "_w", "_e")


def window_vectors(
    pair: DataFrame, shape, window_size: int, search_size: int, overlap: int, keys=("pair_id",)
) -> DataFrame:
    """One vector per window at grid place ``y, x``; NULL where no peak could be fitted."""
    peaks = first_peak(window_correlation(pair, shape, window_size, search_size, overlap, keys), search_size)
    return subpixel(peaks, search_size).select(*keys, F.col("wy").alias("y"), F.col("wx").alias("x"), "u", "v")


def piv_field(
    pair: DataFrame,
    shape: tuple[int, int],
    window_size: int,
    search_size: int,
    overlap: int,
    replace_iter: int = 10,
    replace_radius: int = 3,
    keys=("pair_id",),
) -> DataFrame:
    """Dense field of an image pair: window vectors, gaps replaced, resized to the frame."""
    coarse = window_vectors(pair, shape, window_size, search_size, overlap, keys)
    flagged = coarse.withColumn("is_outlier", F.col("u").isNull() | F.col("v").isNull())
    grid = grid_shape(shape, search_size, overlap)
    filled = neighbor_mean(flagged, replace_iter, replace_radius, keys=keys, shape=grid)
    return upsample_field(filled, grid, shape, keys)


def upsample_field(field: DataFrame, grid: tuple[int, int], shape: tuple[int, int], keys=FRAME) -> DataFrame:
    """Bring a coarse vector grid to frame size; vector values are not rescaled."""
    return resize_bilinear(field, ["u", "v"], grid, shape, keys)


def feature_correlation(
    first: DataFrame,
    second: DataFrame,
    radius: int,
    channels: int,
    level: int = 0,
    shape: tuple[int, int] | None = None,
    keys=FRAME,
    tile: int = TILE,
) -> DataFrame:
    """Correlation of each pixel's feature vector with those around it in another frame.

    ``f`` is an array column. Of the all-pairs product only the entries within
    ``radius`` are ever looked up, so only those are made: ``corr`` has
    ``(2r+1)**2`` values, 0 outside the frame. Averaging commutes with the
    product: at ``level`` the second frame's features are averaged over blocks
    of ``2**level`` and a pixel is compared around its own block.
    """
    side = 2**level
    for _ in range(level):
        second = pool_features(second, channels, shape, keys)
        shape = (shape[0] // 2, shape[1] // 2)

    def block(axis: str) -> Column:
        return F.floor(F.col(axis) / side).cast("int").alias(axis)

    # at most side**2 pixels share a block
    members = first.groupBy(*keys, block("y"), block("x")).agg(
        F.collect_list(F.struct((F.col("y") % side).alias("dy"), (F.col("x") % side).alias("dx"), F.col("f"))).alias("_first")
    )
    steps = range(-radius, radius + 1)
    joined = second.select(*keys, "y", "x", F.col("f").alias("_f2")).join(members, [*keys, "y", "x"], "left")
    zeros = F.array_repeat(F.lit(0.0), channels)
    tiled = spread(joined, radius, keys, tile)
    tiled = tiled.withColumn("_row", F.array(*[F.coalesce(shifted("_f2", k, along_x(keys)), zeros) for k in steps]))
    blank = F.array_repeat(zeros, len(steps))
    tiled = tiled.withColumn("_nb", F.flatten(F.array(*[F.coalesce(shifted("_row", k, along_y(keys)), blank) for k in steps])))

    def dot(other: Column) -> Column:
        if channels <= 16:  # few enough to write out
            total = sum((F.get("_f1", F.lit(c)) * F.get(other, F.lit(c)) for c in range(channels)), F.lit(0.0))
        else:
            products = F.zip_with("_f1", other, lambda a, b: a * b)
            total = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
        return total / float(channels) ** 0.5

    pixels = own(tiled, tile).select(*keys, "y", "x", "_nb", F.explode("_first").alias("_m"))
    pixels = pixels.select(
        *keys,
        (F.col("y") * side + F.col("_m.dy")).alias("y"),
        (F.col("x") * side + F.col("_m.dx")).alias("x"),
        F.col("_m.f").alias("_f1"),
        "_nb",
    )
    return pixels.select(*keys, "y", "x", F.transform("_nb", dot).alias("corr"))


def pool_features(table: DataFrame, channels: int, shape: tuple[int, int], keys=FRAME) -> DataFrame:
    """2x2 mean of feature vectors, an odd last row or column dropped."""
    kept = table.where((F.col("y") < shape[0] // 2 * 2) & (F.col("x") < shape[1] // 2 * 2))
    half = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("y", "x")]
    means = F.array(*[F.avg(F.get("f", F.lit(c))) for c in range(channels)])
    return kept.groupBy(*keys, *half).agg(means.alias("f"))
