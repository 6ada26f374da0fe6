"""Work at displaced places, by tiles of two images.

A row sits at a pixel of the first image and points, by its vector, to a place
of the second. Rows and the pixels of both images meet by the row's tile, with a
halo; what lies inside the halo is computed there. A row that points beyond it
takes the patch it needs from the first image along, as one number a row, to
the tile it points to. So only single numbers cross a shuffle: one row a vector
plus, for those that leave the halo, one a patch pixel, and there are at most two
rounds whatever the vectors are. A tile at which very many rows point is
shared by several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftgrid.deploy import ship
from driftgrid.functions.grids import as_grid
from driftgrid.scale import durable
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, TX, TY, assign

HALO = 16
#: Patch pixels that may meet in one task of the second round, and vectors sampled at a time in a task.
MEET, AT_ONCE = 1 << 19, 4096
_HOME = ("_hy", "_hx", "_n")


def samples(grid: np.ndarray, y0: int, x0: int, yc: np.ndarray, xc: np.ndarray, half: int, size: int | None = None) -> np.ndarray:
    """Bilinear patches (n, p, p) around float centres, p being ``size`` (default: odd); what lies outside the grid is 0."""
    h, w = grid.shape
    span = np.arange(size or 2 * half + 1) - half
    yf, xf = yc[:, None] + span - y0, xc[:, None] + span - x0
    fy, fx = np.floor(yf), np.floor(xf)
    wy, wx = (yf - fy)[:, :, None], (xf - fx)[:, None, :]
    # far and undefined places collapse onto the border of zeros
    yi, xi = (np.nan_to_num(np.clip(f, -2, n + 1), nan=-2).astype(np.int64) for f, n in ((fy, h), (fx, w)))
    ringed = np.pad(grid, 1)

    def value(dy, dx):
        r, c = np.clip(yi + dy, -1, h) + 1, np.clip(xi + dx, -1, w) + 1
        return ringed[r[:, :, None], c[:, None, :]]

    return (1 - wx) * (1 - wy) * value(0, 0) + wx * (1 - wy) * value(0, 1) + (1 - wx) * wy * value(1, 0) + wx * wy * value(1, 1)


def within(yc: np.ndarray, xc: np.ndarray, half: int, shape: tuple[int, int], box: tuple[int, int, int, int]) -> np.ndarray:
    """Whether all pixels of the frame that patches at ``yc, xc`` need lie in ``box`` (top, left, bottom, right)."""
    need = []
    for c, length in ((yc, shape[0]), (xc, shape[1])):
        first = np.floor(c) - half
        need.append((np.clip(first, 0, length), np.clip(first + 2 * half + 2, 0, length)))
    (t, b), (left, r) = need
    nothing = (t >= b) | (left >= r)
    return nothing | ~np.isfinite(yc) | ~np.isfinite(xc) | ((t >= box[0]) & (b <= box[2]) & (left >= box[1]) & (r <= box[3]))


def gradient_energy(grid: np.ndarray, y0: int, x0: int, half: int, shape: tuple[int, int]) -> np.ndarray:
    """Squared Sobel gradients summed over the patch of every pixel; those at the frame's border count 0."""
    p = np.pad(grid, 1)
    d, s = p[:, 2:] - p[:, :-2], p[:, :-2] + 2.0 * p[:, 1:-1] + p[:, 2:]
    ix, iy = 0.125 * (d[:-2] + 2.0 * d[1:-1] + d[2:]), 0.125 * (s[2:] - s[:-2])
    y, x = y0 + np.arange(grid.shape[0]), x0 + np.arange(grid.shape[1])
    inner = ((y >= 1) & (y <= shape[0] - 2))[:, None] & ((x >= 1) & (x <= shape[1] - 2))
    power = np.pad(np.where(inner, ix * ix + iy * iy, 0.0), half)
    rows = sum(power[k : k + grid.shape[0]] for k in range(2 * half + 1))
    return sum(rows[:, k : k + grid.shape[1]] for k in range(2 * half + 1))


def target(axis: Column, shift: Column, length: int, tile: int) -> Column:
    """The tile that a displaced place lies in, or the nearest one of the frame."""
    place = F.coalesce(F.floor(axis + shift), F.lit(0))
    return F.floor(F.least(F.greatest(place, F.lit(0)), F.lit(length - 1)) / tile).cast("int")


def shared(rows: DataFrame, pixels: DataFrame, keys: list[str], by=_HOME) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``: a tile met by more than ``MEET`` rows is dealt to several tasks (rows by their columns ``by``), a tile met by none to none."""
    loads = durable(rows.groupBy(*keys, TY, TX).agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("_parts")))
    on = [*keys, TY, TX]
    dealt = pixels.join(loads, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return rows.join(loads, on).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_parts"), dealt


def both_images(prev: DataFrame, curr: DataFrame, keys, halo: int, tile: int, column: str = "i") -> DataFrame:
    """Pixels of both images under each other (``_which`` 0 and 1), copied to the tiles whose halo they lie in."""
    sides = []
    for which, image in enumerate((prev, curr)):
        sides.append(image.select(*[F.col(k).alias(k) for k in (*keys, "y", "x")], F.col(column).cast("double").alias("_i"), F.lit(which).alias("_which")))
    return assign(sides[0].unionByName(sides[1]), halo, tile)


def image_of(pixels: pa.Table, which: int) -> tuple[np.ndarray, int, int] | None:
    """The grid of one image in a tile and its first row and column; None if the frame has no such image."""
    mine = pixels.filter(pc.equal(pixels["_which"], which))
    if mine.num_rows == 0:
        return None
    grids, y0, x0 = as_grid(mine.select(["y", "x", "_i"]))
    return grids["_i"], y0, x0


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def with_patch_error(
    field: DataFrame,
    prev: DataFrame,
    curr: DataFrame,
    patch_size: int,
    shape: tuple[int, int],
    squared: bool = False,
    component_order: str = "yx",
    energy: bool = False,
    keys=FRAME,
    tile: int = TILE,
    halo: int = HALO,
) -> DataFrame:
    """Every row of ``field`` with the difference ``err`` between the patch of ``prev`` at its pixel and that of
    ``curr`` at the pixel moved by its vector; with ``energy`` also ``g``, the gradient energy of the former.

    ``err`` is NULL within ``patch_size // 2`` of the border and for a missing vector. Rows of frames that ``prev`` does
    not have are left out; a frame that ``curr`` does not have is all zeros.
    """
    if patch_size < 1 or patch_size % 2 == 0:
        raise ValueError("patch_size must be a positive odd integer")
    if component_order not in ("yx", "xy"):
        raise ValueError("component_order must be 'yx' or 'xy'")
    keys, half, p = list(keys), patch_size // 2, patch_size
    halo = max(halo, half + 2)
    down, right = ("u", "v") if component_order == "yx" else ("v", "u")
    ship(field.sparkSession)
    made = ["err", "g"] if energy else ["err"]
    rows = field.drop(*made)
    names = rows.columns
    types = {f.name: T.StructField(f.name, f.dataType) for f in rows.schema}
    out = [types[n] for n in names] + [T.StructField(n, T.DoubleType()) for n in made]
    extra = [*(T.StructField(n, T.LongType()) for n in _HOME), T.StructField("_k", T.IntegerType()), T.StructField("_a", T.DoubleType())]
    height, width = shape

    def finished(total: np.ndarray) -> np.ndarray:
        return total if squared else np.sqrt(total)

    def inside(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y >= half) & (y <= height - 1 - half) & (x >= half) & (x <= width - 1 - half)

    def near(rows_: pa.Table, pixels: pa.Table) -> pa.Table:
        first = image_of(pixels, 0) if rows_.num_rows else None
        if first is None:
            return pa.Table.from_batches([], schema=near_schema)
        a, ay, ax = first
        second = image_of(pixels, 1)
        b, by, bx = second if second is not None else (np.zeros((1, 1)), 0, 0)
        box = (by, bx, by + b.shape[0], bx + b.shape[1]) if second is not None else (0, 0, height, width)
        y, x, dy, dx = (numbers(rows_, c) for c in ("y", "x", down, right))
        lost = pc.or_(pc.is_null(rows_["u"]), pc.is_null(rows_["v"])).to_numpy()
        sits, here = inside(y, x) & ~lost, within(y + dy, x + dx, half, shape, box)
        err, ringed = np.full(len(y), np.nan), np.pad(a, half)
        cuts = np.lib.stride_tricks.sliding_window_view(ringed, (p, p))
        iy, ix = (y - ay).astype(np.int64), (x - ax).astype(np.int64)
        todo = np.flatnonzero(sits & here)
        for at in np.split(todo, range(AT_ONCE, len(todo), AT_ONCE)):
            gap = cuts[iy[at], ix[at]] - samples(b, by, bx, y[at] + dy[at], x[at] + dx[at], half)
            err[at] = finished((gap * gap).sum(axis=(1, 2)))
        columns = [rows_.column(n) for n in names] + [pa.array(err, pa.float64(), mask=~sits)]
        if energy:
            columns.append(pa.array(gradient_energy(a, ay, ax, half, shape)[iy, ix]))
        ty, tx = rows_[TY][0].as_py(), rows_[TX][0].as_py()
        n = len(y)
        columns += [pa.array(np.full(n, t), pa.int64()) for t in (ty, tx)] + [pa.array(np.arange(n))]
        far = np.flatnonzero(sits & ~here)
        ready = np.flatnonzero(~(sits & ~here))
        whole = pa.table([c.cast(k.type) if isinstance(c, pa.ChunkedArray) else c.cast(k.type) for c, k in zip(columns, near_schema)], names=near_schema.names[:-2])
        parts = [(whole.take(pa.array(ready)), np.full(len(ready), -1), np.zeros(len(ready)))]
        if len(far):
            parts.append((whole.take(pa.array(np.repeat(far, p * p))), np.tile(np.arange(p * p), len(far)), cuts[iy[far], ix[far]].ravel()))
        tables = [t.append_column("_k", pa.array(k, pa.int32())).append_column("_a", pa.array(v, pa.float64())) for t, k, v in parts]
        return pa.concat_tables(tables)

    def away(rows_: pa.Table, pixels: pa.Table) -> pa.Table:
        if rows_.num_rows == 0:
            return pa.Table.from_batches([], schema=away_schema)
        rows_ = rows_.sort_by([(c, "ascending") for c in (*_HOME, "_k")])
        heads = rows_.take(pa.array(np.arange(0, rows_.num_rows, p * p)))
        patches = numbers(rows_, "_a").reshape(-1, p, p)
        grids, by, bx = as_grid(pixels.select(["y", "x", "_i"]))
        y, x, dy, dx = (numbers(heads, c) for c in ("y", "x", down, right))
        total = np.empty(len(y))
        for at in range(0, len(y), AT_ONCE):
            cut = slice(at, at + AT_ONCE)
            gap = patches[cut] - samples(grids["_i"], by, bx, y[cut] + dy[cut], x[cut] + dx[cut], half)
            total[cut] = (gap * gap).sum(axis=(1, 2))
        done = heads.select([f.name for f in out])
        return done.set_column(done.schema.get_field_index("err"), "err", pa.array(finished(total)))

    near_schema, away_schema = to_arrow_schema(T.StructType([*out, *extra])), to_arrow_schema(T.StructType(out))
    home = rows.select(*[F.col(n).alias(n) for n in names]).withColumns({TY: F.floor(F.col("y") / tile).cast("int"), TX: F.floor(F.col("x") / tile).cast("int")})
    on = [*keys, TY, TX]
    pixels = both_images(prev, curr, keys, halo, tile)
    stored = durable(home.groupBy(*on).cogroup(pixels.groupBy(*on)).applyInArrow(near, T.StructType([*out, *extra])))
    done, far = stored.where("_k < 0").select(*[f.name for f in out]), stored.where("_k >= 0")
    if far.isEmpty():
        return done
    aimed = far.withColumns({TY: target(F.col("y"), F.col(down), height, tile), TX: target(F.col("x"), F.col(right), width, tile)})
    dealt, held = shared(aimed, pixels.where("_which = 1"), keys)
    on.append("_part")
    return done.unionByName(dealt.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(away, T.StructType(out)))
