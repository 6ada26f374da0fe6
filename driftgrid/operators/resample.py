"""Resizing, sampling at float positions, warping and pooling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import clip, floor_int, missing
from driftgrid.schema import FRAME
from driftgrid.tiles import TILE, TX, TY, along_x, along_y, assign, own, shifted, spread


def quads(image: DataFrame, columns: Sequence[str], keys=FRAME, tile: int = TILE) -> DataFrame:
    """Each pixel with its right, lower and lower-right neighbour.

    Adds ``<c>_q``: struct ``a b c d`` = (y,x) (y,x+1) (y+1,x) (y+1,x+1), NULL
    beyond the frame. One exchange; afterwards a bilinear sample is one lookup.
    """
    tiled = spread(image.select(*keys, "y", "x", *columns), 1, keys, tile)
    x, y = along_x(keys), along_y(keys)
    tiled = tiled.withColumns({f"{c}_r": shifted(c, 1, x) for c in columns})
    tiled = tiled.withColumns(
        {
            f"{c}_q": F.struct(
                F.col(c).alias("a"),
                F.col(f"{c}_r").alias("b"),
                shifted(c, 1, y).alias("c"),
                shifted(f"{c}_r", 1, y).alias("d"),
            )
            for c in columns
        }
    )
    return own(tiled, tile).select(*keys, "y", "x", *[f"{c}_q" for c in columns])


def _clamped(q: str, wy: Column, wx: Column) -> Column:
    """Bilinear blend of a quad whose missing neighbours repeat the edge."""
    a = F.col(f"{q}.a")
    b, c = F.coalesce(F.col(f"{q}.b"), a), F.coalesce(F.col(f"{q}.c"), a)
    d = F.coalesce(F.col(f"{q}.d"), F.col(f"{q}.b"), F.col(f"{q}.c"), a)
    return (1.0 - wx) * (1.0 - wy) * a + wx * (1.0 - wy) * b + (1.0 - wx) * wy * c + wx * wy * d


def _zeroed(q: str, wy: Column, wx: Column, dy: Column, dx: Column) -> Column:
    """Blend with zeros outside. ``dy, dx`` is -1 where the position lies before row/column 0,
    so that the stored quad at 0 holds the blend's second row/column."""
    part = {k: F.coalesce(F.col(f"{q}.{k}"), F.lit(0.0)) for k in "abcd"}
    up, left = dy < 0, dx < 0
    zero = F.lit(0.0)
    a = F.when(up | left, zero).otherwise(part["a"])
    b = F.when(up, zero).when(left, part["a"]).otherwise(part["b"])
    c = F.when(left, zero).when(up, part["a"]).otherwise(part["c"])
    d = F.when(up & left, part["a"]).when(up, part["b"]).when(left, part["c"]).otherwise(part["d"])
    return (1.0 - wx) * (1.0 - wy) * a + wx * (1.0 - wy) * b + (1.0 - wx) * wy * c + wx * wy * d


def sample(
    points: DataFrame,
    image: DataFrame,
    columns: Sequence[str],
    shape: tuple[int, int],
    pad: str = "clamp",
    keys=FRAME,
    tile: int = TILE,
) -> DataFrame:
    """Bilinear values of ``image`` at each point's ``yf, xf``, added as ``s_<column>``.

    ``clamp`` moves positions into the frame, ``zero`` treats the outside as 0; a
    position that is NULL or NaN has the value NULL. Points and quads meet in one
    equi-join; nothing is exploded.
    """
    height, width = shape
    lost = missing("yf", "xf")
    store = quads(image, columns, keys, tile).withColumnsRenamed({"y": "_qy", "x": "_qx"})
    yf, xf = F.col("yf"), F.col("xf")
    if pad == "clamp":
        yc, xc = clip(yf, 0.0, height - 1.0), clip(xf, 0.0, width - 1.0)
        # a missing position looks at some pixel, so that its row stays, and is blanked below
        at = points.withColumns({"_qy": F.when(lost, 0).otherwise(floor_int(yc)), "_qx": F.when(lost, 0).otherwise(floor_int(xc))})
        at = at.withColumns({"_wy": yc - F.col("_qy"), "_wx": xc - F.col("_qx")})
        found = at.join(store, [*keys, "_qy", "_qx"])
        made = {f"s_{c}": _clamped(f"{c}_q", F.col("_wy"), F.col("_wx")) for c in columns}
    elif pad == "zero":
        at = points.withColumns({"_fy": F.floor(yf), "_fx": F.floor(xf)})
        at = at.withColumns({"_wy": yf - F.col("_fy"), "_wx": xf - F.col("_fx")})
        at = at.withColumns(
            {
                "_qy": F.when(F.col("_fy") == -1, 0).otherwise(F.col("_fy")).cast("int"),
                "_qx": F.when(F.col("_fx") == -1, 0).otherwise(F.col("_fx")).cast("int"),
            }
        )
        found = at.join(store, [*keys, "_qy", "_qx"], "left")
        made = {
            f"s_{c}": _zeroed(f"{c}_q", F.col("_wy"), F.col("_wx"), F.col("_fy"), F.col("_fx")) for c in columns
        }
    else:
        raise ValueError(f"pad must be 'clamp' or 'zero', got {pad!r}")
    helpers = ("_qy", "_qx", "_wy", "_wx", "_fy", "_fx")
    made = {name: F.when(~lost, value) for name, value in made.items()}
    return found.withColumns(made).drop(*helpers, *[f"{c}_q" for c in columns])


def sample_normalized(
    points: DataFrame, image: DataFrame, columns, shape, align_corners: bool = True, pad: str = "zero", keys=FRAME
) -> DataFrame:
    """``sample`` at positions ``gy, gx`` given on the [-1, 1] scale of the frame."""
    height, width = shape

    def place(g: Column, n: int) -> Column:
        if align_corners:
            return 0.5 * (g + 1.0) * (n - 1)
        return ((g + 1.0) * n - 1.0) / 2.0

    located = points.withColumns({"yf": place(F.col("gy"), height), "xf": place(F.col("gx"), width)})
    return sample(located, image, columns, shape, pad, keys).drop("yf", "xf")


def gather(points: DataFrame, table: DataFrame, columns: Sequence[str], keys=FRAME) -> DataFrame:
    """Values at integer positions ``py, px``; positions outside the frame are dropped."""
    store = table.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), *columns)
    return points.join(store, [*keys, "py", "px"])


def _bilinear_axis(old: int, new: int) -> dict[int, list[tuple[int, float]]]:
    """Per source index: the outputs sampled between it and its successor, with the successor's weight."""
    found: dict[int, list[tuple[int, float]]] = {}
    for o in range(new):
        place = (o + 0.5) * (old / new) - 0.5
        source = min(max(math.floor(place), 0), old - 1)
        found.setdefault(source, []).append((o, min(max(place - source, 0.0), 1.0)))
    return found


def _triangle_axis(old: int, new: int) -> dict[int, list[tuple[int, float]]]:
    """Per source index: the outputs it contributes to, with normalised triangle weights."""
    scale = old / new
    support = max(scale, 1.0)
    found: dict[int, list[tuple[int, float]]] = {}
    for o in range(new):
        centre = (o + 0.5) * scale - 0.5
        near = range(max(math.ceil(centre - support), 0), min(math.floor(centre + support), old - 1) + 1)
        raw = {i: 1.0 - abs(i - centre) / support for i in near}
        total = sum(raw.values())
        for i, w in raw.items():
            if w > 0:
                found.setdefault(i, []).append((o, w / total))
    return found


def _on_axis(table: DataFrame, axis: str, outputs: dict[int, list[tuple[int, float]]]) -> DataFrame:
    """Copy every pixel to its outputs along one axis (``_o<axis>``: struct ``o, w``).

    The lookup table has one row per row or column of a frame, which bounds its broadcast.
    """
    schema = f"{axis} int, _outs array<struct<o: int, w: double>>"
    lookup = table.sparkSession.createDataFrame(sorted(outputs.items()), schema)
    return table.join(F.broadcast(lookup), axis).withColumn(f"_o{axis}", F.explode("_outs")).drop("_outs")


def resize_bilinear(
    table: DataFrame, columns: Sequence[str], shape: tuple[int, int], new_shape: tuple[int, int], keys=FRAME, tile: int = TILE
) -> DataFrame:
    """Bilinear resize with half-pixel centres and clamped borders, no antialiasing.

    Every pixel produces the outputs lying in its own cell, so no join is needed.
    """
    out = quads(table, columns, keys, tile)
    for axis, old, new in zip(("y", "x"), shape, new_shape):
        out = _on_axis(out, axis, _bilinear_axis(old, new))
    values = [_clamped(f"{c}_q", F.col("_oy.w"), F.col("_ox.w")).alias(c) for c in columns]
    return out.select(*keys, F.col("_oy.o").alias("y"), F.col("_ox.o").alias("x"), *values)


def resize_antialias(
    table: DataFrame, columns: Sequence[str], shape: tuple[int, int], new_shape: tuple[int, int], keys=FRAME
) -> DataFrame:
    """Resize with a triangle filter that widens when shrinking.

    Contributions are summed map-side first, so a shrink shuffles about one
    row per output pixel and map task.
    """
    parts = table
    for axis, old, new in zip(("y", "x"), shape, new_shape):
        parts = _on_axis(parts, axis, _triangle_axis(old, new))
    w = F.col("_oy.w") * F.col("_ox.w")
    sums = [F.sum(w * F.col(c)).alias(c) for c in columns]
    return parts.groupBy(*keys, F.col("_oy.o").alias("y"), F.col("_ox.o").alias("x")).agg(*sums)


def warp_backward(
    image: DataFrame, field: DataFrame, shape: tuple[int, int], dt: float = 1.0, column: str = "i", keys=FRAME
) -> DataFrame:
    """Image value at ``(y - v*dt, x - u*dt)`` for every pixel."""
    points = field.select(
        *keys, "y", "x", (F.col("y") - F.col("v") * dt).alias("yf"), (F.col("x") - F.col("u") * dt).alias("xf")
    )
    out = sample(points, image, [column], shape, "clamp", keys)
    return out.select(*keys, "y", "x", F.col(f"s_{column}").alias(column))


def beside(first: DataFrame, second: DataFrame, keys=FRAME, tile: int = TILE) -> DataFrame:
    """Two pixel tables joined by pixel, with neighbouring pixels left in the same task.

    A join would hash single pixels apart. Here both sides are shuffled by tile
    and paired by a grouping that needs no further shuffle, so that sums over
    nearby pixels that follow are mostly formed before their own shuffle.
    """
    by = [*keys, "y", "x"]
    left = [c for c in first.columns if c not in by]
    right = [c for c in second.columns if c not in by]
    both = first.withColumn("_in", F.lit(1)).unionByName(second.withColumn("_in", F.lit(2)), allowMissingColumns=True)
    tiled = assign(both, 0, tile).repartition(*keys, TY, TX)
    found = tiled.groupBy(*keys, TY, TX, "y", "x").agg(F.bit_or("_in").alias("_in"), *[F.max(c).alias(c) for c in (*left, *right)])
    return found.where(F.col("_in") == 3).drop("_in", TY, TX)


def warp_forward(
    image: DataFrame, field: DataFrame, shape: tuple[int, int], dt: float = 1.0, column: str = "i", keys=FRAME
) -> DataFrame:
    """Every pixel deposits its value around ``(y + v*dt, x + u*dt)``; overlaps add up.

    Deposits outside the frame are lost, and so is what a pixel without a vector
    (NULL or NaN) or value would deposit; pixels that receive nothing are 0.
    """
    height, width = shape
    moved = beside(image.select(*keys, "y", "x", column), field.select(*keys, "y", "x", "u", "v"), keys)
    moved = moved.withColumns({"_y": F.col("y") + F.col("v") * dt, "_x": F.col("x") + F.col("u") * dt})
    moved = moved.withColumns({"_y0": F.floor("_y").cast("int"), "_x0": F.floor("_x").cast("int")})
    wy, wx = F.col("_y") - F.col("_y0"), F.col("_x") - F.col("_x0")
    lost = missing("u", "v", column)
    near = ~lost & (F.col("y") - F.col("_y0")).isin(0, 1) & (F.col("x") - F.col("_x0")).isin(0, 1)

    def corner(dy: int, dx: int, w: Column) -> Column:
        return F.struct((F.col("_y0") + dy).alias("y"), (F.col("_x0") + dx).alias("x"), (w * F.col(column)).alias("d"))

    deposits = F.array(
        *[F.when(~lost, c) for c in (corner(0, 0, (1.0 - wx) * (1.0 - wy)), corner(0, 1, wx * (1.0 - wy)), corner(1, 0, (1.0 - wx) * wy), corner(1, 1, wx * wy))],
        # a pixel whose own deposit does not reach it still appears, with 0
        F.when(~near, F.struct(F.col("y"), F.col("x"), F.lit(0.0).alias("d"))),
    )
    inside = F.filter(deposits, lambda s: s.isNotNull() & s["y"].between(0, height - 1) & s["x"].between(0, width - 1))
    spots = moved.select(*keys, F.explode(inside).alias("s")).select(*keys, "s.y", "s.x", "s.d")
    return spots.groupBy(*keys, "y", "x").agg(F.sum("d").alias(column))


def mean_pool2(table: DataFrame, columns: Sequence[str], shape: tuple[int, int], keys=FRAME) -> DataFrame:
    """Mean of 2x2 blocks; an odd last row or column is dropped."""
    kept = table.where((F.col("y") < shape[0] // 2 * 2) & (F.col("x") < shape[1] // 2 * 2))
    half = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("y", "x")]
    return kept.groupBy(*keys, *half).agg(*[F.avg(c).alias(c) for c in columns])


def pyramid(
    image: DataFrame,
    shape: tuple[int, int],
    levels: int,
    start_level: int = 0,
    steps: int = 1,
    column: str = "i",
    keys=FRAME,
) -> DataFrame:
    """Every level resized from the original; ``level`` 0 is the coarsest."""
    parts = []
    for depth in reversed(range(levels)):
        small = level_shape(shape, depth, start_level, steps)
        resized = resize_bilinear(image, [column], shape, small, keys)
        parts.append(resized.withColumn("level", F.lit(levels - 1 - depth)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def level_shape(shape: tuple[int, int], depth: int, start_level: int, steps: int) -> tuple[int, int]:
    factor = 2 ** (depth * steps + start_level)
    if min(shape) < factor:
        raise ValueError(f"a frame of {shape} has no level of factor {factor}")
    return shape[0] // factor, shape[1] // factor


def loss_unsupervised(first: DataFrame, second: DataFrame, field: DataFrame, shape, keys=FRAME) -> DataFrame:
    """Per frame: mean squared difference of the second image and the forward-warped first."""
    warped = warp_forward(first, field, shape, 1.0, "i", keys).withColumnRenamed("i", "_w")
    gap = F.col("i") - F.col("_w")
    return second.join(warped, [*keys, "y", "x"]).groupBy(*keys).agg(F.avg(gap * gap).alias("loss"))
