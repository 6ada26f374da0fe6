"""Iterated stencils: several steps per halo exchange.

A step that looks ``reach`` pixels away can be repeated ``halo // reach`` times
on a tile before the halo is used up, so ``n`` steps need about
``n * reach / halo`` shuffles instead of ``n``; frames no larger than a tile need
one. Between exchanges the state is a durable table, which also cuts the lineage.

A tile is packed into one row of arrays; tasks work on stacks of equally
shaped tiles, as many as one Arrow batch holds (Spark bounds a batch by
``spark.sql.execution.arrow.maxBytesPerBatch``), so small frames do not cost
one Python call each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship
from driftgrid.functions.grids import list_column, stacks
from driftgrid.scale import durable, release
from driftgrid.schema import FRAME, PIXEL, frame_shape
from driftgrid.tiles import TX, TY, assign

Step = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def iterate(
    df: DataFrame,
    step: Step,
    state: Sequence[str],
    fixed: Sequence[str],
    steps: int,
    reach: int = 1,
    halo: int = 64,
    tile: int = 512,
    keys: Sequence[str] = FRAME,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Apply ``step`` ``steps`` times to the ``state`` columns of every frame.

    ``step`` maps arrays (tiles, rows, columns) to new arrays of the state
    columns and must treat the array border as the frame border.
    """
    per_round = halo // reach
    if per_round < 1 or halo > tile:
        raise ValueError("need reach <= halo <= tile")
    keys, names = list(keys), [*state, *fixed]
    table = df.select(*keys, *PIXEL, *names)
    if steps > per_round and max(shape or frame_shape(table)) <= tile:
        # no frame crosses a tile border: all borders are true ones
        return _superstep(table, step, names, steps, 0, tile, keys)
    done = 0
    while done < steps:
        now = min(per_round, steps - done)
        moved = _superstep(table, step, names, now, now * reach, tile, keys)
        done += now
        if done < steps:
            moved = durable(moved)
            release(table)
        table = moved
    return table


def _superstep(table: DataFrame, step: Step, names: list[str], now: int, halo: int, tile: int, keys) -> DataFrame:
    packed = (
        assign(table, halo, tile)
        .groupBy(*keys, TY, TX)
        .agg(F.collect_list(F.struct(*PIXEL, *names)).alias("_px"))
        .select(*keys, TY, TX, *[F.col(f"_px.{c}").alias(c) for c in (*PIXEL, *names)])
    )
    schema = T.StructType([table.schema[k] for k in keys])
    for n in ("_oy", "_ox", "_ow"):
        schema = schema.add(n, T.IntegerType())
    for n in names:
        schema = schema.add(n, T.ArrayType(table.schema[n].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ty, tx = (batch.column(c).to_numpy().astype(np.int64) for c in (TY, TX))
            kinds = {n: batch.schema.field(n).type.value_type for n in names}
            for stack in stacks(batch, names):
                grids = stack.grids
                for _ in range(now):
                    grids = {**grids, **step(grids)}
                height, width = next(iter(grids.values())).shape[1:]
                first_y, first_x = ty[stack.rows] * tile, tx[stack.rows] * tile
                top = np.maximum(first_y - stack.y0, 0)
                left = np.maximum(first_x - stack.x0, 0)
                bottom = np.minimum(first_y + tile - stack.y0, height)
                right = np.minimum(first_x + tile - stack.x0, width)
                cuts = np.stack([top, left, bottom, right], axis=1)
                for cut in np.unique(cuts, axis=0):
                    mine = np.flatnonzero((cuts == cut).all(axis=1))
                    t, lf, b, r = (int(v) for v in cut)
                    if t >= b or lf >= r:
                        continue  # halo only: a tile beyond the frame's last one
                    arrays = [batch.column(k).take(pa.array(stack.rows[mine])) for k in keys]
                    arrays += [
                        pa.array((stack.y0[mine] + t).astype(np.int32)),
                        pa.array((stack.x0[mine] + lf).astype(np.int32)),
                        pa.array(np.full(len(mine), r - lf, dtype=np.int32)),
                    ]
                    arrays += [list_column(grids[n][mine][:, t:b, lf:r], kinds[n]) for n in names]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "_oy", "_ox", "_ow", *names])

    ship(table.sparkSession)
    moved = packed.mapInArrow(run, schema)
    long = moved.select(*keys, "_oy", "_ox", "_ow", F.posexplode(F.arrays_zip(*names)).alias("_p", "_v"))
    return long.select(
        *keys,
        (F.col("_oy") + F.floor(F.col("_p") / F.col("_ow"))).cast("int").alias("y"),
        (F.col("_ox") + F.col("_p") % F.col("_ow")).cast("int").alias("x"),
        *[F.col(f"_v.{n}").alias(n) for n in names],
    )
