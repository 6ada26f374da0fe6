"""Consensus by the alternating direction method of multipliers.

Without regularisers every pixel is independent given the number of steps its
frame takes, so two passes suffice whatever the number of iterations: the first
runs all iterations per pixel and sums only the residuals per frame and
iteration, the second repeats them up to the iteration at which the frame
stopped. With regularisers a z-step looks two pixels away. Frames that fit one
tile are then solved in their task, many at a time; for larger ones an iteration
is one halo exchange of tiles, and stopped frames leave the loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as dc_field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.operators.consensus import REGULARIZERS
from driftgrid.deploy import ship
from driftgrid.functions.grids import list_column, runs
from driftgrid.scale import durable, release
from driftgrid.schema import FRAME, PIXEL, frame_shape
from driftgrid.tiles import TX, TY, assign

CLOSED = {"closed_form_l2": "l2", "closed_form_l1": "l1"}
SUMS = ("primal", "dual", "xx", "zz", "dd")


@dataclass(frozen=True)
class Config:
    rho: float = 1.0
    objective: str = "l2"
    solver_flows: str = "closed_form_l2"
    steps_flows: int | None = None
    rate_flows: float | None = None
    solver_consensus: str = "sgd"
    steps_consensus: int = 1
    rate_consensus: float = 0.01
    regularizers: dict[str, float] = dc_field(default_factory=dict)
    max_iterations: int = 10
    eps_abs: float | None = None
    eps_rel: float | None = None


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def config_from(options: dict) -> Config:
    """Checked settings from a config dict; unknown keys are ignored."""

    def option(name: str, default, test: Callable[[object], bool], what: str):
        value = options.get(name)
        if value is None:
            return default
        _check(test(value), f"{name} must be {what}, got {value!r}")
        return value

    def count(v):
        return isinstance(v, int) and not isinstance(v, bool) and v > 0

    def rate(v):
        return isinstance(v, float) and v > 0

    rho = option("rho", 1.0, lambda v: _number(v) and v > 0, "a positive number")
    objective = option("flows_objective_type", "l2", lambda v: v in ("l1", "l2"), "'l1' or 'l2'")
    solver = option("solver_flows", "closed_form_l2", lambda v: v in (*CLOSED, "sgd", "adam"), "a known solver")
    if solver in CLOSED:
        _check(objective == CLOSED[solver], f"{solver} needs flows_objective_type {CLOSED[solver]!r}")
        for name in ("num_iterations_flows", "learning_rate_flows"):
            _check(options.get(name) is None, f"{name} has no meaning for a closed form")
    names = option("regularizer_list", [], lambda v: isinstance(v, list), "a list")
    weights = option("regularizer_weights", {}, lambda v: isinstance(v, dict), "a dict")
    _check(all(_number(w) for w in weights.values()), "regularizer weights must be numbers")
    missing = [n for n in names if n not in weights]
    _check(not missing, f"no weight for regularizers {missing}")
    unknown = [n for n in names if n not in REGULARIZERS]
    _check(not unknown, f"unknown regularizers {unknown}")
    eps_abs = option("eps_abs_stopping", None, rate, "a positive float")
    eps_rel = option("eps_rel_stopping", None, rate, "a positive float")
    if (eps_abs is None) != (eps_rel is None):
        eps_abs, eps_rel = eps_abs or 0.0, eps_rel or 0.0
    closed = solver in CLOSED
    return Config(
        rho=float(rho),
        objective=objective,
        solver_flows=solver,
        steps_flows=None if closed else option("num_iterations_flows", 1, count, "a positive integer"),
        rate_flows=None if closed else option("learning_rate_flows", 0.01, rate, "a positive float"),
        solver_consensus=option("solver_consensus", "sgd", lambda v: v in ("sgd", "adam"), "'sgd' or 'adam'"),
        steps_consensus=option("num_iterations_consensus", 1, count, "a positive integer"),
        rate_consensus=option("learning_rate_consensus", 0.01, rate, "a positive float"),
        regularizers={n: float(weights[n]) for n in names if weights[n] != 0},
        max_iterations=option("max_admm_iterations", 10, count, "a positive integer"),
        eps_abs=eps_abs,
        eps_rel=eps_rel,
    )


def descend(start: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], solver: str, rate: float, steps: int) -> np.ndarray:
    """Gradient descent; the moments of ``adam`` start afresh on every call."""
    z = start
    first = second = np.zeros_like(start)
    for k in range(1, steps + 1):
        g = slope(z)
        if solver == "sgd":
            z = z - rate * g
            continue
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        z = z - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return z


def _beside(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The array read ``(dy, dx)`` further on in its last two axes, 0 outside."""
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)])
    return p[..., 1 + dy : p.shape[-2] - 1 + dy, 1 + dx : p.shape[-1] - 1 + dx]


def _central(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = np.zeros_like(a), np.zeros_like(a)
    dx[..., 1:-1, 1:-1] = (a[..., 1:-1, 2:] - a[..., 1:-1, :-2]) / 2
    dy[..., 1:-1, 1:-1] = (a[..., 2:, 1:-1] - a[..., :-2, 1:-1]) / 2
    return dx, dy


def regularizer_slope(z: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Gradient of the weighted regularisers at fields ``(..., h, w, 2)``."""
    out = np.zeros_like(z)
    diffs = [_central(z[..., c]) for c in (0, 1)]
    for name, weight in weights.items():
        if name == "divergence":
            div = diffs[0][0] + diffs[1][1]
            out[..., 0] += weight * (_beside(div, 0, -1) - _beside(div, 0, 1))
            out[..., 1] += weight * (_beside(div, -1, 0) - _beside(div, 1, 0))
            continue
        for c in (0, 1):
            dx, dy = diffs[c]
            if name == "laplacian":
                a, lap = z[..., c], np.zeros(z.shape[:-1])
                inner = a[..., 1:-1, 1:-1]
                lap[..., 1:-1, 1:-1] = (
                    a[..., 1:-1, 2:] + a[..., 1:-1, :-2] + a[..., 2:, 1:-1] + a[..., :-2, 1:-1] - 4 * inner
                )
                around = _beside(lap, -1, 0) + _beside(lap, 1, 0) + _beside(lap, 0, -1) + _beside(lap, 0, 1)
                out[..., c] += weight * 2 * (around - 4 * lap)
                continue
            scale = 1.0
            if name == "tv":
                g = np.sqrt(dx * dx + dy * dy + 1e-4)
                dx, dy, scale = dx / g, dy / g, 0.5
            out[..., c] += weight * scale * (_beside(dx, 0, -1) - _beside(dx, 0, 1) + _beside(dy, -1, 0) - _beside(dy, 1, 0))
    return out


def one_iteration(cfg: Config, a, w, x, z, d, grid: tuple[int, int] | None = None):
    """New ``x, z, d`` of pixels: ``a, x, d`` are (..., P, N, 2), ``w`` (..., P, N, 1), ``z`` (..., P, 2)."""
    target = z[..., None, :] - d
    if cfg.solver_flows == "closed_form_l2":
        x = (2.0 * w * a + cfg.rho * target) / (2.0 * w + cfg.rho)
    elif cfg.solver_flows == "closed_form_l1":
        gap = target - a
        x = a + np.sign(gap) * np.maximum(np.abs(gap) - w / cfg.rho, 0.0)
    else:

        def slope_x(q):
            pull = 2.0 * w * (q - a) if cfg.objective == "l2" else w * np.sign(q - a)
            return pull + cfg.rho * (q - target)

        x = descend(x, slope_x, cfg.solver_flows, cfg.rate_flows, cfg.steps_flows)
    total, n = (x + d).sum(axis=-2), x.shape[-2]

    def slope_z(q):
        g = cfg.rho * (n * q - total)
        if cfg.regularizers:
            fields = q.reshape(*q.shape[:-2], *grid, 2)
            g = g + regularizer_slope(fields, cfg.regularizers).reshape(q.shape)
        return g

    z_new = descend(z, slope_z, cfg.solver_consensus, cfg.rate_consensus, cfg.steps_consensus)
    return x, z_new, d + x - z_new[..., None, :]


def _square_sums(x, z, d, z_old) -> np.ndarray:
    """Per pixel (last axis: the five sums of squares of the stopping test)."""
    wide = [((x - z[..., None, :]) ** 2).sum(axis=-2), (z - z_old) ** 2, (x**2).sum(axis=-2), z**2, (d**2).sum(axis=-2)]
    return np.stack([p.sum(axis=-1) for p in wide], axis=-1)


def _within(cfg: Config, sums: np.ndarray, n: int, pixels: int) -> np.ndarray:
    """The stopping test for frames with ``n`` estimators, given (frames, 5) sums."""
    primal, dual, xx, zz, dd = np.sqrt(sums).T
    root, several = np.sqrt(n * pixels * 2.0), np.sqrt(n)
    primal_ok = primal <= root * cfg.eps_abs + cfg.eps_rel * np.maximum(xx, several * zz)
    return primal_ok & (cfg.rho * several * dual <= root * cfg.eps_abs + cfg.eps_rel * cfg.rho * dd)


def _stops(sums: DataFrame, cfg: Config) -> DataFrame:
    """The same test on a table of sums: adds ``met`` (``n`` estimators, ``pixels``)."""
    n, root = F.sqrt(F.col("n")), F.sqrt(F.col("n") * F.col("pixels") * 2.0)
    scale = F.greatest(F.sqrt("xx"), n * F.sqrt("zz"))
    primal_ok = F.sqrt("primal") <= root * cfg.eps_abs + cfg.eps_rel * scale
    dual_ok = cfg.rho * n * F.sqrt("dual") <= root * cfg.eps_abs + cfg.eps_rel * cfg.rho * F.sqrt("dd")
    return sums.withColumn("met", primal_ok & dual_ok)


@dataclass(frozen=True)
class Result:
    """``field``: the consensus; ``stops``: per frame ``stopped`` and ``stop_iter`` (0-based, NULL if never)."""

    field: DataFrame
    stops: DataFrame


def consensus_admm(
    weighted: DataFrame, options: dict | None = None, keys=FRAME, shape: tuple[int, int] | None = None, tile: int = 512
) -> Result:
    """Fused field and stopping iterations of a weighted ensemble.

    ``shape`` saves looking up the frame size when there are regularisers.
    """
    cfg = config_from(options or {})
    ship(weighted.sparkSession)
    keys = list(keys)
    packed = weighted.groupBy(*keys, *PIXEL).agg(
        F.sort_array(F.collect_list(F.struct("estimator", "u", "v", "w"))).alias("e")
    )
    pixels = durable(packed.select(*keys, *PIXEL, F.col("e.u").alias("au"), F.col("e.v").alias("av"), F.col("e.w").alias("w")))
    if not cfg.regularizers:
        return _pointwise(pixels, cfg, keys)
    if max(shape or frame_shape(pixels)) <= tile:
        return _whole_frames(pixels, cfg, keys)
    return _tiled(pixels, cfg, keys)


def _lists(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def _anchors(batch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([_lists(batch, "au"), _lists(batch, "av")], axis=2), _lists(batch, "w")[:, :, None]


def _same_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches split so that all pixels of a piece have equally many estimators."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.asarray(pa.compute.list_value_length(batch.column("w")))
        for size in np.unique(sizes):
            piece = table.filter(pa.array(sizes == size))
            if piece.num_rows:
                yield piece


def _begin(a):
    z = a.mean(axis=-2)
    return a.copy(), z, a - z[..., None, :]


def _pointwise(pixels: DataFrame, cfg: Config, keys) -> Result:
    key_fields = [pixels.schema[k] for k in keys]
    if cfg.eps_abs is None:
        planned = pixels.withColumn("runs", F.lit(cfg.max_iterations))
        stops = pixels.where("y = 0 AND x = 0").select(
            *keys, F.lit(False).alias("stopped"), F.lit(None).cast("int").alias("stop_iter")
        )
    else:
        fields = [*key_fields, T.StructField("iter", T.IntegerType()), T.StructField("n", T.LongType())]
        fields += [T.StructField("pixels", T.LongType()), *[T.StructField(s, T.DoubleType()) for s in SUMS]]

        def residuals(batches):
            for piece in _same_size(batches):
                a, w = _anchors(piece)
                key_frame = piece.select(keys).to_pandas()
                x, z, d = _begin(a)
                found = []
                for it in range(cfg.max_iterations):
                    z_old = z
                    x, z, d = one_iteration(cfg, a, w, x, z, d)
                    part = key_frame.copy()
                    part[list(SUMS)] = _square_sums(x, z, d, z_old)
                    summed = part.groupby(keys, sort=False, as_index=False).agg("sum")
                    counts = key_frame.groupby(keys, sort=False).size().to_numpy()
                    summed.insert(len(keys), "iter", np.int32(it))
                    summed.insert(len(keys) + 1, "n", np.int64(a.shape[1]))
                    summed.insert(len(keys) + 2, "pixels", counts.astype(np.int64))
                    found.append(summed)
                yield from pa.Table.from_pandas(pd.concat(found), preserve_index=False).to_batches()

        sums = pixels.mapInArrow(residuals, T.StructType(fields)).groupBy(*keys, "iter", "n")
        sums = sums.agg(F.sum("pixels").alias("pixels"), *[F.sum(s).alias(s) for s in SUMS])
        at = _stops(sums, cfg).groupBy(*keys).agg(F.min(F.when(F.col("met"), F.col("iter"))).alias("stop_iter"))
        stops = durable(at.select(*keys, F.col("stop_iter").isNotNull().alias("stopped"), "stop_iter"))
        runs = F.coalesce(F.col("stop_iter") + 1, F.lit(cfg.max_iterations))
        planned = pixels.join(stops.select(*keys, runs.alias("runs")), keys)
    out_schema = T.StructType([*key_fields, *[pixels.schema[p] for p in PIXEL]]).add("u", T.DoubleType()).add("v", T.DoubleType())

    def solve(batches):
        for piece in _same_size(batches):
            a, w = _anchors(piece)
            runs = piece.column("runs").to_numpy()
            x, z, d = _begin(a)
            for it in range(int(runs.max())):
                live = np.flatnonzero(runs > it)
                x, z, d = x.copy(), z.copy(), d.copy()
                x[live], z[live], d[live] = one_iteration(cfg, a[live], w[live], x[live], z[live], d[live])
            done = piece.select([*keys, *PIXEL]).append_column("u", pa.array(z[:, 0])).append_column("v", pa.array(z[:, 1]))
            yield from done.to_batches()

    return Result(planned.mapInArrow(solve, out_schema), stops)


def _frame_stacks(batch: pa.RecordBatch):
    """Frames of one shape and estimator count, a bounded number at a time: rows in the batch, shape, anchors and weights."""
    starts = batch.column("y").offsets.to_numpy()
    ys, xs = (batch.column(c).values.to_numpy()[: starts[-1]] for c in PIXEL)
    nested = {c: batch.column(c).values for c in ("au", "av", "w")}
    inner = nested["w"].offsets.to_numpy()
    values = {c: v.values.to_numpy() for c, v in nested.items()}
    h = np.maximum.reduceat(ys, starts[:-1]) + 1
    w = np.maximum.reduceat(xs, starts[:-1]) + 1
    if (h * w != np.diff(starts)).any():
        raise ValueError("a frame is not dense")
    n = np.diff(inner)[starts[:-1]]
    kinds = np.stack([h, w, n], axis=1)
    for kind in np.unique(kinds, axis=0):
        height, width, count = (int(v) for v in kind)
        for rows in runs(np.flatnonzero((kinds == kind).all(axis=1)), height * width * count * 2):
            index = starts[rows][:, None] + np.arange(height * width)
            order = np.argsort(ys[index] * width + xs[index], axis=1)
            cells = inner[np.take_along_axis(index, order, axis=1)][..., None] + np.arange(count)
            anchors = np.stack([values["au"][cells], values["av"][cells]], axis=-1)
            yield rows, (height, width), anchors, values["w"][cells][..., None]


def _whole_frames(pixels: DataFrame, cfg: Config, keys) -> Result:
    packed = (
        pixels.groupBy(*keys)
        .agg(F.collect_list(F.struct(*PIXEL, "au", "av", "w")).alias("_px"))
        .select(*keys, *[F.col(f"_px.{c}").alias(c) for c in (*PIXEL, "au", "av", "w")])
    )
    schema = T.StructType([pixels.schema[k] for k in keys]).add("width", T.IntegerType()).add("stop_iter", T.IntegerType())
    for c in ("u", "v"):
        schema = schema.add(c, T.ArrayType(T.DoubleType()))

    def solve(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for rows, grid, a, w in _frame_stacks(batch):
                x, z, d = _begin(a)
                stop = np.full(len(rows), -1, dtype=np.int32)
                for it in range(cfg.max_iterations):
                    live = np.flatnonzero(stop < 0)
                    if not len(live):
                        break
                    z_old = z[live]
                    new = one_iteration(cfg, a[live], w[live], x[live], z_old, d[live], grid)
                    x[live], z[live], d[live] = new
                    if cfg.eps_abs is not None:
                        sums = _square_sums(*new, z_old).sum(axis=-2)
                        stop[live[_within(cfg, sums, a.shape[-2], a.shape[-3])]] = it
                arrays = [batch.column(k).take(pa.array(rows)) for k in keys]
                arrays += [pa.array(np.full(len(rows), grid[1], dtype=np.int32)), pa.array(stop, mask=stop < 0)]
                arrays += [list_column(z[..., c], pa.float64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    solved = durable(packed.mapInArrow(solve, schema))
    long = solved.select(*keys, "width", F.posexplode(F.arrays_zip("u", "v")).alias("_p", "_v"))
    field = long.select(
        *keys,
        F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"),
        (F.col("_p") % F.col("width")).cast("int").alias("x"),
        F.col("_v.u").alias("u"),
        F.col("_v.v").alias("v"),
    )
    return Result(field, solved.select(*keys, F.col("stop_iter").isNotNull().alias("stopped"), "stop_iter"))


def _tiled(pixels: DataFrame, cfg: Config, keys) -> Result:
    halo = 2 * cfg.steps_consensus
    tile = max(128, 2 * halo)

    def mean(name):
        return F.aggregate(name, F.lit(0.0), lambda s, v: s + v) / F.size(name)

    state = pixels.withColumns({"zu": mean("au"), "zv": mean("av"), "xu": F.col("au"), "xv": F.col("av")})
    state = state.withColumns(
        {"du": F.transform("au", lambda v: v - F.col("zu")), "dv": F.transform("av", lambda v: v - F.col("zv"))}
    )
    names = state.columns
    schema = T.StructType([*state.schema.fields, *[T.StructField(s, T.DoubleType()) for s in SUMS]])

    def run(group: pa.Table) -> pa.Table:
        ty, tx = group.column(TY)[0].as_py(), group.column(TX)[0].as_py()
        ys, xs = (group.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        order = np.lexsort((xs, ys))
        group = group.select(names).take(pa.array(order)).combine_chunks()
        ys, xs = ys[order], xs[order]
        shape = (int(ys[-1] - ys[0]) + 1, int(xs.max() - xs.min()) + 1)
        if shape[0] * shape[1] != len(ys):
            raise ValueError("tile is not dense")
        a, w = _anchors(group)
        x = np.stack([_lists(group, "xu"), _lists(group, "xv")], axis=2)
        d = np.stack([_lists(group, "du"), _lists(group, "dv")], axis=2)
        z_old = np.stack([group.column("zu").to_numpy(), group.column("zv").to_numpy()], axis=1)
        x, z, d = one_iteration(cfg, a, w, x, z_old, d, shape)
        sums = _square_sums(x, z, d, z_old)
        mine = np.flatnonzero((ys // tile == ty) & (xs // tile == tx))
        new = {
            "zu": z[mine, 0], "zv": z[mine, 1],
            "xu": x[mine, :, 0], "xv": x[mine, :, 1], "du": d[mine, :, 0], "dv": d[mine, :, 1],
        }
        kept = group.take(pa.array(mine))
        arrays = []
        for n in names:
            kind = kept.schema.field(n).type
            if n not in new:
                arrays.append(kept.column(n))
            elif new[n].ndim == 1:
                arrays.append(pa.array(new[n], type=kind))
            else:
                arrays.append(list_column(new[n], pa.float64()).cast(kind))
        arrays += [pa.array(sums[mine, k]) for k in range(len(SUMS))]
        return pa.Table.from_arrays(arrays, names=[*names, *SUMS])

    finished, ends = [], []
    for it in range(cfg.max_iterations):
        moved = durable(assign(state.select(*names), halo, tile).groupBy(*keys, TY, TX).applyInArrow(run, schema))
        release(state)
        if cfg.eps_abs is None:
            # keep the stored table itself, so that the next round can release it
            state = moved
            continue
        sums = moved.groupBy(*keys).agg(
            F.max(F.size("w")).alias("n"), F.count(F.lit(1)).alias("pixels"), *[F.sum(s).alias(s) for s in SUMS]
        )
        verdict = durable(_stops(sums, cfg).select(*keys, "met"))
        state = moved
        if not verdict.where("met").isEmpty():
            joined = moved.join(verdict, keys)
            finished.append(durable(joined.where("met").select(*keys, *PIXEL, "zu", "zv")))
            ends.append(verdict.where("met").select(*keys, F.lit(True).alias("stopped"), F.lit(it).alias("stop_iter")))
            state = durable(joined.where(~F.col("met")).select(*moved.columns))
            release(moved)
        if verdict.where(~F.col("met")).isEmpty():
            break
    finished.append(state.select(*keys, *PIXEL, "zu", "zv"))
    ends.append(
        state.where("y = 0 AND x = 0").select(*keys, F.lit(False).alias("stopped"), F.lit(None).cast("int").alias("stop_iter"))
    )
    field, stops = finished[0], ends[0]
    for more in finished[1:]:
        field = field.unionByName(more)
    for more in ends[1:]:
        stops = stops.unionByName(more)
    return Result(field.select(*keys, *PIXEL, F.col("zu").alias("u"), F.col("zv").alias("v")), stops)
