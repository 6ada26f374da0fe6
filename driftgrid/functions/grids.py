"""Numpy helpers used inside tasks on tiles (never on a whole frame or table)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def columns_of(table: pa.Table) -> dict[str, np.ndarray]:
    return {n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in table.column_names}


def as_grid(table: pa.Table) -> tuple[dict[str, np.ndarray], int, int]:
    """Columns of a dense tile as 2-D arrays, with the tile's first row and column."""
    cols = columns_of(table)
    y, x = cols["y"].astype(np.int64), cols["x"].astype(np.int64)
    y0, x0 = int(y.min()), int(x.min())
    h, w = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
    if h * w != len(y):
        raise ValueError(f"tile at ({y0}, {x0}) is not dense: {len(y)} pixels for {h}x{w}")
    place = (y - y0) * w + (x - x0)
    grids = {}
    for name, values in cols.items():
        flat = np.empty(h * w, dtype=values.dtype)
        flat[place] = values
        grids[name] = flat.reshape(h, w)
    return grids, y0, x0


@dataclass(frozen=True)
class Stack:
    """Tiles of one shape from one Arrow batch: ``rows`` in the batch, arrays (n, h, w)."""

    rows: np.ndarray
    grids: dict[str, np.ndarray]
    y0: np.ndarray
    x0: np.ndarray


#: Numbers a stack holds at most, unless one tile has more: what is computed from it is several times as large.
STACK_CELLS = 1 << 18


def runs(rows: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """The rows in runs of at most ``STACK_CELLS`` numbers, ``each`` per row."""
    size = max(1, STACK_CELLS // max(1, each))
    for k in range(0, len(rows), size):
        yield rows[k : k + size]


def stacks(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[Stack]:
    """Tiles given as unordered pixel lists (``y``, ``x`` and ``names``), grouped by shape, a bounded number at a time."""
    starts = batch.column("y").offsets.to_numpy()
    flat = {n: batch.column(n).values.to_numpy(zero_copy_only=False)[: starts[-1]] for n in ("y", "x", *names)}
    lengths = np.diff(starts)
    y0, x0 = (np.minimum.reduceat(flat[a], starts[:-1]).astype(np.int64) for a in ("y", "x"))
    h = np.maximum.reduceat(flat["y"], starts[:-1]) - y0 + 1
    w = np.maximum.reduceat(flat["x"], starts[:-1]) - x0 + 1
    if (h * w != lengths).any():
        raise ValueError("a tile is not dense")
    for height, width in np.unique(np.stack([h, w], axis=1), axis=0):
        area = int(height * width)
        for rows in runs(np.flatnonzero((h == height) & (w == width)), area):
            index = (starts[rows][:, None] + np.arange(area)).ravel()
            owner = np.repeat(np.arange(len(rows)), area)
            place = owner * area + (flat["y"][index] - y0[rows][owner]) * width + flat["x"][index] - x0[rows][owner]
            grids = {}
            for n in names:
                cells = np.empty(len(index), dtype=flat[n].dtype)
                cells[place] = flat[n][index]
                grids[n] = cells.reshape(len(rows), int(height), int(width))
            yield Stack(rows, grids, y0[rows], x0[rows])


def list_column(cells: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per first-axis entry."""
    each = int(np.prod(cells.shape[1:]))
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * each
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()).cast(kind))


def _grown(a: np.ndarray, by: int, mode: str) -> np.ndarray:
    return np.pad(a, [(0, 0)] * (a.ndim - 2) + [(by, by), (by, by)], mode=mode)


def edge_neighbour_mean(a: np.ndarray) -> np.ndarray:
    """Mean of the four neighbours in the last two axes, the border repeated outwards."""
    p = _grown(a, 1, "edge")
    return (p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:]) / 4.0


def ring_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """Zero-padded window mean without the centre; the divisor is always ``(2r+1)**2 - 1``."""
    size = 2 * radius + 1
    p = _grown(a, radius, "constant")
    rows = sum(p[..., k : k + a.shape[-1]] for k in range(size))
    total = sum(rows[..., k : k + a.shape[-2], :] for k in range(size))
    return (total - a) / (size * size - 1)
