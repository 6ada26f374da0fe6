"""Structured Streaming twins of the sequence operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftgrid.deploy import ship

EMA_OUTPUT = "key long, ts timestamp, seq long, value double, ema double, late long"
# What a group's state holds of every key, besides the operator's own.
MARKS = {"keys": "array<long>", "last_us": "array<long>", "last_seq": "array<long>", "late": "array<long>", "due": "array<long>"}
#: Keys that share a call and a state: a call costs as much as some thousand rows.
KEYS = 16
#: Before every time, and a row without one (sorted last).
NEVER, NO_TIME = -(2**63), 2**63 - 1


@dataclass
class _Group:
    """The rows of a group's keys in one micro-batch (which the trigger bounds), and what the keys leave to the next.

    ``rows`` are the new ones by ``(key, ts, seq)``, with ``late``. Late is what is not after the last row its key
    consumed, including repeats; ``late`` of a row counts those up to it. Per key of the rows: its ``names``,
    ``starts`` (of its rows, and their end), its number in ``before`` or -1.
    """

    rows: pd.DataFrame
    names: list
    starts: np.ndarray
    before: np.ndarray


def _new_rows(batches: Iterator[pd.DataFrame], held: dict[str, list]) -> tuple[_Group, dict[str, list]]:
    """The group of a micro-batch and the keys' new marks (``held`` has those of before: ``MARKS`` without ``due``)."""
    rows = pd.concat(list(batches)).sort_values(["key", "us", "seq"], kind="stable", ignore_index=True)
    number, found = pd.factorize(rows["key"], use_na_sentinel=False)
    names = [None if pd.isna(k) else int(k) for k in found]
    place = {k: n for n, k in enumerate(held["keys"])}
    before = np.array([place.get(k, -1) for k in names])

    def of(name: str, first: int) -> np.ndarray:
        return np.array([*held[name], first], np.int64)[before]  # -1: a new key

    us, last_us, last_seq, late = rows["us"], of("last_us", NEVER), of("last_seq", -1), of("late", 0)
    seen = last_us[number]
    old = (us < seen) | ((us == seen) & (rows["seq"] <= last_seq[number])) | (us == NO_TIME) | rows.duplicated(["key", "us", "seq"])
    counted = old.to_numpy().astype(np.int64)
    upto = np.cumsum(counted)
    ends = np.searchsorted(number, np.arange(len(names)), side="right")
    begins = np.append(0, ends[:-1])
    earlier = upto[begins] - counted[begins]
    rows["late"] = (late - earlier)[number] + upto
    late = late + upto[ends - 1] - earlier
    rows = rows[~old].reset_index(drop=True)
    starts = np.searchsorted(number[~old.to_numpy()], np.arange(len(names) + 1))
    fresh = np.flatnonzero(np.diff(starts))
    last_us[fresh] = rows["us"].to_numpy()[starts[fresh + 1] - 1]
    last_seq[fresh] = rows["seq"].to_numpy()[starts[fresh + 1] - 1]
    marks = {"keys": names, "last_us": last_us.tolist(), "last_seq": last_seq.tolist(), "late": late.tolist()}
    return _Group(rows, names, starts, before), marks


def _by_key(
    stream: DataFrame, advance: Callable, kept: Mapping[str, str], output: str, key: str, ts: str, seq: str, value: str, watermark: str, expiry_ms: int | None
) -> DataFrame:
    """Rows through a function with state per key; ``KEYS`` neighbouring keys go through one call and share one state.

    ``advance(group, held)`` gives the columns that ``rows`` get and, per key of the group, what it leaves: the columns
    ``kept`` of ``held``, which holds them by key as lists. Keys expire one by one.
    """
    ship(stream.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.EventTimeTimeout
    kinds = {**MARKS, **kept}
    columns = [c.split()[0] for c in output.split(", ")]

    def fold(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {name: list(v) for name, v in zip(kinds, state.get)} if state.exists else {name: [] for name in kinds}
        names, out = [], None
        if not state.hasTimedOut:
            group, left = _new_rows(batches, held)
            made, carried = advance(group, held)
            left.update(carried)
            names, out = group.names, group.rows.assign(**made)[columns]
        now = 0 if expiry_ms is None else state.getCurrentWatermarkMs()
        met = set(names)
        silent = [n for n, (k, due) in enumerate(zip(held["keys"], held["due"])) if k not in met and (expiry_ms is None or due >= now)]
        next_ = {name: [v[n] for n in silent] for name, v in held.items()}
        if names:
            left["due"] = [0 if expiry_ms is None else max(us // 1000, now) + expiry_ms for us in left["last_us"]]
            next_ = {name: v + left[name] for name, v in next_.items()}
        if next_["keys"]:
            state.update(tuple(next_[name] for name in kinds))
            if expiry_ms is not None:
                state.setTimeoutTimestamp(min(next_["due"]))
        else:
            state.remove()
        if out is not None:
            yield out

    name = F.col(key).cast("long")
    rows = stream.select(
        F.shiftright(name, KEYS.bit_length() - 1).alias("_group"),
        name.alias("key"),
        F.col(ts).alias("ts"),
        F.col(seq).cast("long").alias("seq"),
        F.col(value).cast("double").alias("value"),
    ).withWatermark("ts", watermark)
    rows = rows.withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)))
    return rows.groupBy("_group").applyInPandasWithState(fold, output, ", ".join(f"{n} {kind}" for n, kind in kinds.items()), "append", timeout)


def _recursion(values: np.ndarray, alpha: float, level: float) -> np.ndarray:
    """``a*x + (1-a)*previous`` in pieces short enough for the weights to stay within a double."""
    keep = 1.0 - alpha
    if keep <= 0.0:
        return values.copy()
    size = max(1, min(4096, int(100.0 / max(-math.log10(keep), 1e-9))))
    out = np.empty(len(values))
    for i in range(0, len(values), size):
        x = values[i : i + size]
        weight = keep ** np.arange(len(x), dtype=float)
        out[i : i + len(x)] = weight * (keep * level + np.cumsum(alpha * x / weight))
        level = out[i + len(x) - 1]
    return out


def ema_stream(
    stream: DataFrame,
    alpha: float,
    key: str,
    ts: str = "ts",
    seq: str = "seq",
    value: str = "value",
    initial: float = 0.0,
    watermark: str = "1 hour",
    expiry_ms: int | None = None,
) -> DataFrame:
    """Recursive average per key over a stream, in ``(ts, seq)`` order.

    A recursive value cannot be corrected afterwards: rows older than what a key
    has already consumed are left out and counted in ``late``. With
    ``expiry_ms`` the state of a key silent for that long (event time) is
    dropped and the key starts again from ``initial``.
    """
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be in the range [0, 1], got {alpha}")

    def advance(group: _Group, held: dict[str, list]) -> tuple[dict, dict]:
        values, out = group.rows["value"].to_numpy(float), np.empty(len(group.rows))
        levels = [held["ema"][n] if n >= 0 else float(initial) for n in group.before]
        for k, (i, j) in enumerate(pairwise(group.starts)):
            if i < j:
                out[i:j] = _recursion(values[i:j], alpha, levels[k])
                levels[k] = float(out[j - 1])
        return {"ema": out}, {"ema": levels}

    return _by_key(stream, advance, {"ema": "array<double>"}, EMA_OUTPUT, key, ts, seq, value, watermark, expiry_ms)


def running_metrics_stream(stream: DataFrame, value: str, keys=()) -> DataFrame:
    """Running mean, maximum and minimum; write it in ``complete`` or ``update`` mode."""
    return stream.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("run_mean"),
        F.max(value).alias("run_max"),
        F.min(value).alias("run_min"),
    )


HISTORY_OUTPUT = "key long, ts timestamp, seq long, hist array<double>, late long"


def history_stream(
    stream: DataFrame,
    length: int,
    key: str,
    ts: str = "ts",
    seq: str = "seq",
    value: str = "value",
    watermark: str = "1 hour",
    expiry_ms: int | None = None,
) -> DataFrame:
    """The last ``length`` values per key after every step, the first value filling the start.

    Late rows are left out and counted, and silent keys expire, as in ``ema_stream``.
    """
    if length < 1:
        raise ValueError("length must be positive")

    def advance(group: _Group, held: dict[str, list]) -> tuple[dict, dict]:
        values = group.rows["value"].to_numpy(float)
        parts, last = [], []
        for n, (i, j) in zip(group.before, pairwise(group.starts)):
            recent = held["hist"][n] if n >= 0 else []
            if i < j:
                parts += [recent[1:] if len(recent) else [values[i]] * (length - 1), values[i:j]]
                recent = np.concatenate(parts[-2:])[-length:].tolist()
            last.append(list(recent))
        made: list = []
        if parts:
            windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(parts), length)
            # a key's values follow the length - 1 before them
            turn = np.cumsum(np.diff(group.starts) > 0) - 1
            made = list(windows[np.arange(len(values)) + (length - 1) * np.repeat(turn, np.diff(group.starts))])
        return {"hist": made}, {"hist": last}

    return _by_key(stream, advance, {"hist": "array<array<double>>"}, HISTORY_OUTPUT, key, ts, seq, value, watermark, expiry_ms)
