"""Operators along the time axis of frame sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.scale import attach

PIXEL_OF = ("seq_id", "y", "x")


BLOCK = 4096


def _blocks(table: DataFrame, time: str, reach: int, size: int) -> DataFrame:
    """Cut the time axis into blocks; steps that a later block looks back at are copied to it.

    ``time`` counts 0, 1, 2, … per key. A window over ``(keys, _block)`` then sees
    at most ``size + reach`` rows, however long a sequence is.
    """
    first, last = F.floor(F.col(time) / size), F.floor((F.col(time) + reach) / size)
    return table.withColumn("_block", F.explode(F.sequence(first, last)))


def _own(table: DataFrame, time: str, size: int) -> DataFrame:
    return table.where(F.col("_block") == F.floor(F.col(time) / size)).drop("_block")


def _in_block(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys, "_block").orderBy(time)


def history(
    table: DataFrame,
    columns: Sequence[str],
    length: int,
    keys: Sequence[str] = PIXEL_OF,
    time: str = "t",
    block: int = BLOCK,
) -> DataFrame:
    """Add ``hist``: the last ``length`` values, oldest first.

    Before enough steps have passed the first value fills the missing places.
    """
    size = max(block, length)
    blocked = _blocks(table, time, length - 1, size)
    recent = F.collect_list(F.struct(*columns)).over(_in_block(keys, time).rowsBetween(-(length - 1), 0))
    out = _own(blocked.withColumn("hist", recent), time, size)
    fill = F.array_repeat(F.get("hist", F.lit(0)), length - F.size("hist"))
    return out.withColumn("hist", F.concat(fill, F.col("hist")))


def temporal_init(field: DataFrame, keys: Sequence[str] = PIXEL_OF, time: str = "t", block: int = BLOCK) -> DataFrame:
    """Starting field of each step: the previous estimate, zero at the first step."""
    line = _in_block(keys, time)
    blocked = _blocks(field, time, 1, block)
    begun = blocked.withColumns({f"{c}0": F.coalesce(F.lag(c).over(line), F.lit(0.0)) for c in ("u", "v")})
    return _own(begun, time, block)


def ema(
    field: DataFrame,
    alpha: float,
    columns: Sequence[str] = ("u", "v"),
    initial: float = 0.0,
    keys: Sequence[str] = PIXEL_OF,
    time: str = "t",
    block: int = BLOCK,
    steps: int | None = None,
) -> DataFrame:
    """Recursive average ``a*x + (1-a)*previous``; ``time`` counts 0, 1, 2, … per key.

    Blocks of steps are averaged independently; what a block leaves at its end is
    averaged over the blocks in the same way and fades into the next block. So
    nothing is cut off and no task sees more than ``block`` steps of a key. As in
    the recursion, a NULL makes all later values NULL and a NaN or infinity stays.
    ``steps``, the length of the longest sequence, saves a pass if it is known.
    """
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must be in the range [0, 1], got {alpha}")
    if alpha == 1.0:
        return field
    if alpha == 0.0:
        return field.withColumns({c: F.lit(float(initial)) for c in columns})
    if steps is None:
        steps = (field.agg(F.max(time)).first()[0] or 0) + 1
    keys, keep, parts = list(keys), 1.0 - alpha, {}
    for c in columns:
        x = F.col(c).cast("double")
        kind = F.when(x.isNull(), _NULL).when(F.isnan(x), _NAN).when(x == math.inf, _HIGH).when(x == -math.inf, _LOW).otherwise(0)
        parts |= {f"_f_{c}": kind, c: F.when(kind == 0, x).otherwise(0.0)}
    faded = _faded(field.withColumns(parts), columns, keep, keys, time, block, steps)
    result = {}
    for c in columns:
        seen = lambda bit: F.col(f"_f_{c}").bitwiseAND(bit) > 0  # noqa: B023, E731
        value = F.col(c) * alpha + F.pow(F.lit(keep), F.col(time) + 1) * F.lit(float(initial))
        nan = seen(_NAN) | (seen(_HIGH) & seen(_LOW))
        result[c] = F.when(~seen(_NULL), F.when(nan, math.nan).when(seen(_HIGH), math.inf).when(seen(_LOW), -math.inf).otherwise(value))
    return faded.withColumns(result).drop(*[f"_f_{c}" for c in columns])


# What a sequence has met so far.
_NULL, _NAN, _HIGH, _LOW = 1, 2, 4, 8


def _faded(table: DataFrame, columns: Sequence[str], keep: float, keys: list[str], time: str, block: int, steps: int) -> DataFrame:
    """``c`` becomes ``c + keep * c of the step before + …``, ``_f_c`` the union of all flags up to the step."""
    # within a block weights stay inside the range of a double
    span = int(200.0 / -math.log10(keep)) if keep > 0 else 0
    size = min(block, span) if span > 1 else block
    out = table.withColumn("_block", F.floor(F.col(time) / size))
    place = F.col(time) - F.col("_block") * size
    line = _in_block(keys, time)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    if span > 1:
        weight = F.pow(F.lit(keep), -place.cast("double"))
        within = {c: F.sum(F.col(c) * weight).over(upto) / weight for c in columns}
    else:  # few steps count: seven back the weight takes even the largest double to 0
        lagged = lambda c, k: F.coalesce(F.lag(c, k).over(line), F.lit(0.0)) * keep**k
        within = {c: sum((lagged(c, k) for k in range(1, 7)), F.col(c)) for c in columns}
    flags = {f"_f_{c}": F.bit_or(f"_f_{c}").over(upto) for c in columns}
    if steps <= size:
        return out.withColumns(within | flags).drop("_block")
    left = F.pow(F.lit(keep), F.lit(size - 1) - place)
    ends = out.groupBy(*keys, "_block").agg(*[F.sum(F.col(c) * left).alias(c) for c in columns], *[F.bit_or(f).alias(f) for f in flags])
    carried = _faded(ends.withColumnRenamed("_block", "_b"), columns, keep**size, keys, "_b", block, -(-steps // size))
    carried = carried.select(*keys, (F.col("_b") + 1).alias("_block"), *[F.col(c).alias(f"_p_{c}") for c in columns], *[F.col(f).alias(f"_p{f}") for f in flags])
    joined = out.withColumns(within | flags).join(carried, [*keys, "_block"], "left")
    fade = F.pow(F.lit(keep), F.col(time) - F.col("_block") * size + 1)
    merged = {c: F.col(c) + F.coalesce(f"_p_{c}", F.lit(0.0)) * fade for c in columns}
    merged |= {f: F.col(f).bitwiseOR(F.coalesce(f"_p{f}", F.lit(0))) for f in flags}
    return joined.withColumns(merged).drop("_block", *[f"_p_{c}" for c in columns], *[f"_p{f}" for f in flags])


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    table: DataFrame,
    parts: dict[str, tuple[str, Column]],
    keys: Sequence[str],
    time: str = "t",
    block: int = 65536,
) -> DataFrame:
    """Inclusive running ``sum``/``max``/``min`` per key, in two levels.

    Blocks of ``block`` steps are scanned independently and the block totals are
    scanned afterwards, so a single long sequence is spread over many tasks.
    """
    keys = list(keys)
    out = table.withColumn("_block", F.floor(F.col(time) / block))
    out = out.withColumns({f"_e_{n}": e for n, (_, e) in parts.items()})
    inner = Window.partitionBy(*keys, "_block").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    totals = out.groupBy(*keys, "_block").agg(*[_MERGE[k](f"_e_{n}").alias(f"_t_{n}") for n, (k, _) in parts.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *[_MERGE[k](f"_t_{n}").over(earlier).alias(f"_p_{n}") for n, (k, _) in parts.items()])
    out = out.withColumns({n: _MERGE[k](f"_e_{n}").over(inner) for n, (k, _) in parts.items()})
    out = attach(out, carried, [*keys, "_block"])
    merged = {}
    for n, (kind, _) in parts.items():
        before = F.col(f"_p_{n}")
        if kind == "sum":
            merged[n] = F.col(n) + F.coalesce(before, F.lit(0))
        else:
            merged[n] = (F.greatest if kind == "max" else F.least)(F.col(n), before)
    out = out.withColumns(merged)
    return out.drop("_block", *[f"_{p}_{n}" for n in parts for p in "ep"])


def running_metrics(table: DataFrame, value: str, keys: Sequence[str] = ("seq_id",), time: str = "t") -> DataFrame:
    """Running mean, maximum and minimum of a metric over its batches."""
    v = F.col(value)
    parts = {"_s": ("sum", v), "_n": ("sum", F.lit(1)), "run_max": ("max", v), "run_min": ("min", v)}
    out = running(table, parts, keys, time)
    return out.withColumn("run_mean", F.col("_s") / F.col("_n")).drop("_s", "_n")


def episodes(table: DataFrame, keys: Sequence[str] = ("seq_id",), time: str = "t") -> DataFrame:
    """Add ``episode``: how many earlier steps of the sequence were ``done``."""
    ended = F.col("done").cast("long")
    out = running(table, {"episode": ("sum", ended)}, keys, time)
    return out.withColumn("episode", F.col("episode") - ended)


def until_any_done(table: DataFrame, keys: Sequence[str], time: str = "t") -> DataFrame:
    """Steps of a batch up to and including the first at which any item is done."""
    stop = table.groupBy(*keys).agg(F.min(F.when(F.col("done"), F.col(time))).alias("_stop"))
    return attach(table, stop, keys).where(F.col("_stop").isNull() | (F.col(time) <= F.col("_stop"))).drop("_stop")


def episode_metrics(table: DataFrame, values: Sequence[str], keys: Sequence[str] = ("seq_id", "episode")) -> DataFrame:
    return table.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def consecutive_pairs(frames: DataFrame) -> DataFrame:
    """Previous and current frame of every step (``frame_prev, frame_curr``)."""
    before = frames.select("seq_id", (F.col("t") + 1).alias("t"), F.col("frame_id").alias("frame_prev"))
    return frames.withColumnRenamed("frame_id", "frame_curr").join(before, ["seq_id", "t"])
