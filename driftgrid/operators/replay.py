"""Bounded first-in-first-out store of experiences, one per ``buffer_id``.

Rows carry ``seq``, increasing with age of arrival within a buffer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import mix
from driftgrid.scale import durable
from driftgrid.sources.tables import rank_all

BUFFER = ("buffer_id",)
_SALTS = 64
#: Up to so many rows of one buffer may meet in a task.
MEET = 1 << 18


def _tie(table: DataFrame) -> Column:
    """Tells rows with equal keys and order apart; rows that it does not are equal in every column."""
    return F.xxhash64(*[F.col(c) for c in sorted(table.columns)])


def _same(keys) -> Column:
    """A row's keys are those of a summary (``_of_`` columns); NULL is a key like any other."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _of(keys) -> list[Column]:
    return [F.col(k).alias(f"_of_{k}") for k in keys]


def _placed(table: DataFrame, order: dict[str, Column], keys) -> tuple[DataFrame, DataFrame]:
    """The stored rows with a number ``_row`` of their own, and keys, order columns, ``_row`` and the place (from 0) in its buffer of every row.

    Only keys and order columns go through the range shuffle.
    """
    stored = durable(table.withColumns({"_tie": _tie(table), "_row": F.monotonically_increasing_id()}))
    light = stored.select(*keys, *[c.alias(name) for name, c in order.items()], "_tie", "_row")
    ranks = rank_all(light, [*keys, *order, "_tie", "_row"], "_rank")
    first = durable(ranks.groupBy(*_of(keys)).agg(F.min("_rank").alias("_first")))
    return stored, ranks.join(first, _same(keys)).drop(*[f"_of_{k}" for k in keys]).withColumn("_place", F.col("_rank") - F.col("_first"))


def _first_n(table: DataFrame, n: int, order: dict[str, Column], keys) -> DataFrame:
    """The first ``n`` rows per key under ``order`` (ascending; ties by the other columns): exactly n, or all if there are fewer.

    For small ``n`` each salt keeps its own first ``n``, which contain the key's first ``n``, and only those meet.
    Otherwise ranks tell every key's ``n``-th row, and rows compare with it where they are. Both ways keep the same rows.
    """
    if n * _SALTS <= MEET:
        by = [*order.values(), F.col("_tie")]
        salted = table.withColumns({"_salt": F.pmod(F.coalesce(mix("seq", 7), F.lit(0)), F.lit(_SALTS)), "_tie": _tie(table)})
        part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*by))
        few = salted.withColumn("_rn", part).where(F.col("_rn") <= n).drop("_rn", "_salt")
        whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return few.withColumn("_rn", whole).where(F.col("_rn") <= n).drop("_rn", "_tie")
    stored, places = _placed(table, order, keys)
    # every buffer's n-th row; rows compare with it where they are
    last = durable(places.where(F.col("_place") == n - 1).select(*_of(keys), F.struct(*order, "_tie", "_row").alias("_last")))
    own = F.struct(*[c.alias(name) for name, c in order.items()], "_tie", "_row")
    kept = stored.join(last, _same(keys), "left").where(F.col("_last").isNull() | (own <= F.col("_last")))
    return kept.drop("_last", "_row", "_tie", *[f"_of_{k}" for k in keys])


def retain(table: DataFrame, capacity: int, keys: Sequence[str] = BUFFER) -> DataFrame:
    """The newest ``capacity`` rows of every buffer."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return _first_n(table, capacity, {"_o": -F.col("seq")}, keys)


def _smallest(table: DataFrame, keys) -> int:
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n")).first()[0] or 0


def sample(table: DataFrame, n: int, seed: int, keys: Sequence[str] = BUFFER) -> DataFrame:
    """``n`` rows per buffer, uniformly without replacement, reproducible by seed."""
    held = _smallest(table, keys)
    if n > held:
        raise ValueError(f"requested batch size {n} exceeds buffer size {held}")
    return _first_n(table, n, {"_o": mix("seq", seed), "_p": F.col("seq")}, keys)


def sample_at(table: DataFrame, positions: int | Sequence[int], keys: Sequence[str] = BUFFER) -> DataFrame:
    """Rows at given positions of every buffer, 0 being the oldest."""
    wanted = [positions] if isinstance(positions, int) else list(positions)
    held = _smallest(table, keys)
    if max(wanted) >= held or min(wanted) < 0:
        raise IndexError(f"positions {wanted} out of range for a buffer of length {held}")
    if (max(wanted) + 1) * _SALTS > MEET:
        stored, places = _placed(table, {"_o": F.col("seq")}, keys)
        found = places.where(F.col("_place").isin(wanted)).select("_row", F.col("_place").cast("int").alias("position"))
        return stored.join(durable(found), "_row").drop("_row", "_tie")
    oldest = _first_n(table, max(wanted) + 1, {"_o": F.col("seq")}, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", _tie(oldest))) - 1
    return oldest.withColumn("position", place).where(F.col("position").isin(wanted))


def push(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Buffer with new rows appended; ``rows`` are numbered on by ``seq`` of the caller."""
    return table.unionByName(rows)


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)
