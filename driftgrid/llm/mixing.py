"""Mixing sources to target weights by balanced (cube) sampling.

A source's target divided by its size says how often each of its documents is
taken: the whole part for all, the fraction as an inclusion probability. The
flight phase moves three probabilities at a time along the direction that
keeps both the number of documents and their total size, until one of them is
0 or 1; it stops when at most two are left. It runs in blocks of about
``BLOCK`` documents of a source; what the blocks leave open (a few documents
each) meets in blocks of the next level, until one block per source is left. There ``LANDING`` documents
stay out of the flight; they and the last two land on the outcome closest to
the target. Only ids and sizes are shuffled.

The random numbers depend on the seed, the source and the block alone, so
reruns agree. The list of sources (not of documents) is held by the driver.

Defined cases: a null source is a source of its own, the last; a null text has
size 0; a source without words has target 0; null and repeated ids are
ordinary rows. Other columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.scale import durable

#: Documents of a block, and blocks that meet in one of the next level.
BLOCK, FAN = 4096, 512
#: Open documents of a source that the last flight leaves out, so that the landing can meet the target; blocks before leave half as many.
LANDING = 14
WORDS = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), cap: float = 3) -> dict[str | None, float]:
    """The words asked of each source: all sizes shared by weight, no source above ``cap`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        rest, all_weight = sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / all_weight for s in free}
        above = {s: float(cap * sizes[s]) for s in free if share[s] > cap * sizes[s]}
        out |= above or share
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities along the null space of (count, size) until at most two are fractional."""
    p = p.copy()
    waiting = iter(np.flatnonzero((p > EDGE) & (p < 1 - EDGE)).tolist())
    at: list[int] = []
    while True:
        while len(at) < 3 and (i := next(waiting, None)) is not None:
            at.append(i)
        if len(at) < 2 or len(at) == 2 and size[at[0]] != size[at[1]]:
            return p
        z = size[at]
        if len(at) == 2 or z[0] == z[1] == z[2]:
            u = np.array([1.0, -1.0, 0.0][: len(at)])
        else:
            u = np.array([z[2] - z[1], z[0] - z[2], z[1] - z[0]], float)
        q, moved = p[at], u != 0
        up = np.min(np.where(u > 0, 1 - q, q)[moved] / np.abs(u)[moved])
        down = np.min(np.where(u > 0, q, 1 - q)[moved] / np.abs(u)[moved])
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        q[q < EDGE], q[q > 1 - EDGE] = 0.0, 1.0
        p[at] = q
        at = [i for i, x in zip(at, q) if 0 < x < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the last (at most ``LANDING`` + 2) fractions: least error in size, then in number."""
    p = np.where(p < EDGE, 0.0, np.where(p > 1 - EDGE, 1.0, p))
    at = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
    off = outcomes - p[at]
    p[at] = outcomes[np.lexsort((np.abs(off.sum(axis=1)), np.round(np.abs(off @ size[at]), 6)))[0]]
    return p


def _step(seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        source, block, level, last = (k.as_py() for k in key)
        table = table.sort_by([("order_", "ascending"), ("size", "ascending")])
        name = hashlib.sha256(repr((seed, source, block, level)).encode()).digest()
        p, size = table["p_"].to_numpy(), table["size"].to_numpy()
        held = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))[: LANDING if last else LANDING // 2]
        moving = np.ones(len(p), bool)
        moving[held] = False
        p = p.copy()
        p[moving] = flight(p[moving], size[moving], np.random.default_rng(list(name)))
        if last:
            p = land(p, size)
        return table.set_column(table.schema.get_field_index("p_"), "p_", pa.array(p))

    return run


def mix(docs: DataFrame, weights=(5, 2, 1), cap: float = 3, seed: int = 17, id_col: str = "doc_id", source: str = "source", text: str = "text", keep: dict | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies).

    ``keep`` maps names to further columns computed from ``docs``.
    """
    spark, keep = docs.sparkSession, keep or {}
    if set(keep) & {"doc_id", "source", "size", "source_size", "target", "copies", "taken"}:
        raise ValueError("a kept column has the name of a result")
    ship(spark)
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *(c.alias(k) for k, c in keep.items())))
    found = rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    goal = targets({s: n for s, n, _ in found}, weights, cap)
    plan = [(s, n, float(goal[s]), goal[s] / n if n else 0.0, -(-count // BLOCK)) for s, n, count in found]
    plan = spark.createDataFrame(plan, "name_ string, source_size long, target double, rate_ double, blocks_ long")
    open_ = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("name_")))
        .withColumn("copies", F.floor("rate_"))
        .withColumn("p_", F.col("rate_") - F.col("copies"))
        .withColumn("order_", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .withColumn("block_", F.pmod("order_", "blocks_"))
        .drop("name_", "rate_")
    )
    done, level, most = [], 0, max([-(-count // BLOCK) for *_, count in found], default=1)
    while True:
        step = open_.withColumn("level_", F.lit(level)).withColumn("last_", F.col("blocks_") == 1)
        step = step.groupBy("source", "block_", "level_", "last_").applyInArrow(_step(seed), step.schema)
        if most == 1:
            done.append(step)
            break
        step = durable(step)
        undecided = (F.col("p_") > 0) & (F.col("p_") < 1)
        done.append(step.where(~undecided))
        level, most = level + 1, -(-most // FAN)
        open_ = step.where(undecided).withColumn("block_", F.floor(F.col("block_") / FAN)).withColumn("blocks_", F.ceil(F.col("blocks_") / FAN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("copies") + F.col("p_").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep)
