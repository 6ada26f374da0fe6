"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to ``AXES`` dimensions in several random ways, shifted,
and laid out by their places on Hilbert curves: each ordering is sorted across
the cluster and every row learns its exact rank. A row's neighbours along a
curve stand in the blocks of ranks next to its own. A query is compared with
the blocks within a window on every curve, the results of all windows are
merged, and the nearest are kept by exact inner product.

The window is measured, not guessed: for ``AUDIT`` queries the true neighbours
are found among all rows, and the window is the smallest that holds
``RECALL`` of them on at least one curve. Data without structure get wide
windows, up to all blocks, so recall does not depend on the data.

Vectors are compared with those of their own length. Every length with more
than ``BLOCK`` rows has its own curves and window; the rows of any other length
are one block, in which every query is compared with every row.

Defined cases: null, zero, empty and non-finite vectors and null ids take no
part; rows with a query's own id are not its candidates; repeated rows count once; ties go to smaller ids.
Other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm.vectors import matrix, usable
from driftgrid.scale import durable

CURVES, AXES, BITS = 4, 8, 7
#: Ranks of a block; blocks whose queries are compared together, and blocks they are compared with in one task.
BLOCK, SPAN, WIDE = 4096, 4, 8
AUDIT, RECALL = 128, 0.96
#: Scores this close to the last one kept are compared by the exact sum.
NEAR = 1e-9


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below ``2 ** bits``.

    The coordinates' bits are Gray-decoded from the top, undoing the
    reflections and swaps of the larger cubes, and then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            upper = (x[i] >> level & 1).astype(bool)
            differ = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, differ)
            x[i] ^= differ
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[i] >> level & 1
    return key


def _directions(curve: int, size: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([3, curve, size])
    return np.linalg.qr(rng.standard_normal((size, axes)))[0], rng.random(axes)


def _ranked(rows: DataFrame, size: int, curves: int) -> DataFrame:
    """``curve``, ``rank`` and ``vec_id``: exact ranks along every curve."""
    axes = min(AXES, size)
    spread = rows.select(F.sqrt(F.avg(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) / size)).first()[0] or 1.0

    def run(batches):
        for batch in batches:
            vectors = matrix(batch.column(1))
            for curve in range(curves):
                turn, shift = _directions(curve, size, axes)
                place = ((vectors @ turn) / (8 * spread) + 0.5 + (shift - 0.5) / 8) * (1 << BITS)
                key = hilbert_key(np.clip(place, 0, (1 << BITS) - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve), pa.int32()), pa.array(key), batch.column(0)], ["curve", "key", "vec_id"])

    keys = rows.select("vec_id", "vec").mapInArrow(run, "curve int, key long, vec_id long")
    laid = durable(keys.repartitionByRange("curve", "key", "vec_id").withColumn("part", F.spark_partition_id()))
    held = laid.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = held.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "vec_id"))
    return durable(laid.withColumn("at", place).join(base, ["curve", "part"]).select("curve", (F.col("base") + F.col("at") - 1).alias("rank"), "vec_id"))


def _top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query its ``k`` best rows: (query, row, score), by exact sums and then ids."""
    scores = queries @ rows.T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if k < len(ids):
        last = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        near = NEAR * np.maximum(1, np.abs(np.where(np.isfinite(last), last, 0)))
        q, v = np.nonzero(scores >= (last - near)[:, None])
    else:
        q, v = np.nonzero(scores >= -np.inf)
    fit = np.isfinite(scores[q, v])
    q, v = q[fit], v[fit]
    exact = np.concatenate([(queries[q[i : i + 65536]] * rows[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
    order = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    begin = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - begin < k
    return q[keep], v[keep], exact[keep]


_FOUND = "query_id long, vec_id long, score double"


def _batch(query_ids, ids, q, v, score) -> pa.Table:
    return pa.table({"query_id": pa.array(query_ids[q], pa.int64()), "vec_id": pa.array(ids[v], pa.int64()), "score": pa.array(score, pa.float64())})


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The true neighbours of a few queries, by comparing them with all rows."""
    if not queries:
        return rows.sparkSession.createDataFrame([], _FOUND + ", rank int")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries]), np.array([v for _, v in queries], np.float64)))

    def run(batches):
        query_ids, own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = part.column(0).to_numpy()
                yield from _batch(query_ids, ids, *_top(ids, matrix(part.column(1)), query_ids, own, k)).to_batches()

    return _first(rows.select("vec_id", "vec").mapInArrow(run, _FOUND), k)


def window(ranks: DataFrame, true: DataFrame, recall: float) -> int:
    """The least number of blocks to either side that holds ``recall`` of the true pairs on some curve."""
    a = ranks.select("curve", F.col("vec_id").alias("query_id"), F.floor(F.col("rank") / BLOCK).alias("a"))
    b = ranks.select("curve", "vec_id", F.floor(F.col("rank") / BLOCK).alias("b"))
    pairs = true.select("query_id", "vec_id").join(a, "query_id").join(b, ["curve", "vec_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    held = pairs.groupBy("apart").count().orderBy("apart").collect()  # at most AUDIT times k rows
    total, so_far = sum(n for _, n in held), 0
    for apart, n in held:
        so_far += n
        if so_far >= recall * total:
            return int(apart)
    return 0


def _comparison(k: int):
    """A function of a cogroup: queries of one length and rows of that length."""

    def compare(key: tuple[pa.Scalar, ...], own: pa.Table, against: pa.Table) -> pa.Table:
        """Each query's best among the rows of up to ``WIDE`` blocks, one block's scores at a time."""
        parts = [_batch(np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], [])]
        if own.num_rows and against.num_rows:
            ids, rows_ = against["vec_id"].to_numpy(), matrix(against["vec"])
            query_ids, queries = own["query_id"].to_numpy(), matrix(own["query"])
            for i in range(0, len(query_ids), 512):
                at, best = slice(i, i + 512), []
                for j in range(0, len(ids), BLOCK):
                    q, v, score = _top(ids[j : j + BLOCK], rows_[j : j + BLOCK], query_ids[at], queries[at], k)
                    best.append((q, v + j, score))
                q, v, score = (np.concatenate(x) for x in zip(*best))
                order = np.lexsort((ids[v], -score, q))
                q, v, score = q[order], v[order], score[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
                parts.append(_batch(query_ids[at], ids, q[keep], v[keep], score[keep]))
        return pa.concat_tables(parts)

    return compare


def _along_curves(rows: DataFrame, size: int, is_query: Column, k: int, curves: int, recall: float) -> DataFrame:
    """Pairs found among the vectors of one length, in rows of ``_FOUND``; each query's nearest are among them."""
    ranks = _ranked(rows, size, curves)
    sample = rows.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(AUDIT).collect()
    reach = window(ranks, exact(rows, [(r.vec_id, r.vec) for r in sample], k), recall)

    block = F.floor(F.col("rank") / BLOCK).cast("int")
    laid = durable(ranks.join(rows, "vec_id").select("curve", block.alias("block"), "vec_id", "vec"))
    most = F.lit(int(ranks.agg(F.max("rank")).first()[0] // BLOCK))
    low, high = F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, most)
    span, wide = (lambda b, n=n: F.floor(b / n).cast("int") for n in (SPAN, WIDE))
    asked = laid.where(is_query).select(
        F.col("curve").alias("on"), span(F.col("block")).alias("span_"), F.explode(F.sequence(wide(low), wide(high))).alias("with"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query")
    )
    # a block goes to the groups of queries whose windows may hold it
    stored = laid.select("curve", F.explode(F.sequence(span(low), span(high))).alias("span"), wide(F.col("block")).alias("wide"), "vec_id", "vec")

    return asked.groupBy("on", "span_", "with").cogroup(stored.groupBy("curve", "span", "wide")).applyInArrow(_comparison(k), _FOUND)


def search(df: DataFrame, is_query: Column, k: int = 20, curves: int = CURVES, recall: float = RECALL, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the inner product in double precision.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    ship(spark)
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast(kind).alias("vec"))
    rows = durable(rows.where(usable(F.col("vec")) & F.col("vec_id").isNotNull()))
    sizes = durable(rows.groupBy(F.size("vec").alias("size")).count())
    many = [r["size"] for r in sizes.where(F.col("count") > BLOCK).orderBy("size").collect()]
    met = [_along_curves(rows.where(F.size("vec") == size), size, is_query, k, curves, recall) for size in many]
    if not sizes.where(F.col("count") <= BLOCK).isEmpty():
        few = rows.where(~F.size("vec").isin(many)) if many else rows
        asked = few.where(is_query).select(F.size("vec").alias("size"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query"))
        stored = few.select(F.size("vec").alias("size"), "vec_id", "vec")
        met.append(asked.groupBy("size").cogroup(stored.groupBy("size")).applyInArrow(_comparison(k), _FOUND))
    if not met:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _first(reduce(DataFrame.unionByName, met), k).select("query_id", "rank", "vec_id", "score")
