"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node with a weight. A first graph comes from
random sign codes: nodes of one code are compared and keep their nearest
neighbours. Rounds of NN-descent follow: each node hands its neighbours, and
those that name it, to a join in which they are compared with each other, and
better neighbours replace worse ones until few change. Neighbours at or above
the threshold are links; their components are found.

Neighbour lists are bounded and the lists of dense groups are saturated, so the
graph alone may miss links. An audit of ``AUDIT`` nodes against all rows of
their label measures that; below ``recall`` the search goes on with twice the
codes and longer lists. Whatever it reached, an exact check follows: the nodes
of a label are put into blocks, large components apart, and every two blocks
are compared, unless the angle between their centres rules a link out. Links
and components come from the exact check alone; the graph only makes the
blocks tight, so that more pairs of blocks are left out.

Defined cases: null, zero, empty and non-finite vectors and those without a
label link with nothing; vectors of different lengths never link; a null id is
a row of its own without links or component; repeated rows link with each
other. Other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm.components import components
from driftgrid.llm.vectors import matrix, unit, usable
from driftgrid.scale import durable

#: Nodes that a code should gather, at most in one group.
GROUP, MOST = 256, 512
#: Nodes of a block of the exact check; parts in which the pairs of blocks of a label are formed.
BLOCK, SALTS = 2048, 16
CODES, NEIGHBOURS, ROUNDS, AUDIT = 6, 8, 4, 256
EDGES = "u long, v long, sim double"


def _codes(count: int, first: int, size: int, bits: int) -> np.ndarray:
    return np.stack([np.random.default_rng([7, first + t, size]).standard_normal((bits, size)) for t in range(count)])


def _coded(nodes: DataFrame, first: int, count: int) -> DataFrame:
    """Each node once per code: ``code`` has as many signs as its label's number of nodes asks for."""

    def run(batches):
        for batch in batches:
            for size in set(batch.column("size").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("size"), size))
                rows, bits = matrix(part.column("vec")), part.column("bits").to_numpy()
                # the bounds of int64 leave room for 40 signs
                planes = _codes(count, first, size, 40)
                for t in range(count):
                    signs = (rows @ planes[t].T > 0).astype(np.int64)
                    kept = np.arange(40)[None, :] < bits[:, None]
                    code = (np.where(kept, signs, 0) << np.arange(40)).sum(axis=1)
                    columns = [part.column(c) for c in ("u", "label", "size", "vec")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(code), first + t), pa.int32()), pa.array(code)], ["u", "label", "size", "vec", "table", "code"])

    label, vec = (nodes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    return nodes.mapInArrow(run, f"u long, label {label}, size int, vec {vec}, table int, code long")


def _nearest(ids: np.ndarray, rows: np.ndarray, keep: int):
    """For each row its ``keep`` nearest others: index arrays and similarities."""
    sims = unit(rows) @ unit(rows).T
    np.fill_diagonal(sims, -2)
    keep = min(keep, len(ids) - 1)
    at = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    u = np.repeat(np.arange(len(ids)), keep)
    return u, at.ravel(), sims[u, at.ravel()]


def _first_graph(nodes: DataFrame, first: int, count: int, keep: int) -> DataFrame:
    coded = _coded(nodes, first, count)
    keys = ["label", "size", "table", "code"]
    large = durable(coded.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > MOST))
    parts = F.coalesce(F.ceil(F.col("n_") / MOST), F.lit(1))
    groups = coded.join(large, keys, "left").withColumn("part", F.pmod(F.xxhash64("u", "table"), parts)).groupBy(*keys, "part").agg(F.collect_list(F.struct("u", "vec")).alias("rows"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(0).slice(row, 1).flatten()
                ids, rows = own.field("u").to_numpy(), matrix(own.field("vec"))
                u, v, sim = _nearest(ids, rows, keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(sim)], ["u", "v", "sim"])

    return groups.where(F.size("rows") > 1).select("rows").mapInArrow(run, EDGES)


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest neighbours of each node, ties to smaller ids."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.distinct().withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= keep).drop("n_")


def _descend(nodes: DataFrame, graph: DataFrame, keep: int) -> DataFrame:
    """Better neighbours found among the neighbours of neighbours."""
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= keep, F.min("sim")).otherwise(-1.0).alias("worst"))
    named = graph.select(F.col("u").alias("w"), "v", "sim").union(graph.select(F.col("v").alias("w"), F.col("u").alias("v"), "sim")).distinct()
    near = Window.partitionBy("w").orderBy(F.desc("sim"), "v")
    members = named.withColumn("n_", F.row_number().over(near)).where(F.col("n_") <= 2 * keep).select("w", F.col("v").alias("u"))
    known = nodes.select("u", "vec").join(worst, "u", "left").select("u", "vec", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    groups = members.join(known, "u").groupBy("w").agg(F.collect_list(F.struct("u", "vec", "worst")).alias("rows"))

    def run(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                own = batch.column(0).slice(row, 1).flatten()
                ids, rows = own.field("u").to_numpy(), matrix(own.field("vec"))
                u, v, sim = _nearest(ids, rows, keep)
                better = sim > own.field("worst").to_numpy()[u]
                found.append((ids[u[better]], ids[v[better]], sim[better]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v", "sim"])

    better = groups.where(F.size("rows") > 1).select("rows").mapInArrow(run, EDGES).distinct()
    return better.join(graph, ["u", "v"], "left_anti")


def _blocked(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``id``, ``label``, ``size`` and ``rows``: every node in one block of at most about ``BLOCK`` nodes.

    A component of many nodes has blocks of its own, the other nodes of a label meet by a short sign code.
    """
    less = F.greatest(F.col("bits") - math.ceil(math.log2(BLOCK / GROUP)), F.lit(0)).cast("int")
    codes = _coded(nodes.withColumn("bits", less), 0, 1).select("u", "code")
    large = durable(roots.groupBy("root").agg(F.count("*").alias("n_")).where(F.col("n_") >= GROUP).select("root"))
    own = roots.join(large, "root").select(F.col("node").alias("u"), "root")
    place = F.when(F.col("root").isNotNull(), F.xxhash64(F.lit("component"), "root")).otherwise(F.xxhash64(F.lit("code"), "code"))
    placed = durable(nodes.join(codes, "u").join(own, "u", "left").select("label", "size", place.alias("place"), "u", "weight", "vec"))
    keys = ["label", "size", "place"]
    crowded = durable(placed.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > BLOCK))
    part = F.pmod(F.xxhash64("u"), F.coalesce(F.ceil(F.col("n_") / BLOCK), F.lit(1)))
    groups = placed.join(crowded, keys, "left").withColumn("part", part).groupBy(*keys, "part").agg(F.collect_list(F.struct("u", "weight", "vec")).alias("rows"))
    return durable(groups.select(F.monotonically_increasing_id().alias("id"), "label", "size", "rows"))


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """``a`` and ``b``: the pairs of blocks of one label that may hold a link.

    By the triangle inequality of angles, blocks whose centres are further apart than both radii and the link's angle hold none.
    """

    def run(batches):
        for batch in batches:
            centres, radii = [], []
            for row in range(batch.num_rows):
                rows = unit(matrix(batch.column(3).slice(row, 1).flatten().field("vec")))
                centre = rows.sum(axis=0)
                centre = centre / np.linalg.norm(centre) if centre.any() else rows[0]
                centres.append(centre)
                radii.append(float(np.arccos(np.clip(rows @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(centres, pa.list_(pa.float64())), pa.array(radii)], ["id", "label", "size", "centre", "radius"])

    label = blocks.schema["label"].dataType.simpleString()
    balls = durable(blocks.mapInArrow(run, f"id long, label {label}, size int, centre array<double>, radius double"))
    a = balls.select("label", "size", F.col("id").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    b = balls.select("label", "size", F.col("id").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cosine = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))
    # the slack covers the rounding of the angles
    near = (F.col("a") == F.col("b")) | (angle <= F.col("ra") + F.col("rb") + float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6)
    return durable(a.join(b, ["label", "size", "salt"]).where(F.col("a") <= F.col("b")).where(near).select("a", "b"))


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric matrix of links: two lists of indices."""
    a, b, open_ = [], [], linked.any(axis=1)
    for start in np.flatnonzero(open_).tolist():
        if not open_[start]:
            continue
        open_[start], stack = False, [start]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & open_).tolist()
            open_[new] = False
            a += [i] * len(new)
            b += new
            stack += new
    return a, b


def _exact_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Every link of every label: rows ``u, v`` of spanning forests, and rows ``u, n`` that add up to the weight of a node's links."""
    blocks = _blocked(nodes, roots)
    pairs = _block_pairs(blocks, threshold)
    sides = durable(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")))
    cells = blocks.join(sides, "id").groupBy("a", "b").agg(F.collect_list(F.struct("id", "rows")).alias("sides"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sides = batch.column(0).slice(row, 1).flatten()
                lists = sides.field("rows")
                own = lists.flatten()
                ids, weight = own.field("u").to_numpy(), own.field("weight").to_numpy()
                rows = unit(matrix(own.field("vec")))
                linked = rows @ rows.T >= threshold
                np.fill_diagonal(linked, False)
                if len(sides) > 1:  # links within a block are counted in its own cell
                    side = np.repeat(np.arange(len(sides)), lists.value_lengths().to_numpy())
                    linked &= side[:, None] != side[None, :]
                some = np.flatnonzero(linked.any(axis=1))
                if len(some):
                    linked = linked[np.ix_(some, some)]
                    ids, weight = ids[some], weight[some]
                    a, b = _forest(linked)
                    none = pa.nulls(len(ids), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), none, pa.array(linked @ weight)], ["u", "v", "n"])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.zeros(len(a), np.int64))], ["u", "v", "n"])

    return durable(cells.select("sides").mapInArrow(run, "u long, v long, n long"))


def _audit(nodes: DataFrame, roots: DataFrame, threshold: float) -> float:
    """The part of the links of a bounded sample of nodes whose ends are in one component."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("u", F.lit(11)), "u").limit(AUDIT).select("u", "label", "vec").collect()
    shared = spark.sparkContext.broadcast([(r.u, r.label, np.array(r.vec, np.float64)) for r in sample])  # AUDIT vectors

    def run(batches):
        for batch in batches:
            ids, labels, column = batch.column("u").to_numpy(), np.array(batch.column("label").to_pylist(), object), batch.column("vec")
            sizes = pa.compute.list_value_length(column).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = unit(matrix(column.take(pa.array(at))))
                for u, label, vec in shared.value:
                    if len(vec) == size:
                        hit = at[(rows @ vec / np.sqrt(vec @ vec) >= threshold) & (labels[at] == label) & (ids[at] != u)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), u), pa.int64()), pa.array(ids[hit])], ["u", "v"])

    links = nodes.select("u", "label", "vec").mapInArrow(run, "u long, v long")
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
    true, found = links.join(a, "u", "left").join(b, "v", "left").agg(F.count("*"), F.count_if(F.col("root_u") == F.col("root_v"))).first()
    return found / true if true else 1.0


def near_duplicates(df: DataFrame, threshold: float = 0.98, recall: float = 0.995, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept``; one row per input row.

    Rows link only if their labels are equal and their cosine is at least ``threshold``.
    """
    ship(df.sparkSession)
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector).cast(kind).alias("vec"), F.col(label).alias("label"))
    linkable = F.coalesce(usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    equal = rows.where(linkable).groupBy("label", "vec").agg(F.min("vec_id").alias("u"), F.count("*").alias("weight"))
    equal = durable(equal.withColumn("size", F.size("vec")))
    often = equal.groupBy("label", "size").agg(F.count("*").alias("n"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / GROUP)), F.lit(0)), F.lit(40)).cast("int")
    nodes = durable(equal.join(durable(often.select("label", "size", bits.alias("bits"))), ["label", "size"]))
    total, first, codes, keep, graph = nodes.count(), 0, CODES, NEIGHBOURS, None
    while True:
        begun = _first_graph(nodes, first, codes, keep)
        graph = durable(_best(begun if graph is None else begun.union(graph), keep))
        for _ in range(ROUNDS):
            better = durable(_descend(nodes, graph, keep))
            changed = better.count()
            graph = durable(_best(graph.union(better), keep))
            if changed <= 0.02 * total * keep:
                break
        roots = durable(components(graph.where(F.col("sim") >= threshold), "u", "v"))
        if _audit(nodes, roots, threshold) >= recall or keep >= 8 * NEIGHBOURS:
            break
        first, codes, keep = first + codes, 2 * codes, 2 * keep
    links = _exact_links(nodes, roots, threshold)
    roots, counted = durable(components(links, "u", "v")), links.groupBy("u").agg(F.sum("n").alias("n"))
    known = nodes.join(counted, "u", "left").join(roots, nodes.u == roots.node, "left").select("label", "vec", "u", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "u").alias("component_id"))
    out = rows.withColumn("ok_", linkable).join(known.withColumn("ok_", F.lit(True)), ["ok_", "label", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
