"""A Merkle manifest of a table, and proofs of many leaves by octopus multiproofs.

Rows become leaves; the leaves of a group (a source), in order, are the lowest
level of the group's tree, and every ``ARITY`` consecutive nodes have a parent
until one node is left. The groups' last nodes are the leaves of a tree of
their own, whose last node is the root.

To prove leaves, a partition of ``PART`` consecutive places of a group first
works out, level by level, which nodes it needs and can't derive from its own
leaves: of each run that holds a known node the others, and the run's parent
is known from then on. This minimal union of coordinates, over the group's tree
and the tree of groups, is fetched by one join. The partition then derives
the inner nodes that its leaves share once, and cuts every leaf's own proof
out of the runs.

Defined cases: nulls are digested as ``-``, empty values as ``0:``; rows that
tie in the order are ordered by their digest, and repeated rows are
leaves of their own; a group of one leaf has that leaf as its last node, and a
proof of what lies above only; a table of one row has an empty proof; an empty
table has no rows. Other columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship
from driftgrid.llm.places import before
from driftgrid.scale import attach, durable

ARITY, PART = 16, 4096
#: The key of the tree of groups; groups have the key ``-`` (null) or ``=`` and their name.
TOP = "^"
PROOF = "array<struct<left:string,right:string>>"
_NAMES = {"leaf", "proof", "subroot", "root", "tree_", "at_", "width_", "row_", "node_", "level_", "part_", "top_at_", "top_width_"}


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    said = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def grow(leaves: DataFrame) -> DataFrame:
    """``tree_, level_, at_, node_`` above the leaves ``tree_, at_, node_, width_`` (its number of leaves), stored level by level."""
    widest = leaves.agg(F.max("width_")).first()[0] or 1
    now, levels = leaves.select("tree_", "at_", "node_", "width_"), []
    while widest > 1:
        up = now.where("width_ > 1").withColumn("up_", F.expr(f"at_ div {ARITY}"))
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at_", "node_"))), lambda s: s["node_"]), "")
        up = up.groupBy("tree_", "up_").agg(F.sha2(run.cast("binary"), 256).alias("node_"), F.max("width_").alias("width_"))
        now = durable(up.select("tree_", F.col("up_").alias("at_"), "node_", F.ceil(F.col("width_") / ARITY).alias("width_")))
        levels.append(now.withColumn("level_", F.lit(len(levels) + 1)))
        widest = -(-widest // ARITY)
    nodes = leaves.select("tree_", F.lit(0).alias("level_"), "at_", "node_", "width_")
    for level in levels:
        nodes = nodes.unionByName(level)
    return nodes


def plant(leaves: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """The leaves with their place ``at_`` and their tree's ``width_``, stored."""
    placed = before(leaves, [tree], order, "at_")
    widths = placed.groupBy(tree).agg(F.count(F.lit(1)).alias("width_"))
    return durable(attach(placed, widths, [tree]))


class Manifest:
    """Leaves (``leaf`` and kept columns, by group and place), the nodes of all trees, and the groups with ``subroot`` and ``root``."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, groups: DataFrame):
        self.leaves, self.nodes, self.groups = leaves, nodes, groups


def manifest(rows: DataFrame, leaf: Column, group: str, order: Sequence[str], keep: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``rows``: their leaves by ``group`` in ``order`` (nulls first, then by digest)."""
    keep = keep or {}
    if set(keep) & _NAMES:
        raise ValueError("a kept column has the name of a result")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree_")
    ranks = [F.col(c).alias(f"order{k}_") for k, c in enumerate(order)]
    made = rows.select(tree, *ranks, leaf.alias("leaf"), *(c.alias(k) for k, c in keep.items()))
    made = durable(made.withColumn("row_", F.monotonically_increasing_id()))
    by = [*(f"order{k}_" for k in range(len(order))), "leaf", "row_"]
    leaves = plant(made, "tree_", by).drop(*by[:-2], "row_")
    lower = grow(leaves.withColumn("node_", F.col("leaf")))
    last = lower.where("width_ = 1").select("tree_", F.col("node_").alias("subroot"))
    named = last.select(F.lit(TOP).alias("top_"), F.col("tree_").alias("name_"), F.col("subroot").alias("node_"))
    tops = plant(named, "top_", ["name_"]).withColumnRenamed("top_", "tree_")
    upper = grow(tops)
    root = upper.where("width_ = 1").select("tree_", F.col("node_").alias("root"))
    groups = attach(tops, root, ["tree_"]).select(
        F.col("name_").alias("tree_"), F.col("node_").alias("subroot"), "root", F.col("at_").alias("top_at_"), F.col("width_").alias("top_width_")
    )
    return Manifest(leaves, lower.unionByName(upper), durable(groups))


def missing(at: np.ndarray, width: int) -> tuple[list[tuple[int, np.ndarray]], int]:
    """The coordinates (level, places) that leaves at ``at`` of a tree with ``width`` leaves need and can't derive, and the number of levels below the last node."""
    known, found, level = np.unique(at), [], 0
    while width > 1:
        runs = np.unique(known // ARITY)
        needed = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        needed = np.setdiff1d(needed[needed < width], known, assume_unique=True)
        if len(needed):
            found.append((level, needed))
        known, width, level = runs, -(-width // ARITY), level + 1
    return found, level


def climb(known: dict[int, str], fetched: dict[tuple[int, int], str], width: int) -> tuple[list[dict[int, str]], str]:
    """For every level the joined nodes of the runs on the way up, and the last node."""
    levels, level = [], 0
    while width > 1:
        runs, up = {}, {}
        for run in {at // ARITY for at in known}:
            places = range(run * ARITY, min((run + 1) * ARITY, width))
            runs[run] = "".join([known[p] if p in known else fetched[level, p] for p in places])
            up[run] = hashlib.sha256(runs[run].encode()).hexdigest()
        levels.append(runs)
        known, width, level = up, -(-width // ARITY), level + 1
    return levels, next(iter(known.values()))


def _sides(levels: list[dict[int, str]], at: int) -> list[dict[str, str]]:
    """What stands left and right of the path from ``at``, level by level."""
    out = []
    for runs in levels:
        at, place = divmod(at, ARITY)
        run = runs[at]
        out.append({"left": run[: 64 * place], "right": run[64 * (place + 1) :]})
    return out


def _needs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    tree, part = (k.as_py() for k in key)
    own, _ = missing(table["at_"].to_numpy(), table["width_"][0].as_py())
    top, _ = missing(np.array([table["top_at_"][0].as_py()]), table["top_width_"][0].as_py())
    rows = [(t, level, places) for t, found in ((tree, own), (TOP, top)) for level, places in found]
    n = [len(p) for *_, p in rows]
    return pa.table(
        {
            "holder_": pa.array([tree] * sum(n), pa.string()),
            "part_": pa.array([part] * sum(n), pa.int64()),
            "tree_": pa.array([t for (t, *_), k in zip(rows, n) for _ in range(k)], pa.string()),
            "level_": pa.array([level for (_, level, _), k in zip(rows, n) for _ in range(k)], pa.int32()),
            "at_": pa.array(np.concatenate([p for *_, p in rows]) if rows else [], pa.int64()),
        }
    )


def prove(built: Manifest, wanted: DataFrame | None = None, part: int = PART) -> DataFrame:
    """``leaf``, its kept columns, ``subroot``, ``root`` and its ``proof``: from the leaf's level up to the root, the joined
    digests that stand left and right of its path.

    ``wanted`` is a subset of ``built.leaves`` (default: all). The unit of work is a partition of ``part`` places of a group.
    """
    leaves = built.leaves if wanted is None else wanted
    ship(leaves.sparkSession)
    kept = [c for c in leaves.columns if c not in _NAMES]
    held = leaves.join(built.groups, "tree_").withColumn("part_", F.expr(f"at_ div {part}"))
    light = held.select("tree_", "part_", "at_", "width_", "top_at_", "top_width_")
    needs = light.groupBy("tree_", "part_").applyInArrow(_needs, "holder_ string, part_ long, tree_ string, level_ int, at_ long")
    fetched = needs.join(built.nodes.select("tree_", "level_", "at_", "node_"), ["tree_", "level_", "at_"])
    fetched = fetched.select("holder_", F.col("part_").alias("of_"), (F.col("tree_") == TOP).alias("top_"), "level_", F.col("at_").alias("place_"), "node_")
    schema = T.StructType([*(held.schema[c] for c in ["leaf", *kept, "subroot", "root"]), T.StructField("proof", T._parse_datatype_string(PROOF))])

    def run(own: pa.Table, nodes: pa.Table) -> pa.Table:
        if own.num_rows == 0:
            return schema_table()
        found: dict[bool, dict] = {True: {}, False: {}}
        for top, level, at, node in zip(*(nodes[c].to_pylist() for c in ("top_", "level_", "place_", "node_"))):
            found[top][level, at] = node
        at, leaf = own["at_"].to_pylist(), own["leaf"].to_pylist()
        lower, last = climb(dict(zip(at, leaf)), found[False], own["width_"][0].as_py())
        upper, _ = climb({own["top_at_"][0].as_py(): last}, found[True], own["top_width_"][0].as_py())
        above = _sides(upper, own["top_at_"][0].as_py())
        proofs = pa.array([_sides(lower, a) + above for a in at], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return own.select(["leaf", *kept, "subroot", "root"]).append_column("proof", proofs)

    def schema_table() -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    return held.groupBy("tree_", "part_").cogroup(fetched.groupBy("holder_", "of_")).applyInArrow(run, schema)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, joined level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")
