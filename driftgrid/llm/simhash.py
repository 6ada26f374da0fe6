"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one node. Any two fingerprints within the radius agree
on enough of ``bands`` bit ranges that some combination of them is equal on
both, so nodes meet by those combinations. A meeting place with more than
``BLOCK`` fingerprints is cut into cells, each of which holds two of its
blocks. Within a group the fingerprints stand as 64 vertical bit planes; a
query is compared with 64 of them at a time by carry-save counters, one plane
after the other, and a block is left once all its distances exceed the radius.
A group returns a spanning forest of its links, never all of its pairs.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; a null ``doc_id`` keeps its row and counts only if its component has
no other; repeated rows repeat. Other columns are not carried; ``keep`` must not
name one of the operator's own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm.components import components
from driftgrid.scale import durable

#: Fingerprints of a block of a crowded meeting place; rows compared at a time; shingles counted at a time.
BLOCK, ROWS, SHINGLES = 1024, 1 << 17, 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Names of columns that a result has, or that are used on the way to it.
OWN = {"doc_id", "fp", "component_id", "group_id", "input_"}


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of the ``width``-word shingles of a text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = list(zip((ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    count = np.zeros(64, np.int64)
    for i in range(0, len(spans), SHINGLES):
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans[i : i + SHINGLES]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return sum(1 << int(i) for i in np.flatnonzero(count * 2 > len(spans)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, keep: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``fp``, the fingerprint as a signed long."""
    if taken := OWN & {k.lower() for k in keep or {}}:
        raise ValueError(f"keep must not have columns called {', '.join(sorted(taken))}")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in (keep or {}).items()))
    schema = rows.withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", width, seed) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], schema.names)

    given = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in (keep or {}).items()), F.col(text).cast("binary").alias("input_"))
    return given.mapInArrow(run, schema)


def meeting_keys(fp, radius: int, bands: int, agree: int | None = None):
    """Keys of which any two fingerprints within ``radius`` share at least one."""
    agree = bands - radius if agree is None else agree
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for n, chosen in enumerate(combinations(range(bands), agree)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
        keys.append(key)
    return keys


def cells(rows: DataFrame, key: str, order, block: int) -> DataFrame:
    """Rows with ``cell``: the key's only cell, or every pair of blocks that the row's block is in.

    Rows of a key with at most ``block`` rows stay together; a larger key is cut into blocks by ``order``.
    """
    large = durable(rows.groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > block))
    blocks = F.coalesce(F.ceil(F.col("n_") / block), F.lit(1)).cast("int")
    own = F.pmod(order, blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    # two blocks meet in their own cell; one block alone is covered by any cell it is in
    several = F.filter(pairs, lambda p: p.a != p.b)
    return rows.join(large, key, "left").withColumn("cell", F.explode(F.when(blocks == 1, pairs).otherwise(several))).drop("n_")


def linked_masks(fps: np.ndarray, sizes: np.ndarray, radius: int):
    """For the groups of ``fps`` (lengths ``sizes``): arrays (query, word of its group, mask of near lanes)."""
    n, words = len(fps), -(-sizes // 64)
    first = np.cumsum(sizes) - sizes
    slot = np.arange(n) - np.repeat(first, sizes)
    base = np.cumsum(words) - words
    of_row = np.repeat(np.arange(len(sizes)), sizes)
    word_of = base[of_row] + slot // 64
    begins = np.flatnonzero(slot % 64 == 0)
    lane = np.uint64(1) << (slot % 64).astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat(np.where(fps >> np.uint64(b) & np.uint64(1), lane, np.uint64(0)), begins) for b in range(64)])
    there = np.bitwise_or.reduceat(lane, begins)
    reach = words[of_row]
    upto = np.cumsum(reach)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROWS, "right")))
        q = np.repeat(np.arange(at, end), reach[at:end])
        w = np.arange(len(q)) - np.repeat(np.cumsum(reach[at:end]) - reach[at:end], reach[at:end])
        full = base[of_row[q]] + w
        over = ~there[full] | np.where(full == word_of[q], lane[q], np.uint64(0))
        # counters begin so that the distance radius + 1 carries out of the third bit
        low, mid, high = (np.full(len(q), ALL if 7 - radius >> k & 1 else np.uint64(0)) for k in range(3))
        for b in range(64):
            carry = planes[b][full] ^ (np.uint64(0) - (fps[q] >> np.uint64(b) & np.uint64(1)))
            low, carry = low ^ carry, low & carry
            mid, carry = mid ^ carry, mid & carry
            high, carry = high ^ carry, high & carry
            over |= carry
            if b % 8 == 7:
                left = over != ALL
                if not left.any():
                    q = q[:0]
                    break
                if left.mean() < 0.8:
                    q, w, full, over, low, mid, high = (x[left] for x in (q, w, full, over, low, mid, high))
        if len(q):
            near = over != ALL
            yield q[near], w[near], ~over[near]
        at = end


def forests(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Spanning forests of the links within each group: two lists of indices."""
    masks: dict[int, int] = {}
    for q, w, mask in linked_masks(fps, sizes, radius):
        for i, j, m in zip(q.tolist(), w.tolist(), mask.tolist()):
            masks[i] = masks.get(i, 0) | m << 64 * j
    first = np.cumsum(sizes) - sizes
    group = np.searchsorted(first, np.fromiter(masks, np.int64, len(masks)), "right") - 1
    a, b, seen = [], [], {}
    for start, g in zip(list(masks), group.tolist()):
        begin = int(first[g])
        open_ = seen.setdefault(g, (1 << int(sizes[g])) - 1)
        if not open_ >> start - begin & 1:
            continue
        stack, open_ = [start], open_ & ~(1 << start - begin)
        while stack:
            i = stack.pop()
            new = masks.get(i, 0) & open_
            open_ &= ~new
            while new:
                j = begin + (new & -new).bit_length() - 1
                new &= new - 1
                a.append(i)
                b.append(j)
                stack.append(j)
        seen[g] = open_
    return a, b


def near_duplicates(docs: DataFrame, radius: int = 4, bands: int = 6, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, width: int = 4) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``fp`` (signed), ``component_id``, the smallest id reachable by links, and
    ``group_id``, which names the component even if it has no id; one row per input row.

    ``bands - radius`` of the bands are equal for any linked pair; more bands make more, smaller meeting places.
    """
    if not 0 <= radius <= 7 or bands <= radius:
        raise ValueError(f"radius must be from 0 to 7 and less than bands, got {radius} and {bands}")
    ship(docs.sparkSession)
    prints = durable(fingerprints(docs, id_col, text, width, keep=keep))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    met = nodes.select("fp", F.explode(F.array(*meeting_keys(F.col("fp"), radius, bands))).alias("key"))
    groups = cells(met, "key", F.xxhash64("fp"), BLOCK).groupBy("key", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for i in range(0, len(column), 4096):
                part = column.slice(i, 4096)
                sizes = np.diff(part.offsets.to_numpy())
                fps = part.flatten().to_numpy().view(np.uint64)
                a, b = forests(fps, sizes.astype(np.int64), radius)
                if a:
                    signed = fps.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    roots = components(groups.select("fps").mapInArrow(run, "a long, b long"))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = durable(member.join(least, "root").select("fp", "component_id", F.col("root").alias("group_id")))
    return prints.join(classes, "fp").select("doc_id", *(keep or {}), "fp", "component_id", "group_id")
