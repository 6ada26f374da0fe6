"""Repair of the turn structure of conversations by a parallel Viterbi search.

The cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` (an
optional system turn, then user and assistant in turns) are a shortest path
through four states: nothing said, after a system, a user, an assistant turn.
The search runs backward: the vector of a place holds, for every state, the
least cost from there to the end.

Long conversations are cut into chunks of ``CHUNK`` rows. All chunks but the
last start from a speculative vector. In fix-up passes a chunk takes the vector
that the next chunk begins with and runs again only until its vectors differ
from those it had by a constant; from there on they are the old ones plus that
constant. Passes repeat, over changed chunks only, until none changes. The
constants are stitched by one sum per conversation. With these costs each
chunk traces the ASCII-least cheapest edits from every state it may be entered
in; what states it is left in composes over chunks by doubling, which tells
the state each is entered in.

Edits: ``K`` keep (0), ``R`` change the role (2), ``D`` delete (3), ``I`` insert
an empty turn (2); a truncated row that stays adds 1. Blank rows (without
other than white space) and duplicates (role and text seen earlier in the
conversation) must be deleted.

Defined cases: rows are ordered by turn (null first), role, text; a null role
or text is one space; a null conversation id is a conversation of its own; a
role that starts with none of ``s``, ``u``, ``a`` can't be kept; an empty table
has no conversations. Other columns than the four are not carried. An audit
string is one value of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm.places import before
from driftgrid.scale import durable, release

CHUNK = 1024
#: Cells (rows of padded chunks) that a task handles at a time.
CELLS = 1 << 17
SPACES = " \t\n\x0b\x0c\r"
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept row by state and the row's kind (s, u, a, other); -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after an inserted turn or a changed role: it is the only one that may follow.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Least cost to the end where no row is left.
AT_END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0])
_NEVER = 1 << 28
_DELETE, _TRUNCATED = 4, 8


def backward(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One row earlier: vectors (n, 4) from those after the rows with these codes (kind, 4: must go, 8: truncated)."""
    kind, gone, short = codes & 3, (codes & _DELETE) > 0, ((codes & _TRUNCATED) > 0) * TRUNCATED_COST
    best = after + DELETE_COST
    to = KEPT[:, kind].T
    kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1), _NEVER) + KEEP_COST + short[:, None]
    stays = np.minimum(kept, after[:, NEXT] + ROLE_COST + short[:, None])
    best = np.where(gone[:, None], best, np.minimum(best, stays))
    once = best[:, NEXT] + INSERT_COST
    return np.minimum(best, np.minimum(once, once[:, NEXT] + INSERT_COST))


def _grouped(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of chunks in groups of similar length and at most ``CELLS`` padded cells, longest first."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(1, int(sizes[order[at]])))
        yield order[at : at + n]
        at += n


def _padded(chunks: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(chunks), max(map(len, chunks), default=0), *chunks[0].shape[1:]), chunks[0].dtype)
    for row, chunk in zip(out, chunks):
        row[: len(chunk)] = chunk
    return out


def solve(codes: list[np.ndarray], ends: np.ndarray) -> list[np.ndarray]:
    """The cost vectors (rows + 1, 4) of every chunk, given the vector at its end."""
    sizes, out = np.array([len(c) for c in codes]), [None] * len(codes)
    for group in _grouped(sizes):
        table, n = _padded([codes[i] for i in group]), sizes[group]
        costs = np.zeros((len(group), table.shape[1] + 1, 4), np.int64)
        costs[np.arange(len(group)), n] = ends[group]
        for back in range(table.shape[1]):
            on = np.flatnonzero(n > back)
            t = n[on] - 1 - back
            costs[on, t] = backward(table[on, t], costs[on, t + 1])
        for i, k, c in zip(group, n, costs):
            out[i] = c[: k + 1].copy()
    return out


def fix_up(codes: np.ndarray, costs: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """Costs after the vector at the end became ``end``, and how many rows were run again."""
    costs, now = costs.copy(), end.astype(np.int64)
    for t in range(len(codes), -1, -1):
        gap = now - costs[t]
        if (gap == gap[0]).all():  # parallel: all earlier vectors move by the same constant
            costs[: t + 1] += gap[0]
            return costs, len(codes) - t
        costs[t] = now
        if t:
            now = backward(codes[t - 1 : t], now[None, :])[0]
    return costs, len(codes)


def trace(codes: list[np.ndarray], costs: list[np.ndarray], last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For every chunk and entering state the ASCII-least cheapest edits and the state they lead to."""
    sizes = np.array([len(c) for c in codes])
    audits, exits = [None] * len(codes), np.zeros((len(codes), 4), np.int64)
    for group in _grouped(sizes * 4):
        table, vectors = _padded([codes[i] for i in group]), _padded([costs[i] for i in group])
        lanes = len(group) * 4
        chunk, state, at = np.repeat(np.arange(len(group)), 4), np.tile(np.arange(4), len(group)), np.zeros(lanes, np.int64)
        n, ends = sizes[group][chunk], last[group][chunk]
        said, length = np.zeros((lanes, 3 * table.shape[1] + 3), np.uint8), np.zeros(lanes, np.int64)
        on = np.arange(lanes)
        while len(on):
            c, q, t = chunk[on], state[on], at[on]
            here, inside = vectors[c, t, q], t < n[on]
            after = vectors[c, np.minimum(t + 1, n[on])]
            code = table[c, np.minimum(t, max(table.shape[1] - 1, 0))] if table.shape[1] else np.zeros(len(on), np.int64)
            to, stays = KEPT[q, code & 3], (code & _DELETE) == 0
            short = ((code & _TRUNCATED) > 0) * TRUNCATED_COST
            pick = lambda s: np.take_along_axis(after, s[:, None], axis=1)[:, 0]
            delete = inside & (pick(q) + DELETE_COST == here)
            insert = ~delete & (inside | ends[on]) & (vectors[c, t, NEXT[q]] + INSERT_COST == here)
            keep = ~delete & ~insert & inside & stays & (to >= 0) & (pick(np.maximum(to, 0)) + KEEP_COST + short == here)
            role = ~delete & ~insert & ~keep & inside
            done = ~(delete | insert | keep | role)
            letter = np.select([delete, insert, keep, role], [ord(x) for x in "DIKR"], 0)
            said[on, length[on]] = letter
            length[on] += ~done
            state[on] = np.where(keep, to, np.where(insert | role, NEXT[q], q))
            at[on] += delete | keep | role
            on = on[~done]
        for k, i in enumerate(group):
            audits[i] = [said[j, : length[j]].tobytes().decode() for j in range(4 * k, 4 * k + 4)]
            exits[i] = state[4 * k : 4 * k + 4]
    return audits, exits


def _lists(column: pa.Array, kind) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum([0, *(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _normal(v: np.ndarray) -> list[int]:
    return (v - v.min()).tolist()


_STATE = "conv_ string, chunk_ long, last_ boolean, codes array<int>, costs binary, begin_ array<int>, end_ array<int>, delta_ long"


def _state(table: pa.Table | pa.RecordBatch, costs: list[np.ndarray]) -> pa.RecordBatch:
    columns = [table.column(c) for c in ("conv_", "chunk_", "last_", "codes")]
    made = [
        pa.array([c.astype("<i8").tobytes() for c in costs], pa.binary()),
        pa.array([_normal(c[0]) for c in costs], pa.list_(pa.int32())),
        pa.array([_normal(c[-1]) for c in costs], pa.list_(pa.int32())),
        pa.array([int(c[0].min() - c[-1].min()) for c in costs], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([*columns, *made], ["conv_", "chunk_", "last_", "codes", "costs", "begin_", "end_", "delta_"])


def _costs(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i8").reshape(-1, 4) for b in column.to_pylist()]


def _search(batches):
    for batch in batches:
        ends = np.where(batch.column("last_").to_numpy(zero_copy_only=False)[:, None], AT_END, 0)
        yield _state(batch, solve(_lists(batch.column("codes"), np.int64), ends))


def _mend(batches):
    for batch in batches:
        costs = []
        for codes, old, end in zip(_lists(batch.column("codes"), np.int64), _costs(batch.column("costs")), batch.column("met_").to_pylist()):
            costs.append(fix_up(codes, old, np.array(end))[0])
        yield _state(batch, costs)


def converge(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Stored cost vectors of the chunks ``conv_, chunk_, last_, codes`` and the number of fix-up passes."""
    now, passes = durable(chunks.select("conv_", "chunk_", "last_", "codes").mapInArrow(_search, _STATE)), 0
    while True:
        begins = now.where("chunk_ > 0").select("conv_", (F.col("chunk_") - 1).alias("chunk_"), F.col("begin_").alias("met_"))
        open_ = durable(now.where("NOT last_").join(begins, ["conv_", "chunk_"]).where("met_ <> end_"))
        if open_.isEmpty():
            release(open_)
            return now, passes
        mended = open_.mapInArrow(_mend, _STATE)
        after = durable(now.join(open_.select("conv_", "chunk_"), ["conv_", "chunk_"], "left_anti").select(*now.columns).unionByName(mended))
        release(now)
        release(open_)
        now, passes = after, passes + 1


def _trace(batches):
    for batch in batches:
        last = batch.column("last_").to_numpy(zero_copy_only=False).astype(bool)
        audits, exits = trace(_lists(batch.column("codes"), np.int64), _costs(batch.column("costs")), last)
        columns = [batch.column(c) for c in ("conv_", "chunk_", "delta_")]
        first = pa.array([c[0] for c in batch.column("begin_").to_pylist()], pa.int64())
        made = [pa.array(audits, pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int32())), first]
        yield pa.RecordBatch.from_arrays([*columns, *made], ["conv_", "chunk_", "delta_", "audits", "exits", "first_"])


def _entered(traced: DataFrame) -> DataFrame:
    """``conv_, chunk_, enter_`` of all chunks but the first: maps of states compose over 1, 2, 4, … chunks."""
    most = traced.agg(F.max("chunk_")).first()[0] or 0
    maps, reach = traced.select("conv_", "chunk_", "exits"), 1
    if most:
        maps = durable(maps.join(traced.where("chunk_ > 0").select("conv_").distinct(), "conv_", "left_semi"))
    while reach <= most:
        earlier = maps.select("conv_", (F.col("chunk_") + reach).alias("chunk_"), F.col("exits").alias("before_"))
        both = F.when(F.col("before_").isNull(), F.col("exits")).otherwise(F.transform("before_", lambda s: F.get("exits", s)))
        after = durable(maps.join(earlier, ["conv_", "chunk_"], "left").select("conv_", "chunk_", both.alias("exits")))
        release(maps)
        maps, reach = after, reach * 2
    return maps.where("chunk_ < 0" if not most else "true").select("conv_", (F.col("chunk_") + 1).alias("chunk_"), F.get("exits", F.lit(START)).alias("enter_"))


def _edits(size: int):
    def run(batches):
        for batch in batches:
            conv, at, step, edit, role = [], [], [], [], []
            chunks = zip(batch.column("conv_").to_pylist(), batch.column("chunk_").to_pylist(), batch.column("audit_").to_pylist(), batch.column("enter_").to_pylist(), batch.column("system_").to_pylist())
            for name, chunk, audit, enter, system in chunks:
                letters = np.frombuffer(audit.encode(), np.uint8)
                used = np.cumsum(letters != ord("I")) - (letters != ord("I"))
                kept = np.flatnonzero(letters != ord("D"))
                turn = np.arange(len(kept)) + (enter == USER)
                if system and len(kept):
                    turn -= 1  # the system turn, which only the first kept row of a conversation may be
                conv += [name] * len(kept)
                at.append(chunk * size + used[kept])
                step.append(kept)
                edit += [audit[k] for k in kept]
                role += ["assistant" if k % 2 else "user" for k in turn]
            arrays = [pa.array(conv, pa.string()), pa.array(np.concatenate(at) if at else [], pa.int64()), pa.array(np.concatenate(step) if step else [], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(edit, pa.string()), pa.array(role, pa.string())], ["conv_", "at_", "step_", "edit", "said_"])

    return run


def faults(placed: DataFrame) -> DataFrame:
    """``conv_, at_, kind_, blank, duplicate, truncated`` of placed rows; at most one fault each."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = durable(placed.select("conv_", "at_", key.alias("key_"), kind.alias("kind_"), blank.alias("blank"), (~end.isin(".", "!", "?")).alias("cut_")))
    first = light.groupBy("conv_", "key_").agg(F.min("at_").alias("first_"))
    found = light.join(first, ["conv_", "key_"]).withColumn("duplicate", ~F.col("blank") & (F.col("at_") > F.col("first_")))
    return found.select("conv_", "at_", "kind_", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("cut_")).alias("truncated"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired): per conversation ``gaps, blank, duplicate, truncated, illegal, cost, audit``; and the repaired rows
    ``conv_id, at_, step_, edit, role, text``, in order of ``at_, step_``."""
    ship(rows.sparkSession)
    said = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("-")).alias("conv_"),
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    placed = durable(before(said, ["conv_"], ["turn", "role", "text"], "at_"))
    found = durable(faults(placed).withColumn("chunk_", F.expr(f"at_ div {chunk}")))
    counts = found.groupBy("conv_").agg(F.count(F.lit(1)).alias("n_"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")))
    turns = placed.groupBy("conv_").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    stats = durable(counts.join(turns, "conv_"))
    code = F.col("kind_") + F.when(F.col("blank") | F.col("duplicate"), _DELETE).otherwise(0) + F.when(F.col("truncated"), _TRUNCATED).otherwise(0)
    codes = F.transform(F.sort_array(F.collect_list(F.struct("at_", code.alias("code")))), lambda s: s["code"])
    chunks = found.groupBy("conv_", "chunk_").agg(codes.alias("codes")).join(stats.select("conv_", F.expr(f"(n_ - 1) div {chunk}").alias("end_")), "conv_")
    chunks = durable(chunks.withColumn("last_", F.col("chunk_") == F.col("end_")).select("conv_", "chunk_", "last_", "codes"))
    costs, _ = converge(chunks)
    traced = durable(costs.mapInArrow(_trace, "conv_ string, chunk_ long, delta_ long, audits array<string>, exits array<int>, first_ long"))
    entered = traced.join(_entered(traced), ["conv_", "chunk_"], "left").withColumn("enter_", F.coalesce("enter_", F.lit(START)))
    chosen = durable(entered.select("conv_", "chunk_", "delta_", "first_", "enter_", F.get("audits", F.col("enter_")).alias("audit_")))

    kinds = F.transform("codes", lambda c: c.bitwiseAND(F.lit(3)))
    edges = chunks.select("conv_", "chunk_", kinds.alias("kinds_"))
    met = edges.select("conv_", (F.col("chunk_") + 1).alias("chunk_"), F.slice("kinds_", -1, 1).alias("met_"))
    row = F.concat(F.coalesce("met_", F.array().cast("array<int>")), "kinds_")
    pairs = F.zip_with(row, F.slice(row, F.lit(2), F.size(row)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    legal = lambda p: ((p["a"] == 0) & (p["b"] == 1)) | ((p["a"] == 1) & (p["b"] == 2)) | ((p["a"] == 2) & (p["b"] == 1))
    wrong = F.size(F.filter(pairs, lambda p: p["b"].isNotNull() & ~legal(p)))
    illegal = edges.join(met, ["conv_", "chunk_"], "left").groupBy("conv_").agg(F.sum(wrong).cast("long").alias("illegal"))

    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_", "audit_"))), lambda s: s["audit_"]), "")
    cost = F.sum(F.col("delta_") + F.when(F.col("chunk_") == 0, F.col("first_")).otherwise(0)).cast("long")
    sums = chosen.groupBy("conv_").agg(cost.alias("cost"), audit.alias("audit"))
    reports = stats.join(illegal, "conv_").join(sums, "conv_").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # a system row is kept if it is the first kept row of its conversation
    system = _system_kept(chosen, chunks)
    steps = chosen.join(system, ["conv_", "chunk_"]).mapInArrow(_edits(chunk), "conv_ string, at_ long, step_ long, edit string, said_ string")
    mended = steps.join(placed.select("conv_", "at_", "role", "text"), ["conv_", "at_"], "left").join(stats.select("conv_", "conv_id"), "conv_")
    own = F.col("edit") == "K"
    repaired = mended.select(
        "conv_id", "at_", "step_", "edit", F.when(own, F.col("role")).otherwise(F.col("said_")).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")
    )
    return reports, repaired


def _system_kept(chosen: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether the first row that a chunk keeps is a system turn at the start of its conversation."""
    firsts = chosen.select("conv_", "chunk_", "enter_", F.regexp_extract("audit_", "^D*", 0).alias("gone_"), "audit_").join(chunks.select("conv_", "chunk_", "codes"), ["conv_", "chunk_"])
    at = F.length("gone_")
    kept = (F.substring("audit_", at + 1, F.lit(1)) == "K") & (F.get("codes", at).bitwiseAND(F.lit(3)) == 0)
    return firsts.select("conv_", "chunk_", F.coalesce((F.col("enter_") == START) & kept, F.lit(False)).alias("system_"))


def _digests(batches):
    """One SHA-256 a conversation over its lines, in the order given; nothing but the running digest is held."""
    name, running, some = None, None, False

    def out():
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([running.hexdigest()], pa.string())], ["conv_", "repaired_sha256"])

    for batch in batches:
        for conv, line in zip(batch.column("conv_").to_pylist(), batch.column("line_").to_pylist()):
            if not some or conv != name:
                if some:
                    yield out()
                name, running, some = conv, hashlib.sha256(line.encode()), True
            else:
                running.update(b"\n" + line.encode())
    if some:
        yield out()


def hashed(repaired: DataFrame, line: Column) -> DataFrame:
    """``conv_`` and ``repaired_sha256`` of the newline-joined lines of each conversation, read in order as a stream."""
    lines = repaired.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv_"), "at_", "step_", line.alias("line_"))
    laid = lines.repartition("conv_").sortWithinPartitions("conv_", "at_", "step_").select("conv_", "line_")
    return laid.mapInArrow(_digests, "conv_ string, repaired_sha256 string")
