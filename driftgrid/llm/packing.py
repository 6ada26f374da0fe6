"""Packing documents into sequences whose sources keep target proportions.

Every source is a queue of token ids. A window (one sequence) is filled by
deficit round-robin: each source is owed its target share of the window, what
it is owed adds to its deficit, sources with the largest deficit are served
first, and a source owed fewer than ``least`` ids waits while the others lend
it their turn. So a window holds the target proportions up to ``least`` ids a
source, and what is missing in one is made up in the next.

To run on many machines the windows are dealt in blocks of about ``block``
ids. Block b of B takes of a source with A ids those from floor(b*A/B) on:
that is round-robin with a quantum of A/B ids a block, and the deficit a block
starts with is the fraction of b*A/B, known without the blocks before. Blocks
are packed independently, each in one task that sees lengths only; the ids
meet their pieces afterwards by one join.

Without ``weights`` the target is the share of each source in the corpus, so
all queues end together. With ``weights`` sources are drawn by weight until one
is empty; then the others go on by theirs (another phase of blocks).

The last ids of a block, fewer than a sequence, are cut into sequences whose
lengths are powers of two, so nothing is padded.

Defined cases: null text is empty text and has only the end id; a null source
is a source of its own; null and repeated ids and repeated rows are ordinary
documents; a document longer than a sequence or a block is cut; an empty table
has no pieces. Reruns agree: the order of a queue comes from a hash of id and
token ids. Other columns are carried only if named in ``keep``. The list of
sources (not of documents) is held by the driver, as are at most S² slices of
them where weights make S phases.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship
from driftgrid.llm.memo import Memo, spans
from driftgrid.llm.places import before
from driftgrid.llm.worker import held
from driftgrid.scale import durable

SIZE, LEAST, BLOCK = 2048, 64, 1 << 19
#: Sequence ids of a block start at its number times this.
STRIDE = 1 << 20
#: Words that a worker remembers, their longest form, and characters encoded at a time.
MAX_WORDS, MAX_WORD_CHARS, SLICE = 600_000, 64, 1 << 21

# The classes of the first 256 characters that the tokenizer's splitting pattern tells apart.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_SPACES = "\t\n\v\f\r \x85\xa0"
_DIGITS = "0123456789²³¹¼½¾"
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Words:
    """Token ids of texts by a ``tokenizers`` file, each distinct word encoded once.

    Texts of the first 256 characters are lower-cased and split here, by arrays; their words are encoded by the
    library's model. All other texts, and those that hold a special token, go through the library as they are.
    """

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.special = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self._ids, MAX_WORDS, MAX_WORD_CHARS)
        one = [chr(i) for i in range(256)]
        self.lower = np.array([ord(c.lower()) for c in one], np.uint8)
        kind = [_SPACE if c in _SPACES else _DIGIT if c in _DIGITS else _LETTER if c.isalpha() else _OTHER for c in one]
        self.kind = np.array(kind, np.uint8)
        # bytes as the model's alphabet writes them: printable ones as they are, the others from 256 on
        plain = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174]
        rest = iter(range(256, 512))
        self.written = {i: i if i in plain else next(rest) for i in range(256)}

    def _ids(self, word: bytes) -> bytes:
        """The ids of a lower-cased word, packed; ``word`` is in Latin-1."""
        text = word.decode("latin-1").encode("utf-8").decode("latin-1").translate(self.written)
        return np.array([t.id for t in self.tokenizer.model.tokenize(text)], np.int32).tobytes()

    def _split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the words in lower-cased Latin-1 text."""
        kind = self.kind[data]
        prior = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)
        begins = (kind != prior) | (kind == _DIGIT)
        marks = np.flatnonzero((data == ord("'")) & (prior != _OTHER))
        if len(marks):
            ahead = np.concatenate([data, np.zeros(2, np.uint8)])
            first, second = ahead[marks + 1], ahead[marks + 2]
            taken = np.zeros(len(marks), np.int64)
            for tail in _CONTRACTIONS:
                fits = first == ord(tail[0])
                if len(tail) == 2:
                    fits &= second == ord(tail[1])
                taken[fits] = len(tail)
            marks, taken = marks[taken > 0], taken[taken > 0]
            begins[marks + 1] = False
            after = marks + taken + 1
            inside = after < len(data)
            begins[after[inside]] |= kind[after[inside]] != _SPACE
        starts = np.flatnonzero(begins & (kind != _SPACE))
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        # a word ends where white space begins, if that comes before the next word
        gaps = np.flatnonzero((kind == _SPACE) & (prior != _SPACE))
        if len(gaps):
            at = np.searchsorted(gaps, starts, "right")
            ends = np.minimum(ends, np.append(gaps, len(data))[at])
        return starts, ends - starts

    def _encode_slice(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the joined texts, and how many of them lie before each of ``cuts``."""
        data = self.lower[data]
        starts, lengths = self._split(data)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(cuts), np.int64)
        kept, offsets = spans(starts, lengths)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[kept].tobytes())])
        coded = words.dictionary_encode()
        flat, size = self.memo.look(coded.dictionary)
        index = coded.indices.to_numpy()
        place, total = spans((np.cumsum(size) - size)[index], size[index])
        ids = flat[place].astype("<u4")
        return ids, total[np.searchsorted(starts, cuts, "left")]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of every text (little-endian, four bytes each), then the end id."""
        end = np.array([self.end], "<u4").tobytes()
        wait: list[bytes] = []

        def joined():
            data = np.frombuffer(b"\n".join(wait) + b"\n", np.uint8)
            cuts = np.cumsum([len(w) + 1 for w in wait])
            ids, ends = self._encode_slice(data, cuts)
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                yield ids[a:b].tobytes() + end

        for text in texts:
            try:
                data = None if any(s in text for s in self.special) else text.encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is not None and len(data) <= SLICE:
                wait.append(data)
                if sum(map(len, wait)) >= SLICE:
                    yield from joined()
                    wait = []
                continue
            if wait:
                yield from joined()
                wait = []
            if data is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
            else:
                yield b"".join(self._long(data)) + end
        if wait:
            yield from joined()

    def _long(self, data: bytes) -> Iterator[bytes]:
        """A long text in slices that end at a blank or a new line."""
        begun = 0
        while begun < len(data):
            upto = min(begun + SLICE, len(data))
            if upto < len(data):
                last = max(data.rfind(b" ", begun, upto), data.rfind(b"\n", begun, upto))
                if last <= begun:
                    more = [at for at in (data.find(b" ", upto), data.find(b"\n", upto)) if at >= 0]
                    last = min(more, default=len(data) - 1)
                upto = last + 1
            yield self._encode_slice(np.frombuffer(data[begun:upto], np.uint8), np.array([upto - begun]))[0].tobytes()
            begun = upto


def tokenize(df: DataFrame, path: str, end: int = 1, text: str = "text", keep: list[str] = ("doc_id",), out: str = "ids") -> DataFrame:
    """``keep`` and the whole text's ids by the ``tokenizers`` file ``path``, without added tokens, then ``end``; packed as
    little-endian unsigned 32-bit numbers."""
    spark, keep = df.sparkSession, list(keep)
    if out in keep:
        raise ValueError(f"{out!r} is both carried and computed")
    ship(spark)
    with open(path) as file:
        content = spark.sparkContext.broadcast(file.read())  # one vocabulary file, a few MB

    def tools() -> Words:
        import tempfile

        def build():
            with tempfile.NamedTemporaryFile("w", suffix=".json") as copy:
                copy.write(content.value)
                copy.flush()
                return Words(copy.name, end)

        return held(("words", path, end), build)

    def run(batches):
        words = tools()
        for batch in batches:
            texts, begun = batch.column(batch.num_columns - 1), 0
            while begun < batch.num_rows:
                rows, size = [], 0
                while begun + len(rows) < batch.num_rows and (size < SLICE or not rows):
                    rows.append(texts[begun + len(rows)].as_py())
                    size += len(rows[-1])
                part = batch.slice(begun, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(words.encode(rows)), pa.binary())], [*keep, out])
                begun += len(rows)

    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_".join(["input", *keep])))
    return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())]))


def phases(totals: dict, weights: dict | None) -> list[tuple]:
    """(phase, source, from, to): which ids of each source's queue a phase draws.

    Sources are drawn in proportion to their weights (1 if none is given for a source) until one is empty. Without
    weights the proportions are the totals themselves: one phase.
    """
    rate = {s: Fraction(n if weights is None else weights.get(s, 1)) for s, n in totals.items() if n > 0}
    if any(r <= 0 for r in rate.values()):
        raise ValueError("weights must be positive")
    ends = sorted({totals[s] / r for s, r in rate.items()})
    out, last = [], Fraction(0)
    for phase, now in enumerate(ends):
        for s, r in rate.items():
            if totals[s] / r >= now and (a := int(r * last)) < (b := int(r * now)):
                out.append((phase, s, a, b))
        last = now
    return out


def fill(owned: np.ndarray, carried: np.ndarray, size: int, least: int) -> tuple[list[int], np.ndarray]:
    """The windows of a block: their lengths, and the ids each takes of every source."""
    left, total = owned.astype(np.int64).copy(), int(owned.sum())
    lengths = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if total % size >> b & 1]
    share, deficit = owned / max(total, 1), carried.astype(float).copy()
    takes = np.zeros((len(lengths), len(owned)), np.int64)
    for take, room in zip(takes, lengths):
        deficit += share * room
        for s in np.argsort(-deficit, kind="stable"):
            due = min(int(deficit[s]), int(left[s]), room)
            if due >= min(least, left[s], room) and due > 0:
                take[s] = due
                room -= due
        # what waiting sources leave free is lent to those with most ids to come
        if room:
            for s in np.argsort(take - left, kind="stable"):
                more = min(room, int(left[s] - take[s]))
                take[s] += more
                room -= more
                if not room:
                    break
        left -= take
        deficit -= take
    return lengths, takes


def _deal(size: int, least: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        table = table.sort_by([("slot", "ascending"), ("from_", "ascending")])
        slot, length = table["slot"].to_numpy(), table["length"].to_numpy()
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        owned = np.add.reduceat(length, begin)
        carried = table["carried"].to_numpy()[begin]
        _, takes = fill(owned, carried, size, least)
        base = np.cumsum(takes, axis=1) - takes
        rows, starts, lengths, windows, offsets = [], [], [], [], []
        for s, first in enumerate(begin):
            mine = slice(first, begin[s + 1] if s + 1 < len(begin) else len(slot))
            docs = np.cumsum(length[mine]) - length[mine]
            served = np.concatenate([[0], np.cumsum(takes[:, s])])
            cuts = np.union1d(docs, served[:-1][takes[:, s] > 0])
            doc, window = np.searchsorted(docs, cuts, "right") - 1, np.searchsorted(served, cuts, "right") - 1
            rows.append(first + doc)
            starts.append(cuts - docs[doc])
            lengths.append(np.diff(np.append(cuts, owned[s])))
            windows.append(window)
            offsets.append(base[window, s] + cuts - served[window])
        row = np.concatenate(rows)
        return pa.table(
            {
                "row_": table["row_"].take(pa.array(row)),
                "start": pa.array(table["start"].to_numpy()[row] + np.concatenate(starts)),
                "length": pa.array(np.concatenate(lengths)),
                "sequence_id": pa.array(block * STRIDE + np.concatenate(windows)),
                "offset": pa.array(np.concatenate(offsets)),
            }
        )

    return run


def _bound(block: Column) -> Column:
    """The first id of a source's slice that belongs to ``block``: floor(block * held_ / blocks_), without overflow."""
    rest = block * (F.col("held_") % F.col("blocks_"))
    return block * F.call_function("div", F.col("held_"), F.col("blocks_")) + F.call_function("div", rest, F.col("blocks_"))


def _block_of(place: Column) -> Column:
    """The block of an id of a slice; a quotient of doubles is at most one off."""
    guess = (F.ceil((place + 1) / F.col("held_") * F.col("blocks_")) - 1).cast("long")
    guess = F.least(F.greatest(guess, F.lit(0)), F.col("blocks_") - 1)
    return F.when(_bound(guess) > place, guess - 1).when((_bound(guess + 1) <= place), guess + 1).otherwise(guess)


def plan(light: DataFrame, size: int = SIZE, weights: dict | None = None, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Pieces ``row_, start, length, sequence_id, offset`` of rows ``row_, source, n, order_`` (n: number of ids)."""
    spark = light.sparkSession
    ship(spark)
    found = {s: int(n) for s, n in light.groupBy("source").agg(F.sum("n")).collect()}
    slices, base = [], 0
    slot = {s: i for i, s in enumerate(sorted(found, key=lambda s: (s is None, s)))}
    drawn = phases(found, weights)
    for phase in range(max([p for p, *_ in drawn], default=-1) + 1):
        mine = [(s, a, b) for p, s, a, b in drawn if p == phase]
        blocks = max(1, round(sum(b - a for _, a, b in mine) / block))
        slices += [(slot[s], s, a, b - a, blocks, base) for s, a, b in mine]
        base += blocks
    named = spark.createDataFrame(slices, "slot int, name_ string, first_ long, held_ long, blocks_ long, base_ long")
    rows = light.select("row_", "order_", "n", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("queue_"))
    named = named.select("*", F.coalesce(F.concat(F.lit("="), "name_"), F.lit("-")).alias("queue_")).drop("name_")
    queued = before(rows, ["queue_"], ["order_", "row_"], "at_", "n")
    met = queued.join(named, "queue_").where((F.col("first_") < F.col("at_") + F.col("n")) & (F.col("first_") + F.col("held_") > F.col("at_")))
    begin, end = F.greatest(F.col("at_") - F.col("first_"), F.lit(0)), F.least(F.col("at_") + F.col("n") - F.col("first_"), F.col("held_"))
    met = met.withColumns({"begin_": begin, "end_": end})
    spans = met.withColumn("block_", F.explode(F.sequence(_block_of(F.col("begin_")), _block_of(F.col("end_") - 1))))
    spans = spans.withColumns({"from_": F.greatest("begin_", _bound(F.col("block_"))), "to_": F.least("end_", _bound(F.col("block_") + 1))})
    pieces = spans.where("from_ < to_").select(
        (F.col("base_") + F.col("block_")).alias("block_"),
        "slot",
        "from_",
        "row_",
        (F.col("from_") + F.col("first_") - F.col("at_")).alias("start"),
        (F.col("to_") - F.col("from_")).alias("length"),
        (F.col("block_") * (F.col("held_") % F.col("blocks_")) % F.col("blocks_") / F.col("blocks_")).alias("carried"),
    )
    return pieces.groupBy("block_").applyInArrow(_deal(size, least), "row_ long, start long, length long, sequence_id long, offset long")


def pack(
    docs: DataFrame,
    path: str,
    end: int = 1,
    size: int = SIZE,
    weights: dict | None = None,
    least: int = LEAST,
    block: int = BLOCK,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of all documents.

    ``ids`` are the piece's ids, packed as little-endian unsigned 32-bit numbers; ``keep`` maps names to further
    columns computed from ``docs``.
    """
    keep = keep or {}
    if size < 1 or size & (size - 1) or least < 1 or block < size:
        raise ValueError("size must be a power of two, least positive and block at least size")
    if set(keep) & {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "row_", "n", "order_", "source"}:
        raise ValueError("a kept column has the name of a result")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), *(c.alias(k) for k, c in keep.items()), F.col(text).alias("text_"))
    ids = tokenize(rows, path, end, "text_", ["doc_id", "source", *keep])
    counted = ids.withColumns({"n": (F.octet_length("ids") / 4).cast("long"), "order_": F.xxhash64("doc_id", "ids")})
    stored = durable(counted.withColumn("row_", F.monotonically_increasing_id()), codec="zstd")
    pieces = plan(stored.select("row_", "source", "n", "order_"), size, weights, least, block)
    cut = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    whole = stored.select("row_", "doc_id", *keep, "ids", F.col("n").alias("doc_tokens"))
    return pieces.join(whole, "row_").select("doc_id", "start", "length", cut.alias("ids"), "doc_tokens", "sequence_id", "offset", *keep)
