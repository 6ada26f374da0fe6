"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if every token
encodes to itself and every two neighbours encode to themselves. So there is
one valid last token for each prefix, and encoding is a walk over a
nondeterministic automaton whose hypotheses are (tokens since the last output,
place in the trie of tokens). The subset construction is done lazily: a set of
hypotheses becomes a numbered state the first time it is met, and a transition
outputs the tokens on which all hypotheses agree. A hypothesis lives at most
as long as the longest token, which bounds the lookahead.

Texts are taken by the slice: arrays of code points and their classes give all
matches of the splitting pattern at once, the distinct ones are walked (or
remembered), and their ids are laid out by offsets. Decoding lays out the bytes
of a bounded run of ids the same way and feeds the UTF-8 machine once per run; an unfinished
character waits for the next run.

Defined cases: null text is empty text and gives no ids; a piece that is a
token as a whole is that token; special tokens are ordinary text; rows are
handled one by one, so repeated rows repeat. Only the named columns and those
in ``keep`` are carried.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship
from driftgrid.llm.memo import Memo, spans
from driftgrid.llm.worker import held

#: Bounds of the caches in a Python worker; a full cache is emptied.
MAX_PIECES, MAX_STATES, MAX_PAIRS, MAX_PIECE_CHARS = 600_000, 400_000, 450_000, 64
MAX_RECENT = 20_000
NEVER = 1 << 60
#: A result batch is handed over once it holds so many ids (or decoded characters).
BATCH_IDS = 1 << 20

#: Characters that are split at a time, and ids that are decoded at a time.
SLICE, RUN = 1 << 22, 1 << 18

# Fixed value: the splitting pattern that ``_split`` stands for; others are matched text by text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)

# White space by the Unicode property, as the splitting pattern means it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD_SPACE = re.compile(f" (?![^{_WS}])")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token in a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces of text; its states appear as they are needed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: float = 1.0):
        self.max_pieces, self.max_states, self.max_pairs = (int(n * cache) for n in (MAX_PIECES, MAX_STATES, MAX_PAIRS))
        self.ranks, self.split, self.by_arrays = ranks, regex.compile(pattern).findall, pattern == PATTERN
        self.kinds: np.ndarray | None = None
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[at]
            self.ends[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.pieces, self.spaced, self.words = _Pieces(self, ""), _Pieces(self, " "), _Words(self)
        self.memo = Memo(self._packed, self.max_pieces, 4 * MAX_PIECE_CHARS)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        #: (state, byte) -> the next state, or that and the tokens put out
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        #: the tokens that a piece still has where it ends in a state
        self.rests: dict[int, tuple[int, ...]] = {}
        #: states met lately, unpacked: a walk goes on from the state it has just made
        self.recent: dict[int, tuple[int, list[tuple[tuple[int, ...], int]]]] = {}
        self._number(-1, [((), 0)])

    def _number(self, context: int, hypotheses: list[tuple[tuple[int, ...], int]]) -> int:
        """The number of a state; its hypotheses are packed, as there are many states."""
        flat = array("i", [context])
        for pending, node in hypotheses:
            flat.append(node)
            flat.append(len(pending))
            flat.extend(pending)
        state = flat.tobytes()
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        if len(self.recent) >= MAX_RECENT:
            self.recent.clear()
        self.recent[number] = context, hypotheses
        return number

    def _hypotheses(self, state: int) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
        if (known := self.recent.get(state)) is not None:
            return known
        flat = array("i", self.states[state])
        found, at = [], 1
        while at < len(flat):
            end = at + 2 + flat[at + 1]
            found.append((tuple(flat[at + 2 : end]), flat[at]))
            at = end
        return flat[0], found

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The definition: join the neighbours of least rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _edge(self, token: int) -> tuple[list, list] | None:
        """What stands first and last while the token's bytes merge, each with the
        rank of the merge that takes it up; None if the token isn't its own encoding."""
        if token not in self.edges:
            data, ranks = self.bytes_of[token], self.ranks
            parts, first, last = [data[i : i + 1] for i in range(len(data))], [], []
            while len(parts) > 1:
                best, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == NEVER:
                    break
                if at == 0:
                    first.append((parts[0], best))
                if at == len(parts) - 2:
                    last.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            whole = [(data, NEVER)]
            self.edges[token] = (first + whole, last + whole) if len(parts) == 1 else None
        return self.edges[token]

    def _fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: the start of the piece): no merge
        across their border comes before the merges inside them."""
        if (key := (last, token)) in self.pairs:
            return self.pairs[key]
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        right, left = self._edge(token), self._edge(last) if last >= 0 else None
        fits = right is not None
        if fits and left is not None:
            a, b, i, j = left[1], right[0], 0, 0
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                across = self.ranks.get(x + y, NEVER)
                if across < x_ends and across <= y_ends and across != NEVER:
                    fits = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
        self.pairs[key] = fits
        return fits

    def _move(self, state: int, b: int) -> int | tuple[int, tuple[int, ...]]:
        context, hypotheses = self._hypotheses(state)
        alive, full, child, inner, ends, pairs = [], None, self.child, self.inner, self.ends, self.pairs
        for pending, node in hypotheses:
            node = child.get(node << 8 | b)
            if node is None:
                continue
            if inner[node]:
                alive.append((pending, node))
            token = ends[node]
            if token >= 0:
                last = pending[-1] if pending else context
                fits = pairs.get((last, token))
                if fits is None:
                    fits = self._fits(last, token)
                if fits:
                    if full is not None:
                        raise ValueError("the ranks allow two encodings of a prefix")
                    full = (*pending, token)
        if full is None:
            raise ValueError("the ranks leave a prefix without an encoding")
        alive.append((full, 0))
        common = len(full)
        for pending, _ in alive:
            if pending[:common] != full[:common]:
                common = next(k for k in range(common) if k >= len(pending) or pending[k] != full[k])
        out = full[:common]
        rest = sorted([(p[common:], n) for p, n in alive] if common else alive)
        # only a hypothesis without pending tokens looks at what went before
        after = self._number(-2 if rest[0][0] else out[-1] if out else context, rest)
        move = self.moves[state << 8 | b] = (after, out) if out else after
        return move

    def _packed(self, points: bytes) -> bytes:
        return np.array(self.encode_piece(points.decode("utf-32-le")), np.int32).tobytes()

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if len(self.states) > self.max_states:
            self._forget()
        moves, state, out = self.moves, 0, []
        try:
            for b in data:
                move = moves.get(state << 8 | b)
                if move is None:
                    move = self._move(state, b)
                if move.__class__ is int:
                    state = move
                else:
                    state, tokens = move
                    out += tokens
        except ValueError:  # ranks without the property that the automaton rests on
            return self.merge(data)
        rest = self.rests.get(state)
        if rest is None:
            rest = self.rests[state] = next(p for p, node in self._hypotheses(state)[1] if node == 0)
        return (*out, *rest)

    def _split(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where the matches of ``PATTERN`` start in the joined code points of texts that start at ``heads``."""
        if self.kinds is None:
            self.kinds = _kinds()
        n, kind, blank = len(points), self.kinds[points], points == 32
        head = np.zeros(n + 1, bool)
        head[heads[heads < n]] = head[n] = True
        prior = np.empty(n, np.uint8)
        prior[1:] = kind[:-1]
        prior[head[:n]] = _NONE
        space = kind == _SPACE
        ends = head[1:]  # whether a text ends with this character
        follows = np.empty(n, bool)  # whether another than white space comes next in the same text
        follows[:-1] = ~space[1:]
        follows[ends] = False
        led = np.zeros(n, bool)  # taken up by the blank before
        led[1:] = blank[:-1]
        led &= ~head[:n]
        starts = np.where(space, (prior != _SPACE) | follows, (kind != prior) & ~led)
        marks = np.flatnonzero(starts & (points == ord("'")))
        if len(marks):
            ahead = np.concatenate([points, np.zeros(2, points.dtype)])
            near = ~head[np.minimum(marks + 1, n)]
            far = near & ~head[np.minimum(marks + 2, n)]
            taken = np.zeros(len(marks), np.int64)
            for tail in _TAILS:
                fits = near & (ahead[marks + 1] == ord(tail[0]))
                if len(tail) == 2:
                    fits &= far & (ahead[marks + 2] == ord(tail[1]))
                taken[fits] = len(tail)
            marks, taken = marks[taken > 0], taken[taken > 0]
            starts[marks + 1] = False
            after = marks + taken + 1
            starts[after[after < n]] = True
        return np.flatnonzero(starts)

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = self._split(points, ends - sizes)
        offsets = np.append(starts, len(points)).astype(np.int32) * 4
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(points)]).dictionary_encode()
        flat, size = self.memo.look(coded.dictionary)
        index = coded.indices.to_numpy()
        place, total = spans((np.cumsum(size) - size)[index], size[index])
        ids = flat[place]
        return ids, total[np.searchsorted(starts, ends, "left")]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end. A long text goes slice by slice."""
        if not self.by_arrays:
            each = [np.fromiter(self.encode(t), np.int32) for t in texts]
            return np.concatenate([*each, np.zeros(0, np.int32)]), np.cumsum([len(e) for e in each], dtype=np.int64)
        out, ends, wait, held_ = [], [], [], 0
        done = 0
        for text in [*texts, None]:
            if wait and (text is None or held_ + len(text) > SLICE):
                ids, upto = self._slice(wait)
                out.append(ids)
                ends.append(upto + done)
                done, wait, held_ = done + len(ids), [], 0
            if text is None:
                break
            if len(text) <= SLICE:
                wait.append(text)
                held_ += len(text)
                continue
            for part in _parts(text):
                out.append(self._slice([part])[0])
                done += len(out[-1])
            ends.append(np.array([done]))
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate([*ends, np.zeros(0, np.int64)])

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text. No piece crosses from one run of ``_RUNS`` into the next."""
        if _ODD_SPACE.search(text):
            return chain.from_iterable(map(self.pieces.__getitem__, _RUNS.findall(text)))
        head, *rest = text.split(" ")
        return chain(self.pieces[head], chain.from_iterable(map(self.spaced.__getitem__, rest)))


class _Pieces(dict):
    """Remembered walks: the ids of a run of text behind ``lead``."""

    def __init__(self, transducer: Transducer, lead: str):
        super().__init__()
        self.transducer, self.lead = transducer, lead

    def __missing__(self, run: str) -> tuple[int, ...]:
        words = self.transducer.words
        ids = tuple(chain.from_iterable(map(words.__getitem__, self.transducer.split(self.lead + run))))
        if len(run) <= MAX_PIECE_CHARS:
            if len(self) >= self.transducer.max_pieces:
                self.clear()
            self[run] = ids
        return ids


class _Words(dict):
    """Remembered walks over one match of the pattern."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.transducer.encode_piece(word)
        if len(word) <= MAX_PIECE_CHARS:
            if len(self) >= self.transducer.max_pieces:
                self.clear()
            self[word] = ids
        return ids


_NONE = 9


def _kinds() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, last)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
            for found in regex.finditer(pattern, every):
                out[first + found.start() : first + found.end()] = kind
    return out


_BREAK = re.compile(f"(?<=[^{_WS}])[{_WS}]")


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about ``SLICE`` characters that start with the first of a run of white space."""
    begun = 0
    while begun < len(text):
        found = _BREAK.search(text, begun + SLICE)
        upto = found.start() if found else len(text)
        yield text[begun:upto]
        begun = upto


class _Utf8(dict):
    """A state of the UTF-8 machine: the bytes of a character begun. Token -> (text, next state)."""

    def __init__(self, machine: dict, pending: bytes, bytes_of: dict[int, bytes]):
        super().__init__()
        self.machine, self.pending, self.bytes_of = machine, pending, bytes_of

    def __missing__(self, token: int) -> tuple[str, _Utf8]:
        data = self.pending + self.bytes_of[token]
        text, used = codecs.utf_8_decode(data, "replace", False)
        rest = data[used:]
        if rest not in self.machine:
            self.machine[rest] = _Utf8(self.machine, rest, self.bytes_of)
        self[token] = text, self.machine[rest]
        return self[token]


class Decoder:
    """Turns ids into text run by run; a character may span runs."""

    def __init__(self, bytes_of: dict[int, bytes]):
        machine: dict[bytes, _Utf8] = {}
        self.start = machine[b""] = _Utf8(machine, b"", bytes_of)
        size = max(bytes_of, default=-1) + 1
        self.flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.fromiter((len(bytes_of.get(i, b"")) for i in range(size)), np.int64, size)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def stream(self, ids) -> Iterator[str]:
        """Text as it becomes known, token by token."""
        state = self.start
        for token in ids:
            text, state = state[token]
            yield text
        if state.pending:
            yield codecs.utf_8_decode(state.pending, "replace", True)[0]

    def laid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id begin (and the last ones end)."""
        place, total = spans(self.begins[ids], self.lengths[ids])
        return self.flat[place], total

    def decode(self, ids) -> str:
        ids, out, pending = np.asarray(ids, np.int64), [], b""
        for begun in range(0, len(ids), RUN):
            data = pending + self.laid(ids[begun : begun + RUN])[0].tobytes()
            text, used = codecs.utf_8_decode(data, "replace", False)
            out.append(text)
            pending = data[used:]
        if pending:
            out.append(codecs.utf_8_decode(pending, "replace", True)[0])
        return "".join(out)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids laid one after the other, text k ending at ``ends[k + 1]``."""
        out, row = [], 0
        while row < len(ends) - 1:
            upto = max(int(np.searchsorted(ends, ends[row] + RUN, "right")) - 1, row)
            if upto == row:  # longer than a run
                out.append(self.decode(ids[ends[row] : ends[row + 1]]))
                row += 1
                continue
            data, total = self.laid(ids[ends[row] : ends[upto]])
            raw, cuts = data.tobytes(), total[ends[row : upto + 1] - ends[row]].tolist()
            out += [codecs.utf_8_decode(raw[a:b], "replace", True)[0] for a, b in zip(cuts, cuts[1:])]
            row = upto
        return out


class _Tools:
    """The transducer and the decoder of a worker, which keep their states from task to task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.made = ranks, {}

    def transducer(self, pattern: str, cache: float) -> Transducer:
        if (pattern, cache) not in self.made:
            self.made[pattern, cache] = Transducer(self.ranks, pattern, cache)
        return self.made[pattern, cache]

    def decoder(self) -> Decoder:
        if None not in self.made:
            self.made[None] = Decoder({rank: token for token, rank in self.ranks.items()})
        return self.made[None]


def _tools(path: str, ranks) -> _Tools:
    return held(("bpe", path), lambda: _Tools(ranks.value))


def _schema(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    if name in keep:
        raise ValueError(f"{name!r} is both carried and computed")
    return T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",), out: str = "ids", cache: float = 1.0) -> DataFrame:
    """``keep`` and the ids of the whole text as an array of ints, by the ranks in the file ``path``.

    The ranks (one file of a vocabulary, about 1 MB) are broadcast. One pass, no shuffle. ``cache`` scales the
    bounds on what a worker remembers: less memory against more time, with the same ids.
    """
    spark, keep = df.sparkSession, list(keep)
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    rows = _last(df, keep, F.coalesce(F.col(text), F.lit("")))
    run = lambda batches: _encoded(batches, _tools(path, ranks).transducer(pattern, cache), [*keep, out])
    return rows.mapInArrow(run, _schema(df, keep, out, T.ArrayType(T.IntegerType())))


def _encoded(batches, transducer: Transducer, names: list[str]):
    """Batches of (kept columns, text) -> batches of (kept columns, ids), each of bounded size."""
    for batch in batches:
        texts, begun = batch.column(batch.num_columns - 1), 0
        while begun < batch.num_rows:
            some, size = [], 0
            while begun + len(some) < batch.num_rows and (size < SLICE or not some):
                some.append(texts[begun + len(some)].as_py())
                size += len(some[-1])
            ids, ends = transducer.encode_all(some)
            column = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
            rows = batch.slice(begun, len(some))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], column], names)
            begun += len(some)


def _decoded(batches, decoder: Decoder, names: list[str]):
    """Batches of (kept columns, ids) -> batches of (kept columns, text), each of bounded size."""
    for batch in batches:
        column, begun = batch.column(batch.num_columns - 1), 0
        ends, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
        while begun < batch.num_rows:
            upto = max(int(np.searchsorted(ends, ends[begun] + BATCH_IDS, "right")) - 1, begun + 1)
            rows = batch.slice(begun, upto - begun)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(decoder.decode_all(flat, ends[begun : upto + 1]), pa.string())], names)
            begun = upto


def _last(df: DataFrame, keep: list[str], column) -> DataFrame:
    return df.select(*keep, column.alias("_".join(["input", *keep])))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """``keep`` and the text of the ids, null ids being none; ill-formed bytes become U+FFFD."""
    spark, keep = df.sparkSession, list(keep)
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    rows = _last(df, keep, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    run = lambda batches: _decoded(batches, _tools(path, ranks).decoder(), [*keep, out])
    return rows.mapInArrow(run, _schema(df, keep, out, T.StringType()))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] = ("doc_id",), cache: float = 1.0) -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: ``encode`` and then ``decode`` of its ids, in one Python process."""
    spark, keep = df.sparkSession, list(keep)
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        transducer, decoder = _tools(path, ranks).transducer(pattern, cache), _tools(path, ranks).decoder()
        for batch in _encoded(batches, transducer, [*keep, "ids"]):
            again = batch.select(["ids"])
            (texts,) = pa.Table.from_batches(_decoded([again], decoder, ["decoded"])).combine_chunks().to_batches() if len(again) else ()
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.column(0)], [*keep, "ids", "decoded"])

    schema = _schema(df, keep, "ids", T.ArrayType(T.IntegerType()))
    rows = _last(df, keep, F.coalesce(F.col(text), F.lit("")))
    return rows.mapInArrow(run, T.StructType([*schema, T.StructField("decoded", T.StringType())]))
