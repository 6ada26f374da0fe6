"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ``ORDER``, learned from
a bounded sample and then frozen. A word is coded byte by byte, with a final
space, in the context of the bytes before it in the word: the longest context
the language knows predicts the byte or escapes to the next shorter one, with
method C probabilities, and below order 0 every byte costs 8 bits. The
language with the shortest code wins. The code length of a text is the sum
over its words, so the words of a batch are coded once each, as arrays, and
remembered.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is any text if nothing could be learned; a null ``doc_id`` is neither held
out nor learned from; equal code lengths go to the smaller language name. The
whole text counts whatever its length. Other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm.worker import held
from driftgrid.scale import durable

ORDER = 4
#: The sample: at most so many documents of every language, with their whole texts.
PER_LANG = 250
#: Languages up to which the bounds of a worker hold; with more they shrink, so that its memory does not grow.
LANGS = 64
#: Words (and their characters) remembered by a Python worker; bytes scored at a time; characters of texts taken together.
MAX_WORDS, MAX_CHARS, PART_BYTES, PART_CHARS = 150_000, 4 << 20, 1 << 18, 1 << 21
#: Longer words are scored in pieces and not remembered.
LONG_WORD = 256


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as ``space word space``: the bytes coded, each one's place in its word (from 1), the words' ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begins, lengths)
    return data, place, begins


def _keys(data: np.ndarray, place: np.ndarray):
    """For n = 1 .. ORDER + 1: the keys of the n bytes that end at each position, and where they lie within a word."""
    key = np.zeros(len(data), np.uint64)
    for n in range(1, ORDER + 2):
        moved = np.zeros(len(data), np.uint64)
        moved[n - 1 :] = data[: max(0, len(data) - n + 1)]
        key = key | moved << np.uint64(8 * (n - 1))
        yield n, key, place >= n - 1


class Model:
    """Code lengths in bits: ``symbol[n]`` for n bytes whose last is coded in the context of the others, ``escape[n]`` for n bytes as a context."""

    def __init__(self, words: dict[str, dict[bytes, int]]):
        self.langs = sorted(words)
        grams: list[Counter] = []
        for lang in self.langs:
            kinds = list(words[lang])
            weight = np.fromiter((words[lang][w] for w in kinds), np.int64, len(kinds))
            found: Counter = Counter()
            if kinds:
                data, place, _ = _positions(kinds)
                of = np.repeat(np.arange(len(kinds)), [len(w) + 2 for w in kinds])
                for n, key, inside in _keys(data, place):
                    at = inside & (place >= 1)  # the leading space is a context, never coded
                    kind, where = np.unique(key[at], return_inverse=True)
                    count = np.bincount(where, weight[of[at]], len(kind)).astype(np.int64)
                    found.update({(n, k): c for k, c in zip(kind.tolist(), count.tolist())})
            grams.append(found)
        self.symbols: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, ORDER + 2):
            kind = np.array(sorted({k for g in grams for m, k in g if m == n}), np.uint64)
            bits, context = np.full((len(kind), len(self.langs)), np.inf, np.float32), np.unique(kind >> np.uint64(8))
            away = np.zeros((len(context), len(self.langs)), np.float32)
            of = np.searchsorted(context, kind >> np.uint64(8))
            for j, g in enumerate(grams):
                count = np.fromiter((g.get((n, k), 0) for k in kind.tolist()), np.int64, len(kind))
                total, kinds = np.bincount(of, count, len(context)), np.bincount(of, count > 0, len(context))
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits[:, j] = np.where(count > 0, np.log2((total + kinds)[of] / count), np.inf)
                    away[:, j] = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0)
            self.symbols.append((kind, bits))
            self.escapes.append((context, away))

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word in each language."""
        data, place, begins = _positions(words)
        return np.add.reduceat(self._costs(data, place), begins, axis=0, dtype=np.float64)

    def long_code_length(self, word: bytes, step: int) -> np.ndarray:
        """Bits of one word of any length in each language, ``step`` bytes at a time; a piece starts with the ``ORDER`` bytes before it."""
        data, total = np.frombuffer(b" " + word + b" ", np.uint8), np.zeros(len(self.langs))
        for at in range(0, len(data), step):
            begun = max(0, at - ORDER)
            piece = data[begun : at + step].astype(np.uint64)
            total += self._costs(piece, np.arange(begun, begun + len(piece)))[at - begun :].sum(axis=0, dtype=np.float64)
        return total

    def _costs(self, data: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits of every byte in each language, given its place in its word."""
        keys = [(key, inside & (place >= 1)) for _, key, inside in _keys(data, place)]
        cost = np.zeros((len(data), len(self.langs)), np.float32)
        open_ = np.broadcast_to((place >= 1)[:, None], cost.shape).copy()
        for n in range(ORDER, -1, -1):
            key, inside = keys[n]
            at = np.flatnonzero(inside & open_.any(axis=1))
            (kind, bits), (context, away) = self.symbols[n], self.escapes[n]
            if not len(kind) or not len(at):
                continue
            i = np.minimum(np.searchsorted(kind, key[at]), len(kind) - 1)
            seen = kind[i] == key[at]
            j = np.minimum(np.searchsorted(context, key[at] >> np.uint64(8)), len(context) - 1)
            known = context[j] == key[at] >> np.uint64(8)
            price = np.where(seen[:, None], bits[i], np.inf)
            hit = np.isfinite(price)
            add = np.where(hit, price, np.where(known[:, None], away[j], 0))
            cost[at] += np.where(open_[at], add, 0)
            open_[at] &= ~hit
        cost += open_ * np.float32(8)
        return cost


def fitting(bound: int, model: Model) -> int:
    """``bound``, less in proportion if there are more than ``LANGS`` languages."""
    return max(1, bound * LANGS // max(LANGS, len(model.langs)))


class _Words(dict):
    """Word -> row of ``bits``; rows of new words are filled by ``settle``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.chars, self.bits = model, [], 0, np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def settle(self) -> None:
        at, most = len(self) - len(self.new), fitting(PART_BYTES, self.model)
        if len(self) > len(self.bits):
            self.bits = np.concatenate([self.bits[:at], np.zeros((len(self) * 2 - at, self.bits.shape[1]))])
        part, size = [], 0
        for k, word in enumerate(self.new, 1):
            part.append(word.encode())
            size += len(part[-1]) + 2
            if size >= most or k == len(self.new):
                self.bits[at : at + len(part)] = self.model.code_lengths(part)
                at, part, size = at + len(part), [], 0
        self.chars += sum(map(len, self.new))
        self.new.clear()

    def full(self) -> bool:
        return len(self) > fitting(MAX_WORDS, self.model) or self.chars > fitting(MAX_CHARS, self.model)

    def forget(self) -> None:
        self.clear()
        self.chars = 0


def score(texts: list[str], words: _Words) -> np.ndarray:
    """Code lengths in bits, texts by languages."""
    ids, ends = [], [0]
    total = np.zeros((len(texts), len(words.model.langs)))
    for i, text in enumerate(texts):
        own = text.lower().split()
        if own and max(map(len, own)) > LONG_WORD:
            for word in own:
                if len(word) > LONG_WORD:
                    total[i] += words.model.long_code_length(word.encode(), fitting(PART_BYTES, words.model))
            own = [w for w in own if len(w) <= LONG_WORD]
        ids.append(np.fromiter(map(words.__getitem__, own), np.int64))
        ends.append(ends[-1] + len(ids[-1]))
    words.settle()
    for i, own in enumerate(ids):
        if len(own):
            total[i] += words.bits[own].sum(axis=0)
    if words.full():
        words.forget()
    return total


def _first_rows(rows: DataFrame) -> DataFrame:
    """The first ``PER_LANG`` rows of every language by hash; tasks and then salts keep their own first ones, so only those meet."""
    order = ["hash_", "id_", "text"]
    part = Window.partitionBy("lang", "salt_").orderBy(*order)
    some = rows.withColumn("salt_", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("at_", F.row_number().over(part)).where(F.col("at_") <= PER_LANG).drop("salt_", "at_")
    whole = Window.partitionBy("lang").orderBy(*order)
    return some.withColumn("at_", F.row_number().over(whole)).where(F.col("at_") <= PER_LANG).select("lang", "text")


def sample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang`` and the whole ``text`` of ``PER_LANG`` rows of every language (all, if there are fewer), chosen by a hash of the row."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text).rlike(r"\S"))
    rows = labelled.select(F.col(lang).alias("lang"), F.col(id_col).alias("id_"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), id_col, text).alias("hash_"))
    often = durable(rows.groupBy("lang").agg(F.count("*").alias("n_")))
    # about twice the bound passes the first draw, the windows keep the bound itself
    drawn = rows.join(often, "lang").where(F.pmod("hash_", F.lit(1 << 40)) / (1 << 40) < 2 * PER_LANG / F.col("n_"))
    taken = durable(_first_rows(drawn.drop("n_")))
    # repeated rows share their hash and are drawn or left together: a language that falls short gives its first rows
    got = taken.groupBy("lang").agg(F.count("*").alias("got_"))
    short = durable(often.join(got, "lang", "left").where(F.coalesce("got_", F.lit(0)) < F.least("n_", F.lit(PER_LANG))).select("lang"))
    return taken.join(short, "lang", "left_anti").unionByName(_first_rows(rows.join(short, "lang", "left_semi")))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of every language from a ``sample`` of the rows that are not held out."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.update((name, w.encode()) for w in own.as_py().lower().split())
            names, kinds = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words: dict[str, dict[bytes, int]] = {}
    counted = sample(docs, id_col, text, lang).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for name, word, n in counted.collect():
        words.setdefault(name, {})[bytes(word)] = n
    return Model(words)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None, carry: str | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep``, the text as ``carry`` if asked for, ``lang_pred`` and ``score``, the posterior of that language."""
    spark, keep = docs.sparkSession, keep or {}
    if {*keep, carry} & {"doc_id", "lang_pred", "score"} or carry in keep:
        raise ValueError("a kept column has the name of a result")
    ship(spark)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.langs else F.lit(False)
    # the text goes to Python once, whether it comes back or not
    rows = docs.select(has.alias("has_"), F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in keep.items()), F.col(text).alias(carry or "text_"))
    schema = (rows if carry else rows.drop("text_")).drop("has_").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        words = held(token, lambda: _Words(shared.value))
        names = words.model.langs
        for batch in batches:
            flags, column, begun, part, chars = batch.column(0).to_pylist(), batch.column(batch.num_columns - 1), 0, [], 0
            for i in range(batch.num_rows):
                part.append(column[i].as_py() if flags[i] else "")
                chars += len(part[-1])
                if chars >= PART_CHARS or i == batch.num_rows - 1:
                    own = flags[begun : i + 1]
                    best, sure = ["und"] * len(own), np.zeros(len(own))
                    if names:
                        bits = score(part, words)
                        first = bits.argmin(axis=1)
                        post = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                        best = [names[k] if f else "und" for k, f in zip(first.tolist(), own)]
                        sure = np.where(own, post, 0.0)
                    rows_ = batch.slice(begun, i + 1 - begun)
                    columns = rows_.columns[1:] if carry else rows_.columns[1:-1]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(sure)], schema.names)
                    begun, part, chars = i + 1, [], 0

    return rows.mapInArrow(run, schema)
