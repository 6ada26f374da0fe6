"""Packing, Merkle manifests and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgrid.llm import merkle, packing, places, queries, repair

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def wanted(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


# --- places ---


def test_places_of_hot_groups_and_ties(spark):
    rows = [("a", i % 7, i, i % 3) for i in range(400)] + [("b", 5, i, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k int, i int, w int")
    got = sorted(places.before(df.repartition(9), ["g"], ["k", "i"], "at").collect())
    for group in "ab":
        mine = sorted((r for r in got if r.g == group), key=lambda r: (r.k, r.i))
        assert [r["at"] for r in mine] == list(range(len(mine)))
    got = sorted(places.before(df, ["g"], ["k", "i"], "at", "w").collect(), key=lambda r: (r.g, r.k, r.i))
    for group in "ab":
        mine = [r for r in got if r.g == group]
        assert [r["at"] for r in mine] == [sum(x.w for x in mine[:k]) for k in range(len(mine))]


# --- op11 ---


def test_words_equal_the_library(tokenizer, monkeypatch):
    rng = random.Random(5)
    alphabet = [chr(i) for i in range(256)] + list("'''''sstredvml  \n\n09²ÀéABC") * 6
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "日本 x", "<|endoftext|> x", "A<|startoftext|>", "İΣ 's", "a" + "́" + " b", "x" * 500, "no_spaces" * 400]
    words = packing.Words(WORD_BPE, 1)
    assert list(words.encode(texts)) == [wanted(tokenizer, t).tobytes() for t in texts]
    monkeypatch.setattr(packing, "SLICE", 40)
    monkeypatch.setattr(packing, "MAX_WORDS", 50)
    assert list(words.encode(texts[-600:])) == [wanted(tokenizer, t).tobytes() for t in texts[-600:]]


def test_phases():
    assert packing.phases({"a": 10, None: 30}, None) == [(0, "a", 0, 10), (0, None, 0, 30)]
    got = packing.phases({"a": 10, "b": 30}, {"a": 1, "b": 1})
    assert got == [(0, "a", 0, 10), (0, "b", 0, 10), (1, "b", 10, 30)]
    assert packing.phases({"a": 0}, None) == []
    with pytest.raises(ValueError):
        packing.phases({"a": 1}, {"a": 0})


def test_fill_keeps_proportions():
    owned = np.array([50_000, 9_000, 700, 3])
    lengths, takes = packing.fill(owned, np.array([0.5, 0.2, 0.0, 0.9]), 2048, 64)
    assert (takes.sum(axis=0) == owned).all() and (takes.sum(axis=1) == lengths).all() and (takes >= 0).all()
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and lengths[: 59_703 // 2048] == [2048] * (59_703 // 2048)
    share = owned / owned.sum()
    off = np.abs(np.cumsum(takes, axis=0) - np.cumsum(lengths)[:, None] * share)
    assert off.max() <= 64 * len(owned)


def packed(rows, tokenizer, texts, size):
    """The pieces hold every id once, in sequences without gaps; returns the pieces of each sequence."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids, at = wanted(tokenizer, texts[doc]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}])
def test_pack(spark, tokenizer, weights):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeö") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 40, 900]))), rng.choice(["a", "a", "a", "b", None]), None, 1) for i in range(150)]
    rows += [(900, None, "a", None, None), (901, "", None, None, 0), (902, "x " * 9000, "only", None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1))
    got = packing.pack(df, WORD_BPE, size=256, weights=weights, least=16, block=4096, keep={"src": F.col("source")}).collect()
    sequences = packed(got, tokenizer, {r[0]: r[1] for r in rows}, 256)
    total = sum(r.length for r in got)
    assert sum(sum(p.length for p in s) == 256 for s in sequences.values()) >= total // 256 - total // 4096 - 1
    again = packing.pack(df.repartition(3), WORD_BPE, size=256, weights=weights, least=16, block=4096).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.sequence_id, r.offset)
    assert sorted(map(key, got)) == sorted(map(key, again))
    if weights is None:
        share = defaultdict(Fraction)
        for r in got:
            share[r.src] += Fraction(r.length, total)
        for pieces in sequences.values():
            if sum(p.length for p in pieces) == 256:
                for source in share:
                    assert abs(sum(p.length for p in pieces if p.src == source) - 256 * share[source]) <= 16 * len(share) + 16


def test_pack_repeated_rows_and_empty_tables(spark, tokenizer):
    df = spark.createDataFrame([(None, "one two", None, None, 1)] * 40 + [(7, "one two", None, None, 1)] * 2, DOCS)
    got = packing.pack(df, WORD_BPE, size=8, least=2, block=32).collect()
    assert sum(r.length for r in got) == 42 * 3
    assert packing.pack(df.limit(0), WORD_BPE).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, WORD_BPE, keep={"ids": F.col("lang")})
    with pytest.raises(ValueError):
        packing.pack(df, WORD_BPE, size=100)


# --- op12 ---


def tree(nodes):
    """All levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + 16]).encode()).hexdigest() for i in range(0, len(last), 16)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def framed(*values):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(said).encode()).hexdigest()


@pytest.mark.parametrize("part", [merkle.PART, 7, 40])
def test_merkle(spark, part):
    rng = random.Random(3)
    rows = [(i, f"Tex t{i}é", "big", "en", i) for i in range(300)] + [(i, None, f"s{i % 21}", None, 1) for i in range(40)]
    rows += [(None, "x", None, None, None), (3, "", None, "de", 0), (3, "", None, "de", 0), (5, "lone", "z", None, None)]
    rng.shuffle(rows)
    groups = defaultdict(list)
    for i, text, source, lang, n in rows:
        groups[source].append((i is not None, i or 0, framed(i, source, lang, n, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for at, (known, i, leaf) in enumerate(sorted(groups[s])):
            want.append((i if known else -1, leaf, trees[s][-1][0], top[-1][0], path(trees[s], at) + path(top, k)))
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1))
    leaf = merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    built = merkle.manifest(df, leaf, "source", ["doc_id"], {"doc_id": F.col("doc_id")})
    folded = merkle.prove(built, part=part).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in folded)
    got = [(-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in folded]
    assert sorted(got) == sorted(want)
    few = merkle.prove(built, built.leaves.where("doc_id % 50 = 1"), part).collect()
    proofs = defaultdict(list)
    for i, leaf, *_, proof in want:
        proofs[leaf].append(proof)
    assert few and all([(s.left, s.right) for s in r.proof] in proofs[r.leaf] for r in few)


def test_merkle_of_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "x", "a", None, 1)], DOCS)
    leaf = merkle.digest(F.col("doc_id"), F.col("text"))
    (row,) = merkle.prove(merkle.manifest(df, leaf, "source", ["doc_id"])).collect()
    assert row.leaf == row.subroot == row.root == framed(1, "x") and row.proof == []
    assert merkle.prove(merkle.manifest(df.limit(0), leaf, "source", ["doc_id"])).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(df, leaf, "source", ["doc_id"], {"root": F.lit(1)})


def test_missing_nodes_are_minimal():
    at = np.array([0, 1, 5, 40, 700])
    found, levels = merkle.missing(at, 1000)
    known = {(0, a) for a in at.tolist()}
    want, width = set(), 1000
    for level in range(levels):
        runs = {a // 16 for n, a in known if n == level}
        want |= {(level, a) for r in runs for a in range(16 * r, min(16 * r + 16, width))} - known
        known |= {(level + 1, r) for r in runs}
        width = -(-width // 16)
    assert {(n, a) for n, places_ in found for a in places_.tolist()} == want and width == 1


# --- op13 ---

FORCED, KEPT = {0: "u", 1: "u", 2: "a", 3: "u"}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
AFTER = {"u": 2, "a": 3}


def cheapest(rows):
    """(cost, audit, lines) by comparing all edits; ``rows`` are (role, text, gone, cut)."""
    best = [None] * 4
    for t in range(len(rows), -1, -1):
        now = [(0, "", []) if t == len(rows) and q in (0, 3) else (99999, "", []) for q in range(4)]
        if t < len(rows):
            role, text, gone, cut = rows[t]
            for q in range(4):
                options = [(3 + best[q][0], "D" + best[q][1], best[q][2])]
                if not gone:
                    if (to := KEPT.get((q, role[:1]))) is not None:
                        options.append((cut + best[to][0], "K" + best[to][1], [f"{role}:{text}", *best[to][2]]))
                    to = AFTER[FORCED[q]]
                    name = {"u": "user", "a": "assistant"}[FORCED[q]]
                    options.append((2 + cut + best[to][0], "R" + best[to][1], [f"{name}:{text}", *best[to][2]]))
                now[q] = min(options)
        for _ in range(4):
            for q in range(4):
                to, name = AFTER[FORCED[q]], {"u": "user:", "a": "assistant:"}[FORCED[q]]
                now[q] = min(now[q], (2 + now[to][0], "I" + now[to][1], [name, *now[to][2]]))
        best = now
    return best[0]


def report(talk):
    talk = sorted([(t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in talk])
    seen, rows, counts = set(), [], [0, 0, 0]
    for _, _, role, text in talk:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        rows.append((role, text, fault in (0, 1), int(fault == 2)))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for known, t, *_ in talk if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest(rows)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TALKS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [3, repair.CHUNK])
def test_repair(spark, chunk):
    rng = random.Random(chunk)
    texts = ["Yes.", "No!", "cut", " ", "", "a?\n ", "x\ny.", " ", "Z .", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    talks = {}
    for c in range(60):
        n = rng.choice([1, 2, 5, 9, 30])
        kind = rng.random()
        talk = [(rng.choice([k, k, k, None, k // 2]), ["user", "assistant"][k % 2] if kind < 0.4 else rng.choice(roles), f"{k} " + (rng.choice(texts) or ".") if kind < 0.8 else rng.choice(texts)) for k in range(n)]
        talks[c if c else None] = talk
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TALKS).withColumn("at", F.lit(0))
    reports, repaired = repair.repair(df, chunk=chunk)
    digests = {r.conv_: r.repaired_sha256 for r in repair.hashed(repaired, F.concat("role", F.lit(":"), "text")).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*r[1:], digests.get("-" if r.conv_id is None else f"={r.conv_id}", none)) for r in reports.collect()}
    for c, talk in talks.items():
        assert got[c] == report(talk), (c, talk)
    assert len(got) == len(talks)


def test_vectors_converge(spark):
    """A long conversation in many chunks: passes end, and costs are those of one pass over all."""
    rng = np.random.default_rng(4)
    codes = rng.choice([1, 2, 1, 2, 0, 3, 5, 9, 10], 500)
    whole = repair.solve([codes], repair.AT_END[None, :])[0]
    parts = [codes[i : i + 8].tolist() for i in range(0, 500, 8)]
    rows = [("=1", k, k == len(parts) - 1, p) for k, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "conv_ string, chunk_ long, last_ boolean, codes array<int>")
    costs, passes = repair.converge(df)
    assert 1 <= passes <= len(parts)
    for r in costs.collect():
        mine = np.frombuffer(r["costs"], "<i8").reshape(-1, 4)
        for k, v in enumerate(mine):
            gap = whole[r["chunk_"] * 8 + k] - v
            assert (gap == gap[0]).all()
    fresh, run = repair.fix_up(codes, repair.solve([codes], np.zeros((1, 4), int))[0], repair.AT_END)
    assert (fresh == whole).all() and run < 100  # the vectors agree long before the start


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TALKS)
    reports, repaired = repair.repair(empty)
    assert reports.collect() == [] and repaired.collect() == []
    dropped = [(c, t) for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = queries.repair_digests(spark.createDataFrame([(c, t, "user", "x.") for c, t in dropped], TALKS)).collect()
    assert dropped and {(r.cost, r.audit, r.repaired_sha256) for r in got} == {(0, "", hashlib.sha256(b"").hexdigest())}
