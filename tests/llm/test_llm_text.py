"""BPE, SimHash, mixing and language ID: brute force, edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from driftgrid.llm import bpe, mixing, ppm, simhash
from driftgrid.llm.components import components
from driftgrid.llm.queries import QUERIES, bpe_digests

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, ids string, fp int, copies int, ok_ int, n_ int, score string"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns named like results."""
    rows = [
        (1, "the cat sat on the mat " * 3, "en", "a"),
        (1, "the cat sat on the mat " * 3, "en", "a"),
        (2, None, "en", None),
        (3, "", None, "a"),
        (None, "le chat est sur la table", "fr", "b"),
        (4, "word " * 60_000, "en", "b"),
        (5, "  \t\n ", None, None),
        (6, "1234 !!! 56", "en", "a"),
        (7, "x" * 300_000, "en", "c"),
    ]
    return spark.createDataFrame([(*r, "ids", 1, 2, 3, 4, "s") for r in rows], DOCS)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- BPE ---------------------------------------------------------------------------------------------------------------


def test_transducer_equals_reference(ranks, encoding):
    transducer, decoder, rng = bpe.Transducer(ranks, P.PATTERN), bpe.Decoder({r: t for t, r in ranks.items()}), random.Random(5)
    alphabet = "aAbé \n\t\r  'sSt1٣  😀漢.\x85​#<|ſ"
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        ids = list(transducer.encode(text))
        assert ids == encoding.encode_ordinary(text)
        assert decoder.decode(ids) == text == "".join(decoder.stream(ids))


def test_transducer_survives_full_caches(ranks, encoding, monkeypatch):
    for name in ("MAX_PIECES", "MAX_STATES", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, name, 20)
    transducer = bpe.Transducer(ranks, P.PATTERN)
    for text in ["incremental determinisation, überall " * 5, "zzzqqq" * 50]:
        assert list(transducer.encode(text)) == encoding.encode_ordinary(text)


def test_border_rule_equals_merging(ranks):
    transducer, rng, names = bpe.Transducer(ranks, P.PATTERN), random.Random(6), list(ranks)
    for _ in range(5000):
        a, b = rng.choice(names)[-3:], rng.choice(names)[:3]
        if a in ranks and b in ranks:
            pair = ranks[a], ranks[b]
            assert transducer._fits(*pair) == (transducer.merge(a + b) == pair)


def test_decoder_replaces_ill_formed_bytes(ranks):
    decoder = bpe.Decoder({r: t for t, r in ranks.items()})
    for data in (b"\xe6\xbc", b"a\xff", b"\xf0\x9f\x98", b"\xe6a", b"\xc0\xaf"):
        assert decoder.decode([ranks[data[i : i + 1]] for i in range(len(data))]) == data.decode("utf-8", "replace")


def test_bpe_query_and_odd_rows(spark, odd, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(texts[r.doc_id]))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(encoding.encode_ordinary(r.text or "")), digest(r.text or "")) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe_digests(odd, PATH).collect()) == want
    assert bpe_digests(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd, PATH, P.PATTERN, keep=["doc_id", "ids"])


def test_encode_then_decode(spark, odd):
    rows = bpe.encode(odd, PATH, P.PATTERN)
    assert [len(r.ids) for r in rows.where("doc_id = 3").collect()] == [0]
    back = bpe.decode(rows.union(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()}[9] == ""


# --- SimHash -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(odd):
    for text in ["", " \x0b\x0c ", "One", "one two THREE", "a b c d", "É é\xa0x b c d e", "the cat sat on the mat and left " * 300]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    got = {r.doc_id: r.fp for r in simhash.fingerprints(odd).collect()}
    assert got[2] == got[3] == got[5] == 0


@pytest.mark.parametrize("sizes", [[2, 3], [70, 1, 130], [200]])
def test_bit_sliced_links(sizes):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.array([centre[rng.integers(4)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(sum(sizes))], np.uint64)
    sizes = np.array(sizes)
    a, b = simhash.forests(fps, sizes, 4)
    group = np.repeat(np.arange(len(sizes)), sizes)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((max(p), min(p)) in set(links) for p in zip(a, b)) and len(a) < len(fps)
    assert plain_components(range(len(fps)), zip(a, b)) == plain_components(range(len(fps)), links)


def test_crowded_meeting_places(spark, monkeypatch):
    """All fingerprints meet in few places, which are cut into many cells."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(25):
            text = list(base)
            for _ in range(k % 7):
                text[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert links and got == plain_components(range(len(fps)), links)


def test_near_duplicates_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == {1} and by[2] == by[3] == by[5] == {2} and by[None] == {None}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(600, i) for i in range(601, 640)] + [(7, 7), (3, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == plain_components({i for p in real for i in p}, real)


# --- mixing ------------------------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 50, "Z": 0})
    assert got["Z"] == 0 and got["a"] == 30 and sum(got.values()) == pytest.approx(160)
    assert got["b"] == pytest.approx(130 * 1 / 6) and got[None] == pytest.approx(130 * 5 / 6)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 500, 60).astype(float)
    p, taken = np.full(60, 0.3), np.zeros(60)
    for seed in range(400):
        q = mixing.flight(p, size, np.random.default_rng(seed))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)
        taken += q
    assert np.abs(taken / 400 - 0.3).max() < 0.12


def test_mix(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (docs, docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("hot"))):
        got = mixing.mix(rows).toPandas()
        assert len(got) == rows.count() and (got.taken <= 3 * got["size"]).all()
        per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"), most=("size", "max"))
        assert (per["size"] == per.said).all() and per.target.sum() == pytest.approx(per["size"].sum())
        # whole documents only: a source of three documents may miss by half of one
        assert ((per.taken - per.target).abs() <= np.maximum(0.005 * per.target, 0.5 * per.most * (per["size"] < 5000))).all()
        again = mixing.mix(rows.repartition(5)).toPandas()
        order = ["doc_id", "size", "taken"]
        assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    sizes = {r.doc_id: r["size"] for r in rows}
    assert sizes[2] == sizes[3] == sizes[5] == 0 and sizes[4] == 60_000
    assert mixing.mix(odd.limit(0)).count() == 0


# --- language ID -------------------------------------------------------------------------------------------------------


def plain_bits(model_words, word, order=ppm.ORDER):
    """Code length of a word by the definition, from the words learned with their counts."""
    follow = {}
    for w, n in model_words.items():
        s = b" " + w + b" "
        for i in range(1, len(s)):
            for o in range(min(order, i) + 1):
                at = follow.setdefault(s[i - o : i], {})
                at[s[i]] = at.get(s[i], 0) + n
    s, bits = b" " + word + b" ", 0.0
    for i in range(1, len(s)):
        for o in range(min(order, i), -1, -1):
            at = follow.get(s[i - o : i])
            if at is None:
                continue
            total = sum(at.values()) + len(at)
            if s[i] in at:
                bits += np.log2(total / at[s[i]])
                break
            bits += np.log2(total / len(at))
        else:
            bits += 8
    return bits


def test_code_lengths():
    words = {"en": {b"the": 5, b"then": 2, b"cat": 1}, "fr": {b"le": 4, b"chat": 2, "été".encode(): 1}}
    model = ppm.Model(words)
    tried = [b"the", b"theme", b"chat", b"zzz", "été".encode(), b"a"]
    got = model.code_lengths(tried)
    for i, w in enumerate(tried):
        for j, lang in enumerate(model.langs):
            assert got[i, j] == pytest.approx(plain_bits(words[lang], w), abs=1e-3)


def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = QUERIES["op7_langid"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in docs.index)
    assert (got.lang_pred == docs.lang.reindex(got.index))[got.held_out].mean() > 0.97


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than were once learned, one of long texts only, one whose rows share their number."""
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[3 * k + j], f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} word " * 5, f"l{k:02d}") for k in range(70) for j in range(3)]
    rows += [(ids[300 + j], "langertext wort " * 1000, "long") for j in range(2)] + [(ids[400], f"same number {j}", "same") for j in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(ppm, "PER_LANG", 7)
    taken = ppm.sample(docs).groupBy("lang").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars")).collect()
    assert {r.lang: r.n for r in taken} == {f"l{k:02d}": 3 for k in range(70)} | {"long": 2, "same": 7}
    assert max(r.chars for r in taken) == len("langertext wort " * 1000)
    model = ppm.learn(docs)
    assert model.langs == sorted({r[2] for r in rows})
    assert {(r.lang, r.lang_pred) for r in ppm.identify(docs, model, keep={"lang": F.col("lang")}).collect()} == {(x, x) for x in model.langs}


@pytest.mark.parametrize("first", [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:6])
def test_language_of_repeated_rows_is_learned(spark, first):
    """Copies of a row are drawn or left together; either way their language is learned."""
    rows = [(first, "wort fuer wort", "same")] * 3000 + [(first + 1000 * k, f"word{k} for word", "en") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {"same": ppm.PER_LANG, "en": sum(zlib.crc32(str(r[0]).encode()) % 4 != 2 for r in rows[3000:])}
    assert {r.lang: r["count"] for r in ppm.sample(docs).groupBy("lang").count().collect()} == want


def test_long_words_are_scored_in_pieces(monkeypatch):
    words = {"en": {b"the": 5, b"then": 2, b"cat": 1}, "fr": {b"le": 4, b"chat": 2}}
    model = ppm.Model(words)
    word = "thechatthen" * 40
    for step in (1, 5, 7, 1000):
        np.testing.assert_allclose(model.long_code_length(word.encode(), step), model.code_lengths([word.encode()])[0], rtol=1e-6)
    texts = [f"the {word} cat", word, "", "le chat " + "x" * 300]
    want = ppm.score(texts, ppm._Words(model))
    monkeypatch.setattr(ppm, "LONG_WORD", 10_000)
    monkeypatch.setattr(ppm, "PART_BYTES", 50)
    monkeypatch.setattr(ppm, "MAX_CHARS", 10)
    memory = ppm._Words(model)
    np.testing.assert_allclose(ppm.score(texts, memory), want, rtol=1e-6)
    assert len(memory) == 0


def test_language_odd_rows(odd):
    model = ppm.learn(odd)
    got = {}
    for r in ppm.identify(odd, model, keep={"held_out": ppm.held_out()}).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert got[2][0][0] == got[3][0][0] == got[5][0][0] == got[6][0][0] == "und"
    assert len(got[1]) == 2 and got[None][0][1] is False
    assert ppm.identify(odd.limit(0), model).count() == 0
    nothing = ppm.identify(odd, ppm.learn(odd.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
