"""Chat, WARC, vectors, URLs, pages and the pipeline: brute force, SQL, edge cases."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import tempfile

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from driftgrid.llm import chat, hilbert, html_cut, nndescent, simhash, url_rules, warc
from driftgrid.llm.queries import HOST_RULES, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(rows.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in rows.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


# --- chat --------------------------------------------------------------------------------------------------------------


def said(segments):
    """The conversations read back: the list of (role, text), the text under the mask, the whole string."""
    rows = segments.select("conv_id", "segment", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("m"))
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.segment is not None, r.segment or 0)):
        turns, mask, text = out.get(r.conv_id, ([], "", ""))
        out[r.conv_id] = turns + [tuple(t) for t in r.t], mask + r.m, text + r.formatted
    return out


def test_events_fold(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    monkeypatch.setattr(chat, "SEGMENT", 2)
    rng, log, want = random.Random(1), [], {}
    for conv in range(6):
        seq = 0
        for turn in range(7):
            role, text = ("user", "assistant")[turn % 2], ""
            for step in range(rng.randint(1, 9)):
                kind = "message" if step == 0 else rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
                piece = rng.choice(["a<|im_end|>", "<\\|", "<", "|", "%0A", "", None, "\n", "é"])
                log.append((conv, turn, seq, kind, role if kind == "message" else None, piece))
                text = text + (piece or "") if kind == "delta" else piece or ""
                seq += 1
            want.setdefault(conv, []).append((role, text))
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    segments = chat.render(chat.fold(events))
    got = said(segments)
    assert {c: v[0] for c, v in got.items()} == want
    assert {c: v[1] for c, v in got.items()} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    assert {r.conv_id: r.formatted for r in chat.conversations(segments).collect()} == {c: v[2] for c, v in got.items()}


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "as\nsi%0Ast<|", "x" * 200_000), (1, 1, "assistant", ""), (1, None, "assistant", "<|im_start|>user\nno<|im_end|>\n")]
    events = spark.createDataFrame([(c, t, t, None, r, x, 1) for c, t, r, x in rows], "conv_id long, turn long, seq long, kind string, role string, text string, segment int")
    got = said(chat.render(chat.fold(events)))
    assert got[None][0] == [("", "")]
    assert got[1][0] == [("assistant", rows[3][3]), ("as\nsi%0Ast<|", "x" * 200_000), ("assistant", "")]
    assert got[1][1] == rows[3][3]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


# --- WARC --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, bin int"


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>same</p>" * 30
    rows = [(5, "http://a/\r\nX: y", same), (3, "http://b/", same), (9, None, same), (3, "http://b/", same), (2, "u", "short"), (1, "u", "short"), (7, "é", None), (None, "n", same), (8, "big", "é" * 300_000)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-") + "/warc"


def test_warc_round_trip(spark, pages):
    at = folder()
    manifest = warc.write(pages, at, shard_bytes=4096, roll_bytes=300)
    got = warc.read(spark, at).collect()
    assert len(got) == 9 and manifest.agg(F.sum("records")).first()[0] == 9 and manifest.count() > 2
    same = ("<p>same</p>" * 30).encode()
    for r in got:
        if r.payload is not None:
            assert (len(r.payload), hashlib.sha256(r.payload).hexdigest()) == (r.payload_bytes, r.payload_digest)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got if r.payload_digest == hashlib.sha256(same).hexdigest())
    assert kinds == [(-1, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (9, "revisit", 3)]
    assert [r.record_type for r in got if r.page_id in (1, 2, 7, 8)] == ["response"] * 4
    assert {r.page_id: r.url for r in got}[5] == "http://a/%0D%0AX:%20y"


def test_warc_is_deterministic(spark, pages):
    sums = []
    for rows in (pages, pages.repartition(7)):
        at = folder()
        sums.append(sorted((r.name, r.records, r.sha256) for r in warc.write(rows, at, shard_bytes=4096, roll_bytes=300).collect()))
        base = at.removeprefix("file://")
        for name, _, digest in sums[-1]:
            with open(f"{base}/{name}", "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == digest
    assert sums[0] == sums[1]


def test_warc_any_ids_and_hot_ids(spark):
    """Far ids do not crowd the others into one shard, one id's rows are split, and every row is written once."""
    far = [-(1 << 62) - 5, -(1 << 63), 1 << 62, (1 << 63) - 1]
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 40) for i in [*range(200), *far]] + [(77, f"http://b/{i}", f"<b>{i}</b>" * 40) for i in range(100)]
    at = folder()
    manifest = warc.write(spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES), at, shard_bytes=8192)
    got = warc.read(spark, at, manifest).collect()
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == sorted(rows)
    assert 15 <= manifest.count() <= 60 and manifest.agg(F.max("records")).first()[0] <= 40


def test_warc_ranges_in_order(spark):
    """Shards are ranges of ids; ranges beyond their number are dealt by hash and lose nothing."""
    rows = [(i, "u", f"{i} " * 200, "d", 1) for i in range(300)]
    at = folder()
    files = warc.write(spark.createDataFrame(rows, PAGES), at, shard_bytes=16384)
    kept, base = [], at.removeprefix("file://")
    for name in sorted(r.name for r in files.collect()):
        with open(f"{base}/{name}", "rb") as f:
            kept += [r["page_id"] for m in warc.members(f) if (r := warc.parse(m))]
    assert kept == list(range(300)) and files.count() > 5


def test_warc_more_shards_than_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BINS", 4)
    monkeypatch.setattr(warc, "TASKS", 3)
    at = folder()
    files = warc.write(spark.createDataFrame([(i, "u", f"{i} " * 200, "d", 1) for i in range(300)], PAGES), at, shard_bytes=8192)
    assert sorted(r.page_id for r in warc.read(spark, at, files).collect()) == list(range(300))
    assert files.count() > 12


def test_warc_empty_and_damaged(spark, pages):
    at = folder()
    assert warc.write(pages.limit(0), at).count() == 0 and warc.read(spark, at).count() == 0
    data = warc.record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest())
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n", b"poyload\r\n"))


# --- vectors -----------------------------------------------------------------------------------------------------------


def clustered(seed, n=300, size=16, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, size))
    rows = centre[rng.integers(0, 12, n)] + rng.standard_normal((n, size)) * rng.choice([0.02, 0.08, 0.6], (n, 1))
    return rows.astype(np.float32), rng.integers(0, labels, n)


VECTORS = "vec_id long, embedding array<float>, label int, u int, vec string, n_ int, rank int, component_id int"
ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [], 1), (905, [1.0] * 15 + [None], 1), (906, [1.0, 2.0], 1)]


def table(spark, rows, label, more=()):
    data = [(i, [float(x) for x in r], int(k)) for i, (r, k) in enumerate(zip(rows, label))]
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in [*data, *more]], VECTORS)


def test_nn_descent(spark, monkeypatch):
    for name, value in (("GROUP", 16), ("MOST", 20), ("BLOCK", 7), ("AUDIT", 50)):
        monkeypatch.setattr(nndescent, name, value)
    rows, label = clustered(3)
    extra = [*ODD, (950, [float(x) for x in rows[0]], None), (951, [float(x) for x in rows[0]], int(label[0])), (951, [float(x) for x in rows[0]], int(label[0])), (None, [float(x) for x in rows[0]], int(label[0]))]
    got = nndescent.near_duplicates(table(spark, rows, label, extra)).collect()
    assert len(got) == len(rows) + len(extra)
    every = np.concatenate([rows, rows[:1], rows[:1]]).astype(np.float64)
    ids, label = [*range(len(rows)), 951, 951], np.concatenate([label, label[:1], label[:1]])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = sorted((ids[i], int(near[i].sum()) - 1, ids[find(i)], ids[i] == ids[find(i)]) for i in range(len(ids)))
    assert sorted(tuple(r) for r in got if r.vec_id is not None and (r.vec_id < 900 or r.vec_id == 951)) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, r.vec_id is not None) for r in got if r.vec_id is None or 900 <= r.vec_id <= 950)


@pytest.mark.parametrize("block", [40, 2048])
def test_links_between_saturated_groups(spark, monkeypatch, block):
    """Two groups tighter inside than between: the neighbour lists never hold a link from one to the other."""
    monkeypatch.setattr(nndescent, "BLOCK", block)
    rng, size = np.random.default_rng(12), 32
    base, away = np.linalg.qr(rng.standard_normal((size, 2)))[0].T
    other = 0.985 * base + np.sqrt(1 - 0.985**2) * away
    rows = np.concatenate([c + rng.standard_normal((90, size)) * 0.0005 for c in (base, other)] + [rng.standard_normal((60, size))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want[:180].min() == 179 and want[180:].max() == 0
    got = {r.vec_id: r for r in nndescent.near_duplicates(table(spark, rows, np.ones(240))).collect()}
    assert [got[i].n_links for i in range(240)] == want.tolist()
    assert [got[i].component_id for i in range(240)] == [0] * 180 + list(range(180, 240))


def test_vectors_empty(spark):
    none = table(spark, [], []).limit(0)
    assert nndescent.near_duplicates(none).count() == 0
    assert hilbert.search(none, F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_is_continuous(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block, least", [(16, 0.9), (4096, 1.0)])
def test_search(spark, monkeypatch, block, least):
    monkeypatch.setattr(hilbert, "BLOCK", block)
    monkeypatch.setattr(hilbert, "SPAN", 3)
    monkeypatch.setattr(hilbert, "WIDE", 2)
    rows, label = clustered(4, 400)
    rows[7] = rows[20] = rows[33] = rows[5]  # ties
    got = hilbert.search(table(spark, rows, label, ODD), F.col("vec_id") % 20 == 0, k=5).collect()
    scores = rows.astype(np.float64) @ rows.astype(np.float64).T
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        want = sorted((v for v in range(400) if v != q), key=lambda v: (-round(scores[q, v], 9), v))[:5]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(scores[q, r.vec_id], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
        if least == 1.0:
            assert [r.vec_id for r in mine] == want
    assert hits >= least * 100


@pytest.mark.parametrize("block, least", [(16, 0.9), (4096, 1.0)])
def test_search_of_several_lengths(spark, monkeypatch, block, least):
    """Rows of every length are searched, rare and frequent ones, among their own."""
    monkeypatch.setattr(hilbert, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [rng.standard_normal(size).tolist() for size in [4] * 90 + [7] * 60 + [3] * 10 + [1]]
    order = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, rows[j]) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    got = {}
    for r in hilbert.search(df, F.col("vec_id") % 5 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = total = 0
    for q in range(0, len(order), 5):
        own = np.array(rows[order[q]])
        near = sorted((-float(own @ rows[j]), i) for i, j in enumerate(order) if i != q and len(rows[j]) == len(own))[:4]
        assert len(got.get(q, [])) == len(near)
        hits, total = hits + len({v for _, v in got.get(q, [])} & {v for _, v in near}), total + len(near)
    assert hits >= least * total


def test_search_query_recall(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows, ids = np.stack(data.embedding).astype(np.float64), data.vec_id.to_numpy()
    got = QUERIES["op8_hilbert"](spark, SF).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = rows @ rows[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s)[:20]])
        hits, total = hits + len(best & set(got.vec_id[got.query_id == ids[i]])), total + len(best)
    assert hits >= 0.9 * total


# --- URLs --------------------------------------------------------------------------------------------------------------


def plain_parts(url):
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(low), m[2]) if m else ("", "")


def plain_tokens(url):
    host, path = plain_parts(url)
    query = re.search(r"\?([^#]*)", url or "")
    keys = [q.split("=")[0] for q in query[1].split("&")] if query else []
    parts = re.sub("[0-9]+", "0", path).split("/")
    return {f"host:{host}" if host else "", *(f"label:{x}" for x in host.split(".") if x), *(f"path:{x}" for x in parts if x), *(f"key:{x}" for x in keys if x)} - {""}


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [(len(r), r, v) for v, r in HOST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_url_query_follows_the_rules(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_urls"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (*plain_parts(urls[r.page_id]), rule)
        assert verdict in (None, r.verdict)


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(8)
    urls, blocked = [], []
    for _ in range(300):
        spam = rng.random() < 0.4
        host = rng.choice(["pills.example.org", "win.example.org"]) if spam else rng.choice(["news.example.org", "blog.example.org"])
        urls.append(f"http://{host}/{rng.choice(['en', 'fr'])}/{rng.randrange(99)}" + rng.choice(["", "?ref=x", "?page=2&ref=1"]))
        blocked.append(spam if rng.random() < 0.95 else not spam)
    labelled = spark.createDataFrame(list(zip(urls, blocked)), "url string, blocked boolean")
    got = {frozenset(r.tokens): (r.confidence, r.support) for r in url_rules.mine(labelled, 0.05, 0.8).collect()}
    baskets = [plain_tokens(u) for u in urls]
    rules = {}
    for n in range(1, 9):
        for items in {c for b in baskets for c in combinations(sorted(b), n)}:
            has = [k for k, b in enumerate(baskets) if set(items) <= b]
            hit = sum(blocked[k] for k in has)
            if hit >= 0.05 * len(urls) and hit / len(has) >= 0.8 and hit / len(has) > sum(blocked) / len(urls):
                rules[frozenset(items)] = hit / len(has), hit / len(urls)
    kept = {r: v for r, v in rules.items() if not any(s < r and rules[s][0] >= v[0] for s in rules)}
    assert kept and got.keys() == kept.keys() and all(got[r] == pytest.approx(kept[r]) for r in kept)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in url_rules.judge(pages, labelled, HOST_RULES, 0.05, 0.8).collect():
        want = "block" if any(k <= plain_tokens(urls[r.page_id]) for k in kept) else "allow"
        assert r.verdict == (plain_rule(urls[r.page_id])[1] or want)


def brute_rules(baskets, blocked, support, confidence):
    """Kept rules by extending sets only with tokens of a blocked basket; sets that are as sure as a subset end there."""
    n, b = len(baskets), sum(blocked)
    least = max(math.ceil(support * n), 1)
    kept, level = {}, {frozenset([t]) for s in baskets for t in s}
    while level:
        open_ = set()
        for items in level:
            has = [k for k, s in enumerate(baskets) if items <= s]
            hit = sum(blocked[k] for k in has)
            if hit < least:
                continue
            share = hit / len(has)
            if share >= confidence and share > b / n and not any(s < items and v[0] >= share for s, v in kept.items()):
                kept[items] = share, hit / n
            if share < 1:
                open_.add(items)
        tokens_ = {t for items in open_ for t in items}
        level = {items | {t} for items in open_ for t in tokens_ if t not in items}
    return kept


def test_long_urls_are_mined(spark):
    """A URL of 40 parts, repeated and with mixed labels, neither stops the mining nor changes the kept rules."""
    long = "http://long.example.org/" + "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    sure = "http://sure.example.org/" + "/".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(long, True)] * 9 + [(long, False)] + [(sure, True)] + [("http://a.example.org/en/ok", False)] * 12 + [("http://a.example.org/en/bad", True)] * 3
    rows += [("http://b.example.org/fr/bad?z=1", False), ("http://b.example.org/fr/bad", True), ("http://b.example.net/bad?z=1", True)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    baskets, blocked = [plain_tokens(u) for u, _ in rows], [b for _, b in rows]
    # brute force over one token of each set of tokens with the same URLs, then written out
    where = {}
    for t in set().union(*baskets):
        where.setdefault(frozenset(k for k, s in enumerate(baskets) if t in s), []).append(t)
    same = {min(v): v for v in where.values()}
    kept = brute_rules([{t for t in s if t in same} for s in baskets], blocked, 0.002, 0.8)
    want = {frozenset(c): v for items, v in kept.items() for c in itertools.product(*[same[t] for t in items])}
    got = {frozenset(r.tokens): (r.confidence, r.support) for r in url_rules.mine(labelled).collect()}
    assert len(want) > 80 and got.keys() == want.keys() and all(got[r] == pytest.approx(want[r]) for r in want)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    for r in url_rules.judge(pages, labelled, HOST_RULES).collect():
        url = rows[r.page_id][0]
        assert r.verdict == (plain_rule(url)[1] or ("block" if any(w <= plain_tokens(url) for w in want) else "allow"))


@pytest.mark.parametrize("labels", [[True, True], [False, False], []])
def test_labels_of_one_kind_give_no_rules(spark, labels):
    labelled = spark.createDataFrame([("http://a.org/x", b) for b in labels], "url string, blocked boolean")
    assert url_rules.mine(labelled).count() == 0


def test_urls_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "http://A.Example.COM/en/x"), (2, ""), (3, "no scheme/en/"), (4, "a://b://c/d"), (5, "http://example.com"), (6, "http://notexample.net/es/"), (7, "http://net/es/"), (8, "x\ny://É.net/fr/\nz?q"), (9, "http://" + "a." * 5000 + "net/fr/1")]
    pages = spark.createDataFrame([(*r, "v", 1) for r in rows], "page_id long, url string, verdict string, host int")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = {}
    for r in url_rules.judge(pages, none, HOST_RULES).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    for page_id, url in rows:
        rule, verdict = plain_rule(url)
        assert set(got[page_id]) == {(*plain_parts(url), rule, verdict or "allow")}
    assert len(got[1]) == 2 and url_rules.judge(pages.limit(0), none, HOST_RULES).count() == 0


# --- pages -------------------------------------------------------------------------------------------------------------


def test_minimum_cut_equals_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(1, 8)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(sink[i] if x[i] else source[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_cut.minimum_cut(source, sink, edges)) == min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div id="cookie-banner">We use cookies. Accept all of them please, for this site to work.</div>
<div class="content"><h2>Title  here</h2><p>First paragraph of the story, long enough to be one, and it ends.<p>Hi.<div class="ad">Buy now, it is very cheap today, and only today.</div>
<p>Another paragraph with a <a href=x>link</a> in it &amp; an&nbsp;entity<br>here.<form><label>Name</label><input><button>Send</button></form></div>
<section class="comments"><h3>Comments</h3><p>Great post, I liked it very much, thank you for that and so on.</p></section><aside>Related <a>One</a></aside><footer>&copy; 2020</footer>"""


def test_extract():
    want = "Title here\nFirst paragraph of the story, long enough to be one, and it ends.\nHi.\nAnother paragraph with a link in it & an entity here."
    assert html_cut.extract(PAGE) == want
    assert html_cut.extract("<article><header><h1>Real title</h1></header><p>Body.</p><footer>x</footer></article>") == "Real title\nBody."
    for bad in ("", "<", "<p", "</p></div>", "<a '><p>x" * 40, "<!-- x", "<script>x", "&#0;&bogus;", "<div>" * 3000 + "x"):
        assert isinstance(html_cut.extract(bad), str)


@pytest.mark.parametrize("mark", ['<svg viewBox="0 0 1 1"/>', "<svg/>", "<math />", '<svg data-x="a>b"/>', "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<template-x></template-x>"])
def test_extract_goes_on_after_small_elements(mark):
    said = "A first paragraph that is long enough to be one, and it ends."
    assert html_cut.extract(f"<article><p>{said}{mark}</p><p>{said}</p></article>") == f"{said}\n{said}"


@pytest.mark.parametrize("attribute, shown", [('data-title="The hidden cost of X"', True), ('class="w-64 hidden md:block"', True), ("title='a hidden = b'", True), ('data-css="display:none"', True), ("hidden", False), ("id=a HIDDEN=''", False), ("hidden/", False), ('class="x"hidden', False), ('style="color:red; display : none"', False), ("style=display:none", False)])
def test_extract_hides_by_attribute(attribute, shown):
    said = "A first paragraph that is long enough to be one, and it ends."
    assert html_cut.extract(f"<article {attribute}><p>{said}</p></article>") == (said if shown else "")


def test_page_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op10_html"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html_cut.html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pages_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>" + "Long text. " * 50_000, "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, len(r.text)) for r in html_cut.main_text(rows).collect())
    assert got == [(0, 549_999), (1, 0), (1, 0), (2, 0)]
    assert html_cut.main_text(rows.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------


def plain_five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_row_keys(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (None, None), (1, ""), (None, ""), (11, "a"), (1, "A"), (1, "a")]
    keys = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(corpus_pipeline._row_key()).collect()]
    assert None not in keys and len(set(keys)) == 8 and keys[0] == keys[-1]


@pytest.mark.parametrize("name", ["fp", "doc_id", "component_id", "group_id", "GROUP_ID"])
def test_simhash_rejects_own_names(spark, name):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, keep={name: F.lit(1)})


def test_pipeline_stages(spark):
    text = "the cat sat on the mat and looked at the dog that was asleep in the sun "
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123", None, None, 3), (9003, text * 9, None, None, 9), (9003, text * 9, None, None, 9), (None, text * 9 + "again", "en", "src1", 9), (9004, text * 9, "en", "src1", 9)], docs.schema)
    docs = docs.union(odd)
    first = corpus_pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.count() - 2
    kept = corpus_pipeline.near_duplicates(spark, first, SF)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    # brute force: every two fingerprints, each counted bit by bit
    rows = [(r.doc_id is None, r.doc_id or 0, r.text) for r in first.select("doc_id", "text").collect()]
    prints = np.array([plain_five_words(t) for _, _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    left, want = set(range(len(rows))), []
    while left:
        group, stack = set(), [left.pop()]
        while stack:
            i = stack.pop()
            group.add(i)
            more = left & set(np.flatnonzero(near[i]).tolist())
            left -= more
            stack += more
        want.append(min(rows[i][:2] for i in group)[1])
    assert len(got) < len(rows) and [i for i, _ in got] == sorted(want)
    mixed = corpus_pipeline.source_mix(spark, kept, SF)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(kept.collect())
    tokens = corpus_pipeline.tokens(spark, mixed, SF)
    assert tokens.count() == mixed.count()
    assert tokens.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"
