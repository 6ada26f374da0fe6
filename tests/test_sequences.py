import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import metrics, replay, sequences
from driftgrid.schema import sparse_frames
from driftgrid.scale import durable, release, shared_folder
from driftgrid.sources import tables
from driftgrid.streaming import sequences as streams


def folded(values, alpha, level=0.0):
    out = []
    for v in values:
        level = alpha * v + (1 - alpha) * level
        out.append(level)
    return out


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 0.9, 0.999999, 1.0])
def test_ema_over_block_borders(spark, rng, alpha):
    # at 0.999999 a block is 33 steps long
    x = rng.normal(size=(2, 150))
    df = spark.createDataFrame([(s, 0, 0, t, float(x[s, t]), -float(x[s, t])) for s in range(2) for t in range(150)], "seq_id long, y int, x int, t int, u double, v double")
    rows = sequences.ema(df, alpha, initial=3.0).orderBy("seq_id", "t").collect()
    for s in range(2):
        got = [r["u"] for r in rows if r["seq_id"] == s]
        np.testing.assert_allclose(got, folded(x[s], alpha, 3.0), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(("alpha", "block"), [(0.9, 4096), (0.9, 7), (0.001, 5), (1 - 1e-12, 9), (1e-6, 4096)])
def test_ema_equals_the_recursion_over_all_steps(spark, rng, alpha, block):
    """Nothing is cut off: early values and missing ones count at every later step."""
    steps = 700
    lines = {
        "plain": rng.normal(size=steps).tolist(),
        "nan": [float("nan"), *rng.normal(size=steps - 1).tolist()],
        "null": [*rng.normal(size=200).tolist(), None, *rng.normal(size=steps - 201).tolist()],
        "high": [1.0, float("inf"), *rng.normal(size=steps - 2).tolist()],
        "both": [float("inf"), 0.0, *rng.normal(size=400).tolist(), float("-inf"), *rng.normal(size=steps - 403).tolist()],
        "early": [1e200, *[0.0] * (steps - 1)],
    }
    df = spark.createDataFrame([(k, t, x) for k, line in lines.items() for t, x in enumerate(line)], "k string, t int, u double")
    got = {}
    for r in sequences.ema(df, alpha, ["u"], 2.0, ["k"], block=block).orderBy("t").collect():
        got.setdefault(r["k"], []).append(r["u"])
    for k, line in lines.items():
        want, level = [], 2.0
        for x in line:
            level = None if level is None or x is None else alpha * x + (1 - alpha) * level
            want.append(level)
        assert [v is None for v in got[k]] == [v is None for v in want]
        np.testing.assert_allclose([v for v in got[k] if v is not None], [v for v in want if v is not None], rtol=1e-8, atol=1e-150)


def test_ema_rejects_bad_alpha(spark):
    with pytest.raises(ValueError):
        sequences.ema(spark.range(1), 1.5)


@pytest.mark.parametrize("block", [1, 4, 65536])
def test_running_metrics_in_blocks(spark, rng, block):
    x = rng.normal(size=23)
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t int, m double").withColumn("k", F.lit(1))
    parts = {"s": ("sum", F.col("m")), "hi": ("max", F.col("m")), "lo": ("min", F.col("m"))}
    rows = sequences.running(df, parts, ["k"], block=block).orderBy("t").collect()
    np.testing.assert_allclose([r["s"] for r in rows], np.cumsum(x))
    np.testing.assert_allclose([r["hi"] for r in rows], np.maximum.accumulate(x))
    np.testing.assert_allclose([r["lo"] for r in rows], np.minimum.accumulate(x))


def test_history_starts_with_the_first_value(spark):
    df = spark.createDataFrame([(0, 0, 0, t, float(t + 5)) for t in range(4)], "seq_id long, y int, x int, t int, u double")
    rows = sequences.history(df, ["u"], 3).orderBy("t").collect()
    assert [[h["u"] for h in r["hist"]] for r in rows] == [[5, 5, 5], [5, 5, 6], [5, 6, 7], [6, 7, 8]]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_time_blocks_do_not_show(spark, block):
    df = spark.createDataFrame([(0, 0, 0, t, float(t * t), -float(t)) for t in range(11)], "seq_id long, y int, x int, t int, u double, v double")
    rows = sequences.history(df, ["u"], 3, block=block).orderBy("t").collect()
    assert [[h["u"] for h in r["hist"]] for r in rows] == [[max(t - k, 0) ** 2 for k in (2, 1, 0)] for t in range(11)]
    begun = sequences.temporal_init(df, block=block).orderBy("t").collect()
    assert [r["u0"] for r in begun] == [0.0] + [t * t for t in range(10)]


@pytest.fixture
def buffers(spark):
    return spark.createDataFrame([(b, s, float(s)) for b, n in ((1, 500), (2, 12)) for s in range(n)], "buffer_id long, seq long, reward double")


def test_replay_buffer(buffers):
    kept = replay.retain(buffers, 10)
    held = {b: sorted(r["seq"] for r in kept.where(f"buffer_id = {b}").collect()) for b in (1, 2)}
    assert held == {1: list(range(490, 500)), 2: list(range(2, 12))}
    oldest = replay.sample_at(kept, 0).orderBy("buffer_id").collect()
    assert [r["seq"] for r in oldest] == [490, 2]
    one, two = (sorted(map(tuple, replay.sample(kept, 4, seed).collect())) for seed in (1, 1))
    assert one == two and len(one) == 8
    assert sorted(map(tuple, replay.sample(kept.repartition(7), 4, 1).collect())) == one
    assert replay.clear(kept).isEmpty()
    assert replay.push(kept, buffers.where("seq = 0")).count() == 22


def test_replay_by_ranks_equals_replay_by_windows(spark, buffers, monkeypatch):
    """A buffer that holds nearly all rows, with a capacity close to its size."""
    everything = lambda df: sorted(map(tuple, df.collect()))
    want = [everything(replay.retain(buffers, 490)), everything(replay.sample(buffers.where("buffer_id = 1"), 300, 5)), everything(replay.sample_at(buffers.where("buffer_id = 1"), [0, 7, 499]))]
    monkeypatch.setattr(replay, "MEET", 1)
    got = [everything(replay.retain(buffers, 490)), everything(replay.sample(buffers.where("buffer_id = 1"), 300, 5))]
    assert got == want[:2] and len(got[0]) == 502
    at = replay.sample_at(buffers.where("buffer_id = 1"), [0, 7, 499]).select("buffer_id", "seq", "reward", "position")
    assert everything(at) == want[2]
    plan = replay.retain(buffers, 490)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_replay_keeps_the_same_rows_either_way(spark, monkeypatch):
    """A buffer without a number, repeated ``seq``, equal rows, and one buffer that holds nearly all rows."""
    rows = [(None, k, k % 3, float(k)) for k in range(20)] + [(1, 15, k, 0.5) for k in range(3)] + [(1, 15, 0, 0.5)] + [(1, k, 0, 1.0) for k in range(10)]
    rows += [(2, k // 2, k % 2, float(k)) for k in range(600)]
    df = spark.createDataFrame(rows, "buffer_id long, seq long, action long, reward double")

    def everything():
        taken = [replay.retain(df, n) for n in (5, 25)] + [replay.sample(df, 7, 3), replay.sample_at(df, [0, 2, 9])]
        return [sorted(map(str, t.select(*sorted(t.columns)).collect())) for t in taken]

    few = everything()
    monkeypatch.setattr(replay, "MEET", 1)
    assert everything() == few
    assert [len(x) for x in few] == [15, 20 + 14 + 25, 21, 9]


def test_replay_errors(buffers):
    kept = replay.retain(buffers, 10)
    with pytest.raises(ValueError):
        replay.sample(kept, 11, 0)
    for positions in (10, [-1, 2]):
        with pytest.raises(IndexError):
            replay.sample_at(kept, positions)
    with pytest.raises(ValueError):
        replay.retain(buffers, 0)


def test_episodes_and_first_done(spark):
    df = spark.createDataFrame([(0, i, t, (i, t) in {(0, 2), (1, 1), (0, 4)}) for i in range(2) for t in range(6)], "batch long, item int, t int, done boolean")
    rows = sequences.episodes(df, ["batch", "item"]).orderBy("item", "t").collect()
    assert [r["episode"] for r in rows] == [0, 0, 0, 1, 1, 2] + [0, 0, 1, 1, 1, 1]
    assert {r["t"] for r in sequences.until_any_done(df, ["batch"]).collect()} == {0, 1}


def test_truth_selection_and_logs(spark, tmp_path):
    a, b = spark.range(1), spark.range(2)
    assert tables.select_truth("flow", a, b) is a and tables.select_truth("density", a, b) is b
    with pytest.raises(ValueError):
        tables.select_truth("odd", a, b)
    one = spark.createDataFrame([(1, 2.0)], "z long, a double")
    two = spark.createDataFrame([(3, 4.0)], "z long, b double")
    tables.write_metrics_csv([one, two], str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["a", "b", "z"]


def test_pixel_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f, y, x, 1.0) for f in range(3) for y in range(2) for x in range(2)], "frame_id long, y int, x int, i double")
    tables.write_pixels(df, str(tmp_path / "p"))
    assert sorted(tables.read_image(spark, str(tmp_path / "p")).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        tables.read_field(spark, str(tmp_path / "p"))
    assert sparse_frames(df).isEmpty()
    assert [r["frame_id"] for r in sparse_frames(df.where("frame_id <> 1 OR y + x <> 1")).collect()] == [1]


def test_durable_tables_are_released(spark):
    import os

    stored = durable(spark.range(10).repartition(3))
    folder = shared_folder(spark)
    assert stored.count() == 10
    path = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert path.startswith(folder) and os.path.isdir(path)
    release(stored)
    assert not os.path.exists(path)
    release(stored)


def test_the_shared_folder_is_the_clusters(spark):
    from types import SimpleNamespace as NS

    def session(folder, master):
        return NS(conf=NS(get=lambda key, default: folder), sparkContext=NS(master=master, applicationId="app"))

    assert shared_folder(session("/shared/ck/", "yarn")) == "/shared/ck"
    assert shared_folder(session(None, "local[4]")) == shared_folder(session(None, "local[4]"))
    with pytest.raises(RuntimeError):
        shared_folder(session(None, "spark://host:7077"))


def test_bucketed_tables_join_without_a_shuffle(spark):
    rows = [(f, y, x, float(f), 0.0) for f in range(4) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, u double, v double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("estimate", "truth"):
            tables.save_bucketed(df, f"bucketed_{name}", 4, mode="overwrite")
        pairs = metrics.paired(spark.table("bucketed_estimate"), spark.table("bucketed_truth"))
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("estimate", "truth"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_angle_and_relative_error_literals(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (1.0, 0.0, -1.0, 0.0), (2.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "u double, v double, tu double, tv double")
    rows = df.select(metrics.angle_error().alias("a"), metrics.relative_error().alias("r"), metrics.epe().alias("e")).collect()
    np.testing.assert_allclose([r["a"] for r in rows], [0.5, 1.0, 0.0, 0.5])
    np.testing.assert_allclose([r["r"] for r in rows], [0.0, 0.0, 1.0, 0.0])
    np.testing.assert_allclose([r["e"] for r in rows], [2**0.5, 2.0, 1.0, 0.0])


# --- streams ----------------------------------------------------------------

SCHEMA = "user long, ts timestamp, seq long, value double"


def batch(spark, folder, rows):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(u, start + dt.timedelta(seconds=s), s, v) for u, s, v in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, target):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{target}-state")
    writer.trigger(availableNow=True).start(target).awaitTermination()


def test_ema_stream_over_batches_with_late_rows(spark, tmp_path, rng):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    x = {u: rng.normal(size=12).tolist() for u in (1, 2)}
    first = [(u, s, x[u][s]) for u in x for s in (3, 0, 2, 1, 4, 5)]
    second = [(u, s, x[u][s]) for u in x for s in range(6, 12)] + [(1, 2, 99.0)]
    for rows in (first, second):
        batch(spark, source, rows)
        stream = streams.ema_stream(spark.readStream.schema(SCHEMA).parquet(source), 0.4, "user", watermark="1 day")
        drain(stream, target)
    got = spark.read.schema(streams.EMA_OUTPUT).parquet(target).orderBy("key", "seq").collect()
    for u in x:
        np.testing.assert_allclose([r["ema"] for r in got if r["key"] == u], folded(x[u], 0.4))
    assert max(r["late"] for r in got if r["key"] == 1) == 1
    assert max(r["late"] for r in got if r["key"] == 2) == 0


def test_history_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 0, 5.0), (1, 1, 6.0)], [(1, 2, 7.0), (1, 0, 99.0), (1, 3, 8.0), (1, 3, 98.0), (2, 1, 4.0)]):
        batch(spark, source, rows)
        drain(streams.history_stream(spark.readStream.schema(SCHEMA).parquet(source), 3, "user", watermark="1 day"), target)
    got = spark.read.schema(streams.HISTORY_OUTPUT).parquet(target).orderBy("key", "seq").collect()
    assert [r["hist"] for r in got] == [[5, 5, 5], [5, 5, 6], [5, 6, 7], [6, 7, 8], [4, 4, 4]]
    assert [r["late"] for r in got] == [0, 0, 1, 1, 0]


@pytest.mark.parametrize("alpha", [0.0, 1e-12, 0.3, 0.999999, 1.0])
def test_stream_recursion_in_pieces(rng, alpha):
    x = rng.normal(size=9000)
    np.testing.assert_allclose(streams._recursion(x, alpha, 2.0), folded(x, alpha, 2.0), rtol=1e-9, atol=1e-12)
    x[5000] = np.nan
    assert np.isnan(streams._recursion(x, alpha, 2.0)[5000 + (alpha == 1.0) * 4000 :]).all() or alpha == 1.0


def test_streams_of_neighbouring_keys_share_a_call(spark, tmp_path, rng):
    """Keys of one state go on by themselves over batches: values, late rows, keys without rows, far and missing ones."""
    source, name = str(tmp_path / "in"), str(tmp_path / "out")
    keys = [*range(-3, 40), 10**12, None]
    x = {u: rng.normal(size=6).tolist() for u in keys}
    late = {u: 0 for u in keys}
    calls = []

    def once(stream):
        calls.append(stream._jdf.queryExecution().analyzed().toString())
        return stream

    want = {u: [] for u in keys}
    for part in range(2):
        mine = [u for u in keys if u is None or part == 0 or u % 3]
        rows = [(u, part * 3 + s, x[u][part * 3 + s]) for u in mine for s in (2, 0, 1)]
        if part:
            rows.append((7, 1, 99.0))
            late[7] = 1
        batch(spark, source, rows)
        for kind, make in (("ema", lambda s: streams.ema_stream(s, 0.4, "user", watermark="1 day")), ("hist", lambda s: streams.history_stream(s, 3, "user", watermark="1 day"))):
            drain(once(make(spark.readStream.schema(SCHEMA).parquet(source))), f"{name}-{kind}")
        for u in mine:
            want[u] += x[u][part * 3 : part * 3 + 3]
    assert all("_group" in plan for plan in calls)
    for kind, schema in (("ema", streams.EMA_OUTPUT), ("hist", streams.HISTORY_OUTPUT)):
        got = {}
        for r in spark.read.schema(schema).parquet(f"{name}-{kind}").orderBy("seq").collect():
            got.setdefault(r["key"], []).append(r)
        assert set(got) == set(keys)
        for u in keys:
            assert max(r["late"] for r in got[u]) == late[u]
            if kind == "ema":
                np.testing.assert_allclose([r["ema"] for r in got[u]], folded(want[u], 0.4))
            else:
                line = [want[u][0]] * 2 + want[u]
                assert [r["hist"] for r in got[u]] == [line[k : k + 3] for k in range(len(want[u]))]


def test_silent_keys_expire_one_by_one(spark, tmp_path):
    """A key that stays silent begins anew, its neighbours in the same state go on."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 0, 4.0), (2, 0, 8.0)], [(1, 100, 4.0)], [(1, 101, 4.0)], [(1, 102, 4.0), (2, 102, 8.0)]):
        batch(spark, source, rows)
        drain(streams.ema_stream(spark.readStream.schema(SCHEMA).parquet(source), 0.5, "user", watermark="1 second", expiry_ms=20_000), target)
    got = spark.read.schema(streams.EMA_OUTPUT).parquet(target).orderBy("key", "seq").collect()
    assert [r["ema"] for r in got] == [2.0, 3.0, 3.5, 3.75, 4.0, 4.0]
