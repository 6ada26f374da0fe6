import numpy as np
import pyarrow as pa
import pytest
from conftest import grid, pixels
from pyspark.sql import functions as F

from driftgrid.functions import grids
from driftgrid.operators import admm, consensus


def ensemble(spark, flows, weights):
    """Rows of (frames, estimators, h, w, 2) fields and (frames, estimators, h, w) weights."""
    parts = [
        pixels(spark, u=flows[:, n, :, :, 0], v=flows[:, n, :, :, 1], w=weights[:, n]).withColumn("estimator", F.lit(n))
        for n in range(flows.shape[1])
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.fixture
def flows(rng):
    return rng.normal(size=(3, 3, 9, 8, 2)), rng.random((3, 3, 9, 8))


def loss(z, weights):
    """Regularisation loss of one (h, w, 2) field."""
    dx = (z[1:-1, 2:] - z[1:-1, :-2]) / 2
    dy = (z[2:, 1:-1] - z[:-2, 1:-1]) / 2
    lap = z[1:-1, 2:] + z[1:-1, :-2] + z[2:, 1:-1] + z[:-2, 1:-1] - 4 * z[1:-1, 1:-1]
    terms = {
        "smoothness": (dx**2 + dy**2).sum(),
        "divergence": ((dx[..., 0] + dy[..., 1]) ** 2).sum(),
        "tv": np.sqrt(dx**2 + dy**2 + 1e-4).sum(),
        "laplacian": (lap**2).sum(),
    }
    return sum(w * terms[n] for n, w in weights.items())


@pytest.mark.parametrize("name", consensus.REGULARIZERS)
def test_slopes_are_the_losses_derivatives(rng, name):
    z = rng.normal(size=(6, 7, 2))
    slope = admm.regularizer_slope(z, {name: 1.7})
    numeric = np.zeros_like(z)
    for at in np.ndindex(z.shape):
        up, down = z.copy(), z.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        numeric[at] = (loss(up, {name: 1.7}) - loss(down, {name: 1.7})) / 2e-6
    np.testing.assert_allclose(slope, numeric, atol=1e-6)


def twin(a, w, cfg):
    """The iteration on one frame, written out."""
    x = a.copy()
    z = a.mean(axis=0)
    d = x - z
    for it in range(cfg["max_admm_iterations"]):
        rho = cfg["rho"]
        if cfg.get("solver_flows", "closed_form_l2") == "closed_form_l2":
            x = (2 * w[..., None] * a + rho * (z - d)) / (2 * w[..., None] + rho)
        else:
            for _ in range(cfg["num_iterations_flows"]):
                x = x - cfg["learning_rate_flows"] * (2 * w[..., None] * (x - a) + rho * (x - z + d))
        new, m, s = z.copy(), np.zeros_like(z), np.zeros_like(z)
        for k in range(1, cfg["num_iterations_consensus"] + 1):
            g = rho * (new - x - d).sum(axis=0)
            if cfg.get("regularizer_list"):
                chosen = {n: cfg["regularizer_weights"][n] for n in cfg["regularizer_list"]}
                g = g + admm.regularizer_slope(new, chosen)
            if cfg["solver_consensus"] == "sgd":
                new = new - cfg["learning_rate_consensus"] * g
            else:
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                new = new - cfg["learning_rate_consensus"] * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        d = d + x - new
        if "eps_abs_stopping" in cfg:
            n, root, norm = len(a), np.sqrt(a.size), np.linalg.norm
            ea, er = cfg["eps_abs_stopping"], cfg.get("eps_rel_stopping", 0.0)
            primal, dual = norm(x - new), rho * np.sqrt(n) * norm(new - z)
            ok = primal <= root * ea + er * max(norm(x), np.sqrt(n) * norm(new)) and dual <= root * ea + er * rho * norm(d)
            if ok:
                return new, it
        z = new
    return z, None


BASE = {"rho": 2.0, "solver_consensus": "adam", "num_iterations_consensus": 4, "learning_rate_consensus": 0.05, "max_admm_iterations": 12}
STOP = {"eps_abs_stopping": 3e-2, "eps_rel_stopping": 1e-1}
REG = {"regularizer_list": ["smoothness", "divergence", "laplacian", "tv"], "regularizer_weights": {"smoothness": 0.3, "divergence": 2, "laplacian": 0.2, "tv": 0.1}}
ITERATED = {"solver_flows": "sgd", "num_iterations_flows": 3, "learning_rate_flows": 0.05}


@pytest.mark.parametrize("tile", [512, 1], ids=["whole", "tiled"])
@pytest.mark.parametrize("extra", [{}, STOP, {**STOP, **REG}, REG, {**ITERATED, "solver_consensus": "sgd"}, {**ITERATED, **REG}], ids=str)
def test_admm(spark, flows, extra, tile):
    cfg = {**BASE, **extra}
    if "regularizer_list" not in cfg and tile == 1:
        pytest.skip("without regularisers there is one way")
    if tile == 1:
        cfg["max_admm_iterations"] = 4
    f, w = flows
    f = f.copy()
    f[0] = f[0, :1] + 0.01 * f[0]  # a frame on which the estimators nearly agree stops early
    result = admm.consensus_admm(ensemble(spark, f, w), cfg, tile=tile)
    u, v = grid(result.field, "u", (3, 9, 8)), grid(result.field, "v", (3, 9, 8))
    stops = {r["frame_id"]: r for r in result.stops.collect()}
    for k in range(3):
        want, stop = twin(f[k], w[k], cfg)
        np.testing.assert_allclose(np.stack([u[k], v[k]], axis=-1), want, atol=1e-9)
        assert stops[k]["stop_iter"] == stop and stops[k]["stopped"] == (stop is not None)


def test_tiles_with_true_halos_agree_with_whole_frames(spark, rng):
    f, w = rng.normal(size=(1, 2, 140, 5, 2)), rng.random((1, 2, 140, 5))
    cfg = {**BASE, **REG, "max_admm_iterations": 2}
    table = ensemble(spark, f, w)
    whole = admm.consensus_admm(table, cfg).field
    tiled = admm.consensus_admm(table, cfg, tile=64).field
    np.testing.assert_allclose(grid(tiled, "u", (1, 140, 5)), grid(whole, "u", (1, 140, 5)), atol=1e-9)


@pytest.mark.parametrize(
    "bad",
    [
        {"rho": 0}, {"rho": "1"}, {"flows_objective_type": "l3"}, {"flows_objective_type": "l1"}, {"solver_flows": 3},
        {"num_iterations_flows": 2}, {"learning_rate_flows": 0.1}, {"solver_flows": "sgd", "num_iterations_flows": 0},
        {"regularizer_list": "tv"}, {"regularizer_list": ["tv"]}, {"regularizer_weights": {"tv": "x"}},
        {"regularizer_list": ["odd"], "regularizer_weights": {"odd": 1}}, {"num_iterations_consensus": -1},
        {"solver_consensus": "lbfgs"}, {"learning_rate_consensus": 1}, {"max_admm_iterations": 0},
        {"eps_abs_stopping": -1.0}, {"eps_rel_stopping": 1},
    ],
    ids=str,
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        admm.config_from(bad)


def test_one_tolerance_sets_the_other_to_zero():
    cfg = admm.config_from({"eps_abs_stopping": 1e-3})
    assert (cfg.eps_abs, cfg.eps_rel) == (1e-3, 0.0)
    assert admm.config_from({}).eps_abs is None


def test_mean_falls_back_to_equal_weights(spark):
    f = np.array([1.0, 5.0]).reshape(1, 2, 1, 1, 1) * np.ones((1, 2, 1, 2, 2))
    w = np.zeros((1, 2, 1, 2))
    w[0, :, 0, 1] = [3.0, 1.0]
    got = grid(consensus.consensus_mean(ensemble(spark, f, w)), "u", (1, 1, 2))
    np.testing.assert_allclose(got[0, 0], [3.0, 2.0], atol=1e-6)


def test_max_normalisation_splits_ties(spark):
    f = np.zeros((1, 3, 1, 1, 2))
    w = np.array([2.0, 2.0, 1.0]).reshape(1, 3, 1, 1)
    rows = consensus.normalize_weights(ensemble(spark, f, w), "max").orderBy("estimator").collect()
    np.testing.assert_allclose([r["w"] for r in rows], [0.5, 0.5, 0.0], atol=1e-6)


@pytest.mark.parametrize(
    "config",
    [{"weights_type": "odd"}, {"weights_type": "list"}, {"normalization": "odd"}, {"weights_type": "photometric", "patch_size": 4}, {"weights_type": "photograd", "patch_stride": 2}],
    ids=str,
)
def test_bad_weight_settings(spark, flows, config):
    with pytest.raises(ValueError):
        consensus.make_weights(ensemble(spark, *flows), config=config)


def test_mask_needs_an_oracle(spark, flows):
    table = ensemble(spark, *flows)
    with pytest.raises(ValueError):
        consensus.oracle_mask(table, table, 1.0, oracle=False)
    with pytest.raises(ValueError):
        consensus.oracle_mask(table, table, -1.0)


def test_short_weight_list_raises(spark):
    ensemble = spark.createDataFrame([(0, e, 0, 0, 1.0, 1.0) for e in range(3)], "frame_id long, estimator int, y int, x int, u double, v double")
    with pytest.raises(Exception, match="none for estimator 2"):
        consensus.weights_list(ensemble, [0.5, 0.5]).collect()
    assert [r["w"] for r in consensus.weights_list(ensemble, [1.0, 2.0, 3.0]).orderBy("estimator").collect()] == [1.0, 2.0, 3.0]


def test_weight_table(spark, flows):
    fields, weights = flows
    rows = ensemble(spark, fields, weights)
    table = rows.select("frame_id", "estimator", "y", "x", F.col("w") * 2)
    table = table.toDF("frame_id", "estimator", "y", "x", "w")
    bare = rows.drop("w").withColumn("extra", F.lit("kept"))
    far = table.where("frame_id = 0").withColumn("frame_id", F.lit(99).cast("long"))  # no such frame: ignored
    got = consensus.weights_table(bare, table.unionByName(far))
    assert got.columns == [*bare.columns, "w"] and got.count() == rows.count()
    both = got.alias("a").join(rows.alias("b"), ["frame_id", "estimator", "y", "x"])
    assert both.where("abs(a.w - 2 * b.w) > 1e-12 OR a.extra <> 'kept'").count() == 0
    normal = consensus.normalize_weights(got, "per_pixel")
    fused = consensus.consensus_mean(normal)
    assert fused._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("harm", ["lacking", "repeated", "null"])
def test_weight_table_must_be_complete(spark, flows, harm):
    fields, weights = flows
    rows = ensemble(spark, fields, weights)
    table = rows.select("frame_id", "estimator", "y", "x", "w")
    one = "frame_id = 1 AND estimator = 2 AND y = 3 AND x = 4"
    if harm == "lacking":
        table = table.where(f"NOT ({one})")
    elif harm == "repeated":
        table = table.unionByName(table.where(one))
    else:
        table = table.withColumn("w", F.when(F.expr(f"NOT ({one})"), F.col("w")))
    with pytest.raises(Exception, match="where one is needed: frame_id=1, estimator=2, y=3, x=4"):
        consensus.weights_table(rows.drop("w"), table).collect()


def test_total_regularization_reads_pixels_once(spark, rng):
    z = rng.normal(size=(2, 9, 8, 2))
    field = pixels(spark, u=z[..., 0], v=z[..., 1])
    weights = {"smoothness": 0.3, "divergence": 2.0, "laplacian": 0.5, "tv": 0.1}
    total = consensus.total_regularization(field, weights, tile=4)
    plan = total._jdf.queryExecution().executedPlan().toString()
    for row in total.collect():
        assert row["loss"] == pytest.approx(loss(z[row["frame_id"]], weights))
    assert plan.count("Exchange hashpartitioning") == 2  # pixels to tiles, then one partial sum per frame
    assert {r["loss"] for r in consensus.total_regularization(field, {}).collect()} == {0.0}


def test_frames_of_a_batch_are_solved_in_bounded_runs(rng):
    """What a task holds beyond its batch does not grow with the frames in it; every frame comes once, as in one go."""
    frames, side, count = 700, 8, 3
    y, x = (np.tile(a.ravel(), frames).astype(np.int32) for a in np.indices((side, side)))
    offsets = pa.array(np.arange(frames + 1, dtype=np.int32) * side * side)
    inner = pa.array(np.arange(len(y) + 1, dtype=np.int32) * count)
    values = {c: rng.normal(size=len(y) * count) for c in ("au", "av", "w")}
    columns = {"y": pa.ListArray.from_arrays(offsets, pa.array(y)), "x": pa.ListArray.from_arrays(offsets, pa.array(x))}
    columns |= {c: pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(inner, pa.array(v))) for c, v in values.items()}
    batch = pa.RecordBatch.from_pydict(columns)
    parts = list(admm._frame_stacks(batch))
    assert len(parts) > 1 and max(a.size for _, _, a, _ in parts) <= grids.STACK_CELLS
    assert np.concatenate([rows for rows, *_ in parts]).tolist() == list(range(frames))
    whole = np.stack([values["au"], values["av"]], axis=-1).reshape(frames, side * side, count, 2)
    np.testing.assert_array_equal(np.concatenate([a for _, _, a, _ in parts]), whole)
    np.testing.assert_array_equal(np.concatenate([w for *_, w in parts])[..., 0].ravel(), values["w"])
    many = pa.RecordBatch.from_pydict({**{c: columns[c] for c in "yx"}, "i": pa.ListArray.from_arrays(offsets, pa.array(values["w"][: len(y)]))})
    tiles = [t for k in range(8) for t in grids.stacks(many, ["i"])]
    assert sum(len(t.rows) for t in tiles) == 8 * frames and max(t.grids["i"].size for t in tiles) <= grids.STACK_CELLS
