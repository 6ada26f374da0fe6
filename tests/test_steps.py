import numpy as np
import pytest
from conftest import grid, pixels
from pyspark.sql import functions as F
from test_stencils import jacobi, window

from driftgrid.operators import filling, metrics, normalize, pixels as px, resample, smoothing, validation
from driftgrid import tiles
from driftgrid.plans import estimators, evaluate, steps


@pytest.fixture
def field(spark, rng):
    u, v = rng.normal(size=(2, 10, 9)), rng.normal(size=(2, 10, 9))
    u[0, 4, 4] = 40
    return pixels(spark, u=u, v=v), u, v


CONTEXT = steps.Context((10, 9))


def chain(u, v, mask_mode):
    """The published field chain in NumPy."""
    out = []
    for fu, fv in zip(u, v):
        bad = np.zeros(fu.shape, bool)
        for f in (fu, fv):
            nb = np.delete(window(f, 2), 12, axis=-1)
            med = np.median(nb, axis=-1)
            bad |= np.abs(f - med) / (np.median(np.abs(nb - med[..., None]), axis=-1) + 1e-4) > 2.0
        valid = bad if mask_mode == "reference" else ~bad
        pair = []
        for f in (fu, fv):
            f = jacobi(f, valid, 512)
            for _ in range(4):
                f = np.median(window(f, 2), axis=-1)
            pair.append(window(f, 2, "edge").mean(axis=-1))
        out.append(pair)
    return np.array(out)


@pytest.mark.parametrize("mask_mode", ["intent", "reference"])
def test_published_field_chain(field, mask_mode):
    df, u, v = field
    got = steps.run_steps("field", df, steps.FIELD_CHAIN, steps.Context((10, 9), mask_mode=mask_mode))
    want = chain(u, v, mask_mode)
    np.testing.assert_allclose(grid(got, "u", u.shape), want[:, 0], atol=1e-9)
    np.testing.assert_allclose(grid(got, "v", u.shape), want[:, 1], atol=1e-9)


def test_chain_equals_its_steps(field):
    df, u, _ = field
    made = steps.run_steps(
        "field",
        df,
        [
            {"name": "constant_threshold_filter", "vel_min": 0.2, "vel_max": 3.0},
            {"name": "adaptive_global_filter", "n_sigma": 2.0},
            {"name": "adaptive_local_filter", "n_sigma": 2.0, "radius": 1},
            {"name": "tile_average_interpolation", "radius": 1},
            {"name": "gaussian_smoothing", "sigma": 0.6},
        ],
        CONTEXT,
    )
    t = df.withColumn("valid", F.lit(True))
    for find in (
        lambda d: validation.constant_threshold(d, 0.2, 3.0),
        lambda d: validation.adaptive_global(d, 2.0),
        lambda d: validation.adaptive_local(d, 2.0, 1),
    ):
        t = find(t).withColumn("valid", F.col("valid") & ~F.col("is_outlier")).drop("is_outlier")
    t = smoothing.gaussian(filling.tile_average(t, 1), 0.6)
    np.testing.assert_allclose(grid(made, "u", u.shape), grid(t, "u", u.shape))


def test_neighbouring_steps_share_an_exchange(field, monkeypatch):
    df, u, v = field
    four = [{"name": "median_smoothing", "radius": 2}] * 4 + [{"name": "average_smoothing", "radius": 2}]
    made = steps.run_steps("field", df, four, CONTEXT)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    # the same chain over tiles of 3 pixels, and with the halo used up after every second step
    monkeypatch.setattr(steps, "spread", lambda t, h, k: tiles.spread(t, h, k, 3))
    monkeypatch.setattr(steps, "own", lambda t: tiles.own(t, 3))
    small = steps.run_steps("field", df, four, CONTEXT)
    monkeypatch.setattr(steps, "MAX_HALO", 4)
    split = steps.run_steps("field", df, four, CONTEXT)
    want = []
    for f in u:
        for _ in range(4):
            f = np.median(window(f, 2), axis=-1)
        want.append(window(f, 2, "edge").mean(axis=-1))
    for got in (made, small, split):
        np.testing.assert_allclose(grid(got, "u", u.shape), np.stack(want), atol=1e-12)


def test_shape_follows_crop_and_resize(spark, rng):
    image = pixels(spark, i=rng.random((2, 20, 16)))
    got = steps.run_steps(
        "image",
        image,
        [
            {"name": "crop_special", "target_height": 12, "target_width": 10, "fraction_v": 0.0, "fraction_h": 1.0},
            {"name": "resize_image", "target_height": 6, "target_width": 9},
            {"name": "high_pass_filter", "sigma": 0.5},
            {"name": "intensity_clipping", "n": 2.0},
            {"name": "stretch_contrast"},
        ],
        steps.Context((20, 16)),
    )
    a = grid(got, "i", (2, 6, 9))
    assert np.isfinite(a).all() and a.min() == 0 and abs(a.max() - 1) < 1e-12


def test_every_image_step_runs(spark, rng):
    image = pixels(spark, i=rng.random((1, 16, 16)))
    for name, params in {"clahe": {"clip_limit": 0.02, "tile_grid_size": [4, 4], "nbins": 16}, "background_suppression": {"threshold": 0.1}}.items():
        a = grid(steps.run_steps("image", image, [{"name": name, **params}], steps.Context((16, 16))), "i", (1, 16, 16))
        assert np.isfinite(a).all() and a.min() >= 0 and a.max() <= 1 + 1e-9


BAD = [
    ("image", {"name": "unknown"}, ValueError),
    ("image", {"threshold": 1}, ValueError),
    ("image", "stretch_contrast", ValueError),
    ("image", {"name": "intensity_capping", "n": 0}, ValueError),
    ("image", {"name": "intensity_capping", "n": "2"}, TypeError),
    ("image", {"name": "intensity_clipping", "n": -1}, ValueError),
    ("image", {"name": "background_suppression", "threshold": -1.0}, ValueError),
    ("image", {"name": "clahe", "clip_limit": 0}, ValueError),
    ("image", {"name": "clahe", "tile_grid_size": (8,)}, ValueError),
    ("image", {"name": "high_pass_filter", "sigma": 0}, ValueError),
    ("image", {"name": "crop_special", "target_height": 0, "target_width": 3}, ValueError),
    ("image", {"name": "crop_special", "target_height": 3, "target_width": 3, "fraction_v": 1.5}, ValueError),
    ("image", {"name": "resize_image", "target_height": 2.5, "target_width": 3}, ValueError),
    ("field", {"name": "constant_threshold_filter", "vel_min": 2, "vel_max": 1}, ValueError),
    ("field", {"name": "adaptive_global_filter", "n_sigma": 0}, ValueError),
    ("field", {"name": "adaptive_local_filter", "n_sigma": 1, "radius": -1}, ValueError),
    ("field", {"name": "universal_median_test", "epsilon": 0}, ValueError),
    ("field", {"name": "tile_average_interpolation", "radius": 0}, ValueError),
    ("field", {"name": "laplace_interpolation", "num_iter": 0}, ValueError),
    ("field", {"name": "median_smoothing", "radius": 0}, ValueError),
    ("field", {"name": "average_smoothing", "radius": 1.0}, ValueError),
    ("field", {"name": "gaussian_smoothing", "sigma": -1}, ValueError),
    ("field", {"name": "quantize", "min_val": (0,), "max_val": (1, 1)}, ValueError),
    ("field", {"name": "quantize", "min_val": (0, 0), "max_val": (1, 1), "dtype": "int8"}, ValueError),
    ("field", {"name": "temporal_smoothing_ema", "alpha": 1.5}, ValueError),
    ("field", {"name": "temporal_smoothing_ema", "alpha": 1}, ValueError),
]


@pytest.mark.parametrize(("kind", "step", "error"), BAD, ids=str)
def test_bad_steps(kind, step, error):
    with pytest.raises(error):
        steps.validate_steps(kind, [step])


def test_an_inner_average_over_time_needs_the_previous_field(field):
    ema = {"name": "temporal_smoothing_ema", "alpha": 0.5}
    with pytest.raises(ValueError):
        steps.run_steps("field", field[0], [ema, {"name": "median_smoothing", "radius": 1}], CONTEXT)
    with pytest.raises(ValueError):
        steps.run_steps("field", field[0], [ema], CONTEXT)


def test_sequences_read_the_field_before(spark, rng):
    images = rng.normal(size=(2, 5, 7, 6))
    rows = [(s, t, y, x, float(images[s, t, y, x])) for s, t, y, x in np.ndindex(images.shape)]
    frames = spark.createDataFrame(rows, "seq_id long, t int, y int, x int, i double")

    def difference(pairs, shape, start=None, keys=("frame_id",)):
        out = pairs.select(*keys, "y", "x", (F.col("curr") - F.col("prev")).alias("u"), F.lit(1.0).alias("v"))
        if start is None:
            return out
        before = start.select(*keys, "y", "x", F.col("v").alias("_b"))
        return out.join(before, [*keys, "y", "x"]).withColumn("v", F.col("v") + F.col("_b")).drop("_b")

    estimators.register_estimator("difference", difference)
    try:
        chain_ = [{"name": "temporal_smoothing_ema", "alpha": 0.3}, {"name": "average_smoothing", "radius": 1}]
        got = evaluate.estimate_sequence({"estimator": "difference", "postprocess": chain_}, frames, (7, 6))
        for s in range(2):
            level = np.zeros((7, 6))
            for t in range(1, 5):
                level = window(0.3 * (images[s, t] - images[s, t - 1]) + 0.7 * level, 1, "edge").mean(axis=-1)
                now = got.where(f"t = {t}").withColumnRenamed("seq_id", "frame_id")
                np.testing.assert_allclose(grid(now, "u", (2, 7, 6))[s], level, atol=1e-12)
        # steps that do not depend on each other run as one job
        at_once = evaluate.estimate_sequence({"estimator": "difference", "postprocess": [{"name": "average_smoothing", "radius": 1}]}, frames, (7, 6))
        assert at_once.columns == got.columns and at_once.count() == got.count()
        for t in range(1, 5):
            now = at_once.where(f"t = {t}").withColumnRenamed("seq_id", "frame_id")
            np.testing.assert_allclose(grid(now, "u", (2, 7, 6)), [window(x, 1, "edge").mean(axis=-1) for x in images[:, t] - images[:, t - 1]], atol=1e-12)
        counted = evaluate.estimate_sequence({"estimator": "difference"}, frames, (7, 6), propagate=True)
        assert sorted({(r["t"], r["v"]) for r in counted.select("t", "v").collect()}) == [(t, float(t)) for t in range(1, 5)]
    finally:
        del estimators.ESTIMATORS["difference"]


def test_config_and_own_steps(field):
    df, u, _ = field
    steps.register_step("field", "negate", lambda t, c, by=1.0: t.withColumns({k: -by * F.col(k) for k in "uv"}), lambda by=1.0: None)
    try:
        image, chain_ = steps.chain_from_config({"postprocess": [{"name": "negate", "by": 2.0}], "jit": True})
        assert image == []
        np.testing.assert_allclose(grid(steps.run_steps("field", df, chain_, CONTEXT), "u", u.shape), -2 * u)
        with pytest.raises(ValueError):
            steps.chain_from_config({"preprocess": "file.yaml"})
    finally:
        del steps.FIELD_STEPS["negate"]


def test_own_estimator(spark, rng):
    pairs = pixels(spark, prev=rng.random((1, 4, 4)), curr=rng.random((1, 4, 4)))
    estimators.register_estimator(
        "constant", lambda p, shape, u=1.0, keys=("frame_id",): p.select(*keys, "y", "x", F.lit(u).alias("u"), F.lit(0.0).alias("v"))
    )
    try:
        members = [{"name": "constant", "u": 1.0}, {"name": "constant", "u": 2.0}, {"name": "dummy"}]
        for algorithm, want in (("mean", 1.0), ("median", 1.0)):
            got = estimators.estimate("consensus", pairs, (4, 4), estimators=members, algorithm=algorithm)
            np.testing.assert_allclose(grid(got, "u", (1, 4, 4)), want, atol=1e-6)
        with pytest.raises(ValueError):
            estimators.estimate("unknown", pairs, (4, 4))
        with pytest.raises(ValueError):
            estimators.estimate("consensus", pairs, (4, 4), estimators=members, algorithm="odd")
    finally:
        del estimators.ESTIMATORS["constant"]


def test_density_thresholds(spark):
    image = pixels(spark, i=np.array([[[0.0, 1.0], [2.0, 3.0]]]))
    for threshold, want in ((1, 0.5), (2, 0.25), (3, 0.0)):
        assert normalize.density_threshold(image, threshold).first()["density"] == want
    with pytest.raises(ValueError):
        normalize.density_threshold(image, 256)


def test_quantize_cuts_fractions_off(spark):
    field = pixels(spark, u=np.array([[[-5.0, 0.0, 0.5, 1.0, 9.0]]]), v=np.array([[[0.0, 0.999, 1.0, 0.5, 0.1]]]))
    got = px.quantize(field, (0, 0), (1, 1), "uint4").orderBy("x").collect()
    assert [r["u"] for r in got] == [0, 0, 7, 15, 15] and [r["v"] for r in got] == [0, 14, 15, 7, 1]


def test_configured_estimation(spark, rng):
    first = rng.random((2, 32, 32)) * 255
    pairs = pixels(spark, prev=first, curr=np.roll(first, (1, 2), axis=(1, 2)))
    config = {
        "estimator": "window_piv", "window_size": 16, "search_size": 16, "overlap": 8, "jit": True,
        "preprocess": [{"name": "crop_special", "target_height": 24, "target_width": 32}, {"name": "stretch_contrast"}],
        "postprocess": [{"name": "median_smoothing", "radius": 1}],
    }
    field = evaluate.estimate_field(config, pairs, (32, 32))
    u = grid(field, "u", (2, 24, 32))
    assert np.isfinite(u).all() and abs(np.median(u) - 2) < 0.3
    truth = pixels(spark, u=np.full((2, 24, 32), 2.0), v=np.ones((2, 24, 32)))
    row = evaluate.evaluate_field(config, pairs, truth, (32, 32)).first()
    assert row["frames"] == 2 and row["mean"] < 1.5
    same = evaluate.compare_configs(config, config, pairs, (32, 32)).first()
    assert same["mean"] == 0 and same["fraction_below_threshold"] == 1
    with pytest.raises(ValueError):
        evaluate.estimate_field({"estimator": "odd"}, pairs, (32, 32))
    with pytest.raises(ValueError):
        evaluate.estimate_field({**config, "postprocess": [{"name": "median_smoothing", "radius": 0}]}, pairs, (32, 32))


def test_missing_values_stay_missing(spark):
    """NULL and NaN are not replaced by a bound or by the pixel at a border."""
    nan = float("nan")
    image = spark.createDataFrame([(0, y, x, float(10 * y + x)) for y in range(3) for x in range(3)], "frame_id long, y int, x int, i double")
    field = spark.createDataFrame([(0, y, x, nan if (y, x) == (0, 1) else 0.0, None if (y, x) == (2, 2) else 0.0) for y in range(3) for x in range(3)], "frame_id long, y int, x int, u double, v double")
    back = {(r["y"], r["x"]): r["i"] for r in resample.warp_backward(image, field, (3, 3)).collect()}
    assert len(back) == 9 and back[0, 1] is None and back[2, 2] is None and back[1, 1] == 11.0
    forth = {(r["y"], r["x"]): r["i"] for r in resample.warp_forward(image, field, (3, 3)).collect()}
    assert len(forth) == 9 and forth[0, 1] == forth[2, 2] == 0.0 and forth[1, 1] == 11.0
    holes = image.withColumn("i", F.when(F.col("x") == 1, None).when(F.col("x") == 2, nan).otherwise(F.col("i")))
    for made in (px.background_suppression(holes, 5.0), normalize.stretch_contrast(holes)):
        found = made.collect()
        assert all(r["i"] is None for r in found if r["x"] == 1)
        assert all(r["i"] != r["i"] for r in found if r["x"] == 2)
    per_frame = metrics.frame_epe(metrics.paired(field, field.fillna(0.0))).first()
    assert (per_frame["mean_epe"], per_frame["missing"], per_frame["pixels"]) == (0.0, 2, 9)
    total = metrics.eval_dataset(field, field.fillna(0.0)).first()
    assert total["missing"] == 2 and total["coverage"] == pytest.approx(7 / 9)
