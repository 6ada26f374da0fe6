"""Neighbourhood operators against plain NumPy, with tiles smaller than the frames."""

import numpy as np
import pytest
from conftest import grid, pixels
from pyspark.sql import functions as F

from driftgrid.functions.columns import gaussian_weights
from driftgrid.operators import correlation, differential, filling, normalize, resample, smoothing, validation

SHAPES = [(2, 13, 9), (1, 1, 7), (1, 6, 1), (2, 3, 3)]
TILE = 4


def window(a, radius, mode="constant"):
    """(…, k*k) windows of a 2-D array."""
    p = np.pad(a, radius, mode=mode)
    k = 2 * radius + 1
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(k) for j in range(k)], axis=-1)


@pytest.fixture(params=SHAPES, ids=str)
def field(request, spark, rng):
    u, v = rng.normal(size=request.param), rng.normal(size=request.param)
    return pixels(spark, u=u, v=v), u, v


def check(df, columns, want, shape):
    for c, w in zip(columns, want):
        np.testing.assert_allclose(grid(df, c, shape), w, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("radius", [1, 2])
def test_median_smoothing(field, radius):
    df, u, v = field
    want = [np.stack([np.median(window(f, radius), axis=-1) for f in a]) for a in (u, v)]
    check(smoothing.median(df, radius, tile=TILE), "uv", want, u.shape)


@pytest.mark.parametrize("radius", [1, 3])
def test_average_smoothing_edge_padding(field, radius):
    df, u, v = field
    want = [np.stack([window(f, radius, "edge").mean(axis=-1) for f in a]) for a in (u, v)]
    check(smoothing.average(df, radius, tile=TILE), "uv", want, u.shape)


def test_gaussian_smoothing_zero_padding(field):
    df, u, v = field
    w = np.array(gaussian_weights(0.7))
    kernel = np.outer(w, w).ravel()
    want = [np.stack([window(f, len(w) // 2) @ kernel for f in a]) for a in (u, v)]
    check(smoothing.gaussian(df, 0.7, tile=TILE), "uv", want, u.shape)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_adaptive_local(field, radius):
    df, u, v = field
    m = np.sqrt(u * u + v * v)
    flags = []
    for f in m:
        w = window(f, radius)
        mean = w.mean(axis=-1)
        std = np.sqrt(np.maximum((w * w).mean(axis=-1) - mean**2, 0))
        flags.append((f < mean - 1.2 * std) | (f > mean + 1.2 * std))
    got = grid(validation.adaptive_local(df, 1.2, radius, tile=TILE).withColumn("o", F.col("is_outlier").cast("int")), "o", u.shape)
    if radius:
        np.testing.assert_array_equal(got, np.stack(flags))
    else:
        assert not got.any()


@pytest.mark.parametrize("radius", [1, 2])
def test_median_test_scores(field, radius):
    df, u, v = field
    centre = (2 * radius + 1) ** 2 // 2

    def score(f):
        nb = np.delete(window(f, radius), centre, axis=-1)
        med = np.median(nb, axis=-1)
        return np.abs(f - med) / (np.median(np.abs(nb - med[..., None]), axis=-1) + 0.1)

    want = [np.stack([score(f) for f in a]) for a in (u, v)]
    check(validation.median_scores(df, 0.1, radius, tile=TILE), ("score_u", "score_v"), want, u.shape)


def test_median_test_finds_a_spike(spark):
    u = np.zeros((1, 5, 5))
    u[0, 2, 2] = 10.0
    flagged = validation.median_test(pixels(spark, u=u, v=u)).where("is_outlier").select("y", "x").collect()
    assert [tuple(r) for r in flagged] == [(2, 2)]


def test_tile_average(field, rng):
    df, u, v = field
    valid = rng.random(u.shape) > 0.6
    table = pixels(df.sparkSession, u=u, v=v, valid=valid)
    got = filling.tile_average(table, 1, tile=TILE)
    for name, a in (("u", u), ("v", v)):
        want = []
        for f, ok in zip(a, valid):
            n = window(ok.astype(float), 1).sum(axis=-1)
            want.append(np.where(ok, f, window(f * ok, 1).sum(axis=-1) / np.maximum(n, 1)))
        np.testing.assert_allclose(grid(got, name, u.shape), np.stack(want), atol=1e-12)
    now = np.stack([window(ok.astype(float), 1).sum(axis=-1) > 0 for ok in valid])
    np.testing.assert_array_equal(grid(got.withColumn("ok", F.col("valid").cast("int")), "ok", u.shape), now)


def jacobi(f, ok, steps):
    for _ in range(steps):
        p = np.pad(f, 1, mode="edge")
        f = np.where(ok, f, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4)
    return f


@pytest.mark.parametrize(("halo", "tile"), [(2, 4), (3, 5), (4, 4), (8, 512)])
def test_laplace_is_the_same_for_every_tiling(field, rng, halo, tile):
    df, u, v = field
    valid = rng.random(u.shape) > 0.5
    table = pixels(df.sparkSession, u=u, v=v, valid=valid)
    got = filling.laplace(table, 9, halo, tile)
    want = [np.stack([jacobi(f, ok, 9) for f, ok in zip(a, valid)]) for a in (u, v)]
    check(got, "uv", want, u.shape)
    assert got.where("NOT valid").isEmpty()


@pytest.mark.parametrize("tile", [4, 512])
def test_neighbor_mean(field, rng, tile):
    df, u, v = field
    bad = rng.random(u.shape) > 0.5
    table = pixels(df.sparkSession, u=np.where(bad, np.nan, u), v=v, is_outlier=bad)
    got = filling.neighbor_mean(table, 5, 2, tile=tile)
    for name, a in (("u", np.where(bad, 0.0, u)), ("v", v)):
        want = []
        for f, b in zip(a, bad):
            for _ in range(5):
                f = np.where(b, (window(f, 2).sum(axis=-1) - f) / 24, f)
            want.append(f)
        np.testing.assert_allclose(grid(got, name, u.shape), np.stack(want), atol=1e-12)


def test_uniform_field_is_refilled(spark, rng):
    valid = rng.random((2, 16, 16)) > 0.1
    ones = np.ones((2, 16, 16))
    table = pixels(spark, u=np.where(valid, ones, 0), v=np.where(valid, ones, 0), valid=valid)
    np.testing.assert_allclose(grid(filling.tile_average(table, 2), "u", ones.shape), ones)


def test_high_pass_reflects(spark, rng):
    a = rng.normal(size=(2, 12, 11))
    w = np.array(gaussian_weights(1.0))
    want = np.stack([f - window(f, 4, "reflect") @ np.outer(w, w).ravel() for f in a])
    got = normalize.high_pass(pixels(spark, i=a), 1.0, (12, 11), tile=TILE)
    np.testing.assert_allclose(grid(got, "i", a.shape), want, atol=1e-12)
    flat = normalize.high_pass(pixels(spark, i=np.full((1, 12, 12), 5.0)), 1.0, (12, 12))
    np.testing.assert_allclose(grid(flat, "i", (1, 12, 12)), 0, atol=1e-12)
    with pytest.raises(ValueError):
        normalize.high_pass(pixels(spark, i=a), 3.0, (12, 11))


def test_sobel_and_structure_tensor(spark, rng):
    a = rng.normal(size=(2, 11, 7))
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    ix = np.stack([window(f, 1) @ kx.ravel() for f in a])
    iy = np.stack([window(f, 1) @ kx.T.ravel() for f in a])
    got = differential.sobel(pixels(spark, i=a), tile=TILE)
    check(got, ("ix", "iy"), (ix, iy), a.shape)
    tensor = differential.structure_tensor(pixels(spark, i=a), 3, tile=TILE)
    want = [np.stack([window(f, 1).mean(axis=-1) for f in p]) for p in (ix * ix, ix * iy, iy * iy)]
    check(tensor, ("jxx", "jxy", "jyy"), want, a.shape)


def test_derivatives(spark, rng):
    u, v = rng.normal(size=(2, 9, 10)), rng.normal(size=(2, 9, 10))
    df = pixels(spark, u=u, v=v)

    def inner(values):
        out = np.full(u.shape, np.nan)
        out[:, 1:-1, 1:-1] = values
        return out

    dx = lambda a: (a[:, 1:-1, 2:] - a[:, 1:-1, :-2]) / 2
    dy = lambda a: (a[:, 2:, 1:-1] - a[:, :-2, 1:-1]) / 2
    lap = lambda a: a[:, 1:-1, 2:] + a[:, 1:-1, :-2] + a[:, 2:, 1:-1] + a[:, :-2, 1:-1] - 4 * a[:, 1:-1, 1:-1]
    got = differential.div_vort(df, tile=TILE)
    check(got, ("div", "vort"), (inner(dx(u) + dy(v)), inner(dx(v) - dy(u))), u.shape)
    check(differential.laplacian(df, tile=TILE), ("u_lap", "v_lap"), (inner(lap(u)), inner(lap(v))), u.shape)


def bilinear(a, y, x, clamp):
    h, w = a.shape
    if clamp:
        y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
    y0, x0 = int(np.floor(y)), int(np.floor(x))

    def value(i, j):
        if clamp:
            return a[min(i, h - 1), min(j, w - 1)]
        return a[i, j] if 0 <= i < h and 0 <= j < w else 0.0

    wy, wx = y - y0, x - x0
    return (1 - wy) * ((1 - wx) * value(y0, x0) + wx * value(y0, x0 + 1)) + wy * (
        (1 - wx) * value(y0 + 1, x0) + wx * value(y0 + 1, x0 + 1)
    )


@pytest.mark.parametrize("pad", ["clamp", "zero"])
def test_sampling(spark, rng, pad):
    a = rng.normal(size=(2, 9, 6))
    yf, xf = rng.uniform(-3, 11, size=a.shape), rng.uniform(-3, 8, size=a.shape)
    yf[0, 0, :3], xf[0, 0, :3] = [-1.0, 8.0, 0.0], [-1.0, 5.0, -0.5]
    got = resample.sample(pixels(spark, yf=yf, xf=xf), pixels(spark, i=a), ["i"], (9, 6), pad, tile=TILE)
    want = np.vectorize(lambda f, y, x: bilinear(a[f], y, x, pad == "clamp"))(
        np.arange(2)[:, None, None] + np.zeros(a.shape, int), yf, xf
    )
    np.testing.assert_allclose(grid(got, "s_i", a.shape), want, atol=1e-12)


@pytest.mark.parametrize("new", [(4, 4), (9, 6), (20, 3), (1, 1)])
def test_resize(spark, rng, new):
    a = rng.normal(size=(2, 9, 6))
    got = resample.resize_bilinear(pixels(spark, i=a), ["i"], (9, 6), new, tile=TILE)
    want = np.array(
        [[[bilinear(f, (y + 0.5) * 9 / new[0] - 0.5, (x + 0.5) * 6 / new[1] - 0.5, True) for x in range(new[1])] for y in range(new[0])] for f in a]
    )
    np.testing.assert_allclose(grid(got, "i", (2, *new)), want, atol=1e-12)
    flat = resample.resize_antialias(pixels(spark, i=np.ones((1, 9, 6))), ["i"], (9, 6), new)
    np.testing.assert_allclose(grid(flat, "i", (1, *new)), 1.0)


def test_zero_flow_is_identity_and_mass_is_kept(spark, rng):
    a = rng.random((1, 8, 8))
    zero = pixels(spark, u=np.zeros_like(a), v=np.zeros_like(a))
    image = pixels(spark, i=a)
    np.testing.assert_allclose(grid(resample.warp_backward(image, zero, (8, 8)), "i", a.shape), a)
    np.testing.assert_allclose(grid(resample.warp_forward(image, zero, (8, 8)), "i", a.shape), a)
    a[:, [0, -1], :] = a[:, :, [0, -1]] = 0
    small = pixels(spark, u=rng.uniform(-1, 1, a.shape), v=rng.uniform(-1, 1, a.shape))
    moved = resample.warp_forward(pixels(spark, i=a), small, (8, 8))
    np.testing.assert_allclose(np.nansum(grid(moved, "i", a.shape)), a.sum())


def test_feature_correlation_and_pooling_commute(spark, rng):
    f1, f2 = rng.normal(size=(2, 6, 6, 2)), rng.normal(size=(2, 6, 6, 2))

    def table(f):
        return pixels(spark, a=f[..., 0], b=f[..., 1]).select("frame_id", "y", "x", F.array("a", "b").alias("f"))

    got = correlation.feature_correlation(table(f1), table(f2), 1, 2, tile=TILE)
    got = got.select("frame_id", "y", "x", F.posexplode("corr").alias("k", "c"))
    for k in range(9):
        dy, dx = k // 3 - 1, k % 3 - 1
        p = np.pad(f2, ((0, 0), (1, 1), (1, 1), (0, 0)))[:, 1 + dy : 7 + dy, 1 + dx : 7 + dx]
        np.testing.assert_allclose(grid(got.where(F.col("k") == k), "c", (2, 6, 6)), (f1 * p).sum(-1) / np.sqrt(2), atol=1e-12)
    pooled = correlation.pool_features(table(f2), 2, (6, 6)).withColumn("a", F.get("f", F.lit(0)))
    np.testing.assert_allclose(grid(pooled, "a", (2, 3, 3)), f2[..., 0].reshape(2, 3, 2, 3, 2).mean(axis=(2, 4)))


def test_one_exchange_per_stencil(spark, rng):
    df = pixels(spark, u=rng.normal(size=(1, 6, 6)), v=rng.normal(size=(1, 6, 6)))
    for out in (smoothing.median(df, 2), smoothing.average(df, 1), validation.adaptive_local(df, 1.5, 1), differential.div_vort(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan


def test_a_constant_field_has_no_local_outliers(spark):
    u = np.full((1, 7, 7), 0.3)
    flags = validation.adaptive_local(pixels(spark, u=u, v=u), 1.5, 1).where("is_outlier").select("y", "x").collect()
    assert all(r["y"] in (0, 6) or r["x"] in (0, 6) for r in flags)


def test_filters_and_columns_reach_the_files(spark, rng, tmp_path):
    from driftgrid.operators import pixels as px
    from driftgrid.sources import tables

    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    tables.write_pixels(pixels(spark, i=rng.random((2, 8, 8))), str(tmp_path / "p"))
    cropped = px.crop(tables.read_image(spark, str(tmp_path / "p")), (8, 8), 4, 4)
    plan = cropped._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,2)" in plan and "LessThanOrEqual(x,5)" in plan
    dense = normalize.density_threshold(tables.read_image(spark, str(tmp_path / "p")), 100)
    assert "ReadSchema: struct<frame_id:bigint,i:double>" in dense._jdf.queryExecution().executedPlan().toString()
