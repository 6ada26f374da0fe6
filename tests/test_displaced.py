"""Patch differences at displaced places against plain sampling, for every way a vector can point."""

import re

import numpy as np
import pytest
from conftest import grid, pixels
from pyspark.sql import functions as F
from test_search import dense, sampled, smooth_pair, sobel
from test_stencils import bilinear

from driftgrid.operators import consensus, correlation, displaced, search

SHAPE = (19, 17)


def expected(a, b, u, v, size):
    half, (h, w) = size // 2, a.shape
    out = np.full(a.shape, np.nan)
    for y in range(half, h - half):
        for x in range(half, w - half):
            if np.isfinite(u[y, x]) and np.isfinite(v[y, x]):
                gap = a[y - half : y + half + 1, x - half : x + half + 1] - sampled(b, y + u[y, x], x + v[y, x], size)
                out[y, x] = (gap**2).sum()
    return out


@pytest.fixture
def scene(rng):
    a, b = rng.normal(size=SHAPE), rng.normal(size=SHAPE)
    u, v = rng.uniform(-25, 25, SHAPE), rng.uniform(-25, 25, SHAPE)
    u[:, :6], v[:, :6] = rng.uniform(-1, 1, (2, SHAPE[0], 6))
    u[5, 5] = np.nan
    u[6, 6] = 1e12
    return a, b, u, v


@pytest.mark.parametrize(("size", "tile", "meet"), [(3, 4, 20), (7, 8, 1 << 19), (7, 128, 1 << 19), (1, 4, 1)])
def test_error_for_every_tiling(spark, scene, monkeypatch, size, tile, meet):
    monkeypatch.setattr(displaced, "MEET", meet)
    monkeypatch.setattr(displaced, "AT_ONCE", 10)
    a, b, u, v = scene
    field = pixels(spark, u=u[None], v=v[None])
    field = field.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("u", "v")}).withColumn("note", F.col("x") * 2)
    got = displaced.with_patch_error(field, pixels(spark, i=a[None]), pixels(spark, i=b[None]), size, SHAPE, True, tile=tile, halo=1)
    assert got.count() == SHAPE[0] * SHAPE[1] and got.where("note <> x * 2").isEmpty()
    np.testing.assert_allclose(grid(got, "err", (1, *SHAPE))[0], expected(a, b, u, v, size), rtol=1e-9, atol=1e-9)
    half = size // 2
    assert got.where("err IS NULL").count() == SHAPE[0] * SHAPE[1] - (SHAPE[0] - 2 * half) * (SHAPE[1] - 2 * half) + 1


def test_energy_and_several_estimators(spark, scene):
    a, b, u, v = scene
    u, v = np.nan_to_num(u), np.nan_to_num(v)
    one, two = pixels(spark, u=u[None], v=v[None]), pixels(spark, u=v[None] / 9, v=u[None] / 9)
    ensemble = consensus.stack([one, two])
    got = displaced.with_patch_error(ensemble, pixels(spark, i=a[None]), pixels(spark, i=b[None]), 3, SHAPE, True, energy=True, tile=5, halo=3)
    ix, iy = sobel(a)
    power = ix**2 + iy**2
    power[[0, -1]] = power[:, [0, -1]] = 0
    energy = sum(np.pad(power, 1)[i : i + SHAPE[0], j : j + SHAPE[1]] for i in range(3) for j in range(3))
    for k, (du, dv) in enumerate(((u, v), (v / 9, u / 9))):
        mine = got.where(F.col("estimator") == k)
        np.testing.assert_allclose(grid(mine, "err", (1, *SHAPE))[0], expected(a, b, du, dv, 3), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(grid(mine, "g", (1, *SHAPE))[0], energy, rtol=1e-9, atol=1e-9)


def test_frames_without_an_image(spark, scene):
    a, b, *_ = scene
    still = np.zeros((2, *SHAPE))
    field = pixels(spark, u=still, v=still)
    first, second = pixels(spark, i=np.stack([a, a])), pixels(spark, i=b[None])
    got = displaced.with_patch_error(field, first, second, 3, SHAPE, True)
    err = grid(got, "err", (2, *SHAPE))
    np.testing.assert_allclose(err[0, 4, 4], ((a - b)[3:6, 3:6] ** 2).sum())
    np.testing.assert_allclose(err[1, 4, 4], (a[3:6, 3:6] ** 2).sum())
    assert displaced.with_patch_error(field, second, first, 3, SHAPE).select("frame_id").distinct().count() == 1


def test_only_single_numbers_are_shuffled(spark, scene):
    """Below every exchange, in both rounds, there are no arrays."""
    a, b, u, v = scene
    field = pixels(spark, u=np.nan_to_num(u)[None], v=np.nan_to_num(v)[None])
    first, second = pixels(spark, i=a[None]), pixels(spark, i=b[None])
    schemas = []
    stored = displaced.durable
    try:
        displaced.durable = lambda df: (schemas.append(df), stored(df))[1]
        schemas.append(displaced.with_patch_error(field, first, second, 7, SHAPE, tile=4, halo=1))
    finally:
        displaced.durable = stored
    assert len(schemas) >= 3
    for df in schemas:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search("CoGroupedMap|FlatMapCoGroups|Aggregate", plan)
        assert "array<" not in plan and not any(t.startswith("array") for _, t in df.dtypes)


@pytest.mark.parametrize(("tile", "halo"), [(128, 32), (4, 5), (8, 5)])
def test_search_from_heads_is_search_with_templates(spark, rng, tile, halo):
    """Templates cut where the patches are give the same as templates brought along, also for patches that move far."""
    prev, curr = smooth_pair(rng, (18, 21))
    first, second = pixels(spark, i=prev[None]), pixels(spark, i=curr[None])
    begun = {"u0": (F.col("patch_id") % 3).cast("double") * 4 - 4, "v0": (F.col("patch_id") % 5).cast("double") * 3 - 6}
    brought = search.patch_features(first, 5, 4, prev.shape).withColumns(begun)
    heads = search.patch_heads(first, 5, 4, prev.shape).withColumns(begun)
    one = {r.patch_id: r for r in search.patch_search(second, brought, 4, 5, prev.shape, tile=tile, halo=halo).collect()}
    two = {r.patch_id: r for r in search.patch_search(second, heads, 4, 5, prev.shape, tile=tile, halo=halo, prev=first).collect()}
    assert set(one) == set(two) and len(one) == brought.count()
    for k, r in one.items():
        np.testing.assert_allclose([r.u, r.v, *r.err], [two[k].u, two[k].v, *two[k].err], atol=1e-9)


@pytest.mark.parametrize(("shape", "stride"), [((14, 11), 3), ((9, 8), 7), ((5, 16), 4)])
def test_features_for_every_tiling(spark, rng, shape, stride):
    image = pixels(spark, i=rng.normal(size=shape)[None])
    whole = {r.patch_id: r for r in search.patch_features(image, 5, stride, shape).collect()}
    parts = {r.patch_id: r for r in search.patch_features(image, 5, stride, shape, tile=4).collect()}
    heads = {(r.patch_id, r.cy, r.cx) for r in search.patch_heads(image, 5, stride, shape).collect()}
    assert heads == {(r.patch_id, r.cy, r.cx) for r in whole.values()} and set(whole) == set(parts)
    for k, r in whole.items():
        for name in ("tpl", "gx", "gy", "h00", "h01", "h11"):
            np.testing.assert_allclose(r[name], parts[k][name], atol=1e-12)


@pytest.mark.parametrize(("tile", "overlap"), [(8, 4), (20, 3), (128, 0)])
def test_windows_for_every_tiling(spark, rng, tile, overlap):
    shape = (37, 30)
    first, second = rng.random((2, *shape)), rng.random((2, *shape))
    pair = pixels(spark, prev=first, curr=second).withColumnRenamed("frame_id", "pair_id")
    found = correlation.window_correlation(pair, shape, 6, 8, overlap, tile=tile)
    assert str(found._jdf.queryExecution().executedPlan().toString()).count("Exchange") == 1
    rows, step = found.collect(), 8 - overlap
    assert len(rows) == 2 * ((37 - 8) // step + 1) * ((30 - 8) // step + 1) == len({r[:3] for r in rows})
    for r in rows:
        cut = (r.pair_id, slice(r.wy * step, r.wy * step + 8), slice(r.wx * step, r.wx * step + 8))
        np.testing.assert_allclose(r.corr, correlation.correlate(first[cut][None], second[cut][None], 6).ravel(), atol=1e-12)


@pytest.mark.parametrize("tile", [3, 128])
def test_densify_and_samples_for_every_tiling(spark, rng, tile, monkeypatch):
    monkeypatch.setattr(displaced, "MEET", 7)
    shape, size = (11, 9), 5
    found = {(int(y), int(x)): (*rng.normal(size=2), rng.normal(size=(size, size)) * 3) for y, x in rng.integers(-2, 13, (12, 2))}
    rows = [(0, y, x, float(u), float(v), e.ravel().tolist()) for (y, x), (u, v, e) in found.items()]
    sparse = spark.createDataFrame(rows, "frame_id long, cy int, cx int, u double, v double, err array<double>")
    image = rng.normal(size=(2, *shape))
    got = search.densify(sparse, pixels(spark, i=image), size, shape, tile=tile)
    assert got.count() == 2 * 99 and got.where("frame_id = 1 AND u IS NOT NULL").isEmpty()
    with np.errstate(invalid="ignore"):
        want = dense(found, size, shape)
    for k, c in enumerate("uv"):
        np.testing.assert_allclose(grid(got.where("frame_id = 0"), c, (1, *shape))[0], want[..., k], atol=1e-12)
    points = [(k % 2, float(y), float(x), k) for k, (y, x) in enumerate(rng.uniform(-9, 20, (30, 2)))] + [(0, None, 1.0, 99)]
    table = spark.createDataFrame(points, "frame_id long, yc double, xc double, note int")
    for p in (3, 4):
        got = search.sample_patch(table, pixels(spark, i=image), p, shape, tile=tile).collect()
        assert len(got) == 31 * p * p
        for r in got:
            if r.yc is None:
                assert r.value is None
                continue
            assert abs(r.value - bilinear(image[r.frame_id], r.yc + r.py - p // 2, r.xc + r.px - p // 2, False)) < 1e-9
