"""Patch operators against plain NumPy."""

import numpy as np
import pytest
from conftest import grid, pixels
from pyspark.sql import functions as F
from test_stencils import bilinear

from driftgrid.operators import correlation, patches, search

P, HALF = 5, 2


def sampled(image, yc, xc, size):
    half = size // 2
    return np.array([[bilinear(image, yc + dy, xc + dx, False) for dx in range(-half, half + 1)] for dy in range(-half, half + 1)])


def sobel(a):
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]) / 8
    p = np.pad(a, 1)
    shifted = lambda m: sum(m[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3))
    return shifted(k), shifted(k.T)


def features(image, size, stride):
    """Templates per centre: value, gradients, inverse Hessian."""
    half, (h, w) = size // 2, image.shape
    ny, nx = search.centre_counts(image.shape, size, stride)
    big = np.pad(image, 4 * size)
    gx, gy = sobel(big)
    o = 4 * size
    out = {}
    for r in range(ny):
        for c in range(nx):
            cut = (slice(o + r * stride - half, o + r * stride + half + 1), slice(o + c * stride - half, o + c * stride + half + 1))
            ix, iy = gx[cut], gy[cut]
            sxx, sxy, syy = (ix * ix).sum(), (ix * iy).sum(), (iy * iy).sum()
            det = sxx * syy - sxy * sxy + 1e-4
            out[r * nx + c] = (r * stride, c * stride, big[cut], ix, iy, syy / det, -sxy / det, sxx / det)
    return out


def searched(curr, patch, u0, v0, iterations, size):
    cy, cx, tpl, ix, iy, h00, h01, h11 = patch
    u, v = u0, v0
    for _ in range(iterations):
        gap = sampled(curr, cy + v, cx + u, size) - tpl
        bx, by = (ix * gap).sum(), (iy * gap).sum()
        u, v = u - (h00 * bx + h01 * by), v - (h01 * bx + h11 * by)
    if np.hypot(u - u0, v - v0) > size:
        u, v = u0, v0
    return u, v, tpl - sampled(curr, cy + v, cx + u, size)


def smooth_pair(rng, shape):
    """A smooth random image and itself moved by (1, 2)."""
    big = rng.normal(size=(shape[0] + 20, shape[1] + 20))
    for _ in range(3):
        big = (big + np.roll(big, 1, 0) + np.roll(big, -1, 0) + np.roll(big, 1, 1) + np.roll(big, -1, 1)) / 5
    big *= 100
    return big[10:-10, 10:-10][: shape[0], : shape[1]], big[9:-9, 8:-8][: shape[0], : shape[1]]


def test_patch_features(spark, rng):
    image = rng.normal(size=(14, 11))
    rows = search.patch_features(pixels(spark, i=image[None]), P, 3, (14, 11), tile=4).collect()
    want = features(image, P, 3)
    assert {r["patch_id"] for r in rows} == set(want)
    for r in rows:
        cy, cx, tpl, ix, iy, *inverse = want[r["patch_id"]]
        assert (r["cy"], r["cx"]) == (cy, cx)
        for name, value in (("tpl", tpl), ("gx", ix), ("gy", iy)):
            np.testing.assert_allclose(r[name], value.ravel(), atol=1e-12)
        np.testing.assert_allclose([r["h00"], r["h01"], r["h11"]], inverse, rtol=1e-9)


@pytest.mark.parametrize(("tile", "halo"), [(128, 32), (4, 4), (8, 5)])
def test_patch_search_for_every_tiling(spark, rng, tile, halo):
    prev, curr = smooth_pair(rng, (18, 21))
    f = search.patch_features(pixels(spark, i=prev[None]), P, 4, prev.shape)
    starts = f.withColumns({"u0": (F.col("patch_id") % 3).cast("double") * 4 - 4, "v0": (F.col("patch_id") % 5).cast("double") * 3 - 6})
    rows = search.patch_search(pixels(spark, i=curr[None]), starts, 4, P, prev.shape, tile=tile, halo=halo).collect()
    want = features(prev, P, 4)
    assert sorted(r["patch_id"] for r in rows) == sorted(want)
    for r in rows:
        k = r["patch_id"]
        u, v, err = searched(curr, want[k], k % 3 * 4.0 - 4, k % 5 * 3.0 - 6, 4, P)
        np.testing.assert_allclose([r["u"], r["v"]], [u, v], atol=1e-6)
        np.testing.assert_allclose(r["err"], err.ravel(), atol=1e-5)


def dense(found, size, shape):
    half = size // 2
    total, weight = np.zeros((*shape, 2)), np.zeros(shape)
    for (cy, cx), (u, v, err) in found.items():
        w = 1 / np.maximum(1, np.abs(err))
        for dy in range(-half, half + 1):
            for dx in range(-half, half + 1):
                y, x = cy + dy, cx + dx
                if 0 <= y < shape[0] and 0 <= x < shape[1]:
                    total[y, x] += w[dy + half, dx + half] * np.array([u, v])
                    weight[y, x] += w[dy + half, dx + half]
    return total / weight[..., None]


def queried(found, size, reach, qy, qx):
    half, total, weight = reach // 2, np.zeros(2), 0.0
    for (cy, cx), (u, v, err) in found.items():
        iy, ix = qy - cy + half, qx - cx + half
        if 0 <= iy <= 2 * half and 0 <= ix <= 2 * half:
            w = 1 / max(1, abs(err[min(iy, size - 1), min(ix, size - 1)]))
            total, weight = total + w * np.array([u, v]), weight + w
    return total / weight if weight else np.zeros(2)


def resized(a, shape):
    h, w = a.shape
    return np.array([[bilinear(a, (y + 0.5) * h / shape[0] - 0.5, (x + 0.5) * w / shape[1] - 0.5, True) for x in range(shape[1])] for y in range(shape[0])])


def test_coarse_to_fine(spark, rng):
    prev, curr = smooth_pair(rng, (20, 24))
    got = search.coarse_to_fine(pixels(spark, i=prev[None]), pixels(spark, i=curr[None]), prev.shape, 2, 3, P, 3)
    found = None
    for shape in ((10, 12), (20, 24)):
        a, b = resized(prev, shape), resized(curr, shape)
        now = {}
        for cy, cx, *rest in features(a, P, 3).values():
            u0 = v0 = 0.0
            if found is not None:
                scaled = {(y * 2, x * 2): value for (y, x), value in found.items()}
                u0, v0 = queried(scaled, P, (P // 2) * 2 * 2 + 1, cy, cx) * 2
            now[cy, cx] = searched(b, (cy, cx, *rest), u0, v0, 3, P)
        found = now
    want = dense(found, P, prev.shape)
    np.testing.assert_allclose(grid(got, "u", (1, 20, 24))[0], want[..., 0], atol=1e-5)
    np.testing.assert_allclose(grid(got, "v", (1, 20, 24))[0], want[..., 1], atol=1e-5)
    # the pair was moved by one row and two columns
    inner = want[6:-6, 6:-6]
    assert abs(np.median(inner[..., 0]) - 2) < 0.5 and abs(np.median(inner[..., 1]) - 1) < 0.5


def test_coarse_to_fine_with_refinement_and_half_resolution(spark, rng):
    prev, curr = smooth_pair(rng, (24, 24))
    f = search.coarse_to_fine(
        pixels(spark, i=prev[None]), pixels(spark, i=curr[None]), prev.shape, 2, 3, P, 3, start_level=1, refine_iters=2
    )
    u = grid(f, "u", (1, 24, 24))
    assert np.isfinite(u).all() and abs(np.median(u) - 2) < 1


@pytest.mark.parametrize(("dy", "dx"), [(1, 0), (0, 2), (2, 3), (-1, 1), (40, 0)])
def test_photometric_error_of_a_moved_ramp(spark, dy, dx):
    ramp = np.add.outer(np.arange(12.0) * 3, np.arange(13.0))
    moved = np.zeros_like(ramp)
    ys, xs = np.meshgrid(range(12), range(13), indexing="ij")
    ok = (ys - dy >= 0) & (ys - dy < 12) & (xs - dx >= 0) & (xs - dx < 13)
    moved[ok] = ramp[(ys - dy)[ok], (xs - dx)[ok]]
    field = pixels(spark, u=np.full((1, 12, 13), float(dy)), v=np.full((1, 12, 13), float(dx)))
    got = search.photometric_error(pixels(spark, i=ramp[None]), pixels(spark, i=moved[None]), field, 3, (12, 13), tile=4)
    err = grid(got, "err", (1, 12, 13))[0]
    assert np.isnan(err[0]).all() and np.isnan(err[:, -1]).all()
    inner = err[1:-1, 1:-1]
    whole = ok[np.clip(ys + dy, 0, 11), np.clip(xs + dx, 0, 12)] & (ys + dy + 1 < 12) & (xs + dx + 1 < 13) & (ys + dy >= 1) & (xs + dx >= 1)
    np.testing.assert_allclose(inner[whole[1:-1, 1:-1]], 0, atol=1e-9)
    other = search.photometric_error(
        pixels(spark, i=ramp[None]), pixels(spark, i=moved[None]), field.select("frame_id", "y", "x", F.col("v").alias("u"), F.col("u").alias("v")), 3, (12, 13), component_order="xy"
    )
    np.testing.assert_allclose(grid(other, "err", (1, 12, 13))[0], err)


@pytest.mark.parametrize("size", [3, 5])
def test_photometric_error_against_sampling(spark, rng, size):
    a, b = rng.normal(size=(10, 9)), rng.normal(size=(10, 9))
    u, v = rng.uniform(-4, 4, (10, 9)), rng.uniform(-14, 4, (10, 9))
    got = search.photometric_error(pixels(spark, i=a[None]), pixels(spark, i=b[None]), pixels(spark, u=u[None], v=v[None]), size, (10, 9), True, tile=4)
    half = size // 2
    err = grid(got, "err", (1, 10, 9))[0]
    for y in range(half, 10 - half):
        for x in range(half, 9 - half):
            gap = a[y - half : y + half + 1, x - half : x + half + 1] - sampled(b, y + u[y, x], x + v[y, x], size)
            np.testing.assert_allclose(err[y, x], (gap**2).sum(), rtol=1e-9)


def test_window_correlation_finds_the_shift(spark, rng):
    first = rng.random((4, 32, 32)) * 255
    second = np.roll(first, (1, 2), axis=(1, 2))
    pair = pixels(spark, prev=first, curr=second).withColumnRenamed("frame_id", "pair_id")
    rows = correlation.window_vectors(pair, (32, 32), 16, 16, 8).collect()
    assert len(rows) == 4 * 9
    for r in rows:
        assert abs(r["u"] - 2) < 0.5 and abs(r["v"] - 1) < 0.5
    dense = correlation.piv_field(pair, (32, 32), 16, 16, 8)
    assert dense.count() == 4 * 32 * 32


def test_flat_windows_have_no_vector(spark):
    flat = np.full((1, 16, 16), 3.0)
    pair = pixels(spark, prev=flat, curr=flat).withColumnRenamed("frame_id", "pair_id")
    row = correlation.window_vectors(pair, (16, 16), 16, 16, 8).collect()
    assert len(row) == 1 and row[0]["u"] is None and row[0]["v"] is None


def test_fold_restores_an_image(spark, rng):
    image = rng.random((2, 14, 14))
    cut = patches.windows(pixels(spark, i=image), ["i"], (14, 14), 6, 4)
    np.testing.assert_allclose(grid(patches.fold_blend(cut, ["i"], 6, 4), "i", image.shape), image)


def test_taper_is_symmetric_with_mean_one():
    for size in (4, 7, 12, 32):
        w = patches.taper_weights(size)
        np.testing.assert_allclose(w, w[::-1])
        assert abs(np.mean(w) - 1) < 1e-12


def test_uncovered_pixels_have_no_vector(spark):
    rows = [(0, 0, 3, 3, 1.5, -0.5, [0.0] * 9)]
    sparse = spark.createDataFrame(rows, "frame_id long, patch_id int, cy int, cx int, u double, v double, err array<double>")
    got = search.densify(sparse, pixels(spark, i=np.zeros((1, 7, 7))), 3, (7, 7))
    u = grid(got, "u", (1, 7, 7))[0]
    assert got.count() == 49 and np.isfinite(u).sum() == 9 and (u[2:5, 2:5] == 1.5).all()
