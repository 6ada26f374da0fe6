"""Queries on single images and fields, metrics and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgrid.functions.columns import magnitude, mix, rounded
from driftgrid.operators import differential, filling, metrics, normalize, pixels, replay, resample, sequences, smoothing, validation
from driftgrid.plans.oracle import around, bilinear_clamped, bilinear_zero, r6, relaxed_sql, resize_sql, sobel_sql, sql
from driftgrid.plans.registry import query
from driftgrid.sources import adapters as A
from driftgrid.sources import tables
from driftgrid.scale import shared_folder

FYX = ("frame_id", "y", "x")


def out(df, *values, keys=FYX):
    """Keys as they are, values rounded for comparison."""
    return df.select(*keys, *[rounded(v).alias(v) for v in values])


# --- sources ----------------------------------------------------------------


@query("scan_frames", sql("image8", f"SELECT frame_id, count(*) AS pixels, {r6('sum(i)', 'total')} FROM image8 GROUP BY frame_id"))
def _(s, d):
    g = A.image8(s, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("i").alias("total"))
    return out(g, "total", keys=("frame_id", "pixels"))


@query(
    "batch_assign",
    """WITH p AS (SELECT vec_id AS pair_id, (vec_id * 2654435761 + 5 * 40503) % 4294967296 AS m FROM embeddings),
       k AS (SELECT pair_id, row_number() OVER (ORDER BY m, pair_id) - 1 AS rk FROM p)
       SELECT pair_id, e::INT AS epoch, rk // 32 AS batch_id, (rk % 32) // 8 AS draw FROM k CROSS JOIN range(2) r(e)""",
)
def _(s, d):
    pairs = A.vectors(s, d).select(F.col("vec_id").alias("pair_id"))
    return tables.assign_batches(pairs, 32, 8, seed=5, loops=2)


@query("drop_padding", sql("sequence8", "SELECT seq_id, count(*) AS n FROM sequence8 WHERE NOT is_padding GROUP BY seq_id"))
def _(s, d):
    return pixels.drop_padding(A.sequence8(s, d)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query("select_truth", sql("truth8", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM truth8"))
def _(s, d):
    density = normalize.density_threshold(A.image8(s, d), 100)
    return out(tables.select_truth("flow", A.truth8(s, d), density), "u", "v")




def _pairs(s, d):
    return metrics.paired(A.field8(s, d), A.truth8(s, d))


_EPE = "sqrt((u - tu) ** 2 + (v - tv) ** 2)"


@query(
    "metrics_union",
    sql(
        "pairs8 image8",
        f"""SELECT NULL::DOUBLE AS density, frame_id, {r6(f'avg({_EPE})', 'mean_epe')} FROM pairs8 GROUP BY frame_id
        UNION ALL SELECT {r6('avg(CASE WHEN i > 128 THEN 1.0 ELSE 0.0 END)')}, frame_id, NULL FROM image8 GROUP BY frame_id""",
    ),
)
def _(s, d):
    flow = out(metrics.frame_epe(_pairs(s, d)), "mean_epe", keys=("frame_id",))
    density = out(normalize.density_threshold(A.image8(s, d), 128), "density", keys=("frame_id",))
    return tables.metrics_union([flow, density])


_FRAME_EPE = ("fe", f"SELECT frame_id, avg({_EPE}) AS e FROM pairs8 GROUP BY frame_id")


@query(
    "run_log_append",
    sql(
        "pairs8",
        f"""SELECT r AS run_id, count(*) AS frames, {r6('avg(e)', 'mean')}, {r6('max(e)', 'max')}, {r6('min(e)', 'min')}
        FROM fe, (SELECT unnest(['first', 'second']) AS r) GROUP BY r""",
        _FRAME_EPE,
    ),
)
def _(s, d):
    import uuid

    path = f"{shared_folder(s)}/runs-{uuid.uuid4().hex}"
    result = metrics.eval_dataset(A.field8(s, d), A.truth8(s, d))
    for run in ("first", "second"):
        tables.run_log_append(result, run, path)
    return out(tables.read_run_log(s, path), "mean", "max", "min", keys=("run_id", "frames"))


@query(
    "metrics_long",
    sql(
        "pairs8",
        f"""SELECT frame_id, 'epe/max' AS name, {r6(f'max({_EPE})', 'value')} FROM pairs8 GROUP BY frame_id
        UNION ALL SELECT frame_id, 'epe/mean', {r6(f'avg({_EPE})')} FROM pairs8 GROUP BY frame_id""",
    ),
)
def _(s, d):
    e = metrics.epe()
    wide = _pairs(s, d).groupBy("frame_id").agg(F.struct(F.avg(e).alias("mean"), F.max(e).alias("max")).alias("epe"))
    return out(tables.metrics_long(wide, ["frame_id"]), "value", keys=("frame_id", "name"))


@query("decimate", sql("mosaic32", f"SELECT frame_id, y // 4 AS y, x // 4 AS x, {r6('i', 'i')} FROM mosaic32 WHERE y % 4 = 0 AND x % 4 = 0"))
def _(s, d):
    return out(pixels.decimate(A.mosaic32(s, d), 4), "i")


# --- pixels -----------------------------------------------------------------


@query("background_suppression", sql("image8", f"SELECT frame_id, y, x, {r6('greatest(i - 120, 0.0)', 'i')} FROM image8"))
def _(s, d):
    return out(pixels.background_suppression(A.image8(s, d), 120.0), "i")


@query(
    "crop",
    sql("mosaic32", f"SELECT frame_id, y - 4 AS y, x - 12 AS x, {r6('i', 'i')} FROM mosaic32 WHERE y BETWEEN 4 AND 27 AND x BETWEEN 12 AND 31"),
)
def _(s, d):
    return out(pixels.crop(A.mosaic32(s, d), A.LARGE, 24, 20, 0.5, 1.0), "i")


@query("magnitude", sql("field8", f"SELECT frame_id, y, x, {r6('sqrt(u * u + v * v)', 'mag')} FROM field8"))
def _(s, d):
    return out(pixels.with_magnitude(A.field8(s, d)), "mag")


@query(
    "magnitude_normalized",
    sql(
        "field8",
        f"""SELECT frame_id, y, x, {r6('least(greatest((m - lo) / (hi - lo), 0.0), 1.0)', 'mag')} FROM g
        JOIN (SELECT frame_id, min(m) + 1e-6 AS lo, max(m) + 1e-6 AS hi FROM g GROUP BY frame_id) USING (frame_id)""",
        ("g", "SELECT *, sqrt(u * u + v * v) AS m FROM field8"),
    ),
)
def _(s, d):
    return out(pixels.normalized_magnitude(A.field8(s, d)), "mag")


def _code(c: str, lo: float, hi: float) -> str:
    return f"floor(least(greatest(({c} - ({lo})) / ({hi} - ({lo}) + 1e-22), 0.0), 1.0) * 255)::SMALLINT AS {c}"


@query("quantize", sql("field8", f"SELECT frame_id, y, x, {_code('u', -2.0, 2.0)}, {_code('v', -1.5, 1.0)} FROM field8"))
def _(s, d):
    return pixels.quantize(A.field8(s, d), (-2.0, -1.5), (2.0, 1.0)).select(*FYX, "u", "v")


@query("nonzero_frames", sql("image8", "SELECT frame_id, max(CASE WHEN i > 200 THEN i ELSE 0 END <> 0) AS nonzero FROM image8 GROUP BY frame_id"))
def _(s, d):
    bright = A.image8(s, d).withColumn("i", F.when(F.col("i") > 200, F.col("i")).otherwise(0.0))
    return pixels.nonzero_frames(bright)


# --- per-frame normalisation ------------------------------------------------

_STATS = (
    "st",
    "SELECT frame_id, min(i) AS lo, max(i) AS hi, median(i) AS med, stddev_pop(i) AS sd FROM image8 GROUP BY frame_id",
)


@query(
    "stretch_contrast",
    sql("image8", f"SELECT frame_id, y, x, {r6('least(greatest((i - lo) / (hi - lo + 1e-22), 0.0), 1.0)', 'i')} FROM image8 JOIN st USING (frame_id)", _STATS),
)
def _(s, d):
    return out(normalize.stretch_contrast(A.image8(s, d)), "i")


@query("intensity_capping", sql("image8", f"SELECT frame_id, y, x, {r6('least(i, med + 1.1 * sd)', 'i')} FROM image8 JOIN st USING (frame_id)", _STATS))
def _(s, d):
    return out(normalize.intensity_capping(A.image8(s, d), 1.1), "i")


@query(
    "intensity_clipping",
    sql("image8", f"SELECT frame_id, y, x, {r6('least(greatest(i, med - 1.5 * sd), med + 1.5 * sd)', 'i')} FROM image8 JOIN st USING (frame_id)", _STATS),
)
def _(s, d):
    return out(normalize.intensity_clipping(A.image8(s, d), 1.5), "i")


_REGION, _COUNT = 8, 4
_NEAR = ", ".join(
    f"least(greatest(floor(({a} + 0.5) / 8 - 0.5) + {k}, 0), 3)::INT AS g{a}{k}" for a in "yx" for k in (0, 1)
)


@query(
    "clahe",
    sql(
        "mosaic32",
        f"""SELECT b.frame_id, b.y, b.x, {r6(
            '(1 - fy) * (1 - fx) * c00.l + (1 - fy) * fx * c01.l + fy * (1 - fx) * c10.l + fy * fx * c11.l', 'i')}
        FROM near b {' '.join(f'JOIN cdf c{p}{q} ON c{p}{q}.frame_id = b.frame_id AND c{p}{q}.gy = b.gy{p} AND c{p}{q}.gx = b.gx{q} AND c{p}{q}.bin = b.bin' for p in (0, 1) for q in (0, 1))}""",
        ("mm", "SELECT frame_id, min(i) AS lo, max(i) AS hi FROM mosaic32 GROUP BY frame_id"),
        (
            "b0",
            """SELECT frame_id, y, x, least(floor((i - lo) / (hi - lo + 1e-22) * 32), 31)::INT AS bin
            FROM mosaic32 JOIN mm USING (frame_id)""",
        ),
        ("hist", "SELECT frame_id, y // 8 AS gy, x // 8 AS gx, bin, count(*) AS n FROM b0 GROUP BY ALL"),
        (
            "bars",
            """SELECT t.frame_id, t.gy, t.gx, k::INT AS bin, coalesce(h.n, 0)::DOUBLE AS n
            FROM (SELECT DISTINCT frame_id, gy, gx FROM hist) t CROSS JOIN range(32) r(k)
            LEFT JOIN hist h ON h.frame_id = t.frame_id AND h.gy = t.gy AND h.gx = t.gx AND h.bin = k""",
        ),
        (
            "excess",
            "SELECT frame_id, gy, gx, greatest(64 * 0.05, 1.0) AS lim, sum(greatest(n - greatest(64 * 0.05, 1.0), 0)) / 32 AS share FROM bars GROUP BY ALL",
        ),
        (
            "cdf",
            """SELECT frame_id, gy, gx, bin, sum(least(n, lim) + share) OVER (PARTITION BY frame_id, gy, gx ORDER BY bin) / 64 AS l
            FROM bars JOIN excess USING (frame_id, gy, gx)""",
        ),
        (
            "near",
            f"""SELECT *, {_NEAR}, (y + 0.5) / 8 - 0.5 - floor((y + 0.5) / 8 - 0.5) AS fy,
            (x + 0.5) / 8 - 0.5 - floor((x + 0.5) / 8 - 0.5) AS fx FROM b0""",
        ),
    ),
)
def _(s, d):
    return out(normalize.clahe(A.mosaic32(s, d), A.LARGE, 0.05, (8, 8), 32), "i")


def _gauss(sigma: float, truncate: float = 4.0) -> str:
    radius = int(truncate * sigma + 0.5)
    return f"""SELECT dy, dx, exp(-(dy * dy + dx * dx) / {2 * sigma * sigma!r}) /
        sum(exp(-(dy * dy + dx * dx) / {2 * sigma * sigma!r})) OVER () AS w
        FROM (SELECT unnest(range({-radius}, {radius + 1})) AS dy) CROSS JOIN (SELECT unnest(range({-radius}, {radius + 1})) AS dx)"""


@query(
    "high_pass",
    sql(
        "mosaic32",
        f"""SELECT a.frame_id, a.y, a.x, {r6('any_value(a.i) - sum(k.w * b.i)', 'i')}
        FROM mosaic32 a CROSS JOIN k JOIN mosaic32 b ON b.frame_id = a.frame_id
          AND b.y = 31 - abs(31 - abs(a.y + k.dy)) AND b.x = 31 - abs(31 - abs(a.x + k.dx))
        GROUP BY a.frame_id, a.y, a.x""",
        ("k", _gauss(1.0)),
    ),
)
def _(s, d):
    return out(normalize.high_pass(A.mosaic32(s, d), 1.0, A.LARGE), "i")


@query("density_threshold", sql("image8", f"SELECT frame_id, {r6('avg(CASE WHEN i > 100 THEN 1.0 ELSE 0.0 END)', 'density')} FROM image8 GROUP BY frame_id"))
def _(s, d):
    return out(normalize.density_threshold(A.image8(s, d), 100), "density", keys=("frame_id",))


# --- validation -------------------------------------------------------------

FLAG = (*FYX, "is_outlier")


@query("outlier_constant", sql("field8", "SELECT frame_id, y, x, sqrt(u * u + v * v) NOT BETWEEN 0.3 AND 2.0 AS is_outlier FROM field8"))
def _(s, d):
    return validation.constant_threshold(A.field8(s, d), 0.3, 2.0).select(*FLAG)


_MAG = ("g", "SELECT *, sqrt(u * u + v * v) AS m FROM spiky8")


@query(
    "outlier_global",
    sql("spiky8", "SELECT frame_id, y, x, m < a - 1.5 * sd OR m > a + 1.5 * sd AS is_outlier FROM g, (SELECT avg(m) AS a, stddev_pop(m) AS sd FROM g)", _MAG),
)
def _(s, d):
    return validation.adaptive_global(A.field8_spiky(s, d), 1.5).select(*FLAG)


@query(
    "outlier_global_frame",
    sql(
        "spiky8",
        """SELECT frame_id, y, x, m < a - 1.5 * sd OR m > a + 1.5 * sd AS is_outlier
        FROM g JOIN (SELECT frame_id, avg(m) AS a, stddev_pop(m) AS sd FROM g GROUP BY frame_id) USING (frame_id)""",
        _MAG,
    ),
)
def _(s, d):
    return validation.adaptive_global(A.field8_spiky(s, d), 1.5, "frame").select(*FLAG)


@query(
    "outlier_local",
    sql(
        "spiky8",
        """SELECT frame_id, y, x, m < mean - 1.5 * sqrt(greatest(ss / 9 - mean * mean, 0)) OR m > mean + 1.5 * sqrt(greatest(ss / 9 - mean * mean, 0)) AS is_outlier
        FROM (SELECT frame_id, y, x, sum(m) / 9 AS mean, sum(m * m) AS ss FROM nb GROUP BY ALL) JOIN g USING (frame_id, y, x)""",
        _MAG,
        ("nb", around("g", "m", 1)),
    ),
)
def _(s, d):
    return validation.adaptive_local(A.field8_spiky(s, d), 1.5, 1).select(*FLAG)


def _median_scores(radius: int, eps: float):
    return (
        ("nb", f"SELECT * FROM ({around('spiky8', 'u v', radius)}) WHERE dy <> 0 OR dx <> 0"),
        ("md", "SELECT frame_id, y, x, median(u) AS mu, median(v) AS mv FROM nb GROUP BY ALL"),
        (
            "ms",
            f"""SELECT frame_id, y, x, median(abs(u - mu)) + {eps} AS ru, median(abs(v - mv)) + {eps} AS rv
            FROM nb JOIN md USING (frame_id, y, x) GROUP BY ALL""",
        ),
        (
            "sc",
            """SELECT frame_id, y, x, abs(u - mu) / ru AS su, abs(v - mv) / rv AS sv
            FROM spiky8 JOIN md USING (frame_id, y, x) JOIN ms USING (frame_id, y, x)""",
        ),
    )


@query("outlier_median_test", sql("spiky8", "SELECT frame_id, y, x, su > 2 OR sv > 2 AS is_outlier FROM sc", *_median_scores(2, 0.1)))
def _(s, d):
    return validation.median_test(A.field8_spiky(s, d), 2.0, 0.1, 2).select(*FLAG)


@query(
    "median_test_scores",
    sql("spiky8", f"SELECT frame_id, y, x, {r6('su', 'score_u')}, {r6('sv', 'score_v')} FROM sc", *_median_scores(1, 0.1)),
)
def _(s, d):
    return out(validation.median_scores(A.field8_spiky(s, d), 0.1, 1), "score_u", "score_v")


# --- filling and smoothing --------------------------------------------------


@query(
    "fill_tile_average",
    sql(
        "valid8",
        f"""SELECT frame_id, y, x, {r6('CASE WHEN valid THEN u ELSE su / greatest(n, 1) END', 'u')},
        {r6('CASE WHEN valid THEN v ELSE sv / greatest(n, 1) END', 'v')}, valid OR n > 0 AS valid
        FROM valid8 JOIN (SELECT frame_id, y, x, sum(ok) AS n, sum(ok * u) AS su, sum(ok * v) AS sv FROM nb GROUP BY ALL) USING (frame_id, y, x)""",
        ("ok8", "SELECT *, valid::INT AS ok FROM valid8"),
        ("nb", around("ok8", "ok u v", 1, None)),
    ),
)
def _(s, d):
    return out(filling.tile_average(A.field8_valid(s, d), 1), "u", "v", keys=FYX + ("valid",)).select(*FYX, "u", "v", "valid")


def _jacobi(rounds: int):
    steps = []
    last = "valid8"
    for k in range(rounds):
        means = ", ".join(
            f"""CASE WHEN any_value(a.valid) THEN any_value(a.{c}) ELSE sum(b.{c}) / 4 END AS {c}""" for c in ("u", "v")
        )
        steps.append(
            (
                f"j{k}",
                f"""SELECT a.frame_id, a.y, a.x, {means}, any_value(a.valid) AS valid
            FROM {last} a CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)
            JOIN {last} b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + o.dy, 0), 7) AND b.x = least(greatest(a.x + o.dx, 0), 7)
            GROUP BY a.frame_id, a.y, a.x""",
            )
        )
        last = f"j{k}"
    return steps, last


_J, _JLAST = _jacobi(4)


@query("fill_laplace", sql("valid8", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM {_JLAST}", *_J))
def _(s, d):
    return out(filling.laplace(A.field8_valid(s, d), 4, 4), "u", "v")


@query("fill_laplace_512", sql("valid8", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM rl", *relaxed_sql("valid8", 512)))
def _(s, d):
    return out(filling.laplace(A.field8_valid(s, d), 512, 128), "u", "v")


def _ring(rounds: int, radius: int):
    size = (2 * radius + 1) ** 2 - 1
    steps, last = [], "valid8"
    for k in range(rounds):
        steps.append((f"n{k}", f"SELECT frame_id, y, x, sum(u) / {size} AS mu, sum(v) / {size} AS mv FROM ({around(last, 'u v', radius)}) WHERE dy <> 0 OR dx <> 0 GROUP BY ALL"))
        steps.append(
            (
                f"m{k}",
                f"""SELECT frame_id, y, x, CASE WHEN valid THEN u ELSE mu END AS u, CASE WHEN valid THEN v ELSE mv END AS v, valid
            FROM {last} JOIN n{k} USING (frame_id, y, x)""",
            )
        )
        last = f"m{k}"
    return steps, last


_N, _NLAST = _ring(3, 1)


@query("fill_neighbor_mean", sql("valid8", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM {_NLAST}", *_N))
def _(s, d):
    flagged = A.field8_valid(s, d).withColumn("is_outlier", ~F.col("valid"))
    return out(filling.neighbor_mean(flagged, 3, 1), "u", "v")


@query(
    "smooth_gaussian",
    sql(
        "field8",
        f"SELECT frame_id, y, x, {r6('sum(w * u)', 'u')}, {r6('sum(w * v)', 'v')} FROM ({around('field8', 'u v', 3)}) JOIN k USING (dy, dx) GROUP BY ALL",
        ("k", _gauss(0.8)),
    ),
)
def _(s, d):
    return out(smoothing.gaussian(A.field8(s, d), 0.8), "u", "v")


@query(
    "smooth_average",
    sql(
        "field8",
        f"""SELECT a.frame_id, a.y, a.x, {r6('avg(b.u)', 'u')}, {r6('avg(b.v)', 'v')}
        FROM field8 a CROSS JOIN range(-2, 3) r1(dy) CROSS JOIN range(-2, 3) r2(dx)
        JOIN field8 b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7)
        GROUP BY a.frame_id, a.y, a.x""",
    ),
)
def _(s, d):
    return out(smoothing.average(A.field8(s, d), 2), "u", "v")


@query("smooth_median", sql("field8", f"SELECT frame_id, y, x, {r6('median(u)', 'u')}, {r6('median(v)', 'v')} FROM ({around('field8', 'u v', 2)}) GROUP BY ALL"))
def _(s, d):
    return out(smoothing.median(A.field8(s, d), 2), "u", "v")


# --- resampling -------------------------------------------------------------


@query("resize_bilinear", sql("mosaic32", f"SELECT frame_id, y, x, {r6('i', 'i')} FROM ({resize_sql('mosaic32', 'i', (32, 32), (20, 45))})"))
def _(s, d):
    return out(resample.resize_bilinear(A.mosaic32(s, d), ["i"], A.LARGE, (20, 45)), "i")


@query(
    "resize_antialias",
    sql(
        "mosaic32",
        f"SELECT m.frame_id, a.o AS y, b.o AS x, {r6('sum(a.w * b.w * m.i)', 'i')} FROM mosaic32 m JOIN ay a ON a.i = m.y JOIN ax b ON b.i = m.x GROUP BY ALL",
        *(
            (
                f"a{axis}",
                f"""SELECT o::INT AS o, i::INT AS i, w / sum(w) OVER (PARTITION BY o) AS w FROM (
                SELECT o, i, greatest(0, 1 - abs(i - ((o + 0.5) * {32 / n!r} - 0.5)) / {max(32 / n, 1.0)!r}) AS w FROM range({n}) r1(o) CROSS JOIN range(32) r2(i)) WHERE w > 0""",
            )
            for axis, n in (("y", 12), ("x", 40))
        ),
    ),
)
def _(s, d):
    return out(resample.resize_antialias(A.mosaic32(s, d), ["i"], A.LARGE, (12, 40)), "i")


@query("upsample_field", sql("field8", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM ({resize_sql('field8', 'u v', (8, 8), (20, 24))})"))
def _(s, d):
    from driftgrid.operators.correlation import upsample_field

    return out(upsample_field(A.field8(s, d), (8, 8), (20, 24)), "u", "v")


_AT = ("spots", "SELECT frame_id, y, x, y + v AS yf, x + u AS xf FROM mfield32")


def _points(s, d):
    f = A.mosaic_field32(s, d)
    return f.select(*FYX, (F.col("y") + F.col("v")).alias("yf"), (F.col("x") + F.col("u")).alias("xf"))


@query("sample_bilinear", sql("mosaic32 mfield32", f"SELECT frame_id, y, x, {r6('s_i', 's_i')} FROM ({bilinear_clamped('mosaic32', 'spots', (32, 32))})", _AT))
def _(s, d):
    return out(resample.sample(_points(s, d), A.mosaic32(s, d), ["i"], A.LARGE), "s_i")


@query("sample_bilinear_zero", sql("mosaic32 mfield32", f"SELECT frame_id, y, x, {r6('s', 's_i')} FROM ({bilinear_zero('mosaic32', 'spots')})", _AT))
def _(s, d):
    scaled = _points(s, d).withColumns({f"g{a}": F.col(f"{a}f") * 2.0 / 31.0 - 1.0 for a in "yx"}).drop("yf", "xf")
    return out(resample.sample_normalized(scaled, A.mosaic32(s, d), ["i"], A.LARGE), "s_i")


_BACK = ("back", "SELECT frame_id, y, x, y - v AS yf, x - u AS xf FROM mfield32")


@query("warp_backward", sql("mosaic32 mfield32", f"SELECT frame_id, y, x, {r6('s_i', 'i')} FROM ({bilinear_clamped('mosaic32', 'back', (32, 32))})", _BACK))
def _(s, d):
    return out(resample.warp_backward(A.mosaic32(s, d), A.mosaic_field32(s, d), A.LARGE), "i")


_GONE = "(y * 32 + x + frame_id) % 37 = 0"


@query(
    "warp_backward_missing",
    sql("mosaic32 mfield32", f"SELECT frame_id, y, x, CASE WHEN {_GONE} THEN NULL ELSE {r6('s_i')} END AS i FROM ({bilinear_clamped('mosaic32', 'back', (32, 32))})", _BACK),
)
def _(s, d):
    """Pixels without a vector (NULL in u, NaN in v) have no value."""
    gone = F.expr(_GONE)
    field = A.mosaic_field32(s, d).select(*FYX, F.when(~gone | (F.col("y") % 2 == 1), F.col("u")).alias("u"), F.when(gone, F.lit(float("nan"))).otherwise(F.col("v")).alias("v"))
    return out(resample.warp_backward(A.mosaic32(s, d), field, A.LARGE), "i")


_SPLAT = (
    ("mv", "SELECT m.frame_id, m.i, m.y + f.v AS yf, m.x + f.u AS xf FROM mosaic32 m JOIN mfield32 f USING (frame_id, y, x)"),
    (
        "dep",
        """SELECT frame_id, (floor(yf) + dy)::INT AS y, (floor(xf) + dx)::INT AS x,
        i * (CASE dy WHEN 0 THEN 1 - (yf - floor(yf)) ELSE yf - floor(yf) END) * (CASE dx WHEN 0 THEN 1 - (xf - floor(xf)) ELSE xf - floor(xf) END) AS d
        FROM mv CROSS JOIN range(2) r1(dy) CROSS JOIN range(2) r2(dx)""",
    ),
    ("warped", "SELECT m.frame_id, m.y, m.x, coalesce(sum(d), 0.0) AS i FROM mosaic32 m LEFT JOIN dep USING (frame_id, y, x) GROUP BY ALL"),
)


@query("warp_forward", sql("mosaic32 mfield32", f"SELECT frame_id, y, x, {r6('i', 'i')} FROM warped", *_SPLAT))
def _(s, d):
    return out(resample.warp_forward(A.mosaic32(s, d), A.mosaic_field32(s, d), A.LARGE), "i")


@query(
    "gather",
    sql(
        "mosaic32",
        f"SELECT p.frame_id, p.y, p.x, {r6('m.i', 'i')} FROM mosaic32 p JOIN mosaic32 m ON m.frame_id = p.frame_id AND m.y = (p.y * 7 + p.x) % 40 AND m.x = 31 - p.x",
    ),
)
def _(s, d):
    m = A.mosaic32(s, d)
    points = m.select(*FYX, ((F.col("y") * 7 + F.col("x")) % 40).alias("py"), (31 - F.col("x")).alias("px"))
    return out(resample.gather(points, m, ["i"]), "i")


@query(
    "pyramid",
    sql(
        "mosaic32",
        " UNION ALL ".join(
            f"SELECT frame_id, {lvl} AS level, y, x, {r6('i', 'i')} FROM ({resize_sql('mosaic32', 'i', (32, 32), (n, n))})" for lvl, n in ((0, 8), (1, 16), (2, 32))
        ),
    ),
)
def _(s, d):
    return out(resample.pyramid(A.mosaic32(s, d), A.LARGE, 3), "i", keys=("frame_id", "level", "y", "x"))


@query("mean_pool2", sql("mosaic32", f"SELECT frame_id, y // 2 AS y, x // 2 AS x, {r6('avg(i)', 'i')} FROM mosaic32 GROUP BY ALL"))
def _(s, d):
    return out(resample.mean_pool2(A.mosaic32(s, d), ["i"], A.LARGE), "i")


# --- differential operators -------------------------------------------------

_NB = ("nb", around("field8", "u v", 1, None))


def _d(c: str, axis: str) -> str:
    other = "dx" if axis == "dy" else "dy"
    return f"sum(CASE WHEN {other} = 0 THEN {axis} * {c} END) / 2"


_GRAD = (
    "gr",
    f"""SELECT frame_id, y, x, {_d('u', 'dx')} AS u_dx, {_d('u', 'dy')} AS u_dy, {_d('v', 'dx')} AS v_dx, {_d('v', 'dy')} AS v_dy
    FROM nb WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY ALL""",
)


@query("gradients", sql("field8", f"SELECT frame_id, y, x, {', '.join(r6(c, c) for c in ('u_dx', 'u_dy', 'v_dx', 'v_dy'))} FROM gr", _NB, _GRAD))
def _(s, d):
    return out(differential.gradients(A.field8(s, d)), "u_dx", "u_dy", "v_dx", "v_dy")


@query("div_vort", sql("field8", f"SELECT frame_id, y, x, {r6('u_dx + v_dy', 'div')}, {r6('v_dx - u_dy', 'vort')} FROM gr", _NB, _GRAD))
def _(s, d):
    return out(differential.div_vort(A.field8(s, d)), "div", "vort")


_LAP = (
    "lp",
    """SELECT frame_id, y, x, sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN u WHEN dy = 0 AND dx = 0 THEN -4 * u END) AS u_lap,
    sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN v WHEN dy = 0 AND dx = 0 THEN -4 * v END) AS v_lap
    FROM nb WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY ALL""",
)


@query("laplacian", sql("field8", f"SELECT frame_id, y, x, {r6('u_lap', 'u_lap')}, {r6('v_lap', 'v_lap')} FROM lp", _NB, _LAP))
def _(s, d):
    return out(differential.laplacian(A.field8(s, d)), "u_lap", "v_lap")


_SOBEL = ("sb", sobel_sql("mosaic32"))


@query("sobel", sql("mosaic32", f"SELECT frame_id, y, x, {r6('ix', 'ix')}, {r6('iy', 'iy')} FROM sb", _SOBEL))
def _(s, d):
    return out(differential.sobel(A.mosaic32(s, d)), "ix", "iy")


@query(
    "structure_tensor",
    sql(
        "mosaic32",
        f"SELECT frame_id, y, x, {r6('sum(ix * ix) / 25', 'jxx')}, {r6('sum(ix * iy) / 25', 'jxy')}, {r6('sum(iy * iy) / 25', 'jyy')} FROM ({around('sb', 'ix iy', 2)}) GROUP BY ALL",
        _SOBEL,
    ),
)
def _(s, d):
    return out(differential.structure_tensor(A.mosaic32(s, d), 5), "jxx", "jxy", "jyy")


@query(
    "patch_hessian",
    sql(
        "mosaic32",
        f"""SELECT frame_id, y, x, {r6('sxx', 'sxx')}, {r6('sxy', 'sxy')}, {r6('syy', 'syy')},
        {r6('syy / (sxx * syy - sxy * sxy + 1e-4)', 'h00')}, {r6('-sxy / (sxx * syy - sxy * sxy + 1e-4)', 'h01')}, {r6('sxx / (sxx * syy - sxy * sxy + 1e-4)', 'h11')}
        FROM (SELECT a.frame_id, a.y, a.x, sum(b.ix * b.ix) AS sxx, sum(b.ix * b.iy) AS sxy, sum(b.iy * b.iy) AS syy
          FROM sb a JOIN sb b ON b.frame_id = a.frame_id AND b.y BETWEEN a.y AND a.y + 4 AND b.x BETWEEN a.x AND a.x + 4
          WHERE a.y % 3 = 0 AND a.x % 3 = 0 AND a.y <= 27 AND a.x <= 27 GROUP BY a.frame_id, a.y, a.x)""",
        _SOBEL,
    ),
)
def _(s, d):
    return out(differential.patch_hessian(A.mosaic32(s, d), 5, 3, A.LARGE), "sxx", "sxy", "syy", "h00", "h01", "h11")


# --- metrics ----------------------------------------------------------------

_DOT = "(u * tu + v * tv) / greatest(sqrt(u * u + v * v) * sqrt(tu * tu + tv * tv), 1e-3)"


@query("epe", sql("pairs8", f"SELECT frame_id, y, x, {r6(_EPE, 'epe')} FROM pairs8"))
def _(s, d):
    return out(_pairs(s, d).withColumn("epe", metrics.epe()), "epe")


@query("angle_error", sql("pairs8", f"SELECT frame_id, y, x, {r6(f'acos(least(greatest({_DOT}, -1.0), 1.0)) / pi()', 'angle')} FROM pairs8"))
def _(s, d):
    return out(_pairs(s, d).withColumn("angle", metrics.angle_error()), "angle")


@query(
    "relative_error",
    sql("pairs8", f"SELECT frame_id, y, x, {r6('abs(sqrt(u * u + v * v) - sqrt(tu * tu + tv * tv)) / greatest(sqrt(tu * tu + tv * tv), 1e-10)', 'rel')} FROM pairs8"),
)
def _(s, d):
    return out(_pairs(s, d).withColumn("rel", metrics.relative_error()), "rel")


@query("loss_supervised", sql("pairs8", f"SELECT {r6('avg((u - tu) ** 2 + (v - tv) ** 2)', 'loss')} FROM pairs8"))
def _(s, d):
    return out(metrics.loss_supervised(_pairs(s, d)), "loss", keys=())


@query(
    "loss_unsupervised",
    sql("mosaic32 moved32 mfield32", f"SELECT frame_id, {r6('avg((m.i - w.i) ** 2)', 'loss')} FROM moved32 m JOIN warped w USING (frame_id, y, x) GROUP BY frame_id", *_SPLAT),
)
def _(s, d):
    loss = resample.loss_unsupervised(A.mosaic32(s, d), A.moved32(s, d), A.mosaic_field32(s, d), A.LARGE)
    return out(loss, "loss", keys=("frame_id",))


_DENS = (
    "dn",
    """SELECT frame_id, avg(CASE WHEN i > 120 THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN i > 100 THEN 1.0 ELSE 0.0 END) AS t
    FROM image8 GROUP BY frame_id""",
)


def _densities(s, d):
    image = A.image8(s, d)
    return normalize.density_threshold(image, 120), normalize.density_threshold(image, 100)


@query("loss_density", sql("image8", f"SELECT frame_id, {r6('(e - t) ** 2 / t', 'loss')} FROM dn", _DENS))
def _(s, d):
    return out(metrics.density_loss(*_densities(s, d)), "loss", keys=("frame_id",))


@query(
    "eval_density",
    sql("image8", f"SELECT count(*) AS frames, {r6('avg(l)', 'mean')}, {r6('max(l)', 'max')}, {r6('min(l)', 'min')} FROM (SELECT (e - t) ** 2 / t AS l FROM dn)", _DENS),
)
def _(s, d):
    return out(metrics.eval_density(*_densities(s, d)), "mean", "max", "min", keys=("frames",))


STATS = ("mean", "std", "fraction_below_threshold", "lower_quartile", "upper_quartile", "median", "lower_whisker", "upper_whisker")


def stats_sql(value: str, threshold: float) -> str:
    a, b = f"quantile_cont({value}, 0.25)", f"quantile_cont({value}, 0.75)"
    return ", ".join(
        [
            r6(f"avg({value})", "mean"),
            r6(f"stddev_pop({value})", "std"),
            r6(f"avg(CASE WHEN {value} < {threshold} THEN 1.0 ELSE 0.0 END)", "fraction_below_threshold"),
            r6(a, "lower_quartile"),
            r6(b, "upper_quartile"),
            r6(f"median({value})", "median"),
            r6(f"{a} - 1.5 * ({b} - {a})", "lower_whisker"),
            r6(f"{b} + 1.5 * ({b} - {a})", "upper_whisker"),
        ]
    )


@query("error_stats", sql("pairs8", f"SELECT {stats_sql('e', 0.5)} FROM (SELECT {_EPE} AS e FROM pairs8)"))
def _(s, d):
    return out(metrics.error_stats(_pairs(s, d).select(metrics.epe().alias("e")), "e"), *STATS, keys=())


_NO_VECTOR = "(frame_id * 131 + y * 17 + x * 7) % 23 = 0"


@query("error_stats_missing", sql("pairs8", f"SELECT {stats_sql('e', 0.5)} FROM (SELECT {_EPE} AS e FROM pairs8 WHERE NOT ({_NO_VECTOR}))"))
def _(s, d):
    """NULL errors are left out; the bound is low so that the distributed quantiles run at every size."""
    errors = _pairs(s, d).select(F.when(~F.expr(_NO_VECTOR), metrics.epe()).alias("e"))
    return out(metrics.error_stats(errors, "e", bound=1000), *STATS, keys=())


@query("error_stats_by_frame", sql("pairs8", f"SELECT frame_id, {stats_sql('e', 1.5)} FROM (SELECT frame_id, {_EPE} AS e FROM pairs8) GROUP BY frame_id"))
def _(s, d):
    e = _pairs(s, d).select("frame_id", metrics.epe().alias("e"))
    return out(metrics.error_stats(e, "e", 1.5, ["frame_id"]), *STATS, keys=("frame_id",))


@query(
    "constraint_violation",
    sql(
        "field8",
        f"""SELECT 'speed' AS "constraint", {stats_sql('s', 0.01)} FROM (SELECT greatest(sqrt(u * u + v * v) - 1.5, 0) AS s FROM field8)
        UNION ALL SELECT 'divergence', {stats_sql('s', 0.02)} FROM (SELECT (u_dx + v_dy) ** 2 AS s FROM gr)""",
        _NB,
        _GRAD,
    ),
)
def _(s, d):
    return out(metrics.constraint_violation(A.field8(s, d), 1.5, {"divergence": 0.02}), *STATS, keys=("constraint",))


_SUMMARY = f"count(*) AS frames, {r6('avg(e)', 'mean')}, {r6('max(e)', 'max')}, {r6('min(e)', 'min')}"


@query("eval_dataset", sql("pairs8", f"SELECT {_SUMMARY} FROM fe", _FRAME_EPE))
def _(s, d):
    return out(metrics.eval_dataset(A.field8(s, d), A.truth8(s, d)), "mean", "max", "min", keys=("frames",))


@query(
    "eval_dataset_missing",
    sql(
        "pairs8",
        f"""SELECT {_SUMMARY}, sum(gone)::BIGINT AS missing, {r6('1 - sum(gone) / sum(n)', 'coverage')}
        FROM (SELECT frame_id, avg({_EPE}) FILTER (NOT ({_NO_VECTOR})) AS e, count(*) FILTER ({_NO_VECTOR}) AS gone, count(*) AS n FROM pairs8 GROUP BY frame_id)""",
    ),
)
def _(s, d):
    """NULL and NaN vectors enter no mean and are counted."""
    gone, field = F.expr(_NO_VECTOR), A.field8(s, d)
    u = F.when(gone & (F.col("x") % 2 == 0), F.lit(float("nan"))).when(~gone, F.col("u"))
    result = metrics.eval_dataset(field.select(*FYX, u.alias("u"), "v"), A.truth8(s, d))
    return out(result, "mean", "max", "min", "coverage", keys=("frames", "missing"))


@query(
    "eval_dataset_by_sequence",
    sql(
        "sequence8 truth8",
        f"""SELECT seq_id, {_SUMMARY} FROM (SELECT seq_id, frame_id, avg({_EPE}) AS e FROM
        (SELECT q.*, t.u AS tu, t.v AS tv FROM sequence8 q JOIN truth8 t USING (frame_id, y, x)) WHERE NOT is_padding GROUP BY ALL) GROUP BY seq_id""",
    ),
)
def _(s, d):
    return out(metrics.eval_dataset(A.sequence8(s, d), A.truth8(s, d), by=["seq_id"]), "mean", "max", "min", keys=("seq_id", "frames"))


@query("compare_sources", sql("pairs8", f"SELECT {stats_sql('e', 0.5)} FROM fe", _FRAME_EPE))
def _(s, d):
    per_frame = metrics.compare_sources(A.field8(s, d), A.truth8(s, d))
    return out(metrics.error_stats(per_frame, "mean_epe"), *STATS, keys=())


@query(
    "unmatched_frames",
    sql(
        "field8 mosaic32",
        """SELECT DISTINCT frame_id, 'second' AS missing_in FROM field8 WHERE frame_id NOT IN (SELECT frame_id FROM mosaic32)
        UNION ALL SELECT DISTINCT frame_id, 'first' FROM mosaic32 WHERE frame_id NOT IN (SELECT frame_id FROM field8)""",
    ),
)
def _(s, d):
    return metrics.unmatched_frames(A.field8(s, d), A.mosaic32(s, d))


@query(
    "disagreeing_truth",
    sql("field8 spiky8", f"SELECT frame_id, {r6('max(greatest(abs(a.u - b.u), abs(a.v - b.v)))', 'gap')} FROM field8 a JOIN spiky8 b USING (frame_id, y, x) GROUP BY frame_id HAVING max(greatest(abs(a.u - b.u), abs(a.v - b.v))) > 5"),
)
def _(s, d):
    return out(metrics.disagreeing_truth(A.field8(s, d), A.field8_spiky(s, d), 5.0), "gap", keys=("frame_id",))


@query("reward", sql("pairs8", f"SELECT frame_id, {r6('-e', 'reward')} FROM fe", _FRAME_EPE))
def _(s, d):
    return out(metrics.reward(_pairs(s, d)), "reward", keys=("frame_id",))


@query(
    "sequence_loss",
    sql(
        "ensemble8 field8",
        f"""SELECT {r6('sum(pow(0.8, 2 - k) * l)', 'loss')} FROM (SELECT estimator AS k, avg((abs(e.u - f.u) + abs(e.v - f.v)) / 2) AS l
        FROM ensemble8 e JOIN field8 f USING (frame_id, y, x) GROUP BY estimator)""",
    ),
)
def _(s, d):
    predictions = metrics.paired(A.ensemble8(s, d), A.field8(s, d)).withColumnRenamed("estimator", "iter")
    return out(metrics.sequence_loss(predictions, 3, 0.8), "loss", keys=())


# --- sequences --------------------------------------------------------------

SEQ = ("seq_id", "t", "y", "x")


@query(
    "ema",
    sql(
        "sequence8",
        f"""SELECT a.seq_id, a.t, a.y, a.x, {r6('sum(0.7 * pow(0.3, a.t - b.t) * b.u)', 'u')}, {r6('sum(0.7 * pow(0.3, a.t - b.t) * b.v)', 'v')}
        FROM sequence8 a JOIN sequence8 b ON b.seq_id = a.seq_id AND b.y = a.y AND b.x = a.x AND b.t <= a.t GROUP BY a.seq_id, a.t, a.y, a.x""",
    ),
)
def _(s, d):
    return out(sequences.ema(A.sequence8(s, d), 0.7), "u", "v", keys=SEQ)


@query(
    "ema_long",
    sql(
        "image8",
        f"""SELECT a.frame_id AS t, a.y, a.x, {r6('sum(0.05 * pow(0.95, a.frame_id - b.frame_id) * b.i) + pow(0.95, a.frame_id + 1) * 100', 'i')}
        FROM image8 a JOIN image8 b ON b.y = a.y AND b.x = a.x AND b.frame_id <= a.frame_id GROUP BY a.frame_id, a.y, a.x""",
    ),
)
def _(s, d):
    """All images as one sequence, averaged over many blocks."""
    line = A.image8(s, d).select(F.col("frame_id").alias("t"), "y", "x", "i")
    return out(sequences.ema(line, 0.05, ["i"], 100.0, ("y", "x"), block=16), "i", keys=("t", "y", "x"))


@query(
    "history",
    sql(
        "sequence8",
        f"""SELECT a.seq_id, a.t, a.y, a.x, k::INT AS slot, {r6('b.u', 'u')} FROM sequence8 a CROSS JOIN range(4) r(k)
        JOIN sequence8 b ON b.seq_id = a.seq_id AND b.y = a.y AND b.x = a.x AND b.t = greatest(a.t - 3 + k, 0)""",
    ),
)
def _(s, d):
    h = sequences.history(A.sequence8(s, d), ["u", "v"], 4).select(*SEQ, F.posexplode("hist").alias("slot", "h"))
    return out(h.withColumn("u", F.col("h.u")), "u", keys=(*SEQ, "slot"))


@query(
    "temporal_init",
    sql("sequence8", f"SELECT seq_id, t, y, x, {r6('coalesce(lag(u) OVER w, 0)', 'u0')}, {r6('coalesce(lag(v) OVER w, 0)', 'v0')} FROM sequence8 WINDOW w AS (PARTITION BY seq_id, y, x ORDER BY t)"),
)
def _(s, d):
    return out(sequences.temporal_init(A.sequence8(s, d)), "u0", "v0", keys=SEQ)


@query(
    "consecutive_pairs",
    sql("sequence8", "SELECT * FROM (SELECT seq_id, t, lag(frame_id) OVER (PARTITION BY seq_id ORDER BY t) AS frame_prev, frame_id AS frame_curr FROM sequence8 WHERE y = 0 AND x = 0) WHERE frame_prev IS NOT NULL"),
)
def _(s, d):
    frames = A.sequence8(s, d).where("y = 0 AND x = 0").select("seq_id", "t", "frame_id")
    return sequences.consecutive_pairs(frames).select("seq_id", "t", "frame_prev", "frame_curr")


_SEQ_EPE = (
    "se",
    f"""SELECT seq_id, t, any_value(done) AS done, avg({_EPE}) AS e FROM
    (SELECT q.*, t2.u AS tu, t2.v AS tv FROM sequence8 q JOIN truth8 t2 USING (frame_id, y, x)) GROUP BY seq_id, t""",
)


def _per_step(s, d):
    pairs = metrics.paired(A.sequence8(s, d), A.truth8(s, d))
    return pairs.groupBy("seq_id", "t").agg(F.any_value("done").alias("done"), F.avg(metrics.epe()).alias("epe"))


@query(
    "running_metrics",
    sql(
        "sequence8 truth8",
        f"SELECT seq_id, t, {r6('avg(e) OVER w', 'run_mean')}, {r6('max(e) OVER w', 'run_max')}, {r6('min(e) OVER w', 'run_min')} FROM se WINDOW w AS (PARTITION BY seq_id ORDER BY t)",
        _SEQ_EPE,
    ),
)
def _(s, d):
    return out(sequences.running_metrics(_per_step(s, d), "epe"), "run_mean", "run_max", "run_min", keys=("seq_id", "t"))


_EPI = (
    "ep",
    """SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY seq_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode FROM se""",
)


@query("episodes", sql("sequence8 truth8", "SELECT seq_id, t, episode FROM ep", _SEQ_EPE, _EPI))
def _(s, d):
    return sequences.episodes(_per_step(s, d)).select("seq_id", "t", "episode")


@query("episode_metrics", sql("sequence8 truth8", f"SELECT seq_id, episode, {r6('avg(e)', 'epe')} FROM ep GROUP BY ALL", _SEQ_EPE, _EPI))
def _(s, d):
    return out(sequences.episode_metrics(sequences.episodes(_per_step(s, d)), ["epe"]), "epe", keys=("seq_id", "episode"))


@query(
    "until_any_done",
    sql("sequence8", "SELECT seq_id, count(*) AS n FROM sequence8 s WHERE t <= coalesce((SELECT min(t) FROM sequence8 d WHERE d.done AND d.seq_id = s.seq_id), t) GROUP BY seq_id"),
)
def _(s, d):
    return sequences.until_any_done(A.sequence8(s, d), ["seq_id"]).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


_BUF = (
    "buf",
    """SELECT * FROM (SELECT user_id AS buffer_id, event_id AS seq, event_type AS action, value AS reward,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 20""",
)


@query("replay_retain", f"WITH {_BUF[0]} AS ({_BUF[1]}) SELECT buffer_id, seq, action, reward FROM buf")
def _(s, d):
    return replay.retain(A.experience(s, d), 20)


@query(
    "replay_sample",
    f"""WITH {_BUF[0]} AS ({_BUF[1]}) SELECT buffer_id, seq, action, reward FROM (SELECT *, row_number() OVER
    (PARTITION BY buffer_id ORDER BY (seq * 2654435761 + 11 * 40503) % 4294967296, seq) AS k FROM buf) WHERE k <= 8""",
)
def _(s, d):
    return replay.sample(replay.retain(A.experience(s, d), 20), 8, 11)


@query(
    "replay_at",
    f"""WITH {_BUF[0]} AS ({_BUF[1]}) SELECT buffer_id, seq, action, reward, position FROM (SELECT *, (row_number() OVER
    (PARTITION BY buffer_id ORDER BY seq) - 1)::INT AS position FROM buf) WHERE position IN (0, 3, 12)""",
)
def _(s, d):
    return replay.sample_at(replay.retain(A.experience(s, d), 20), [0, 3, 12])


@query("mix", "SELECT vec_id, ((vec_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296 AS mixed FROM embeddings")
def _(s, d):
    return A.vectors(s, d).select("vec_id", mix("vec_id", 42).alias("mixed"))
