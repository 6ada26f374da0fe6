"""Queries on windows, patches, correlation and patch search."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgrid.operators import correlation, patches, search
from driftgrid.plans.catalog_fields import FYX, out
from driftgrid.plans.oracle import around, bilinear_clamped, bilinear_zero, r6, resize_sql, sobel_sql, sql
from driftgrid.plans.registry import query
from driftgrid.sources import adapters as A

PAIR = ("pair_id",)
WINDOW = ("wy", "wx")


@query(
    "window_grid",
    sql(
        "mosaic32",
        """SELECT frame_id, wy::INT AS wy, wx::INT AS wx, wy * 4 + 6.0::DOUBLE AS cy, wx * 4 + 6.0::DOUBLE AS cx
        FROM (SELECT DISTINCT frame_id FROM mosaic32) CROSS JOIN range(6) r1(wy) CROSS JOIN range(6) r2(wx)""",
    ),
)
def _(s, d):
    return patches.window_grid(A.mosaic32(s, d), A.LARGE, 12, 8)


_WIN = (
    "wn",
    """SELECT frame_id, wy::INT AS wy, wx::INT AS wx, (y - wy * 5)::INT AS py, (x - wx * 5)::INT AS px, i
    FROM mosaic32 CROSS JOIN range(5) r1(wy) CROSS JOIN range(5) r2(wx)
    WHERE y BETWEEN wy * 5 AND wy * 5 + 11 AND x BETWEEN wx * 5 AND wx * 5 + 11""",
)


@query("windows", sql("mosaic32", f"SELECT frame_id, wy, wx, py, px, {r6('i', 'i')} FROM wn", _WIN))
def _(s, d):
    cut = patches.windows(A.mosaic32(s, d), ["i"], A.LARGE, 12, 5)
    return out(cut, "i", keys=("frame_id", *WINDOW, "py", "px"))


@query(
    "patch_grid",
    sql(
        "mosaic32",
        """SELECT frame_id, (a.k * 7 + b.k)::INT AS patch_id, a.c::INT AS cy, b.c::INT AS cx FROM (SELECT DISTINCT frame_id FROM mosaic32)
        CROSS JOIN c8 a CROSS JOIN c6 b""",
        ("c8", "SELECT row_number() OVER (ORDER BY c) - 1 AS k, c FROM (SELECT unnest([0, 8, 16, 24, 31]) AS c)"),
        ("c6", "SELECT row_number() OVER (ORDER BY c) - 1 AS k, c FROM (SELECT unnest([0, 6, 12, 18, 24, 30, 31]) AS c)"),
    ),
)
def _(s, d):
    return patches.patch_grid(A.mosaic32(s, d), A.LARGE, 8, 6)


def _taper_sql(size: int) -> str:
    q = size // 4
    half = size / 2 if size % 2 == 0 else (size + 1) / 2
    return f"""SELECT n, raw / avg(raw) OVER () AS w FROM (SELECT n, CASE WHEN n < {q} OR n >= {size - q}
        THEN pow(2 * t, 2) / 2 ELSE 1 - pow(2 * (t - 1), 2) / 2 END AS raw
        FROM (SELECT n::INT AS n, 1 - abs((n - {(size - 1) / 2!r}) / {half!r}) AS t FROM range({size}) r(n)))"""


_TAPER = ("tp", _taper_sql(12))


@query(
    "taper_weights",
    sql("mosaic32", f"SELECT frame_id, wy, wx, {r6('sum(a.w * b.w)', 'weight')}, {r6('sum(a.w * b.w * i)', 'value')} FROM wn JOIN tp a ON a.n = py JOIN tp b ON b.n = px GROUP BY ALL", _WIN, _TAPER),
)
def _(s, d):
    cut = patches.windows(A.mosaic32(s, d), ["i"], A.LARGE, 12, 5).withColumn("w", patches.taper("py", "px", 12))
    g = cut.groupBy("frame_id", *WINDOW).agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("i")).alias("value"))
    return out(g, "weight", "value", keys=("frame_id", *WINDOW))


@query(
    "fold_blend",
    sql(
        "mosaic32",
        f"""SELECT frame_id, wy * 5 + py AS y, wx * 5 + px AS x, {r6('sum(a.w * b.w * (i + wy - wx)) / sum(a.w * b.w)', 'i')}
        FROM wn JOIN tp a ON a.n = py JOIN tp b ON b.n = px GROUP BY frame_id, wy * 5 + py, wx * 5 + px""",
        _WIN,
        _TAPER,
    ),
)
def _(s, d):
    cut = patches.windows(A.mosaic32(s, d), ["i"], A.LARGE, 12, 5)
    cut = cut.withColumn("i", F.col("i") + F.col("wy") - F.col("wx"))
    return out(patches.fold_blend(cut, ["i"], 12, 5), "i")


@query("fold_patches", sql("mosaic32", f"SELECT frame_id, wy * 5 + py AS y, wx * 5 + px AS x, {r6('sum(i)', 'i')} FROM wn GROUP BY frame_id, wy * 5 + py, wx * 5 + px", _WIN))
def _(s, d):
    return out(patches.fold(patches.windows(A.mosaic32(s, d), ["i"], A.LARGE, 12, 5), ["i"], 5), "i")


def _mixed(seed: int) -> str:
    return f"((frame_id % 2147483648) * 2654435761 + {seed} * 40503) % 4294967296"


@query(
    "sample_random_patch",
    sql(
        "mosaic32",
        f"""SELECT frame_id, (y - t)::INT AS py, (x - l)::INT AS px, {r6('i', 'i')}
        FROM (SELECT *, {_mixed(3)} % 6 * 4 AS t, {_mixed(4)} % 6 * 4 AS l FROM mosaic32)
        WHERE y BETWEEN t AND t + 11 AND x BETWEEN l AND l + 11""",
    ),
)
def _(s, d):
    cut = patches.random_patch(A.mosaic32(s, d), ["i"], A.LARGE, 12, 4, seed=3)
    return out(cut, "i", keys=("frame_id", "py", "px"))


# --- correlation ------------------------------------------------------------

_S, _WS, _OV = 16, 12, 8  # search area, window and overlap


def _normal(name: str, source: str, column: str):
    """Two rounds of zero mean, unit deviation and cutting off negatives."""
    steps, last = [], source
    for k in (1, 2):
        steps.append(
            (
                f"{name}{k}",
                f"""SELECT frame_id, wy, wx, py, px, CASE WHEN sd = 0 THEN 0 ELSE greatest(({column} - m) / sd, 0) END AS {column}
            FROM (SELECT *, avg({column}) OVER w AS m, stddev_pop({column}) OVER w AS sd FROM {last} WINDOW w AS (PARTITION BY frame_id, wy, wx))""",
            )
        )
        last = f"{name}{k}"
    return steps


def corr_sql(first: str, second: str):
    """CTEs from two image tables to correlation cells ``cc`` and first peaks ``pk``."""
    return (
        (
            "wa",
            f"""SELECT frame_id, wy::INT AS wy, wx::INT AS wx, (y - wy * 8)::INT AS py, (x - wx * 8)::INT AS px, i
            FROM {first} CROSS JOIN range(3) r1(wy) CROSS JOIN range(3) r2(wx)
            WHERE y BETWEEN wy * 8 AND wy * 8 + {_S - 1} AND x BETWEEN wx * 8 AND wx * 8 + {_S - 1}""",
        ),
        (
            "wb",
            f"""SELECT frame_id, wy::INT AS wy, wx::INT AS wx, (y - wy * 8)::INT AS py, (x - wx * 8)::INT AS px, i
            FROM {second} CROSS JOIN range(3) r1(wy) CROSS JOIN range(3) r2(wx)
            WHERE y BETWEEN wy * 8 AND wy * 8 + {_S - 1} AND x BETWEEN wx * 8 AND wx * 8 + {_S - 1}""",
        ),
        ("wm", "SELECT frame_id, wy, wx, py, px, CASE WHEN py BETWEEN 2 AND 13 AND px BETWEEN 2 AND 13 THEN i ELSE 0.0 END AS i FROM wa"),
        *_normal("na", "wm", "i"),
        *_normal("nb", "wb", "i"),
        # normalised twice inside the correlation as well as before it: the second round above
        (
            "cc",
            f"""SELECT a.frame_id, a.wy, a.wx, (b.py - a.py + {_S // 2 + _S}) % {_S} - {_S // 2} AS di, (b.px - a.px + {_S // 2 + _S}) % {_S} - {_S // 2} AS dj,
            least(greatest(sum(a.i * b.i) / {_S * _S}, 0), 1) AS c
            FROM na2 a JOIN nb2 b ON b.frame_id = a.frame_id AND b.wy = a.wy AND b.wx = a.wx GROUP BY ALL""",
        ),
        (
            "pk",
            "SELECT frame_id, wy, wx, di, dj, c FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, wy, wx ORDER BY c DESC, di, dj) AS k FROM cc) WHERE k = 1",
        ),
    )


CORRELATION = corr_sql("mosaic32", "moved32")


def _fit(low: str, high: str) -> str:
    return f"""CASE WHEN least(m, n, s, w, e) <= 0 THEN ({low} - {high}) / (2 * {low} - 4 * m + 2 * {high})
        WHEN 2 * ln({low}) - 4 * ln(m) + 2 * ln({high}) = 0 THEN 0
        ELSE (ln({low}) - ln({high})) / (2 * ln({low}) - 4 * ln(m) + 2 * ln({high})) END"""


VECTORS = (
    (
        "st",
        """SELECT p.frame_id, p.wy, p.wx, p.di, p.dj, p.c AS m, n.c AS n, s.c AS s, w.c AS w, e.c AS e FROM pk p """
        + " ".join(
            f"LEFT JOIN cc {k} ON {k}.frame_id = p.frame_id AND {k}.wy = p.wy AND {k}.wx = p.wx AND {k}.di = p.di + ({a}) AND {k}.dj = p.dj + ({b})"
            for k, a, b in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))
        ),
    ),
    (
        "vc",
        f"""SELECT frame_id, wy AS y, wx AS x,
        CASE WHEN di BETWEEN -7 AND 6 AND dj BETWEEN -7 AND 6 THEN {_fit('w', 'e')} + dj END AS u,
        CASE WHEN di BETWEEN -7 AND 6 AND dj BETWEEN -7 AND 6 THEN {_fit('n', 's')} + di END AS v FROM st""",
    ),
)


def _correlated(s, d):
    return correlation.window_correlation(A.pair32(s, d), A.LARGE, _WS, _S, _OV)


@query("window_correlation", sql("mosaic32 moved32", f"SELECT frame_id AS pair_id, wy, wx, di, dj, {r6('c', 'value')} FROM cc", *CORRELATION))
def _(s, d):
    cells = correlation.correlation_cells(_correlated(s, d), _S)
    return out(cells, "value", keys=("pair_id", *WINDOW, "di", "dj"))


@query("correlation_peak", sql("mosaic32 moved32", f"SELECT frame_id AS pair_id, wy, wx, di + 8 AS peak_i, dj + 8 AS peak_j, {r6('c', 'value')} FROM pk", *CORRELATION))
def _(s, d):
    p = correlation.first_peak(_correlated(s, d), _S)
    return out(p.withColumn("value", F.array_max("corr")), "value", keys=("pair_id", *WINDOW, "peak_i", "peak_j"))


@query("subpixel_peak", sql("mosaic32 moved32", f"SELECT frame_id AS pair_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM vc", *CORRELATION, *VECTORS))
def _(s, d):
    return out(correlation.window_vectors(A.pair32(s, d), A.LARGE, _WS, _S, _OV), "u", "v", keys=("pair_id", "y", "x"))


def refill_sql(rounds: int):
    steps = [("r0", "SELECT frame_id, y, x, coalesce(u, 0) AS u, coalesce(v, 0) AS v, u IS NULL OR v IS NULL AS bad FROM vc")]
    for k in range(rounds):
        steps.append(
            (
                f"r{k + 1}",
                f"""SELECT a.frame_id, a.y, a.x,
            CASE WHEN any_value(a.bad) THEN coalesce(sum(b.u), 0) / 8 ELSE any_value(a.u) END AS u,
            CASE WHEN any_value(a.bad) THEN coalesce(sum(b.v), 0) / 8 ELSE any_value(a.v) END AS v, any_value(a.bad) AS bad
            FROM r{k} a LEFT JOIN r{k} b ON b.frame_id = a.frame_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x)
            GROUP BY a.frame_id, a.y, a.x""",
            )
        )
    return steps


@query(
    "piv_field",
    sql(
        "mosaic32 moved32",
        f"SELECT frame_id AS pair_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM ({resize_sql('r2', 'u v', (3, 3), (32, 32))})",
        *CORRELATION,
        *VECTORS,
        *refill_sql(2),
    ),
)
def _(s, d):
    f = correlation.piv_field(A.pair32(s, d), A.LARGE, _WS, _S, _OV, replace_iter=2, replace_radius=1)
    return out(f, "u", "v", keys=("pair_id", "y", "x"))


@query(
    "feature_correlation",
    sql(
        "field8 truth8",
        f"""SELECT a.frame_id, a.y, a.x, ((dy + 2) * 5 + dx + 2)::INT AS k,
        {r6('coalesce(a.u * b.u + a.v * b.v, 0) / sqrt(2)', 'corr')}
        FROM field8 a CROSS JOIN (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx)
        LEFT JOIN truth8 b ON b.frame_id = a.frame_id AND b.y = a.y + dy AND b.x = a.x + dx""",
    ),
)
def _(s, d):
    def features(t):
        return t.select(*FYX, F.array("u", "v").alias("f"))

    c = correlation.feature_correlation(features(A.field8(s, d)), features(A.truth8(s, d)), 2, 2)
    return out(c.select(*FYX, F.posexplode("corr").alias("k", "corr")), "corr", keys=(*FYX, "k"))


@query(
    "feature_correlation_coarse",
    sql(
        "field8 truth8",
        f"""SELECT a.frame_id, a.y, a.x, ((dy + 1) * 3 + dx + 1)::INT AS k,
        {r6('coalesce(a.u * b.u + a.v * b.v, 0) / sqrt(2)', 'corr')}
        FROM field8 a CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx)
        LEFT JOIN half b ON b.frame_id = a.frame_id AND b.y = a.y // 2 + dy AND b.x = a.x // 2 + dx""",
        ("half", "SELECT frame_id, y // 2 AS y, x // 2 AS x, avg(u) AS u, avg(v) AS v FROM truth8 GROUP BY ALL"),
    ),
)
def _(s, d):
    def features(t):
        return t.select(*FYX, F.array("u", "v").alias("f"))

    c = correlation.feature_correlation(features(A.field8(s, d)), features(A.truth8(s, d)), 1, 2, 1, A.SMALL)
    return out(c.select(*FYX, F.posexplode("corr").alias("k", "corr")), "corr", keys=(*FYX, "k"))


# --- patches ----------------------------------------------------------------


@query(
    "sample_patch",
    sql(
        "mosaic32 mfield32",
        f"SELECT frame_id, y, x, py, px, {r6('s', 'value')} FROM ({bilinear_zero('mosaic32', 'pt')})",
        (
            "pt",
            """SELECT frame_id, y, x, (dy + 1)::INT AS py, (dx + 1)::INT AS px, y + 2 * v + dy AS yf, x + 2 * u + dx AS xf FROM mfield32
            CROSS JOIN range(-1, 2) r1(dy) CROSS JOIN range(-1, 2) r2(dx)""",
        ),
    ),
)
def _(s, d):
    f = A.mosaic_field32(s, d)
    points = f.select(*FYX, (F.col("y") + 2 * F.col("v")).alias("yc"), (F.col("x") + 2 * F.col("u")).alias("xc"))
    return out(search.sample_patch(points, A.mosaic32(s, d), 3, A.LARGE), "value", keys=(*FYX, "py", "px"))


def photometric_sql(field: str, key: str, half: int, prev: str, curr: str, size: int):
    """CTEs ``ph``: squared patch error per centre (first component added to y)."""
    return (
        (
            "pc",
            f"""SELECT {key}, y, x, dy, dx, y + dy + u AS yf, x + dx + v AS xf FROM {field}
            CROSS JOIN range({-half}, {half + 1}) r1(dy) CROSS JOIN range({-half}, {half + 1}) r2(dx)
            WHERE y BETWEEN {half} AND {size - 1 - half} AND x BETWEEN {half} AND {size - 1 - half}""",
        ),
        ("ps", bilinear_zero(curr, "pc")),
        (
            "ph",
            f"""SELECT {', '.join('q.' + k.strip() for k in key.split(','))}, q.y, q.x, sum((p.i - q.s) ** 2) AS e
            FROM ps q JOIN {prev} p ON p.frame_id = q.frame_id AND p.y = q.y + q.dy AND p.x = q.x + q.dx GROUP BY ALL""",
        ),
    )


@query(
    "photometric_error",
    sql("mosaic32 moved32 mfield32", f"SELECT frame_id, y, x, {r6('sqrt(e)', 'err')} FROM ph", *photometric_sql("mfield32", "frame_id", 1, "mosaic32", "moved32", 32)),
)
def _(s, d):
    e = search.photometric_error(A.mosaic32(s, d), A.moved32(s, d), A.mosaic_field32(s, d), 3, A.LARGE)
    return out(e, "err")


_SPARSE = (
    ("c4", "SELECT row_number() OVER (ORDER BY c) - 1 AS k, c::INT AS c FROM (SELECT unnest([0, 4, 8, 12, 16, 20, 24, 28, 31]) AS c)"),
    (
        "cen",
        """SELECT frame_id, a.k * 9 + b.k AS patch_id, a.c AS cy, b.c AS cx FROM (SELECT DISTINCT frame_id FROM mosaic32) CROSS JOIN c4 a CROSS JOIN c4 b""",
    ),
    (
        "spx",
        """SELECT c.frame_id, c.patch_id, c.cy, c.cx, dy, dx, f.u, f.v, 1 / greatest(1, abs(coalesce(a.i - b.i, 0))) AS w
        FROM cen c JOIN field8 f ON f.frame_id = c.frame_id AND f.y = (c.patch_id % 64) // 8 AND f.x = c.patch_id % 8
        CROSS JOIN range(-2, 3) r1(dy) CROSS JOIN range(-2, 3) r2(dx)
        LEFT JOIN mosaic32 a ON a.frame_id = c.frame_id AND a.y = c.cy + dy AND a.x = c.cx + dx
        LEFT JOIN moved32 b ON b.frame_id = c.frame_id AND b.y = c.cy + dy AND b.x = c.cx + dx""",
    ),
)


@query(
    "densify",
    sql(
        "mosaic32 moved32 field8",
        f"""SELECT m.frame_id, m.y, m.x, {r6('sum(w * u) / sum(w)', 'u')}, {r6('sum(w * v) / sum(w)', 'v')}
        FROM mosaic32 m LEFT JOIN spx s ON s.frame_id = m.frame_id AND s.cy + s.dy = m.y AND s.cx + s.dx = m.x GROUP BY m.frame_id, m.y, m.x""",
        *_SPARSE,
    ),
)
def _(s, d):
    return out(search.densify(A.sparse_flow32(s, d), A.mosaic32(s, d), 5, A.LARGE), "u", "v")


@query(
    "flow_at_points",
    sql(
        "mosaic32 moved32 field8",
        f"""SELECT m.frame_id, m.y AS qy, m.x AS qx, {r6('sum(w * u) / sum(w)', 'u')}, {r6('sum(w * v) / sum(w)', 'v')}
        FROM mosaic32 m JOIN spx s ON s.frame_id = m.frame_id AND s.cy + s.dy = m.y AND s.cx + s.dx = m.x
        GROUP BY m.frame_id, m.y, m.x""",
        *_SPARSE,
    ),
)
def _(s, d):
    points = A.mosaic32(s, d).select("frame_id", F.col("y").alias("qy"), F.col("x").alias("qx"))
    return out(search.flow_at_points(A.sparse_flow32(s, d), points, 5, 5), "u", "v", keys=("frame_id", "qy", "qx"))


_P, _ST = 5, 3
_NPATCH = search.centre_counts((32, 32), _P, _ST)[0]


@query(
    "patch_features",
    sql(
        "mosaic32",
        f"""SELECT frame_id, (r * {_NPATCH} + c)::INT AS patch_id, (r * {_ST})::INT AS cy, (c * {_ST})::INT AS cx,
        {r6('sum(i)', 'tpl')}, {r6('sum(ix)', 'gx')}, {r6('sum(iy)', 'gy')},
        {r6('sum(iy * iy) / (sum(ix * ix) * sum(iy * iy) - sum(ix * iy) ** 2 + 1e-4)', 'h00')},
        {r6('-sum(ix * iy) / (sum(ix * ix) * sum(iy * iy) - sum(ix * iy) ** 2 + 1e-4)', 'h01')},
        {r6('sum(ix * ix) / (sum(ix * ix) * sum(iy * iy) - sum(ix * iy) ** 2 + 1e-4)', 'h11')}
        FROM sg JOIN range({_NPATCH}) r1(r) ON y BETWEEN r * {_ST} - 2 AND r * {_ST} + 2
        JOIN range({_NPATCH}) r2(c) ON x BETWEEN c * {_ST} - 2 AND c * {_ST} + 2 GROUP BY frame_id, r, c""",
        (
            "pad",
            """SELECT g.frame_id, y::INT AS y, x::INT AS x, coalesce(i, 0) AS i FROM (SELECT DISTINCT frame_id FROM mosaic32) g
            CROSS JOIN range(-4, 40) r1(y) CROSS JOIN range(-4, 40) r2(x) LEFT JOIN mosaic32 m USING (frame_id, y, x)""",
        ),
        ("sx", sobel_sql("pad")),
        ("sg", "SELECT * FROM sx JOIN pad USING (frame_id, y, x)"),
    ),
)
def _(s, d):
    f = search.patch_features(A.mosaic32(s, d), _P, _ST, A.LARGE)
    total = {c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) for c in ("tpl", "gx", "gy")}
    return out(f.withColumns(total), "tpl", "gx", "gy", "h00", "h01", "h11", keys=("frame_id", "patch_id", "cy", "cx"))


def _search_sql(
    size: int, stride: int, rounds: int, prev: str, curr: str, side: int, mark: str = "", start: str | None = None
):
    """Patch templates and ``rounds`` unrolled updates.

    ``<mark>fin`` holds the moved patches, ``<mark>err`` their pixel differences.
    ``start`` names a table of ``u0, v0`` per patch.
    """
    half, n = size // 2, search.centre_counts((side, side), size, stride)[0]
    m, reach = mark, size + stride
    begin = f"LEFT JOIN {start} USING (frame_id, patch_id)" if start else ""
    first = {c: f"coalesce({c}0, 0.0)::DOUBLE" if start else "0.0::DOUBLE" for c in "uv"}
    parts = [
        (
            f"{m}pad",
            f"""SELECT g.frame_id, y::INT AS y, x::INT AS x, coalesce(i, 0) AS i FROM (SELECT DISTINCT frame_id FROM {prev}) g
            CROSS JOIN range({-half - 2}, {side + reach}) r1(y) CROSS JOIN range({-half - 2}, {side + reach}) r2(x) LEFT JOIN {prev} m USING (frame_id, y, x)""",
        ),
        (f"{m}sx", sobel_sql(f"{m}pad")),
        (
            f"{m}tpl",
            f"""SELECT frame_id, r * {n} + c AS patch_id, r * {stride} AS cy, c * {stride} AS cx, y - r * {stride} AS dy, x - c * {stride} AS dx, i, ix, iy
            FROM {m}sx JOIN {m}pad USING (frame_id, y, x) JOIN range({n}) r1(r) ON y BETWEEN r * {stride} - {half} AND r * {stride} + {half}
            JOIN range({n}) r2(c) ON x BETWEEN c * {stride} - {half} AND c * {stride} + {half}""",
        ),
        (
            f"{m}u0",
            f"""SELECT frame_id, patch_id, cy, cx, syy / det AS h00, -sxy / det AS h01, sxx / det AS h11,
            {first['u']} AS u, {first['v']} AS v, {first['u']} AS bu, {first['v']} AS bv
            FROM (SELECT *, sxx * syy - sxy * sxy + 1e-4 AS det FROM (SELECT frame_id, patch_id, cy, cx, sum(ix * ix) AS sxx, sum(ix * iy) AS sxy, sum(iy * iy) AS syy
              FROM {m}tpl GROUP BY ALL)) {begin}""",
        ),
    ]
    for k in range(rounds + 1):
        at = f"{m}u{k}"
        if k == rounds:
            parts.append(
                (
                    f"{m}fin",
                    f"""SELECT * REPLACE (CASE WHEN far THEN bu ELSE u END AS u, CASE WHEN far THEN bv ELSE v END AS v)
                    FROM (SELECT *, sqrt((u - bu) ** 2 + (v - bv) ** 2) > {size} AS far FROM {at})""",
                )
            )
            at = f"{m}fin"
        parts.append((f"{m}q{k}", f"SELECT t.*, s.cy + s.v + t.dy AS yf, s.cx + s.u + t.dx AS xf FROM {m}tpl t JOIN {at} s USING (frame_id, patch_id)"))
        parts.append((f"{m}s{k}", bilinear_zero(curr, f"{m}q{k}")))
        if k < rounds:
            parts.append((f"{m}b{k}", f"SELECT frame_id, patch_id, sum(ix * (s - i)) AS gx, sum(iy * (s - i)) AS gy FROM {m}s{k} GROUP BY ALL"))
            parts.append(
                (
                    f"{m}u{k + 1}",
                    f"""SELECT * EXCLUDE (gx, gy) REPLACE (u - (h00 * gx + h01 * gy) AS u, v - (h01 * gx + h11 * gy) AS v)
                    FROM {at} JOIN {m}b{k} USING (frame_id, patch_id)""",
                )
            )
    parts.append((f"{m}err", f"SELECT frame_id, patch_id, dy, dx, i - s AS e FROM {m}s{rounds}"))
    return parts


@query(
    "patch_search",
    sql(
        "mosaic32 moved32",
        f"""SELECT f.frame_id, f.patch_id::INT AS patch_id, f.cy::INT AS cy, f.cx::INT AS cx, {r6('f.u', 'u')}, {r6('f.v', 'v')}, {r6('sqrt(e)', 'err')}
        FROM fin f JOIN (SELECT frame_id, patch_id, sum(e * e) AS e FROM err GROUP BY ALL) USING (frame_id, patch_id)""",
        *_search_sql(7, 5, 6, "mosaic32", "moved32", 32),
    ),
)
def _(s, d):
    first = A.mosaic32(s, d)
    heads = search.patch_heads(first, 7, 5, A.LARGE).withColumns({"u0": F.lit(0.0), "v0": F.lit(0.0)})
    found = search.patch_search(A.moved32(s, d), heads, 6, 7, A.LARGE, prev=first)
    size = F.sqrt(F.aggregate("err", F.lit(0.0), lambda a, v: a + v * v))
    return out(found.withColumn("err", size), "u", "v", "err", keys=("frame_id", "patch_id", "cy", "cx"))


_FINE = search.centre_counts((32, 32), 7, 4)[0]
COARSE_TO_FINE = (
    ("p16", resize_sql("mosaic32", "i", (32, 32), (16, 16))),
    ("c16", resize_sql("moved32", "i", (32, 32), (16, 16))),
    *_search_sql(7, 4, 4, "p16", "c16", 16, "a"),
    # start vectors at the finer centres from the coarse patches that cover them
    (
        "beg",
        f"""SELECT frame_id, patch_id, 2 * sum(w * u) / sum(w) AS u0, 2 * sum(w * v) / sum(w) AS v0 FROM (
          SELECT f.frame_id, r * {_FINE} + c AS patch_id, f.u, f.v, 1 / greatest(1, abs(e.e)) AS w
          FROM afin f JOIN range({_FINE}) r1(r) ON r * 4 BETWEEN f.cy * 2 - 6 AND f.cy * 2 + 6 JOIN range({_FINE}) r2(c) ON c * 4 BETWEEN f.cx * 2 - 6 AND f.cx * 2 + 6
          JOIN aerr e ON e.frame_id = f.frame_id AND e.patch_id = f.patch_id
            AND e.dy = least(r * 4 - f.cy * 2 + 6, 6) - 3 AND e.dx = least(c * 4 - f.cx * 2 + 6, 6) - 3) GROUP BY ALL""",
    ),
    *_search_sql(7, 4, 4, "mosaic32", "moved32", 32, "", "beg"),
    (
        "dense",
        """SELECT m.frame_id, m.y, m.x, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v
        FROM mosaic32 m LEFT JOIN (SELECT frame_id, cy + dy AS y, cx + dx AS x, u, v, 1 / greatest(1, abs(e)) AS w FROM fin JOIN err USING (frame_id, patch_id)) s
          USING (frame_id, y, x) GROUP BY ALL""",
    ),
)


@query(
    "coarse_to_fine",
    sql("mosaic32 moved32", f"SELECT frame_id, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM dense", *COARSE_TO_FINE),
)
def _(s, d):
    f = search.coarse_to_fine(A.mosaic32(s, d), A.moved32(s, d), A.LARGE, levels=2, iterations=4, patch_size=7, stride=4)
    return out(f, "u", "v")


def _sobels(table: str, columns: str) -> str:
    sums = ", ".join(
        f"sum(0.125 * dx * (2 - abs(dy)) * {c}) AS {c}x, sum(0.125 * dy * (2 - abs(dx)) * {c}) AS {c}y" for c in columns.split()
    )
    return f"SELECT frame_id, y, x, {sums} FROM ({around(table, columns, 1)}) GROUP BY ALL"


def _relax_sql(rounds: int):
    steps = [("x0", "SELECT *, 0.0::DOUBLE AS du, 0.0::DOUBLE AS dv FROM sys")]
    for k in range(rounds):
        tu = "(bu - a12 * dv) / a11"
        steps.append(
            (
                f"x{k + 1}",
                f"""SELECT * REPLACE (du + 1.6 * ({tu} - du) AS du, dv + 1.6 * ((bv - a12 * ({tu})) / a22 - dv) AS dv) FROM x{k}""",
            )
        )
    return steps


@query(
    "refine_variational",
    sql(
        "mosaic32 moved32 mfield32",
        f"SELECT frame_id, y, x, {r6('u + du', 'u')}, {r6('v + dv', 'v')} FROM x5",
        ("s0", sobel_sql("mosaic32")),
        (
            "ten",
            "SELECT frame_id, y, x, sum(ix * ix) / 9 AS jxx, sum(ix * iy) / 9 AS jxy, sum(iy * iy) / 9 AS jyy FROM ("
            + around("s0", "ix iy", 1)
            + ") GROUP BY ALL",
        ),
        ("vp", "SELECT frame_id, y, x, y + v AS yf, x + u AS xf, u, v FROM mfield32"),
        ("vw", "SELECT frame_id, y, x, u, v, s_i AS w FROM (" + bilinear_clamped("moved32", "vp", (32, 32)) + ")"),
        ("vg", _sobels("vw", "w u v")),
        (
            "sys",
            """SELECT frame_id, y, x, u, v, 5 / pi + 10 * jxx / pg + 10 * ws AS a11, 5 / pi + 10 * jyy / pg + 10 * ws AS a22, 10 * jxy / pg AS a12,
            -(wx * iz) / pi AS bu, -(wy * iz) / pi AS bv
            FROM (SELECT *, sqrt(iz * iz + 1e-6) AS pi, sqrt(wx * wx + wy * wy + 1e-6) AS pg, 1 / sqrt(ux * ux + uy * uy + vx * vx + vy * vy + 0.01) AS ws
              FROM (SELECT w.frame_id, w.y, w.x, w.u, w.v, w.w - m.i AS iz, g.wx, g.wy, g.ux, g.uy, g.vx, g.vy, t.jxx, t.jxy, t.jyy
                FROM vw w JOIN vg g USING (frame_id, y, x) JOIN ten t USING (frame_id, y, x) JOIN mosaic32 m USING (frame_id, y, x)))""",
        ),
        *_relax_sql(5),
    ),
)
def _(s, d):
    f = search.refine_variational(A.mosaic32(s, d), A.moved32(s, d), A.mosaic_field32(s, d), 3, 1, A.LARGE)
    return out(f, "u", "v")
