"""Queries on ensembles, named chains, estimators and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftgrid.operators import admm, consensus, metrics, normalize, pixels
from driftgrid.plans import estimators, evaluate, steps, sweep
from driftgrid.plans.catalog_fields import FYX, _EPE, _median_scores, out
from driftgrid.plans.catalog_patches import COARSE_TO_FINE, CORRELATION, VECTORS, corr_sql, photometric_sql, refill_sql
from driftgrid.plans.oracle import around, r6, relaxed_sql, resize_sql, sobel_sql, sql
from driftgrid.plans.registry import query
from driftgrid.scale import shared_folder
from driftgrid.sources import adapters as A
from driftgrid.streaming import sequences as streams

EYX = ("frame_id", "estimator", "y", "x")
LIST = [1.0, 2.0, 0.5]


def _listed(s, d):
    return consensus.weights_list(A.ensemble8(s, d), LIST)


# --- masks and weights ------------------------------------------------------


@query("oracle_mask", sql("masked8", "SELECT frame_id, estimator, y, x, mask FROM masked8"))
def _(s, d):
    return consensus.oracle_mask(A.ensemble8(s, d), A.field8(s, d), 1.5).select(*EYX, "mask")


@query(
    "oracle_coverage",
    sql("masked8", f"SELECT frame_id, {r6('avg(hit)', 'coverage')} FROM (SELECT frame_id, y, x, max(mask) AS hit FROM masked8 GROUP BY ALL) GROUP BY frame_id"),
)
def _(s, d):
    masked = consensus.oracle_mask(A.ensemble8(s, d), A.field8(s, d), 1.5)
    return out(consensus.oracle_coverage(masked), "coverage", keys=("frame_id",))


@query(
    "consensus_run_summary",
    sql(
        "masked8 field8 image8",
        f"""SELECT count(*) AS frames, {r6('avg(coverage)', 'coverage_mean')}, {r6('max(coverage)', 'coverage_max')}, {r6('min(coverage)', 'coverage_min')},
        {r6('avg(e)', 'epe_mean')}, {r6('max(e)', 'epe_max')}, {r6('min(e)', 'epe_min')}
        FROM (SELECT frame_id, avg(hit) AS coverage FROM (SELECT frame_id, y, x, max(mask) AS hit FROM masked8 GROUP BY ALL) GROUP BY frame_id)
        JOIN (SELECT frame_id, avg(sqrt((m.u - f.u) ** 2 + (m.v - f.v) ** 2)) AS e
          FROM (SELECT frame_id, y, x, median(u) AS u, median(v) AS v FROM masked8 GROUP BY ALL) m JOIN field8 f USING (frame_id, y, x) GROUP BY frame_id) USING (frame_id)
        WHERE frame_id IN (SELECT frame_id FROM image8 WHERE i > 200)""",
    ),
)
def _(s, d):
    ensemble, truth = A.ensemble8(s, d), A.field8(s, d)
    coverage = consensus.oracle_coverage(consensus.oracle_mask(ensemble, truth, 1.5))
    errors = metrics.frame_epe(metrics.paired(consensus.consensus_median(ensemble), truth))
    bright = A.image8(s, d).withColumn("i", F.when(F.col("i") > 200, F.col("i")).otherwise(0.0))
    result = consensus.run_summary(coverage, errors, pixels.nonzero_frames(bright))
    return out(result, *[f"{n}_{k}" for n in ("coverage", "epe") for k in ("mean", "max", "min")], keys=("frames",))


@query("weights_list", sql("listed8", "SELECT frame_id, estimator, y, x, w FROM listed8"))
def _(s, d):
    return _listed(s, d).select(*EYX, "w")


# previous and current images of the ensemble's frames
_IMAGES = ("curr8", "SELECT frame_id - 1 AS frame_id, y, x, i FROM image8 WHERE frame_id > 0")
_PHOTO = (_IMAGES, *photometric_sql("ensemble8", "frame_id, estimator", 1, "image8", "curr8", 8))


def _images(s, d):
    image = A.image8(s, d)
    return image, image.where("frame_id > 0").withColumn("frame_id", F.col("frame_id") - 1)


@query(
    "weights_photometric",
    sql(
        "ensemble8 image8",
        f"SELECT frame_id, estimator, y, x, {r6('CASE WHEN e IS NULL THEN 0 ELSE 1 / greatest(sqrt(e), 1) END', 'w')} FROM ensemble8 LEFT JOIN ph USING (frame_id, estimator, y, x)",
        *_PHOTO,
    ),
)
def _(s, d):
    prev, curr = _images(s, d)
    return out(consensus.weights_photometric(A.ensemble8(s, d), prev, curr, A.SMALL), "w", keys=EYX)


_GRAD = (
    *_PHOTO,
    ("sb", sobel_sql("image8")),
    ("g2", "SELECT frame_id, y, x, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN ix * ix + iy * iy ELSE 0 END AS g FROM sb"),
    ("en", f"SELECT frame_id, y, x, sum(g) AS g FROM ({around('g2', 'g', 1)}) GROUP BY ALL"),
    (
        "pw",
        """SELECT frame_id, estimator, y, x, u, v, coalesce(en.g / (e / 9 + 1e-4), 0) AS w
        FROM ensemble8 LEFT JOIN ph USING (frame_id, estimator, y, x) JOIN en USING (frame_id, y, x)""",
    ),
)


@query("weights_photograd", sql("ensemble8 image8", f"SELECT frame_id, estimator, y, x, {r6('w', 'w')} FROM pw", *_GRAD))
def _(s, d):
    prev, curr = _images(s, d)
    return out(consensus.weights_photograd(A.ensemble8(s, d), prev, curr, A.SMALL), "w", keys=EYX)


_BASE = ("wt", "SELECT frame_id, estimator, y, x, CASE WHEN mask <> 0 THEN sqrt(u * u + v * v) ELSE 0.0 END AS w, mask FROM masked8")
_NORMAL = {
    "none": "w",
    "per_batch": "w / (sum(w) OVER (PARTITION BY frame_id) + 1e-8)",
    "per_pixel": "w / (sum(w) OVER (PARTITION BY frame_id, y, x) + 1e-8)",
    "softmax_per_batch": "exp(w - mb) / sum(exp(w - mb)) OVER (PARTITION BY frame_id)",
    "softmax_per_pixel": "exp(w - mp) / sum(exp(w - mp)) OVER (PARTITION BY frame_id, y, x)",
    "max": "(w = mp)::INT / (sum((w = mp)::INT) OVER (PARTITION BY frame_id, y, x) + 1e-8)",
}


def _normalization(kind: str) -> None:
    body = f"""SELECT frame_id, estimator, y, x, {r6('CASE WHEN mask <> 0 THEN n ELSE 0 END * 100', 'w')}
        FROM (SELECT *, {_NORMAL[kind]} AS n FROM (SELECT *, max(w) OVER (PARTITION BY frame_id) AS mb, max(w) OVER (PARTITION BY frame_id, y, x) AS mp FROM wt))"""

    @query(f"weights_normalize_{kind}", sql("masked8", body, _BASE))
    def _(s, d):
        masked = consensus.oracle_mask(A.ensemble8(s, d), A.field8(s, d), 1.5)
        w = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
        normal = consensus.normalize_weights(masked.withColumn("w", w), kind)
        return out(normal.withColumn("w", F.col("w") * 100), "w", keys=EYX)


for _kind in consensus.NORMALIZATIONS:
    _normalization(_kind)


# --- fusion -----------------------------------------------------------------


def _mean_sql(table: str) -> str:
    def one(c: str) -> str:
        return r6(f"CASE WHEN max(abs(w)) = 0 THEN sum({c}) / (count(*) + 1e-8) ELSE sum(w * {c}) / (sum(w) + 1e-8) END", c)

    return f"SELECT frame_id, y, x, {one('u')}, {one('v')} FROM {table} GROUP BY frame_id, y, x"


@query("consensus_mean", sql("masked8 listed8", _mean_sql("lw"), ("lw", "SELECT l.frame_id, y, x, u, v, l.w * m.mask AS w FROM listed8 l JOIN (SELECT frame_id, estimator, y, x, mask FROM masked8) m USING (frame_id, estimator, y, x)")))
def _(s, d):
    masked = consensus.oracle_mask(A.ensemble8(s, d), A.field8(s, d), 1.5)
    weighted = consensus.normalize_weights(consensus.weights_list(masked, LIST), "none")
    return out(consensus.consensus_mean(weighted), "u", "v")


@query("consensus_median", sql("ensemble8", f"SELECT frame_id, y, x, {r6('median(u)', 'u')}, {r6('median(v)', 'v')} FROM ensemble8 GROUP BY ALL"))
def _(s, d):
    return out(consensus.consensus_median(A.ensemble8(s, d)), "u", "v")


_NB = ("nb", around("field8", "u v", 1, None))
_DIFF = (
    "df",
    """SELECT frame_id, y, x, sum(CASE WHEN dy = 0 THEN dx * u END) / 2 AS ux, sum(CASE WHEN dx = 0 THEN dy * u END) / 2 AS uy,
    sum(CASE WHEN dy = 0 THEN dx * v END) / 2 AS vx, sum(CASE WHEN dx = 0 THEN dy * v END) / 2 AS vy,
    sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN u WHEN dy = 0 AND dx = 0 THEN -4 * u END) AS ul,
    sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN v WHEN dy = 0 AND dx = 0 THEN -4 * v END) AS vl
    FROM nb WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY ALL""",
)
_LOSS = {
    "smoothness": "sum(ux * ux + uy * uy + vx * vx + vy * vy)",
    "divergence": "sum((ux + vy) ** 2)",
    "tv": "sum(sqrt(ux * ux + uy * uy + 1e-4) + sqrt(vx * vx + vy * vy + 1e-4))",
    "laplacian": "sum(ul * ul + vl * vl)",
}


def _regularizer(name: str) -> None:
    @query(f"regularizer_{name}", sql("field8", f"SELECT frame_id, {r6(_LOSS[name], 'loss')} FROM df GROUP BY frame_id", _NB, _DIFF))
    def _(s, d):
        return out(consensus.regularizer(A.field8(s, d), name), "loss", keys=("frame_id",))


for _name in consensus.REGULARIZERS:
    _regularizer(_name)

_TOTAL = {"smoothness": 0.3, "divergence": 2.0, "laplacian": 0.5, "tv": 0.1}


@query(
    "regularizer_total",
    sql("field8", f"SELECT frame_id, {r6(' + '.join(f'{w} * {_LOSS[n]}' for n, w in _TOTAL.items()), 'loss')} FROM df GROUP BY frame_id", _NB, _DIFF),
)
def _(s, d):
    return out(consensus.total_regularization(A.field8(s, d), _TOTAL), "loss", keys=("frame_id",))


_STATE = (
    "s0",
    """SELECT *, u AS au, v AS av, avg(u) OVER p AS zu, avg(v) OVER p AS zv, u - avg(u) OVER p AS du, v - avg(v) OVER p AS dv
    FROM listed8 WINDOW p AS (PARTITION BY frame_id, y, x)""",
)
_RHO = 2.0


def _state(s, d):
    return consensus.initial_state(_listed(s, d))


def _x_sql(kind: str, rho: float = _RHO) -> str:
    def one(c: str) -> str:
        if kind == "l2":
            return f"(2 * w * a{c} + {rho} * (z{c} - d{c})) / (2 * w + {rho}) AS {c}"
        gap = f"(z{c} - d{c} - a{c})"
        return f"a{c} + sign({gap}) * greatest(abs({gap}) - w / {rho}, 0) AS {c}"

    return f"SELECT * REPLACE ({one('u')}, {one('v')}) FROM "


@query(
    "consensus_objective",
    sql(
        "listed8",
        f"""SELECT frame_id, {r6('sum(((u - au) ** 2 + (v - av) ** 2) * w + 1.0 * ((u - zu + du) ** 2 + (v - zv + dv) ** 2))', 'objective')}
        FROM s1 GROUP BY frame_id""",
        _STATE,
        ("s1", _x_sql("l2") + "s0"),
    ),
)
def _(s, d):
    moved = consensus.x_update_l2(_state(s, d), _RHO)
    return out(consensus.flows_objective(moved, _RHO, "l2"), "objective", keys=("frame_id",))


@query(
    "consensus_z_objective",
    sql(
        "listed8",
        f"""SELECT frame_id, {r6('o + l', 'objective')} FROM (SELECT frame_id, sum((u - zu + du) ** 2 + (v - zv + dv) ** 2) AS o FROM s0 GROUP BY frame_id)
        JOIN (SELECT frame_id, 0.3 * {_LOSS['smoothness']} + 2.0 * {_LOSS['divergence']} AS l FROM df GROUP BY frame_id) USING (frame_id)""",
        _STATE,
        ("zf", "SELECT frame_id, y, x, zu AS u, zv AS v FROM s0 WHERE estimator = 0"),
        ("nb", around("zf", "u v", 1, None)),
        _DIFF,
    ),
)
def _(s, d):
    o = consensus.z_objective(_state(s, d), _RHO, {"smoothness": 0.3, "divergence": 2.0})
    return out(o, "objective", keys=("frame_id",))


@query("admm_x_l2", sql("listed8", f"SELECT frame_id, estimator, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM ({_x_sql('l2')} s0)", _STATE))
def _(s, d):
    return out(consensus.x_update_l2(_state(s, d), _RHO), "u", "v", keys=EYX)


@query("admm_x_l1", sql("listed8", f"SELECT frame_id, estimator, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM ({_x_sql('l1')} s0)", _STATE))
def _(s, d):
    return out(consensus.x_update_l1(_state(s, d), _RHO), "u", "v", keys=EYX)


def _admm_sql(rounds: int, kind: str, rate: float):
    parts, last = [_STATE], "s0"
    for k in range(rounds):
        parts.append((f"x{k}", _x_sql(kind) + last))
        parts.append(
            (
                f"z{k}",
                "SELECT * REPLACE ("
                + ", ".join(f"z{c} - {rate} * {_RHO} * (count(*) OVER p * z{c} - sum({c} + d{c}) OVER p) AS z{c}" for c in "uv")
                + f") FROM x{k} WINDOW p AS (PARTITION BY frame_id, y, x)",
            )
        )
        parts.append((f"d{k}", f"SELECT * REPLACE (du + u - zu AS du, dv + v - zv AS dv) FROM z{k}"))
        last = f"d{k}"
    return parts, last


def _admm(name: str, rounds: int, kind: str, rate: float) -> None:
    parts, last = _admm_sql(rounds, kind, rate)

    @query(name, sql("listed8", f"SELECT frame_id, y, x, {r6('zu', 'u')}, {r6('zv', 'v')} FROM {last} WHERE estimator = 0", *parts))
    def _(s, d):
        options = {
            "rho": _RHO, "solver_flows": f"closed_form_{kind}", "flows_objective_type": kind,
            "solver_consensus": "sgd", "learning_rate_consensus": rate, "max_admm_iterations": rounds,
        }
        return out(admm.consensus_admm(_listed(s, d), options).field, "u", "v")


_admm("admm_z_step", 1, "l2", 0.05)
_admm("consensus_admm", 4, "l2", 0.05)
_admm("consensus_admm_l1", 3, "l1", 0.05)


def _stopping_sql(rounds: int, inner: int, rate: float, eps_abs: float, eps_rel: float, adam: bool = True):
    """All iterations without stopping, then the first at which a frame passes both tests."""
    pixel = "WINDOW p AS (PARTITION BY frame_id, y, x)"
    x = ", ".join(f"(2 * w * a{c} + {_RHO} * (z{c} - d{c})) / (2 * w + {_RHO}) AS x{c}" for c in "uv")
    now = f"SELECT k, frame_id, estimator, y, x, w, au, av, du, dv, zu, zv, {x} FROM rs WHERE k < {rounds}"
    now = "SELECT *, count(*) OVER p AS n, " + ", ".join(
        f"sum(x{c} + d{c}) OVER p AS s{c}, z{c} AS o{c}, 0.0::DOUBLE AS m{c}, 0.0::DOUBLE AS q{c}" for c in "uv"
    ) + f" FROM ({now}) {pixel}"
    for k in range(1, inner + 1):
        slope = {c: f"({_RHO} * (n * z{c} - s{c}))" for c in "uv"}
        if not adam:
            now = "SELECT * REPLACE (" + ", ".join(f"z{c} - {rate} * {slope[c]} AS z{c}" for c in "uv") + f") FROM ({now})"
            continue
        now = "SELECT * REPLACE (" + ", ".join(
            f"0.9 * m{c} + 0.1 * {slope[c]} AS m{c}, 0.999 * q{c} + 0.001 * {slope[c]} ** 2 AS q{c}" for c in "uv"
        ) + f") FROM ({now})"
        now = "SELECT * REPLACE (" + ", ".join(
            f"z{c} - {rate} * (m{c} / {1 - 0.9**k!r}) / (sqrt(q{c} / {1 - 0.999**k!r}) + 1e-8) AS z{c}" for c in "uv"
        ) + f") FROM ({now})"
    moved = ", ".join(f"d{c} + x{c} - z{c} AS d{c}" for c in "uv")
    now = f"SELECT k + 1 AS k, frame_id, estimator, y, x, w, au, av, {moved}, zu, zv, xu, xv, ou, ov FROM ({now})"
    start = """SELECT 0 AS k, frame_id, estimator, y, x, w, au, av, du, dv, zu, zv, u AS xu, v AS xv, zu AS ou, zv AS ov FROM s0"""
    test = f"""SELECT frame_id, k - 1 AS k, sum((xu - zu) ** 2 + (xv - zv) ** 2) AS pr, sum(xu ** 2 + xv ** 2) AS xx, sum(du ** 2 + dv ** 2) AS dd,
        sum(CASE WHEN estimator = 0 THEN (zu - ou) ** 2 + (zv - ov) ** 2 END) AS du, sum(CASE WHEN estimator = 0 THEN zu ** 2 + zv ** 2 END) AS zz,
        count(*) * 2.0 AS total, max(estimator) + 1 AS n FROM rs WHERE k > 0 GROUP BY frame_id, k"""
    met = f"""sqrt(pr) <= sqrt(total) * {eps_abs} + {eps_rel} * greatest(sqrt(xx), sqrt(n) * sqrt(zz))
        AND {_RHO} * sqrt(n) * sqrt(du) <= sqrt(total) * {eps_abs} + {eps_rel} * {_RHO} * sqrt(dd)"""
    return (_STATE, ("rs", f"{start} UNION ALL {now}"), ("tt", test), ("st", f"SELECT frame_id, min(CASE WHEN {met} THEN k END)::INT AS stop_iter FROM tt GROUP BY frame_id"))


@query(
    "consensus_admm_stopping",
    sql("listed8", "SELECT frame_id, stop_iter IS NOT NULL AS stopped, stop_iter FROM st", *_stopping_sql(30, 5, 0.05, 0.02, 0.03)),
)
def _(s, d):
    """Stopping iterations by the residual tests."""
    options = {
        "rho": 2.0, "solver_consensus": "adam", "num_iterations_consensus": 5, "learning_rate_consensus": 0.05,
        "max_admm_iterations": 30, "eps_abs_stopping": 0.02, "eps_rel_stopping": 0.03,
    }
    return admm.consensus_admm(_listed(s, d), options).stops


@query("consensus_admm_regularized")
def _(s, d):
    """The published consensus settings with patch size 3; checked against NumPy in the tests."""
    prev, curr = _images(s, d)
    options = {
        "weights_type": "photograd", "patch_size": 3, "normalization": "none", "rho": 2.0,
        "solver_flows": "closed_form_l2", "flows_objective_type": "l2",
        "solver_consensus": "adam", "num_iterations_consensus": 30, "learning_rate_consensus": 0.01,
        "max_admm_iterations": 30, "eps_abs_stopping": 1e-4, "eps_rel_stopping": 1e-4,
        "regularizer_list": ["smoothness", "divergence", "laplacian", "tv"],
        "regularizer_weights": {"smoothness": 0.3, "divergence": 40, "laplacian": 5, "tv": 0},
    }
    weighted = consensus.make_weights(A.ensemble8(s, d), prev, curr, options, A.SMALL)
    return out(admm.consensus_admm(weighted, options, shape=A.SMALL).field, "u", "v")


@query("consensus_fused", sql("ensemble8 image8", _mean_sql("np"), *_GRAD, ("np", "SELECT * REPLACE (w / (sum(w) OVER (PARTITION BY frame_id, y, x) + 1e-8) AS w) FROM pw")))
def _(s, d):
    prev, curr = _images(s, d)
    pairs = prev.withColumnRenamed("i", "prev").join(curr.withColumnRenamed("i", "curr"), list(FYX))
    options = {"weights_type": "photograd", "normalization": "per_pixel"}
    return out(estimators.fuse_fields(A.ensemble8(s, d), pairs, A.SMALL, "mean", options), "u", "v")


_LIMITS = [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]


@query(
    "sweep_epe_limit",
    sql(
        "ensemble8 field8",
        f"""SELECT epe_limit, {r6('avg(m)', 'mean')}, {r6('max(m)', 'max')}, {r6('min(m)', 'min')} FROM (
          SELECT epe_limit, frame_id, avg({_EPE}) AS m FROM (SELECT f.*, t.u AS tu, t.v AS tv FROM fused f JOIN field8 t USING (frame_id, y, x)) GROUP BY ALL)
        GROUP BY epe_limit""",
        ("grid", f"""SELECT e.*, l::DOUBLE AS epe_limit, CASE WHEN sqrt((e.u - f.u) ** 2 + (e.v - f.v) ** 2) > l THEN 0.0 ELSE 1.0 END AS w
            FROM ensemble8 e JOIN field8 f USING (frame_id, y, x) CROSS JOIN (SELECT unnest({_LIMITS}) AS l)"""),
        (
            "fused",
            "SELECT epe_limit, frame_id, y, x, "
            + ", ".join(f"CASE WHEN max(w) = 0 THEN sum({c}) / (count(*) + 1e-8) ELSE sum(w * {c}) / (sum(w) + 1e-8) END AS {c}" for c in "uv")
            + " FROM grid GROUP BY ALL",
        ),
    ),
)
def _(s, d):
    sweep = estimators.sweep_epe_limit(A.ensemble8(s, d), A.field8(s, d), _LIMITS)
    return out(sweep, "mean", "max", "min", keys=("epe_limit",))


# weights by pixel: those of a list, less at odd places
_ODD = "(y + 2 * x + estimator) % 3"


@query(
    "weights_table",
    sql(
        "listed8",
        f"SELECT frame_id, estimator, y, x, {r6('w / (sum(w) OVER (PARTITION BY frame_id, y, x) + 1e-8)', 'w')} FROM tw",
        ("tw", f"SELECT frame_id, estimator, y, x, w / (1 + {_ODD}) AS w FROM listed8"),
    ),
)
def _(s, d):
    """A weight table by frame, estimator and pixel, normalised per pixel."""
    table = _listed(s, d).withColumn("w", F.col("w") / (1 + F.expr(_ODD))).select(*EYX, "w")
    options = {"weights_type": "table", "weights": table, "normalization": "per_pixel"}
    return out(consensus.make_weights(A.ensemble8(s, d), config=options), "w", keys=EYX)


_RUN = (30, 3, 0.05, 0.02, 0.03)


@query(
    "consensus_metrics",
    sql(
        "masked8 field8 image8",
        f"""SELECT frame_id, valid, {r6('coverage', 'coverage')}, stop_iter, {r6('mean_epe', 'mean_epe')} FROM st
        JOIN (SELECT frame_id - 1 AS frame_id, max(i) > 200 AS valid FROM image8 GROUP BY frame_id) USING (frame_id)
        JOIN (SELECT frame_id, avg(hit) AS coverage FROM (SELECT frame_id, y, x, max(mask) AS hit FROM masked8 GROUP BY ALL) GROUP BY frame_id) USING (frame_id)
        JOIN (SELECT r.frame_id, avg(sqrt((zu - f.u) ** 2 + (zv - f.v) ** 2)) AS mean_epe FROM rs r JOIN st USING (frame_id)
          JOIN field8 f ON f.frame_id = r.frame_id AND f.y = r.y AND f.x = r.x
          WHERE estimator = 0 AND k = coalesce(stop_iter + 1, {_RUN[0]}) GROUP BY r.frame_id) USING (frame_id)""",
        ("listed9", "SELECT *, ([1.0, 2.0, 0.5])[estimator + 1]::DOUBLE * mask AS w FROM masked8"),
        (_STATE[0], _STATE[1].replace("listed8", "listed9")),
        *_stopping_sql(*_RUN, adam=False)[1:],
    ),
)
def _(s, d):
    """Coverage, stopping iteration and error of every frame of a run masked by the truth.

    Plain descent: where every estimator is masked the slope is rounding noise, which ``adam`` would blow up.
    """
    prev, curr = _images(s, d)
    dark = curr.withColumn("i", F.when(F.col("i") > 200, F.col("i")).otherwise(0.0))
    pairs = prev.withColumnRenamed("i", "prev").join(dark.withColumnRenamed("i", "curr"), list(FYX))
    options = {
        "weights_type": "list", "weights": LIST, "rho": _RHO, "solver_consensus": "sgd",
        "num_iterations_consensus": _RUN[1], "learning_rate_consensus": _RUN[2],
        "max_admm_iterations": _RUN[0], "eps_abs_stopping": _RUN[3], "eps_rel_stopping": _RUN[4],
    }
    run = estimators.fuse_ensemble(A.ensemble8(s, d), pairs, A.SMALL, "admm", options, 1.5, A.field8(s, d))
    return out(run.frames.where("coverage IS NOT NULL"), "coverage", "mean_epe", keys=("frame_id", "valid", "stop_iter"))


# --- named chains and estimators --------------------------------------------


@query(
    "image_chain",
    sql(
        "mosaic32",
        f"SELECT frame_id, y, x, {r6('least(i, med + 1.1 * sd)', 'i')} FROM sm JOIN (SELECT frame_id, median(i) AS med, stddev_pop(i) AS sd FROM sm GROUP BY frame_id) USING (frame_id)",
        ("cr", "SELECT frame_id, y - 2 AS y, x - 8 AS x, i FROM mosaic32 WHERE y BETWEEN 2 AND 29 AND x BETWEEN 8 AND 31"),
        (
            "aw",
            """SELECT n, o::INT AS o, i::INT AS i, w / sum(w) OVER (PARTITION BY n, o) AS w FROM (
            SELECT n, o, i, greatest(0, 1 - abs(i - ((o + 0.5) * n / 12.0 - 0.5)) / (n / 12.0)) AS w
            FROM (VALUES (28), (24)) t(n) CROSS JOIN range(12) r1(o) CROSS JOIN range(28) r2(i) WHERE i < n) WHERE w > 0""",
        ),
        ("sm", "SELECT c.frame_id, a.o AS y, b.o AS x, sum(a.w * b.w * c.i) AS i FROM cr c JOIN aw a ON a.n = 28 AND a.i = c.y JOIN aw b ON b.n = 24 AND b.i = c.x GROUP BY ALL"),
    ),
)
def _(s, d):
    """The published image chain at the size of the test frames."""
    chain = [
        {"name": "crop_special", "target_height": 28, "target_width": 24, "fraction_v": 0.5, "fraction_h": 1.0},
        {"name": "resize_image", "target_height": 12, "target_width": 12},
        {"name": "intensity_capping", "n": 1.1},
    ]
    return out(steps.run_steps("image", A.mosaic32(s, d), chain, steps.Context(A.LARGE)), "i")


@query(
    "density_chain",
    sql(
        "image8",
        f"""SELECT frame_id, {r6('avg(CASE WHEN least(i, med + 1.1 * sd) > 100 THEN 1.0 ELSE 0.0 END)', 'density')}
        FROM bs JOIN (SELECT frame_id, median(i) AS med, stddev_pop(i) AS sd FROM bs GROUP BY frame_id) USING (frame_id) GROUP BY frame_id""",
        ("bs", "SELECT frame_id, y, x, greatest(i - 50, 0.0) AS i FROM image8"),
    ),
)
def _(s, d):
    image = steps.run_steps("image", A.image8(s, d), steps.DENSITY_CHAIN, steps.Context(A.SMALL))
    return out(normalize.density_threshold(image, 100), "density", keys=("frame_id",))


def _flagged_chain_sql():
    """Median test (radius 1), two relaxation rounds, median, average."""
    parts = list(_median_scores(1, 0.1))
    parts.append(("c0", "SELECT frame_id, y, x, u, v, NOT (su > 2 OR sv > 2) AS valid FROM spiky8 JOIN sc USING (frame_id, y, x)"))
    for k in range(2):
        means = ", ".join(f"CASE WHEN any_value(a.valid) THEN any_value(a.{c}) ELSE sum(b.{c}) / 4 END AS {c}" for c in "uv")
        parts.append(
            (
                f"c{k + 1}",
                f"""SELECT a.frame_id, a.y, a.x, {means}, any_value(a.valid) AS valid FROM c{k} a CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)
            JOIN c{k} b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + o.dy, 0), 7) AND b.x = least(greatest(a.x + o.dx, 0), 7)
            GROUP BY a.frame_id, a.y, a.x""",
            )
        )
    parts.append(("c3", f"SELECT frame_id, y, x, median(u) AS u, median(v) AS v FROM ({around('c2', 'u v', 1)}) GROUP BY ALL"))
    return parts


@query(
    "field_chain",
    sql(
        "spiky8",
        f"""SELECT a.frame_id, a.y, a.x, {r6('avg(b.u)', 'u')}, {r6('avg(b.v)', 'v')} FROM c3 a CROSS JOIN range(-1, 2) r1(dy) CROSS JOIN range(-1, 2) r2(dx)
        JOIN c3 b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.frame_id, a.y, a.x""",
        *_flagged_chain_sql(),
    ),
)
def _(s, d):
    chain = [
        {"name": "universal_median_test", "radius": 1},
        {"name": "laplace_interpolation", "num_iter": 2},
        {"name": "median_smoothing", "radius": 1},
        {"name": "average_smoothing", "radius": 1},
    ]
    return out(steps.run_steps("field", A.field8_spiky(s, d), chain, steps.Context(A.SMALL)), "u", "v")


def _published_sql():
    parts = list(_median_scores(2, 0.0001))
    parts.append(("fl", "SELECT frame_id, y, x, u, v, NOT (su > 2 OR sv > 2) AS valid FROM spiky8 JOIN sc USING (frame_id, y, x)"))
    parts += relaxed_sql("fl", 512)
    last = "rl"
    for k in range(4):
        parts.append((f"m{k}", f"SELECT frame_id, y, x, median(u) AS u, median(v) AS v FROM ({around(last, 'u v', 2)}) GROUP BY ALL"))
        last = f"m{k}"
    return parts


@query(
    "field_chain_published",
    sql(
        "spiky8",
        f"""SELECT a.frame_id, a.y, a.x, {r6('avg(b.u)', 'u')}, {r6('avg(b.v)', 'v')} FROM m3 a CROSS JOIN range(-2, 3) r1(dy) CROSS JOIN range(-2, 3) r2(dx)
        JOIN m3 b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.frame_id, a.y, a.x""",
        *_published_sql(),
    ),
)
def _(s, d):
    """The published field chain at full depth."""
    return out(steps.run_steps("field", A.field8_spiky(s, d), steps.FIELD_CHAIN, steps.Context(A.SMALL)), "u", "v")


@query(
    "sequence_chain",
    sql(
        "sequence8",
        f"""SELECT a.seq_id, a.t, a.y, a.x, {r6('sum(0.5 * pow(0.5, a.t - b.t) * b.u)', 'u')}, {r6('sum(0.5 * pow(0.5, a.t - b.t) * b.v)', 'v')}
        FROM md a JOIN md b ON b.seq_id = a.seq_id AND b.y = a.y AND b.x = a.x AND b.t <= a.t GROUP BY a.seq_id, a.t, a.y, a.x""",
        ("md", f"SELECT frame_id // 25 AS seq_id, (frame_id % 25)::INT AS t, y, x, median(u) AS u, median(v) AS v FROM ({around('sequence8', 'u v', 1)}) GROUP BY ALL"),
    ),
)
def _(s, d):
    chain = [{"name": "median_smoothing", "radius": 1}, {"name": "temporal_smoothing_ema", "alpha": 0.5}]
    context = steps.Context(A.SMALL, keys=("seq_id", "t"), time="t")
    table = A.sequence8(s, d).select("seq_id", "t", "y", "x", "u", "v")
    return out(steps.run_steps("field", table, chain, context), "u", "v", keys=("seq_id", "t", "y", "x"))


@query(
    "estimator_dummy",
    sql("mosaic32 mfield32", f"SELECT frame_id, {r6('avg(sqrt(u * u + v * v))', 'mean_epe')} FROM mfield32 GROUP BY frame_id"),
)
def _(s, d):
    pairs = A.pair32(s, d).withColumnRenamed("pair_id", "frame_id")
    zero = estimators.estimate("dummy", pairs, A.LARGE)
    return out(metrics.compare_sources(zero, A.mosaic_field32(s, d)), "mean_epe", keys=("frame_id",))


@query(
    "estimator_consensus",
    sql(
        "mosaic32 moved32",
        _mean_sql("nw"),
        *CORRELATION,
        *VECTORS,
        *refill_sql(2),
        *COARSE_TO_FINE,
        (
            "ens",
            f"""SELECT frame_id, 0 AS estimator, y, x, u, v FROM ({resize_sql('r2', 'u v', (3, 3), (32, 32))})
            UNION ALL SELECT frame_id, 1, y, x, u, v FROM dense UNION ALL SELECT frame_id, 2, y, x, 0.0, 0.0 FROM mosaic32""",
        ),
        *photometric_sql("ens", "frame_id, estimator", 1, "mosaic32", "moved32", 32),
        ("wn", "SELECT frame_id, estimator, y, x, u, v, CASE WHEN e IS NULL THEN 0 ELSE 1 / greatest(sqrt(e), 1) END AS w FROM ens LEFT JOIN ph USING (frame_id, estimator, y, x)"),
        ("nw", "SELECT * REPLACE (w / (sum(w) OVER (PARTITION BY frame_id, y, x) + 1e-8) AS w) FROM wn"),
    ),
)
def _(s, d):
    """Window correlation and patch search fused by photometric weights."""
    pairs = A.pair32(s, d).withColumnRenamed("pair_id", "frame_id")
    members = [
        {"name": "window_piv", "window_size": 12, "search_size": 16, "overlap": 8, "replace_iter": 2, "replace_radius": 1},
        {"name": "patch_flow", "levels": 2, "iterations": 4, "patch_size": 7, "stride": 4},
        {"name": "dummy"},
    ]
    options = {"weights_type": "photometric", "normalization": "per_pixel"}
    fused = estimators.estimate("consensus", pairs, A.LARGE, estimators=members, config=options)
    return out(fused, "u", "v")


_MEMBERS = [
    {"name": "window_piv", "window_size": 12, "search_size": 16, "overlap": 8, "replace_iter": 2, "replace_radius": 1},
    {"name": "dummy"},
]


def _moved_truth(s, d):
    """The displacement between the images of ``pair32``."""
    return A.mosaic32(s, d).select(*FYX, F.lit(2.0).alias("u"), F.lit(1.0).alias("v"))


@query(
    "evaluate_oracle_config",
    sql(
        "mosaic32 moved32",
        f"""SELECT count(*) AS frames, {r6('avg(e)', 'mean')}, {r6('max(e)', 'max')}, {r6('min(e)', 'min')} FROM (
          SELECT a.frame_id, avg(a.e) AS e FROM (
            SELECT a.frame_id, a.y, a.x, sqrt((avg(b.u) - 2) ** 2 + (avg(b.v) - 1) ** 2) AS e FROM fused a CROSS JOIN range(-1, 2) r1(dy) CROSS JOIN range(-1, 2) r2(dx)
            JOIN fused b ON b.frame_id = a.frame_id AND b.y = least(greatest(a.y + dy, 0), 31) AND b.x = least(greatest(a.x + dx, 0), 31)
            GROUP BY a.frame_id, a.y, a.x) a GROUP BY a.frame_id)""",
        *CORRELATION,
        *VECTORS,
        *refill_sql(2),
        ("ens", f"SELECT frame_id, y, x, u, v FROM ({resize_sql('r2', 'u v', (3, 3), (32, 32))}) UNION ALL SELECT frame_id, y, x, 0.0, 0.0 FROM mosaic32"),
        ("kept", "SELECT *, CASE WHEN sqrt((u - 2) ** 2 + (v - 1) ** 2) > 1.7 THEN 0.0 ELSE 1.0 END AS w FROM ens"),
        (
            "fused",
            "SELECT frame_id, y, x, "
            + ", ".join(f"CASE WHEN max(w) = 0 THEN sum({c}) / (count(*) + 1e-8) ELSE sum(w * {c}) / (sum(w) + 1e-8) END AS {c}" for c in "uv")
            + " FROM kept GROUP BY ALL",
        ),
    ),
)
def _(s, d):
    """A configured oracle ensemble: members masked by the truth, fused, smoothed and measured."""
    pairs = A.pair32(s, d).withColumnRenamed("pair_id", "frame_id")
    config = {
        "estimator": "consensus", "estimators": _MEMBERS, "algorithm": "mean", "oracle": True,
        "experiment_params": {"epe_limit": 1.7}, "postprocess": [{"name": "average_smoothing", "radius": 1}],
    }
    return out(evaluate.evaluate_field(config, pairs, _moved_truth(s, d), A.LARGE), "mean", "max", "min", keys=("frames",))


_GRID = {"preprocess.0.n": [0.5, 2.0], "config.weights.1": [0.25, 1.0], "postprocess.0.radius": [1, 2]}
_VARIED = (
    (
        "capped",
        """SELECT frame_id * 2 + k AS frame_id, y, x, least(i, med + [0.5, 2.0][k + 1] * sd) AS i FROM mosaic32
        JOIN (SELECT frame_id, median(i) AS med, stddev_pop(i) AS sd FROM mosaic32 GROUP BY frame_id) USING (frame_id) CROSS JOIN range(2) r(k)""",
    ),
    ("capped2", "SELECT frame_id, (y + 1) % 32 AS y, (x + 2) % 32 AS x, i FROM capped"),
    *corr_sql("capped", "capped2"),
    *VECTORS,
    *refill_sql(2),
    # the second member is the zero field
    (
        "fused",
        f"""SELECT frame_id, w, y, x, u / (1 + w + 1e-8) AS u, v / (1 + w + 1e-8) AS v
        FROM ({resize_sql('r2', 'u v', (3, 3), (32, 32))}) CROSS JOIN (VALUES (0.25), (1.0)) t(w)""",
    ),
    (
        "smooth",
        """SELECT a.frame_id, a.w, q.radius, a.y, a.x, avg(b.u) AS u, avg(b.v) AS v FROM fused a CROSS JOIN (VALUES (1), (2)) q(radius)
        CROSS JOIN range(-2, 3) r1(dy) CROSS JOIN range(-2, 3) r2(dx)
        JOIN fused b ON b.frame_id = a.frame_id AND b.w = a.w AND b.y = least(greatest(a.y + dy, 0), 31) AND b.x = least(greatest(a.x + dx, 0), 31)
        WHERE abs(dy) <= radius AND abs(dx) <= radius GROUP BY ALL""",
    ),
)


@query(
    "sweep_config",
    sql(
        "mosaic32",
        f"""SELECT ((frame_id % 2) * 4 + (w = 1)::INT * 2 + radius - 1)::INT AS setting, count(*) AS frames, {r6('avg(e)', 'mean')}, {r6('max(e)', 'max')}, {r6('min(e)', 'min')}
        FROM (SELECT frame_id, w, radius, avg(sqrt((u - 2) ** 2 + (v - 1) ** 2)) AS e FROM smooth GROUP BY ALL) GROUP BY frame_id % 2, w, radius""",
        *_VARIED,
    ),
)
def _(s, d):
    """An image step's, the ensemble's and a field step's parameter, all combinations in one job."""
    pairs = A.pair32(s, d).withColumnRenamed("pair_id", "frame_id")
    config = {
        "estimator": "consensus", "estimators": _MEMBERS, "config": {"weights_type": "list", "weights": [1.0, 1.0]},
        "preprocess": [{"name": "intensity_capping", "n": 1.0}], "postprocess": [{"name": "average_smoothing", "radius": 1}],
    }
    swept = sweep.sweep(config, _GRID, pairs, _moved_truth(s, d), A.LARGE)
    return out(swept, "mean", "max", "min", keys=("setting", "frames"))


@query(
    "evaluate_density_config",
    sql(
        "image8",
        f"""SELECT count(*) AS frames, {r6('avg(l)', 'mean')}, {r6('max(l)', 'max')}, {r6('min(l)', 'min')} FROM (
          SELECT frame_id, (d.e - t.e) ** 2 / t.e AS l
          FROM (SELECT frame_id, avg(CASE WHEN least(i, med + 1.1 * sd) > 70 THEN 1.0 ELSE 0.0 END) AS e
            FROM bs JOIN (SELECT frame_id, median(i) AS med, stddev_pop(i) AS sd FROM bs GROUP BY frame_id) USING (frame_id) GROUP BY frame_id) d
          JOIN (SELECT frame_id, avg(CASE WHEN i > 110 THEN 1.0 ELSE 0.0 END) AS e FROM image8 GROUP BY frame_id) t USING (frame_id))""",
        ("bs", "SELECT frame_id, y, x, greatest(i - 50, 0.0) AS i FROM image8"),
    ),
)
def _(s, d):
    image = A.image8(s, d)
    config = {"estimate_type": "density", "threshold": 70, "preprocess": steps.DENSITY_CHAIN}
    truth = normalize.density_threshold(image, 110)
    return out(evaluate.evaluate_density(config, image, truth, A.SMALL), "mean", "max", "min", keys=("frames",))


@query("evaluate_field_config")
def _(s, d):
    """Image steps, window correlation and field steps against a known displacement."""
    pairs = A.pair32(s, d).withColumnRenamed("pair_id", "frame_id")
    truth = A.mosaic32(s, d).select(*FYX, F.lit(2.0).alias("u"), F.lit(1.0).alias("v"))
    config = {
        "estimator": "window_piv", "window_size": 12, "search_size": 16, "overlap": 8,
        "preprocess": [{"name": "intensity_capping", "n": 2.0}, {"name": "stretch_contrast"}],
        "postprocess": [{"name": "universal_median_test", "radius": 1}, {"name": "tile_average_interpolation", "radius": 2}, {"name": "median_smoothing", "radius": 1}],
    }
    return out(evaluate.evaluate_field(config, pairs, truth, A.LARGE), "mean", "max", "min", keys=("frames",))


def _sequence_sql(steps_: int):
    """Half the new vectors and half the previous result, averaged over 3x3, step by step."""
    parts, last = [], None
    for t in range(1, steps_ + 1):
        before = "0.5 * n.u AS u, 0.5 * n.v AS v" if last is None else "0.5 * n.u + 0.5 * b.u AS u, 0.5 * n.v + 0.5 * b.v AS v"
        join = "" if last is None else f"JOIN {last} b ON b.seq_id = n.seq_id AND b.y = n.y AND b.x = n.x"
        parts.append((f"e{t}", f"SELECT n.seq_id, n.y, n.x, {before} FROM nw n {join} WHERE n.t = {t}"))
        parts.append(
            (
                f"f{t}",
                f"""SELECT a.seq_id, a.y, a.x, avg(b.u) AS u, avg(b.v) AS v FROM e{t} a CROSS JOIN range(-1, 2) r1(dy) CROSS JOIN range(-1, 2) r2(dx)
            JOIN e{t} b ON b.seq_id = a.seq_id AND b.y = least(greatest(a.y + dy, 0), 31) AND b.x = least(greatest(a.x + dx, 0), 31)
            GROUP BY a.seq_id, a.y, a.x""",
            )
        )
        last = f"f{t}"
    return parts


@query(
    "estimate_sequence",
    sql(
        "mosaic32",
        " UNION ALL ".join(f"SELECT seq_id, {t} AS t, y, x, {r6('u', 'u')}, {r6('v', 'v')} FROM f{t}" for t in range(1, 8)),
        ("prev32", "SELECT * FROM mosaic32 WHERE frame_id % 8 < 7 AND frame_id < (SELECT max(frame_id) FROM mosaic32)"),
        ("next32", "SELECT frame_id - 1 AS frame_id, y, x, i FROM mosaic32 WHERE frame_id % 8 > 0"),
        *corr_sql("prev32", "next32"),
        *VECTORS,
        *refill_sql(2),
        ("nw", f"SELECT frame_id // 8 AS seq_id, frame_id % 8 + 1 AS t, y, x, u, v FROM ({resize_sql('r2', 'u v', (3, 3), (32, 32))})"),
        *_sequence_sql(7),
    ),
)
def _(s, d):
    """Sequences of eight frames whose chain averages over time before it smooths."""
    f = A.mosaic32(s, d)
    frames = f.select(F.floor(F.col("frame_id") / 8).alias("seq_id"), (F.col("frame_id") % 8).cast("int").alias("t"), "y", "x", "i")
    config = {
        "estimator": "window_piv", "window_size": 12, "search_size": 16, "overlap": 8, "replace_iter": 2, "replace_radius": 1,
        "postprocess": [{"name": "temporal_smoothing_ema", "alpha": 0.5}, {"name": "average_smoothing", "radius": 1}],
    }
    return out(evaluate.estimate_sequence(config, frames, A.LARGE), "u", "v", keys=("seq_id", "t", "y", "x"))


# --- streams ----------------------------------------------------------------


def _event_stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    rows = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "ema_stream",
    f"""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT a.user_id AS key, a.event_id AS seq, {r6('sum(0.3 * pow(0.7, a.n - b.n) * b.value)', 'ema')}
    FROM e a JOIN e b ON b.user_id = a.user_id AND b.n <= a.n GROUP BY a.user_id, a.event_id""",
)
def _(s, d):
    target = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    averaged = streams.ema_stream(_event_stream(s, d), 0.3, "user_id", seq="event_id")
    writer = averaged.writeStream.format("parquet").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start(f"{target}/rows").awaitTermination()
    stored = s.read.schema(streams.EMA_OUTPUT).parquet(f"{target}/rows")
    return out(stored, "ema", keys=("key", "seq"))


@query(
    "running_metrics_stream",
    f"""SELECT event_type, count(value) AS n, {r6('avg(value)', 'run_mean')}, {r6('max(value)', 'run_max')}, {r6('min(value)', 'run_min')}
    FROM events GROUP BY event_type""",
)
def _(s, d):
    target = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    running = streams.running_metrics_stream(_event_stream(s, d), "value", ["event_type"])
    # every batch replaces the whole result, whose size is the number of event types
    writer = running.writeStream.outputMode("complete").option("checkpointLocation", f"{target}/state")
    writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{target}/rows"))
    writer.trigger(availableNow=True).start().awaitTermination()
    stored = s.read.parquet(f"{target}/rows")
    return out(stored, "run_mean", "run_max", "run_min", keys=("event_type", "n"))


@query(
    "history_stream",
    f"""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
    SELECT a.user_id AS key, a.event_id AS seq, k::INT AS slot, {r6('b.value', 'value')}
    FROM e a CROSS JOIN range(4) r(k) JOIN e b ON b.user_id = a.user_id AND b.n = greatest(a.n - 3 + k, 0)""",
)
def _(s, d):
    target = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rolled = streams.history_stream(_event_stream(s, d), 4, "user_id", seq="event_id")
    writer = rolled.writeStream.format("parquet").option("checkpointLocation", f"{target}/state")
    writer.trigger(availableNow=True).start(f"{target}/rows").awaitTermination()
    stored = s.read.schema(rolled.schema).parquet(f"{target}/rows")
    return out(stored.select("key", "seq", F.posexplode("hist").alias("slot", "value")), "value", keys=("key", "seq", "slot"))
