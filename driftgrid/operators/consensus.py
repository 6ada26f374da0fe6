"""Fusion of several estimators' fields into one.

An ensemble is ``(frame_id, estimator, y, x, u, v)``, with ``w`` once weighted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.operators.displaced import with_patch_error
from driftgrid.operators.metrics import epe
from driftgrid.scale import attach
from driftgrid.schema import FRAME, PIXEL
from driftgrid.tiles import TILE, along_x, along_y, own, shifted, spread

WEIGHTINGS = ("none", "list", "table", "photometric", "photograd")
NORMALIZATIONS = ("none", "per_batch", "per_pixel", "softmax_per_batch", "softmax_per_pixel", "max")


def stack(fields: Sequence[DataFrame]) -> DataFrame:
    """Fields of several estimators under each other, numbered in the given order."""
    parts = [f.withColumn("estimator", F.lit(k)) for k, f in enumerate(fields)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def oracle_mask(ensemble: DataFrame, truth: DataFrame, epe_limit: float, oracle: bool = True, keys=FRAME) -> DataFrame:
    """Add ``mask``: 0 where an estimator's error exceeds the limit, else 1."""
    if not oracle:
        raise ValueError("masking by the truth needs an oracle ensemble (oracle=True)")
    if epe_limit <= 0:
        raise ValueError(f"epe_limit must be a positive number, got {epe_limit}")
    known = truth.select(*keys, *PIXEL, F.col("u").alias("tu"), F.col("v").alias("tv"))
    joined = ensemble.join(known, [*keys, *PIXEL])
    return joined.withColumn("mask", F.when(epe() > F.lit(float(epe_limit)), 0.0).otherwise(1.0)).drop("tu", "tv")


def oracle_coverage(masked: DataFrame, keys=FRAME) -> DataFrame:
    """Share of pixels with at least one unmasked estimator, per frame."""
    per_pixel = masked.groupBy(*keys, *PIXEL).agg(F.max("mask").alias("hit"))
    return per_pixel.groupBy(*keys).agg(F.avg("hit").alias("coverage"))


def run_summary(coverage: DataFrame, errors: DataFrame, images: DataFrame, keys=FRAME) -> DataFrame:
    """One row for a run: coverage and mean error over the frames whose image is not blank.

    ``coverage`` has ``coverage``, ``errors`` has ``mean_epe``, ``images`` has ``nonzero`` per frame.
    """
    valid = images.where("nonzero").select(*keys)
    joined = coverage.join(errors, list(keys)).join(valid, list(keys), "left_semi")
    parts = [F.count(F.lit(1)).alias("frames")]
    for name, column in (("coverage", "coverage"), ("epe", "mean_epe")):
        parts += [f(column).alias(f"{name}_{label}") for label, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return joined.agg(*parts)


def weights_list(ensemble: DataFrame, weights: Sequence[float] | None) -> DataFrame:
    """One given weight per estimator, or 1 for all."""
    return ensemble.withColumn("w", listed_weight(weights))


def listed_weight(weights: Sequence[float] | None) -> Column:
    """The weight of a row's estimator in a list."""
    if weights is None:
        return F.lit(1.0)
    table = F.array(*[F.lit(float(w)) for w in weights])
    lacking = F.raise_error(F.concat(F.lit(f"{len(weights)} weights were given, none for estimator "), F.col("estimator").cast("string")))
    return F.when(F.col("estimator").between(0, len(weights) - 1), F.get(table, F.col("estimator"))).otherwise(lacking.cast("double"))


def weights_table(ensemble: DataFrame, weights: DataFrame, keys=FRAME) -> DataFrame:
    """A weight of its own for every frame, estimator and pixel, from a table with the column ``w``.

    A row of the ensemble without exactly one weight, or with a NULL one, raises
    an error; weights of pixels that the ensemble does not have are ignored.
    Both tables are placed by pixel once, and the normalisation and fusion of
    pixels that follow need no further exchange.
    """
    at = [*keys, "estimator", *PIXEL]
    given = weights.select(*at, F.col("w").cast("double").alias("_given"), F.lit(False).alias("_row"))
    rows = ensemble.withColumn("_row", F.lit(True)).unionByName(given, allowMissingColumns=True).repartition(*keys, *PIXEL)
    met = rows.withColumns({"_n": F.count("_given").over(Window.partitionBy(*at)), "_given": F.max("_given").over(Window.partitionBy(*at))})
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in at])
    wrong = F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" weights where one is needed: "), place)).cast("double")
    out = met.where("_row").withColumn("w", F.when(F.col("_n") == 1, F.col("_given")).otherwise(wrong))
    return out.drop("_row", "_n", "_given")


def weights_photometric(
    ensemble: DataFrame, prev: DataFrame, curr: DataFrame, shape: tuple[int, int], patch_size: int = 3, keys=FRAME
) -> DataFrame:
    """Weight ``1/max(error, 1)``; 0 where the patch leaves the frame."""
    rows = with_patch_error(ensemble, prev, curr, patch_size, shape, keys=keys)
    w = F.coalesce(1.0 / F.greatest(F.col("err"), F.lit(1.0)), F.lit(0.0))
    return rows.withColumn("w", F.when(F.col("err").isNotNull(), w).otherwise(0.0)).drop("err")


def weights_photograd(
    ensemble: DataFrame, prev: DataFrame, curr: DataFrame, shape: tuple[int, int], patch_size: int = 3, keys=FRAME
) -> DataFrame:
    """Gradient energy of the patch over its mean squared error; 0 where the patch leaves the frame."""
    rows = with_patch_error(ensemble, prev, curr, patch_size, shape, True, energy=True, keys=keys)
    w = F.coalesce(F.col("g") / (F.col("err") / float(patch_size**2) + F.lit(1e-4)), F.lit(0.0))
    return rows.withColumn("w", w).drop("err", "g")


def normalize_weights(weighted: DataFrame, kind: str = "none", epsilon: float = 1e-8, keys=FRAME) -> DataFrame:
    """Normalise ``w`` per frame or per pixel. A ``mask`` column zeroes before and after."""
    if kind not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {kind!r}; expected one of {NORMALIZATIONS}")
    masked = "mask" in weighted.columns

    def apply_mask(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.when(F.col("mask") != 0, F.col("w")).otherwise(0.0)) if masked else df

    out = apply_mask(weighted)
    eps = F.lit(float(epsilon))
    if kind == "per_batch":
        total = out.groupBy(*keys).agg(F.sum("w").alias("_s"))
        out = attach(out, total, keys).withColumn("w", F.col("w") / (F.col("_s") + eps)).drop("_s")
    elif kind == "softmax_per_batch":
        top = out.groupBy(*keys).agg(F.max("w").alias("_m"))
        shifted = attach(out, top, keys).withColumn("_e", F.exp(F.col("w") - F.col("_m")))
        total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_s"))
        out = attach(shifted, total, keys).withColumn("w", F.col("_e") / F.col("_s")).drop("_m", "_e", "_s")
    elif kind != "none":
        # a pixel has one row per estimator
        pixel = Window.partitionBy(*keys, *PIXEL)
        if kind == "per_pixel":
            out = out.withColumn("w", F.col("w") / (F.sum("w").over(pixel) + eps))
        elif kind == "softmax_per_pixel":
            out = out.withColumn("_e", F.exp(F.col("w") - F.max("w").over(pixel)))
            out = out.withColumn("w", F.col("_e") / F.sum("_e").over(pixel)).drop("_e")
        else:
            out = out.withColumn("_e", (F.col("w") == F.max("w").over(pixel)).cast("double"))
            out = out.withColumn("w", F.col("_e") / (F.sum("_e").over(pixel) + eps)).drop("_e")
    return apply_mask(out)


def make_weights(
    ensemble: DataFrame,
    prev: DataFrame | None = None,
    curr: DataFrame | None = None,
    config: dict | None = None,
    shape: tuple[int, int] | None = None,
    keys=FRAME,
) -> DataFrame:
    """Weights by ``weights_type`` and ``normalization`` of a config."""
    cfg = config or {}
    kind = cfg.get("weights_type") or "none"
    if kind not in WEIGHTINGS:
        raise ValueError(f"unknown weights_type: {kind}")
    normalization = cfg.get("normalization", "none")
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {normalization!r}")
    if kind in ("photometric", "photograd"):
        size = cfg.get("patch_size", 3)
        if not isinstance(size, int) or size <= 0 or size % 2 == 0:
            raise ValueError("patch_size must be a positive odd integer")
        if cfg.get("patch_stride", 1) != 1:
            raise ValueError("patch_stride must be 1")
        make = weights_photometric if kind == "photometric" else weights_photograd
        weighted = make(ensemble, prev, curr, shape, size, keys)
    elif kind == "list":
        if "weights" not in cfg:
            raise ValueError("weights must be provided when weights_type is 'list'")
        weighted = weights_list(ensemble, cfg["weights"])
    elif kind == "table":
        if not isinstance(cfg.get("weights"), DataFrame):
            raise ValueError("weights must be a table when weights_type is 'table'")
        weighted = weights_table(ensemble, cfg["weights"], keys)
    else:
        weighted = weights_list(ensemble, None)
    return normalize_weights(weighted, normalization, keys=keys)


def consensus_mean(weighted: DataFrame, epsilon: float = 1e-8, keys=FRAME) -> DataFrame:
    """Weighted mean per pixel; pixels whose weights are all 0 use equal weights."""
    return consensus_means(weighted, [F.col("w")], epsilon, keys).withColumnsRenamed({"u0": "u", "v0": "v"})


def consensus_means(ensemble: DataFrame, weights: Sequence[Column], epsilon: float = 1e-8, keys=FRAME) -> DataFrame:
    """``consensus_mean`` for several weights of the same rows at once, as ``u0, v0, u1, v1, …``."""
    made = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in ("u", "v")]]
    for k, w in enumerate(weights):
        made += [F.sum(w).alias(f"w{k}"), F.max(F.abs(w)).alias(f"top{k}")]
        made += [F.sum(w * F.col(c)).alias(f"w{c}{k}") for c in ("u", "v")]
    sums, eps = ensemble.groupBy(*keys, *PIXEL).agg(*made), F.lit(float(epsilon))

    def mean(c: str, k: int) -> Column:
        plain = F.col(f"s{c}") / (F.col("n") + eps)
        return F.when(F.col(f"top{k}") == 0, plain).otherwise(F.col(f"w{c}{k}") / (F.col(f"w{k}") + eps)).alias(f"{c}{k}")

    return sums.select(*keys, *PIXEL, *[mean(c, k) for k in range(len(weights)) for c in ("u", "v")])


def consensus_median(ensemble: DataFrame, keys=FRAME) -> DataFrame:
    """Median of each component per pixel (a pixel has one value per estimator)."""
    return ensemble.groupBy(*keys, *PIXEL).agg(F.median("u").alias("u"), F.median("v").alias("v"))


REGULARIZERS = ("smoothness", "divergence", "tv", "laplacian")


def _roughness(name: str, eps: float = 1e-4) -> Column:
    """One pixel's part of a regulariser, from the columns of ``_stencils``."""
    square = lambda c: c * c
    slopes = {c: square(F.col(f"{c}_dx")) + square(F.col(f"{c}_dy")) for c in ("u", "v")}
    if name == "smoothness":
        return slopes["u"] + slopes["v"]
    if name == "divergence":
        return square(F.col("u_dx") + F.col("v_dy"))
    if name == "tv":
        return F.sqrt(slopes["u"] + F.lit(float(eps))) + F.sqrt(slopes["v"] + F.lit(float(eps)))
    if name == "laplacian":
        return square(F.col("u_lap")) + square(F.col("v_lap"))
    raise ValueError(f"unknown regularizer {name!r}")


def _stencils(field: DataFrame, keys, tile: int) -> DataFrame:
    """Central differences and Laplacians of interior pixels, all from one exchange of tiles."""
    x, y = along_x(keys), along_y(keys)
    made = {}
    for c in ("u", "v"):
        right, left, below, above = shifted(c, 1, x), shifted(c, -1, x), shifted(c, 1, y), shifted(c, -1, y)
        made[f"{c}_dx"], made[f"{c}_dy"] = (right - left) / 2.0, (below - above) / 2.0
        made[f"{c}_lap"] = right + left + below + above - 4.0 * F.col(c)
    tiled = own(spread(field.select(*keys, *PIXEL, "u", "v"), 1, keys, tile).withColumns(made), tile)
    return tiled.where(F.col("u_dx").isNotNull() & F.col("u_dy").isNotNull())


def regularizer(field: DataFrame, name: str, eps: float = 1e-4, keys=FRAME, tile: int = TILE) -> DataFrame:
    """A roughness measure summed over the interior of every frame, as ``loss``."""
    return _stencils(field, keys, tile).groupBy(*keys).agg(F.sum(_roughness(name, eps)).alias("loss"))


def total_regularization(field: DataFrame, weights: dict[str, float], keys=FRAME, tile: int = TILE) -> DataFrame:
    """Weighted sum of several regularisers per frame.

    All of them are read off one tiled pass; what is exchanged after it is one partial sum per regulariser and frame.
    """
    parts = [float(weight) * F.sum(_roughness(name)) for name, weight in weights.items()]
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    return _stencils(field, keys, tile).groupBy(*keys).agg(total.alias("loss"))


def flows_objective(state: DataFrame, rho: float, kind: str = "l2", keys=FRAME) -> DataFrame:
    """Data term plus consensus term per frame.

    ``state``: per estimator and pixel ``u, v``, anchor ``au, av``, weight ``w``,
    consensus ``zu, zv`` and scaled dual ``du, dv``.
    """
    if kind not in ("l1", "l2"):
        raise ValueError(f"objective must be 'l1' or 'l2', got {kind!r}")
    gaps = [F.col("u") - F.col("au"), F.col("v") - F.col("av")]
    data = sum((g * g if kind == "l2" else F.abs(g)) for g in gaps) * F.col("w")
    return state.groupBy(*keys).agg(F.sum(data + 0.5 * rho * _residual()).alias("objective"))


def _residual() -> Column:
    ru = F.col("u") - F.col("zu") + F.col("du")
    rv = F.col("v") - F.col("zv") + F.col("dv")
    return ru * ru + rv * rv


def z_objective(state: DataFrame, rho: float, weights: dict[str, float] | None = None, keys=FRAME) -> DataFrame:
    """Consensus term plus regularisation of the consensus field, per frame."""
    term = state.groupBy(*keys).agg((F.lit(0.5 * rho) * F.sum(_residual())).alias("objective"))
    if not weights:
        return term
    z = state.where(F.col("estimator") == 0).select(*keys, *PIXEL, F.col("zu").alias("u"), F.col("zv").alias("v"))
    reg = total_regularization(z, weights, keys)
    return term.join(reg, list(keys)).select(*keys, (F.col("objective") + F.col("loss")).alias("objective"))


def x_update_l2(state: DataFrame, rho: float) -> DataFrame:
    """Closed form of the quadratic data term."""
    w = F.col("w")
    made = {
        c: (2.0 * w * F.col(f"a{c}") + rho * (F.col(f"z{c}") - F.col(f"d{c}"))) / (2.0 * w + rho) for c in ("u", "v")
    }
    return state.withColumns(made)


def x_update_l1(state: DataFrame, rho: float) -> DataFrame:
    """Closed form of the absolute data term: shrink towards the anchor."""

    def shrunk(c: str) -> Column:
        gap = F.col(f"z{c}") - F.col(f"d{c}") - F.col(f"a{c}")
        return F.col(f"a{c}") + F.signum(gap) * F.greatest(F.abs(gap) - F.col("w") / rho, F.lit(0.0))

    return state.withColumns({c: shrunk(c) for c in ("u", "v")})


def initial_state(weighted: DataFrame, keys=FRAME) -> DataFrame:
    """Starting point of the iteration: anchors, their mean and the scaled duals."""
    pixel = Window.partitionBy(*keys, *PIXEL)
    out = weighted.select(*keys, "estimator", *PIXEL, "u", "v", "w", F.col("u").alias("au"), F.col("v").alias("av"))
    out = out.withColumns({f"z{c}": F.avg(c).over(pixel) for c in ("u", "v")})
    return out.withColumns({f"d{c}": F.col(c) - F.col(f"z{c}") for c in ("u", "v")})
