"""Named estimators: from image pairs to fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators import admm, consensus, correlation, metrics, search
from driftgrid.scale import durable
from driftgrid.schema import FRAME, PIXEL


@dataclass(frozen=True)
class Run:
    """What a run of an estimator gives.

    ``field``: the vectors. ``frames``: a row per frame with ``valid`` (the later
    image is not blank), ``coverage`` (share of pixels where an estimator stays
    within the limit), ``stop_iter`` (0-based iteration at which the consensus
    stopped) and ``mean_epe`` against the truth; NULL where a run has no such value.
    """

    field: DataFrame
    frames: DataFrame


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}
RUNS: dict[str, Callable[..., Run]] = {}
INFORMED: set[str] = set()


def register_estimator(
    name: str, estimate: Callable[..., DataFrame], run: Callable[..., Run] | None = None, informed: bool = False
) -> None:
    """``estimate(pairs, shape, **params)`` maps ``frame_id, y, x, prev, curr`` to a field.

    An ``informed`` estimator also takes ``truth``. ``run`` takes the same
    arguments and the truth, and returns the metrics of the run as well.
    """
    ESTIMATORS[name] = estimate
    (INFORMED.add if informed else INFORMED.discard)(name)
    RUNS.pop(name, None)
    if run is not None:
        RUNS[name] = run


def _known(name: str) -> None:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(ESTIMATORS)}")


def estimate(name: str, pairs: DataFrame, shape: tuple[int, int], truth: DataFrame | None = None, **params) -> DataFrame:
    """The field of a named estimator; the truth reaches informed ones only."""
    _known(name)
    told = {"truth": truth} if name in INFORMED and truth is not None else {}
    return ESTIMATORS[name](pairs, shape, **params, **told)


def estimate_run(name: str, pairs: DataFrame, shape: tuple[int, int], truth: DataFrame | None = None, keys=FRAME, **params) -> Run:
    """The field of a named estimator and its metrics per frame."""
    _known(name)
    if name in RUNS:
        return RUNS[name](pairs, shape, truth=truth, keys=keys, **params)
    field = durable(estimate(name, pairs, shape, truth, keys=keys, **params))
    return Run(field, frame_metrics(pairs, field, truth, keys=keys))


def frame_metrics(pairs, field, truth=None, masked=None, stops=None, keys=FRAME) -> DataFrame:
    """The rows of ``Run.frames``; what is joined here has one row per frame."""
    keys = list(keys)
    out = pairs.groupBy(*keys).agg(F.max(F.coalesce(F.col("curr") != 0, F.lit(False))).alias("valid"))
    parts = (
        ("coverage", "double", consensus.oracle_coverage(masked, keys) if masked is not None else None),
        ("stop_iter", "int", stops.select(*keys, F.col("stop_iter").cast("int")) if stops is not None else None),
        ("mean_epe", "double", metrics.frame_epe(metrics.paired(field, truth, keys), keys).select(*keys, "mean_epe") if truth is not None else None),
    )
    for name, kind, part in parts:
        out = out.withColumn(name, F.lit(None).cast(kind)) if part is None else out.join(part, keys, "left")
    return out


def run_report(run: Run, by: Sequence[str] = ()) -> DataFrame:
    """One row for a run: statistics over the frames whose image is not blank (a summary for ``sources.tables.run_log_append``)."""
    parts = [F.count("*").alias("frames"), F.count("stop_iter").alias("stopped"), F.avg("stop_iter").alias("mean_stop_iter")]
    for name, column in (("epe", "mean_epe"), ("coverage", "coverage")):
        parts += [f(column).alias(f"{label}_{name}") for label, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return run.frames.where("valid").groupBy(*by).agg(*parts)


def _side(pairs: DataFrame, name: str, keys) -> DataFrame:
    return pairs.select(*keys, *PIXEL, F.col(name).alias("i"))


def dummy(pairs: DataFrame, shape, keys=FRAME) -> DataFrame:
    """The zero field."""
    return pairs.select(*keys, *PIXEL, F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))


def window_piv(pairs: DataFrame, shape, window_size=16, search_size=21, overlap=8, replace_iter=10, replace_radius=3, keys=FRAME) -> DataFrame:
    return correlation.piv_field(pairs, shape, window_size, search_size, overlap, replace_iter, replace_radius, keys)


def patch_flow(pairs: DataFrame, shape, start: DataFrame | None = None, keys=FRAME, **params) -> DataFrame:
    """Coarse-to-fine patch search; ``start`` continues from an earlier estimate."""
    return search.coarse_to_fine(_side(pairs, "prev", keys), _side(pairs, "curr", keys), shape, start=start, keys=keys, **params)


def members(pairs: DataFrame, shape: tuple[int, int], estimators: Sequence[dict], keys=FRAME) -> DataFrame:
    """The fields of several estimators as one stored ensemble."""
    return durable(stacked(pairs, shape, estimators, keys))


def stacked(pairs: DataFrame, shape: tuple[int, int], estimators: Sequence[dict], keys=FRAME) -> DataFrame:
    """``members`` without storing them, to be read once."""
    if not estimators:
        raise ValueError("an ensemble needs at least one estimator")
    fields = [estimate(e["name"], pairs, shape, keys=keys, **{k: v for k, v in e.items() if k != "name"}) for e in estimators]
    return consensus.stack(fields)


def _limit(epe_limit, experiment_params, oracle):
    """The limit of a config; masking by the truth needs an oracle ensemble."""
    limit = epe_limit if epe_limit is not None else (experiment_params or {}).get("epe_limit")
    if limit is not None and not oracle:
        raise ValueError("masking by the truth needs an oracle ensemble (oracle=True)")
    return limit


def fuse_run(
    pairs: DataFrame,
    shape: tuple[int, int],
    estimators: Sequence[dict],
    algorithm: str = "mean",
    config: dict | None = None,
    epe_limit: float | None = None,
    truth: DataFrame | None = None,
    experiment_params: dict | None = None,
    oracle: bool = True,
    keys=FRAME,
) -> Run:
    """Run several estimators, mask them by the truth if asked to, weight and fuse them.

    The limit is ``epe_limit`` or that of ``experiment_params``.
    """
    limit = _limit(epe_limit, experiment_params, oracle)
    _fusable(algorithm, limit, truth)
    pairs = durable(pairs)  # every member reads them
    return fuse_ensemble(members(pairs, shape, estimators, keys), pairs, shape, algorithm, config, limit, truth, keys)


def fuse(pairs: DataFrame, shape: tuple[int, int], estimators: Sequence[dict], **options) -> DataFrame:
    """The field of ``fuse_run``."""
    return fuse_run(pairs, shape, estimators, **options).field


def _fusable(algorithm: str, epe_limit: float | None, truth: DataFrame | None) -> None:
    if algorithm not in ("mean", "median", "admm"):
        raise ValueError(f"unknown consensus algorithm {algorithm!r}")
    if epe_limit is not None and truth is None:
        raise ValueError("masking by the truth needs the truth")


def fuse_ensemble(ensemble, pairs, shape, algorithm="mean", config=None, epe_limit=None, truth=None, keys=FRAME) -> Run:
    """Mask, weight and fuse an ensemble; with its metrics per frame."""
    _fusable(algorithm, epe_limit, truth)
    masked = stops = None
    if epe_limit is not None:
        masked = ensemble = durable(consensus.oracle_mask(ensemble, truth, epe_limit, True, keys))  # read by fusion and coverage
    if algorithm == "median":
        field = consensus.consensus_median(ensemble, keys)
    else:
        weighted = consensus.make_weights(ensemble, _side(pairs, "prev", keys), _side(pairs, "curr", keys), config, shape, keys)
        if algorithm == "mean":
            field = consensus.consensus_mean(weighted, keys=keys)
        else:
            result = admm.consensus_admm(weighted, config, keys, shape)
            field, stops = result.field, result.stops
    return Run(field, frame_metrics(pairs, field, truth, masked, stops, keys))


def fuse_fields(ensemble, pairs, shape, algorithm="mean", config=None, epe_limit=None, truth=None, keys=FRAME) -> DataFrame:
    """The field of ``fuse_ensemble``."""
    return fuse_ensemble(ensemble, pairs, shape, algorithm, config, epe_limit, truth, keys).field


def sweep_epe_limit(ensemble: DataFrame, truth: DataFrame, limits: Sequence[float], keys=FRAME) -> DataFrame:
    """Fused error for every value of the oracle limit, as one job.

    The parameter is one more key: each row is taken once per value.
    """
    if any(limit <= 0 for limit in limits):
        raise ValueError("limits must be positive")
    known = truth.select(*keys, *PIXEL, F.col("u").alias("tu"), F.col("v").alias("tv"))
    joined = ensemble.join(known, [*keys, *PIXEL])
    du, dv = F.col("u") - F.col("tu"), F.col("v") - F.col("tv")
    joined = joined.withColumn("_err", F.sqrt(du * du + dv * dv))
    grid = joined.withColumn("epe_limit", F.explode(F.array(*[F.lit(float(v)) for v in limits])))
    grid = grid.withColumn("w", F.when(F.col("_err") > F.col("epe_limit"), 0.0).otherwise(1.0))
    by = ["epe_limit", *keys]
    fused = consensus.consensus_mean(grid, keys=by)
    pairs = fused.join(known, [*keys, *PIXEL])
    gap = F.sqrt((F.col("u") - F.col("tu")) ** 2 + (F.col("v") - F.col("tv")) ** 2)
    per_frame = pairs.groupBy(*by).agg(F.avg(gap).alias("mean_epe"))
    return per_frame.groupBy("epe_limit").agg(
        F.avg("mean_epe").alias("mean"), F.max("mean_epe").alias("max"), F.min("mean_epe").alias("min")
    )


register_estimator("dummy", dummy)
register_estimator("window_piv", window_piv)
register_estimator("patch_flow", patch_flow)
register_estimator("consensus", fuse, fuse_run, informed=True)
