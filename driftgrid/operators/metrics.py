"""Error measures, statistics and data-set evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import at_least, clip, magnitude, missing
from driftgrid.operators.differential import div_vort
from driftgrid.quantiles import BOUND, quantiles
from driftgrid.schema import FRAME, PIXEL


def paired(estimate: DataFrame, truth: DataFrame, keys=FRAME) -> DataFrame:
    """Estimate and truth (``tu, tv``) side by side by pixel."""
    renamed = truth.select(*keys, *PIXEL, F.col("u").alias("tu"), F.col("v").alias("tv"))
    return estimate.join(renamed, [*keys, *PIXEL])


def epe() -> Column:
    du, dv = F.col("u") - F.col("tu"), F.col("v") - F.col("tv")
    return F.sqrt(du * du + dv * dv)


def angle_error() -> Column:
    """Angle between the vectors as a share of a half turn."""
    dot = F.col("u") * F.col("tu") + F.col("v") * F.col("tv")
    norms = at_least(magnitude() * magnitude("tu", "tv"), 1e-3)
    return F.acos(clip(dot / norms, -1.0, 1.0)) / F.pi()


def relative_error() -> Column:
    return F.abs(magnitude() - magnitude("tu", "tv")) / at_least(magnitude("tu", "tv"), 1e-10)


def squared_epe() -> Column:
    du, dv = F.col("u") - F.col("tu"), F.col("v") - F.col("tv")
    return du * du + dv * dv


def loss_supervised(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg(squared_epe()).alias("loss"))


def density_loss(estimated: DataFrame, truth: DataFrame, keys=FRAME) -> DataFrame:
    """Squared density error relative to the true density, per frame."""
    known = truth.select(*keys, F.col("density").alias("true_density"))
    gap = F.col("density") - F.col("true_density")
    return estimated.join(known, list(keys)).select(*keys, (gap * gap / F.col("true_density")).alias("loss"))


def error_stats(
    df: DataFrame, value: str, threshold: float = 0.5, by: Sequence[str] = (), bound: int = BOUND
) -> DataFrame:
    """Mean, population deviation, share below the threshold, quartiles and whiskers.

    The quartiles are exact; see ``quantiles`` for how they stay distributed.
    """
    by = list(by)
    moments = [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.avg((F.col(value) < F.lit(float(threshold))).cast("double")).alias("fraction_below_threshold"),
    ]
    joined = quantiles(df, value, [0.25, 0.5, 0.75], by, bound, extras=moments)
    iqr = F.col("q2") - F.col("q0")
    return joined.select(
        *by,
        "mean",
        "std",
        "fraction_below_threshold",
        F.col("q0").alias("lower_quartile"),
        F.col("q2").alias("upper_quartile"),
        F.col("q1").alias("median"),
        (F.col("q0") - 1.5 * iqr).alias("lower_whisker"),
        (F.col("q2") + 1.5 * iqr).alias("upper_whisker"),
    )


def frame_epe(pairs: DataFrame, keys=FRAME) -> DataFrame:
    """``mean_epe`` over the pixels of a frame where both vectors are there, and how many are ``missing``.

    NULL and NaN both count as missing; a frame without a measured pixel has a NULL mean.
    """
    gone = missing("u", "v", "tu", "tv")
    return pairs.groupBy(*keys).agg(F.avg(F.when(~gone, epe())).alias("mean_epe"), F.count_if(gone).alias("missing"), F.count("*").alias("pixels"))


def summary(per_frame: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Statistics over frames with a value; with ``missing`` and ``pixels`` per frame also their sums and the share measured."""
    parts = [F.count(value).alias("frames"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min")]
    if {"missing", "pixels"} <= set(per_frame.columns):
        parts += [F.sum("missing").alias("missing"), (1 - F.sum("missing") / F.sum("pixels")).alias("coverage")]
    return per_frame.groupBy(*by).agg(*parts)


def eval_dataset(estimate: DataFrame, truth: DataFrame, keys=FRAME, by: Sequence[str] = ()) -> DataFrame:
    """Mean endpoint error per frame, then its mean, maximum and minimum over the data set.

    ``missing`` and ``coverage`` say how many pixels had no vector and what share entered the means.
    """
    return eval_pairs(paired(estimate, truth, keys), keys, by)


def eval_pairs(pairs: DataFrame, keys=FRAME, by: Sequence[str] = ()) -> DataFrame:
    """``eval_dataset`` of an estimate that has its truth (``tu, tv``) beside it."""
    if "is_padding" in pairs.columns:
        pairs = pairs.where(~F.col("is_padding"))
    return summary(frame_epe(pairs, list(dict.fromkeys([*by, *keys]))), "mean_epe", by)


def eval_density(estimated: DataFrame, truth: DataFrame, keys=FRAME) -> DataFrame:
    return summary(density_loss(estimated, truth, keys), "loss")


def constraint_violation(
    field: DataFrame, max_speed: float, thresholds: dict | None = None, keys=FRAME, bound: int = BOUND
) -> DataFrame:
    """Statistics of excess speed and squared divergence, one row per constraint."""
    limits = thresholds or {}
    speed = field.select(at_least(magnitude() - F.lit(float(max_speed)), 0.0).alias("value"))
    squared = div_vort(field.select(*keys, *PIXEL, "u", "v"), keys).select((F.col("div") * F.col("div")).alias("value"))
    parts = []
    for name, table in (("speed", speed), ("divergence", squared)):
        stats = error_stats(table, "value", limits.get(name, 0.01), bound=bound)
        parts.append(stats.select(F.lit(name).alias("constraint"), "*"))
    return parts[0].unionByName(parts[1])


def reward(pairs: DataFrame, keys=FRAME) -> DataFrame:
    return pairs.groupBy(*keys).agg((-F.avg(epe())).alias("reward"))


def sequence_loss(predictions: DataFrame, iterations: int, gamma: float = 0.8) -> DataFrame:
    """Discounted sum over refinement iterations of the mean absolute difference.

    ``predictions`` holds ``iter, u, v, tu, tv``; later iterations weigh more.
    """
    gap = (F.abs(F.col("u") - F.col("tu")) + F.abs(F.col("v") - F.col("tv"))) / 2.0
    per_iter = predictions.groupBy("iter").agg(F.avg(gap).alias("l1"))
    weight = F.pow(F.lit(float(gamma)), F.lit(iterations - 1) - F.col("iter"))
    return per_iter.agg(F.sum(weight * F.col("l1")).alias("loss"))


def compare_sources(first: DataFrame, second: DataFrame, keys=FRAME) -> DataFrame:
    """Per-frame mean distance between two estimates of the same frames."""
    return frame_epe(paired(first, second, keys), keys)


def unmatched_frames(first: DataFrame, second: DataFrame, keys=FRAME) -> DataFrame:
    """Frames that only one of two sources has."""
    a, b = (t.select(*keys).distinct() for t in (first, second))
    only = [x.join(y, list(keys), "left_anti").withColumn("missing_in", F.lit(name)) for x, y, name in ((a, b, "second"), (b, a, "first"))]
    return only[0].unionByName(only[1])


def disagreeing_truth(first: DataFrame, second: DataFrame, atol: float = 1e-4, keys=FRAME) -> DataFrame:
    """Frames whose two truths differ by more than ``atol`` anywhere."""
    gap = at_least(F.abs(F.col("u") - F.col("tu")), F.abs(F.col("v") - F.col("tv")))
    worst = paired(first, second, keys).groupBy(*keys).agg(F.max(gap).alias("gap"))
    return worst.where(F.col("gap") > F.lit(atol))
