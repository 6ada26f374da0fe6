"""From a config to results: prepare images, estimate, clean the field, measure it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.operators import metrics, normalize
from driftgrid.plans.estimators import ESTIMATORS, Run, estimate, estimate_run
from driftgrid.plans.steps import Context, adjusted, chain_from_config, measured, run_chain, validate_steps, with_statistics
from driftgrid.scale import durable, kept
from driftgrid.schema import FRAME, PIXEL

SIDES = ("prev", "curr")

# Keys of a config that are not parameters of its estimator (fixed values).
NOT_PARAMETERS = ("estimator", "estimate_type", "preprocess", "postprocess", "jit")


def _checked(config: dict) -> tuple[list[dict], list[dict], dict]:
    """Image steps, field steps and estimator parameters of a config."""
    if config.get("estimator") not in ESTIMATORS:
        raise ValueError(f"unknown estimator {config.get('estimator')!r}; known: {sorted(ESTIMATORS)}")
    image_steps, field_steps = chain_from_config(config)
    return image_steps, field_steps, {k: v for k, v in config.items() if k not in NOT_PARAMETERS}


def prepare_pairs(pairs: DataFrame, image_steps: list[dict], context: Context) -> tuple[DataFrame, Context]:
    """Both images of every pair after the image steps, and the context afterwards.

    Steps that need a frame's statistics only are done on the pairs themselves; for others the two
    images part and meet again by pixel.
    """
    validate_steps("image", image_steps)
    keys = context.keys
    while image_steps and measured(image_steps[0]):
        pairs = with_statistics(kept(pairs), image_steps[0], SIDES, keys)
        pairs = adjusted(pairs, image_steps[0], SIDES).select(*keys, *PIXEL, *SIDES)
        image_steps = image_steps[1:]
    if not image_steps:
        return pairs, context
    pairs = kept(pairs)  # read by the steps of both sides
    sides = []
    for name in SIDES:
        image = pairs.select(*keys, *PIXEL, F.col(name).alias("i"))
        image, after = run_chain("image", image, image_steps, context)
        sides.append(image.select(*keys, *PIXEL, F.col("i").alias(name)))
    return sides[0].join(sides[1], [*keys, *PIXEL]), after


def estimate_field(
    config: dict, pairs: DataFrame, shape: tuple[int, int], keys=FRAME, mask_mode: str = "intent", truth: DataFrame | None = None
) -> DataFrame:
    """Run a configured estimator with its image and field steps.

    ``config``: ``estimator``, its parameters, and optional ``preprocess`` and
    ``postprocess`` step lists. Everything is checked before Spark is used.
    The truth reaches estimators that ask for it, such as an oracle ensemble.
    """
    image_steps, field_steps, params = _checked(config)
    pairs, context = prepare_pairs(pairs, image_steps, Context(shape, tuple(keys), mask_mode))
    field = estimate(config["estimator"], pairs, context.shape, truth, keys=keys, **params)
    return run_chain("field", field, field_steps, context)[0]


def evaluate_run(
    config: dict, pairs: DataFrame, truth: DataFrame | None, shape: tuple[int, int], keys=FRAME, mask_mode: str = "intent"
) -> Run:
    """A configured run: the field after its field steps, and the metrics of the estimator's own field per frame."""
    image_steps, field_steps, params = _checked(config)
    pairs, context = prepare_pairs(pairs, image_steps, Context(shape, tuple(keys), mask_mode))
    run = estimate_run(config["estimator"], pairs, context.shape, truth, keys, **params)
    return Run(run_chain("field", run.field, field_steps, context)[0], run.frames)


def estimate_sequence(
    config: dict,
    frames: DataFrame,
    shape: tuple[int, int],
    propagate: bool = False,
    mask_mode: str = "intent",
    key: str = "seq_id",
    time: str = "t",
) -> DataFrame:
    """Fields of frame sequences in which a step depends on the field before it.

    ``frames`` holds ``seq_id, t, y, x, i``; the field at ``t`` belongs to the
    frames ``t-1`` and ``t``. ``propagate`` starts each estimate from the field
    before (the estimator takes ``start``), and an average over time may stand
    anywhere in the chain, since it reads the field the whole chain produced.
    That dependence allows one time step after the other; each handles all
    sequences together and reads only its own step's rows. Without it the steps
    are estimated all at once.
    """
    image_steps, field_steps, params = _checked(config)
    prepared, after = run_chain("image", frames, image_steps, Context(shape, (key, time), mask_mode))
    prepared = durable(prepared.select(key, *PIXEL, "i", F.col(time).cast("int").alias(time)), by=time)
    last = prepared.agg(F.max(time)).first()[0]
    if not last:
        raise ValueError("a sequence needs at least two frames")
    if not propagate and all(step["name"] != "temporal_smoothing_ema" for step in field_steps):
        before = prepared.select(key, (F.col(time) + 1).alias(time), *PIXEL, F.col("i").alias("prev"))
        pairs = prepared.withColumnRenamed("i", "curr").join(before, [key, time, *PIXEL])
        field = estimate(config["estimator"], pairs, after.shape, keys=(key, time), **params)
        field, _ = run_chain("field", field, field_steps, Context(after.shape, (key, time), mask_mode))
        return field.select(key, *PIXEL, "u", "v", time)

    def side(t: int, name: str) -> DataFrame:
        return prepared.where(F.col(time) == t).select(key, *PIXEL, F.col("i").alias(name))

    previous = side(0, "i").select(key, *PIXEL, F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    fields = []
    for t in range(1, last + 1):
        pairs = side(t - 1, "prev").join(side(t, "curr"), [key, *PIXEL])
        begun = {"start": previous} if propagate and t > 1 else {}
        field = estimate(config["estimator"], pairs, after.shape, keys=(key,), **params, **begun)
        context = Context(after.shape, (key,), mask_mode, previous=previous)
        field, _ = run_chain("field", field, field_steps, context)
        previous = durable(field.select(key, *PIXEL, "u", "v"))
        fields.append(previous.withColumn(time, F.lit(t)))
    out = fields[0]
    for more in fields[1:]:
        out = out.unionByName(more)
    return out


def estimate_density(config: dict, image: DataFrame, shape: tuple[int, int], keys=FRAME) -> DataFrame:
    """Share of bright pixels after the configured image steps."""
    image_steps, _ = chain_from_config(config)
    prepared, _ = run_chain("image", image, image_steps, Context(shape, tuple(keys)))
    return normalize.density_threshold(prepared, config["threshold"], keys)


def evaluate_field(config: dict, pairs: DataFrame, truth: DataFrame, shape: tuple[int, int], keys=FRAME) -> DataFrame:
    """Mean endpoint error per frame, summed up over the data set."""
    return metrics.eval_dataset(estimate_field(config, pairs, shape, keys, truth=truth), truth, keys)


def evaluate_density(config: dict, image: DataFrame, truth: DataFrame, shape: tuple[int, int], keys=FRAME) -> DataFrame:
    return metrics.eval_density(estimate_density(config, image, shape, keys), truth, keys)


def compare_configs(
    first: dict, second: dict, pairs: DataFrame, shape: tuple[int, int], keys=FRAME, threshold: float = 0.5
) -> DataFrame:
    """Statistics of the per-frame distance between two estimators' fields."""
    fields = [estimate_field(c, pairs, shape, keys) for c in (first, second)]
    return metrics.error_stats(metrics.compare_sources(*fields, keys), "mean_epe", threshold)
