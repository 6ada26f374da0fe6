"""Named steps on images and fields, chained from a list of dicts.

A step is ``{"name": ..., **parameters}``. All parameters of a chain are checked
before Spark is touched; the chain itself is a composition of DataFrame
transformations, which Catalyst plans as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.operators import filling, normalize, pixels, resample, sequences, smoothing, validation
from driftgrid.scale import attach
from driftgrid.schema import FRAME
from driftgrid.tiles import own, spread


@dataclass(frozen=True)
class Context:
    """What a step needs to know besides the table.

    ``keys`` identify a frame; for sequences the last one is the step number.
    ``mask_mode``: ``intent`` removes outliers from ``valid``; ``reference``
    keeps the literal convention in which a detected outlier is what the next
    step reads as valid. For averages over time, either ``time`` names the step
    number among the keys or ``previous`` is the final field of the step before.
    Chains with the same least ``halo`` begin with the same exchange.
    """

    shape: tuple[int, int]
    keys: tuple[str, ...] = FRAME
    mask_mode: str = "intent"
    time: str | None = None
    previous: DataFrame | None = None
    halo: int = 0


Apply = Callable[..., "DataFrame | tuple[DataFrame, Context]"]


@dataclass(frozen=True)
class Step:
    """``apply(table, context, **params)`` and ``check(**params)``.

    With ``reach(**params)`` given, ``apply`` works in place on a table spread
    over tiles and looks that many pixels away. A ``whole`` step reads statistics
    of the whole table, so that it sees one setting of a sweep at a time. With
    ``measure(table, columns, keys)`` an image step is ``adjust(column, **params)``,
    an expression of a pixel and of those statistics of its frame.
    """

    apply: Apply
    check: Callable[..., None]
    reach: Callable[..., int] | None = None
    whole: bool = False
    measure: Callable[..., DataFrame] | None = None
    adjust: Callable[..., Column] | None = None


# Neighbouring steps share one exchange up to this halo.
MAX_HALO = 32


IMAGE_STEPS: dict[str, Step] = {}
FIELD_STEPS: dict[str, Step] = {}


def register_step(
    kind: str, name: str, apply: Apply, check: Callable[..., None], reach: Callable[..., int] | None = None, whole: bool = False,
    measure: Callable[..., DataFrame] | None = None, adjust: Callable[..., Column] | None = None,
) -> None:
    """Add a step (see ``Step``)."""
    _registry(kind)[name] = Step(apply, check, reach, whole, measure, adjust)


def measured(step: dict) -> bool:
    """Whether an image step is an expression of a pixel and its frame's statistics."""
    return IMAGE_STEPS[step["name"]].measure is not None


def with_statistics(table: DataFrame, step: dict, columns: Sequence[str], keys) -> DataFrame:
    """The pixels with what ``adjusted`` needs of their frames."""
    return attach(table, IMAGE_STEPS[step["name"]].measure(table, columns, keys), keys)


def adjusted(table: DataFrame, step: dict, columns: Sequence[str]) -> DataFrame:
    """A measured step done on several image columns in place; the statistics stay."""
    params = {k: v for k, v in step.items() if k != "name"}
    return table.withColumns({c: IMAGE_STEPS[step["name"]].adjust(c, **params) for c in columns})


def widest_halo(chains: Sequence[Sequence[dict]]) -> int:
    """The halo with which chains of field steps done in place can share their first exchange."""
    return min(MAX_HALO, max(sum(FIELD_STEPS[s["name"]].reach(**{k: v for k, v in s.items() if k != "name"}) for s in chain) for chain in chains))


def keeps_columns(kind: str, steps: Sequence[dict]) -> bool:
    """Whether other columns of a table pass through all the steps (those done in place)."""
    return all(_registry(kind)[step["name"]].reach is not None for step in steps)


def reads_whole_table(kind: str, steps: Sequence[dict]) -> bool:
    return any(_registry(kind)[step["name"]].whole for step in steps)


def _registry(kind: str) -> dict[str, Step]:
    if kind not in ("image", "field"):
        raise ValueError(f"kind must be 'image' or 'field', got {kind!r}")
    return IMAGE_STEPS if kind == "image" else FIELD_STEPS


def validate_steps(kind: str, steps: Sequence[dict]) -> None:
    known = _registry(kind)
    if not isinstance(steps, (list, tuple)):
        raise ValueError("steps must be a list of dicts")
    for step in steps:
        if not isinstance(step, dict) or "name" not in step:
            raise ValueError(f"each step must be a dict with a 'name', got {step!r}")
        if step["name"] not in known:
            raise ValueError(f"unknown {kind} step {step['name']!r}")
        params = {k: v for k, v in step.items() if k != "name"}
        known[step["name"]].check(**params)


def run_steps(kind: str, table: DataFrame, steps: Sequence[dict], context: Context) -> DataFrame:
    """Apply the steps in order. Fields start with every vector valid."""
    return run_chain(kind, table, steps, context)[0]


def run_chain(kind: str, table: DataFrame, steps: Sequence[dict], context: Context) -> tuple[DataFrame, Context]:
    """``run_steps`` that also returns the context afterwards (crops and resizes change the shape)."""
    validate_steps(kind, steps)
    if context.previous is None and any(s["name"] == "temporal_smoothing_ema" for s in steps[:-1]):
        raise ValueError(
            "temporal_smoothing_ema averages the chain's final output: as an inner step it needs the previous one "
            "(see plans.evaluate.estimate_sequence)"
        )
    known = _registry(kind)
    if kind == "field" and "valid" not in table.columns:
        table = table.withColumn("valid", F.lit(True))
    together: list[tuple[Step, dict]] = []
    for step in steps:
        params = {k: v for k, v in step.items() if k != "name"}
        found = known[step["name"]]
        if found.reach is not None:
            if together and _halo(together) + found.reach(**params) > MAX_HALO:
                table, together = _in_place(table, context, together), []
            together.append((found, params))
            continue
        table, together = _in_place(table, context, together), []
        result = found.apply(table, context, **params)
        table, context = result if isinstance(result, tuple) else (result, context)
    return _in_place(table, context, together), context


def _halo(steps: list[tuple[Step, dict]]) -> int:
    return sum(step.reach(**params) for step, params in steps)


def _in_place(table: DataFrame, context: Context, steps: list[tuple[Step, dict]]) -> DataFrame:
    """Apply neighbourhood steps one after the other within one exchange.

    Its halo is the sum of their reaches: what the missing outer pixels spoil
    moves inwards by each step's reach and never arrives at a tile's own pixels.
    """
    halo = _halo(steps) and max(_halo(steps), context.halo)
    if halo:
        table = spread(table, halo, context.keys)
    for step, params in steps:
        table = step.apply(table, context, **params)
    return own(table) if halo else table


def chain_from_config(config: dict) -> tuple[list[dict], list[dict]]:
    """Checked image and field steps of a config; other keys are left alone."""
    chains = []
    for kind, key in (("image", "preprocess"), ("field", "postprocess")):
        steps = config.get(key) or []
        if not isinstance(steps, list):
            raise ValueError(f"{key} must be a list of steps")
        validate_steps(kind, steps)
        chains.append(steps)
    return chains[0], chains[1]


# --- parameter checks -------------------------------------------------------


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_count(value, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def _need(ok: bool, name: str, value, what: str) -> None:
    if not ok:
        raise ValueError(f"{name} must be {what}, got {value!r}")


def _need_number(name: str, value) -> None:
    if not _is_number(value):
        raise TypeError(f"{name} must be a number, got {type(value)}")


def _no_parameters() -> None:
    pass


def _check_n(n: float = 2.0) -> None:
    _need_number("n", n)
    _need(n > 0, "n", n, "positive")


def _check_clahe(clip_limit: float = 0.01, tile_grid_size=None, nbins: int = 256) -> None:
    _need_number("clip_limit", clip_limit)
    _need(clip_limit > 0, "clip_limit", clip_limit, "positive")
    if tile_grid_size is not None:
        fits = isinstance(tile_grid_size, (tuple, list)) and len(tile_grid_size) == 2
        _need(fits and all(_is_count(n, 1) for n in tile_grid_size), "tile_grid_size", tile_grid_size, "two positive integers")
    _need(_is_count(nbins, 1), "nbins", nbins, "a positive integer")


def _check_sigma(sigma: float, truncate: float = 4.0) -> None:
    _need(_is_number(sigma) and sigma > 0, "sigma", sigma, "a positive number")
    _need(_is_number(truncate) and truncate > 0, "truncate", truncate, "a positive number")


def _check_threshold(threshold: float = 0.0) -> None:
    _need_number("threshold", threshold)
    _need(threshold >= 0, "threshold", threshold, "non-negative")


def _check_size(target_height: int, target_width: int) -> None:
    for name, value in (("target_height", target_height), ("target_width", target_width)):
        _need(_is_count(value, 1), name, value, "a positive integer")


def _check_crop(target_height: int, target_width: int, fraction_v: float = 0.5, fraction_h: float = 0.5) -> None:
    _check_size(target_height, target_width)
    for name, value in (("fraction_v", fraction_v), ("fraction_h", fraction_h)):
        _need(_is_number(value) and 0 <= value <= 1, name, value, "in [0, 1]")


def _check_speed(vel_min: float, vel_max: float) -> None:
    for name, value in (("vel_min", vel_min), ("vel_max", vel_max)):
        _need(_is_number(value), name, value, "a number")
    _need(vel_min <= vel_max, "vel_min", vel_min, f"at most {vel_max}")


def _check_global(n_sigma: float) -> None:
    _need(_is_number(n_sigma) and n_sigma > 0, "n_sigma", n_sigma, "a positive number")


def _check_local(n_sigma: float, radius: int = 1) -> None:
    _check_global(n_sigma)
    _need(_is_count(radius, 0), "radius", radius, "a non-negative integer")


def _check_median_test(r_threshold: float = 2.0, epsilon: float = 0.1, radius: int = 1) -> None:
    for name, value in (("r_threshold", r_threshold), ("epsilon", epsilon)):
        _need(_is_number(value) and value > 0, name, value, "a positive number")
    _need(_is_count(radius, 0), "radius", radius, "a non-negative integer")


def _check_radius(radius: int = 3) -> None:
    _need(_is_count(radius, 1), "radius", radius, "a positive integer")


def _check_iterations(num_iter: int = 512) -> None:
    _need(_is_count(num_iter, 1), "num_iter", num_iter, "a positive integer")


def _check_alpha(alpha: float) -> None:
    _need(isinstance(alpha, float) and 0 <= alpha <= 1, "alpha", alpha, "a float in [0, 1]")


def _check_quantize(min_val, max_val, dtype: str = "uint8") -> None:
    for name, value in (("min_val", min_val), ("max_val", max_val)):
        _need(len(value) == 2 and all(_is_number(v) for v in value), name, value, "two numbers")
    _need(dtype in pixels.CODE_MAX, "dtype", dtype, f"one of {sorted(pixels.CODE_MAX)}")


# --- steps ------------------------------------------------------------------


def _crop(table, ctx, target_height, target_width, fraction_v=0.5, fraction_h=0.5):
    out = pixels.crop(table, ctx.shape, target_height, target_width, fraction_v, fraction_h)
    return out, replace(ctx, shape=(target_height, target_width))


def _resize_image(table, ctx, target_height, target_width):
    size = (target_height, target_width)
    return resample.resize_antialias(table, ["i"], ctx.shape, size, ctx.keys), replace(ctx, shape=size)


def _resize_flow(table, ctx, target_height, target_width):
    size = (target_height, target_width)
    out = resample.resize_antialias(table, ["u", "v"], ctx.shape, size, ctx.keys)
    return out.withColumn("valid", F.lit(True)), replace(ctx, shape=size)


def _marking(find: Callable[..., DataFrame]) -> Apply:
    """A detector as a step: its verdict goes into ``valid``."""

    def apply(table, ctx, **params):
        out = find(table, ctx, **params)
        keep = ~F.col("is_outlier") if ctx.mask_mode == "intent" else F.col("is_outlier")
        return out.withColumn("valid", F.col("valid") & keep).drop("is_outlier")

    return apply


def _ema(table, ctx, alpha):
    if ctx.previous is not None:
        before = ctx.previous.select(*ctx.keys, "y", "x", F.col("u").alias("_pu"), F.col("v").alias("_pv"))
        joined = table.join(before, [*ctx.keys, "y", "x"], "left")
        blend = {c: alpha * F.col(c) + (1.0 - alpha) * F.coalesce(F.col(f"_p{c}"), F.lit(0.0)) for c in ("u", "v")}
        return joined.withColumns(blend).drop("_pu", "_pv")
    if ctx.time is None:
        raise ValueError("temporal_smoothing_ema needs a context with a time column or a previous field")
    line = [k for k in ctx.keys if k != ctx.time]
    return sequences.ema(table, alpha, keys=[*line, "y", "x"], time=ctx.time)


_STATISTICS = {
    "stretch_contrast": (normalize.bounds, normalize.stretched),
    "intensity_capping": (normalize.centre_and_spread, normalize.capped),
    "intensity_clipping": (normalize.centre_and_spread, normalize.clipped),
}
for _name, _apply, _check in (
    ("background_suppression", lambda t, c, threshold=0.0: pixels.background_suppression(t, threshold), _check_threshold),
    ("stretch_contrast", lambda t, c: normalize.stretch_contrast(t, c.keys), _no_parameters),
    ("intensity_capping", lambda t, c, n=2.0: normalize.intensity_capping(t, n, c.keys), _check_n),
    ("intensity_clipping", lambda t, c, n=2.0: normalize.intensity_clipping(t, n, c.keys), _check_n),
    ("clahe", lambda t, c, **p: normalize.clahe(t, c.shape, keys=c.keys, **p), _check_clahe),
    (
        "high_pass_filter",
        lambda t, c, sigma, truncate=4.0: normalize.high_pass(t, sigma, c.shape, truncate, c.keys),
        _check_sigma,
    ),
    ("crop_special", _crop, _check_crop),
    ("resize_image", _resize_image, _check_size),
):
    register_step("image", _name, _apply, _check, measure=_STATISTICS.get(_name, (None, None))[0], adjust=_STATISTICS.get(_name, (None, None))[1])

def _of_radius(radius: int = 1, **_) -> int:
    return radius


for _name, _apply, _check, _reach in (
    (
        "constant_threshold_filter",
        _marking(lambda t, c, vel_min, vel_max: validation.constant_threshold(t, vel_min, vel_max)),
        _check_speed,
        lambda **_: 0,
    ),
    (
        "adaptive_global_filter",
        _marking(lambda t, c, n_sigma: validation.adaptive_global(t, n_sigma, "dataset", c.keys)),
        _check_global,
        None,
    ),
    (
        "adaptive_local_filter",
        _marking(lambda t, c, n_sigma, radius=1: validation.adaptive_local_within(t, n_sigma, radius, c.keys)),
        _check_local,
        _of_radius,
    ),
    (
        "universal_median_test",
        _marking(lambda t, c, **p: validation.median_test_within(t, keys=c.keys, **p)),
        _check_median_test,
        _of_radius,
    ),
    (
        "tile_average_interpolation",
        lambda t, c, radius: filling.tile_average_within(t, radius, c.keys),
        _check_radius,
        _of_radius,
    ),
    (
        "laplace_interpolation",
        lambda t, c, num_iter=512: filling.laplace(t, num_iter, keys=c.keys, shape=c.shape),
        _check_iterations,
        None,
    ),
    ("average_smoothing", lambda t, c, radius: smoothing.average_within(t, radius, c.keys), _check_radius, _of_radius),
    (
        "median_smoothing",
        lambda t, c, radius=3: smoothing.median_within(t, radius, c.keys),
        _check_radius,
        lambda radius=3: radius,
    ),
    (
        "gaussian_smoothing",
        lambda t, c, sigma, truncate=4.0: smoothing.gaussian_within(t, sigma, truncate, c.keys),
        _check_sigma,
        smoothing.gaussian_radius,
    ),
    ("quantize", lambda t, c, **p: pixels.quantize(t, **p), _check_quantize, None),
    ("resize_flow", _resize_flow, _check_size, None),
    ("temporal_smoothing_ema", _ema, _check_alpha, None),
):
    register_step("field", _name, _apply, _check, _reach, whole=_name == "adaptive_global_filter")


# Published chains (fixed values).
IMAGE_CHAIN = [
    {"name": "crop_special", "target_height": 832, "target_width": 1024, "fraction_v": 0.5, "fraction_h": 1.0},
    {"name": "resize_image", "target_height": 256, "target_width": 256},
    {"name": "intensity_capping", "n": 1.1},
]
FIELD_CHAIN = [
    {"name": "universal_median_test", "radius": 2, "epsilon": 0.0001, "r_threshold": 2.0},
    {"name": "laplace_interpolation", "num_iter": 512},
    {"name": "median_smoothing", "radius": 2},
    {"name": "median_smoothing", "radius": 2},
    {"name": "median_smoothing", "radius": 2},
    {"name": "median_smoothing", "radius": 2},
    {"name": "average_smoothing", "radius": 2},
]
DENSITY_CHAIN = [
    {"name": "background_suppression", "threshold": 50.0},
    {"name": "intensity_capping", "n": 1.1},
]
