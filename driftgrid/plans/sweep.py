"""Sweeps over the keys of a config, as one job.

Every combination of the given values is a *setting*. What settings have in
common is computed once: the shared beginning of their image chains is stored,
images that differ get a number as one more key and go through the estimator
together, and settings whose estimates agree share them up to the field step
in which they differ. The results are one table with a row per setting.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.operators import consensus, metrics
from driftgrid.plans import estimators
from driftgrid.plans.evaluate import SIDES, _checked, prepare_pairs
from driftgrid.plans.steps import Context, adjusted, keeps_columns, measured, reads_whole_table, run_chain, widest_halo, with_statistics
from driftgrid.scale import durable
from driftgrid.schema import FRAME, PIXEL

#: The key that tells images apart which were prepared differently.
VARIANT = "variant_"
#: Marks pixels that have a truth.
KNOWN = "known_"


def with_value(config, key: str, value):
    """A copy of ``config`` in which the dotted ``key`` has the value; digits index lists.

    Missing dicts on the way are made, a list must already hold the place.
    """
    name, _, rest = key.partition(".")
    if isinstance(config, list):
        if not name.isdigit() or int(name) >= len(config):
            raise ValueError(f"no place {name!r} in a list of {len(config)}")
        place, copy = int(name), list(config)
    elif isinstance(config, dict):
        place, copy = name, dict(config)
    else:
        raise ValueError(f"{name!r} is below {config!r}, which holds no keys")
    inner = copy[place] if isinstance(copy, list) else copy.get(place, {})
    copy[place] = with_value(inner, rest, value) if rest else value
    return copy


def settings(config: dict, grid: Mapping[str, Sequence]) -> list[tuple[dict, dict]]:
    """All combinations of the values, the last key's values varying fastest: the values and the config of each."""
    if not grid or any(len(values) == 0 for values in grid.values()):
        raise ValueError("a sweep needs at least one key, and a value for each")
    out = []
    for values in itertools.product(*grid.values()):
        chosen = dict(zip(grid, values))
        out.append((chosen, reduce(lambda c, kv: with_value(c, *kv), chosen.items(), config)))
    return out


def _numbered(items: Sequence) -> tuple[list, list[int]]:
    """The distinct items and each item's number among them (tables are told apart by identity)."""
    distinct: list = []
    numbers = []
    for item in items:
        if item not in distinct:
            distinct.append(item)
        numbers.append(distinct.index(item))
    return distinct, numbers


def _shared(chains: Sequence[Sequence[dict]]) -> int:
    """How many steps all chains begin with."""
    return sum(1 for _ in itertools.takewhile(lambda steps: all(s == steps[0] for s in steps), zip(*chains)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _prepared(pairs: DataFrame, chains: Sequence[list[dict]], context: Context) -> tuple[DataFrame, Context]:
    """The pairs after every chain, told apart by ``VARIANT``."""
    same = _shared(chains)
    pairs, context = prepare_pairs(pairs, chains[0][:same], context)
    if len(chains) > 1:
        pairs = durable(pairs)
    first = [chain[same] for chain in chains if len(chain) > same]
    if len(first) > 1 and len(first) == len(chains) and len({step["name"] for step in first}) == 1 and measured(first[0]):
        # the same statistics whatever the parameters
        told = with_statistics(pairs, first[0], SIDES, context.keys)
        begun = [adjusted(told, step, SIDES).select(*context.keys, *PIXEL, *SIDES) for step in first]
        made = [prepare_pairs(side, chain[same + 1 :], context) for side, chain in zip(begun, chains)]
    else:
        made = [prepare_pairs(pairs, chain[same:], context) for chain in chains]
    if len({after.shape for _, after in made}) > 1:
        raise ValueError("a sweep cannot mix image sizes; sweep each size by itself")
    rows = _union([side.withColumn(VARIANT, F.lit(k)) for k, (side, _) in enumerate(made)])
    # the frame comes first: rows are told apart by the first key they are sorted by
    return durable(rows), Context(made[0][1].shape, (*context.keys, VARIANT), context.mask_mode)


def _beside(field: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """The field with its truth (``tu, tv``), and in ``KNOWN`` whether a pixel has one."""
    known = truth.select(*keys, *PIXEL, F.col("u").alias("tu"), F.col("v").alias("tv"), F.lit(True).alias(KNOWN))
    return field.join(known, [*keys, *PIXEL], "left")


def _estimates(name: str, params: Sequence[dict], pairs: DataFrame, truth: DataFrame, context: Context, ride: bool) -> list[tuple[DataFrame, bool]]:
    """A field per parameter set and whether it is stored; ensembles with the same members are computed once.

    With ``ride`` the truth stands beside every field.
    """
    keys, shape = context.keys, context.shape
    if name != "consensus":
        fields = [estimators.estimate(name, pairs, shape, truth, keys=keys, **p) for p in params]
        return [(_beside(f, truth, keys) if ride else f, False) for f in fields]
    ensembles, number = _numbered([p.get("estimators") for p in params])
    fields: list = [None] * len(params)
    stored: list = [None] * len(ensembles)
    for k, e in enumerate(ensembles):
        mine = [j for j in range(len(params)) if number[j] == k]
        weights = [_constant_weight(params[j]) for j in mine]
        if all(w is not None for w in weights):
            # weights that are the same everywhere: all means in one pass over the members
            means = consensus.consensus_means(estimators.stacked(pairs, shape, e, keys), weights, keys=keys)
            means = durable(_beside(means, truth, keys) if ride else means)
            told = ("tu", "tv", KNOWN) if ride else ()
            for n, j in enumerate(mine):
                fields[j] = means.select(*keys, *PIXEL, F.col(f"u{n}").alias("u"), F.col(f"v{n}").alias("v"), *told), True
        else:
            stored[k] = estimators.members(pairs, shape, e, keys)
    for j, (p, k) in enumerate(zip(params, number)):
        if fields[j] is not None:
            continue
        given = {key: value for key, value in p.items() if key not in ("estimators", "epe_limit", "experiment_params", "oracle")}
        limit = estimators._limit(p.get("epe_limit"), p.get("experiment_params"), p.get("oracle", True))
        field = estimators.fuse_fields(stored[k], pairs, shape, epe_limit=limit, truth=truth, keys=keys, **given)
        fields[j] = (_beside(field, truth, keys) if ride else field), False
    return fields


def _constant_weight(params: dict) -> Column | None:
    """A mean's weight as a number per estimator; ``None`` where it depends on more than that."""
    config = params.get("config") or {}
    plain = {"config", "estimators", "algorithm", "experiment_params", "epe_limit", "oracle"}.issuperset(params)
    limit = estimators._limit(params.get("epe_limit"), params.get("experiment_params"), params.get("oracle", True))
    if not plain or limit is not None or params.get("algorithm", "mean") != "mean" or config.get("normalization", "none") != "none":
        return None
    kind = config.get("weights_type") or "none"
    if kind == "list" and "weights" in config:
        return consensus.listed_weight(config["weights"])
    return consensus.listed_weight(None) if kind == "none" else None


def _finished(field: DataFrame, stored: bool, chains: Sequence[list[dict]], variants: int, context: Context) -> list[DataFrame]:
    """The field after each chain; their common beginning is stored once (nothing, if the field is and they have none)."""

    def apply(table: DataFrame, steps: list[dict]) -> DataFrame:
        if variants == 1 or not reads_whole_table("field", steps):
            return run_chain("field", table, steps, context)[0]
        return _union([run_chain("field", table.where(F.col(VARIANT) == k), steps, context)[0] for k in range(variants)])

    same = _shared(chains)
    if len(chains) > 1 and all(keeps_columns("field", chain) for chain in chains):
        context = replace(context, halo=widest_halo([chain[same:] for chain in chains]))
    if any(step["name"] == "resize_flow" for chain in chains for step in chain[:same]) and len(chains) > 1:
        same = 0  # the shape changes on the way
    if len(chains) > 1:
        field = field if stored and same == 0 else durable(apply(field, chains[0][:same]))
        return [apply(field, chain[same:]) for chain in chains]
    return [apply(field, chains[0])]


def sweep(
    config: dict, grid: Mapping[str, Sequence], pairs: DataFrame, truth: DataFrame, shape: tuple[int, int], keys=FRAME, mask_mode: str = "intent"
) -> DataFrame:
    """Evaluate a config for every combination of values of its dotted keys.

    ``grid`` maps keys such as ``preprocess.0.n``, ``config.weights.1`` or
    ``experiment_params.epe_limit`` to their values. All settings are checked
    before Spark is used. A row per setting: ``setting`` (its number),
    ``parameters`` (the values as JSON) and the columns of ``eval_dataset``.
    The estimator's name cannot be swept, nor the size of the images.
    """
    chosen = settings(config, grid)
    checked = [_checked(c) for _, c in chosen]
    names = {c["estimator"] for _, c in chosen}
    if len(names) > 1:
        raise ValueError("a sweep runs one estimator; compare estimators by plans.evaluate.compare_configs")
    labels = [json.dumps(values, default=str) for values, _ in chosen]
    images, image_of = _numbered([c[0] for c in checked])
    params, params_of = _numbered([c[2] for c in checked])
    prepared, context = _prepared(pairs, images, Context(shape, tuple(keys), mask_mode))
    every = truth.withColumn(VARIANT, F.explode(F.array(*[F.lit(k) for k in range(len(images))])))  # read only where an estimator asks for it
    # the truth goes with the fields through steps that keep it, and need not meet every setting's field by pixel
    ride = all(keeps_columns("field", c[1]) for c in checked)
    parts = []
    for k, (field, stored) in enumerate(_estimates(names.pop(), params, prepared, every, context, ride)):
        mine = [s for s in range(len(chosen)) if params_of[s] == k]
        chains, chain_of = _numbered([checked[s][1] for s in mine])
        for j, done in enumerate(_finished(field, stored, chains, len(images), context)):
            wanted = [s for s, c in zip(mine, chain_of) if c == j]
            numbers = [F.array(*[F.lit(s) for s in wanted if image_of[s] == v]).cast("array<int>") for v in range(len(images))]
            if ride:
                result = metrics.eval_pairs(done.where(KNOWN), keys, by=(VARIANT,))
            else:
                result = metrics.eval_dataset(done, truth, keys, by=(VARIANT,))
            parts.append(result.withColumn("setting", F.explode(F.get(F.array(*numbers), F.col(VARIANT)))).drop(VARIANT))
    return _union(parts).withColumn("parameters", F.get(F.array(*[F.lit(x) for x in labels]), F.col("setting")))
