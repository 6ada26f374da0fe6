"""Runs with metrics, and sweeps over the keys of a config."""

import json

import numpy as np
import pytest
from conftest import pixels
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftgrid.operators import normalize
from driftgrid.plans import estimators, evaluate, sweep


@pytest.fixture
def pairs(spark, rng):
    prev, curr = rng.random((2, 2, 8, 8)) * 100
    curr[1] = 0  # a blank frame
    return pixels(spark, prev=prev, curr=curr)


@pytest.fixture
def truth(spark):
    u = np.zeros((2, 8, 8))
    u[:, :4] = 3.0
    return pixels(spark, u=u, v=np.zeros((2, 8, 8)))


@pytest.fixture
def shift():
    """An estimator of a constant field, which depends on the images and its parameter."""

    def constant(pairs, shape, speed=1.0, keys=("frame_id",)):
        level = F.when(F.max("prev").over(Window.partitionBy(*keys)) > 60, 1.0).otherwise(0.0)
        return pairs.select(*keys, "y", "x", (F.lit(float(speed)) + level).alias("u"), F.lit(0.0).alias("v"))

    estimators.register_estimator("constant", constant)
    yield
    estimators.ESTIMATORS.pop("constant")


MEMBERS = [{"name": "constant", "speed": 2.0}, {"name": "dummy"}]


def test_run_of_an_oracle_ensemble(spark, pairs, truth, shift):
    config = {"estimator": "consensus", "estimators": MEMBERS, "experiment_params": {"epe_limit": 0.5}}
    run = evaluate.evaluate_run(config, pairs, truth, (8, 8))
    rows = {r["frame_id"]: r for r in run.frames.collect()}
    assert rows[0]["valid"] and not rows[1]["valid"]
    assert rows[0]["coverage"] == 1.0 and rows[0]["stop_iter"] is None
    assert rows[0]["mean_epe"] == pytest.approx(0, abs=1e-6)
    report = estimators.run_report(run).first()
    assert report["frames"] == 1 and report["mean_coverage"] == 1.0 and report["stopped"] == 0
    assert evaluate.evaluate_field(config, pairs, truth, (8, 8)).first()["mean"] == pytest.approx(0, abs=1e-6)


def test_run_without_truth(spark, pairs, shift):
    frames = evaluate.evaluate_run({"estimator": "constant"}, pairs, None, (8, 8)).frames.collect()
    assert len(frames) == 2 and all(r["mean_epe"] is None and r["coverage"] is None for r in frames)


def test_limits_need_truth_and_an_oracle(pairs, truth, shift):
    config = {"estimator": "consensus", "estimators": MEMBERS, "experiment_params": {"epe_limit": 0.5}}
    with pytest.raises(ValueError, match="needs the truth"):
        evaluate.evaluate_run(config, pairs, None, (8, 8))
    with pytest.raises(ValueError, match="oracle"):
        evaluate.evaluate_run({**config, "oracle": False}, pairs, truth, (8, 8))


@pytest.mark.parametrize(
    "base, grid",
    [
        ({"estimator": "constant", "speed": 1.0}, {"speed": [0.5, 2.0], "postprocess.0.n_sigma": [1.0, 3.0], "preprocess.0.n": [0.1, 5.0]}),
        ({"estimator": "consensus", "estimators": MEMBERS}, {"experiment_params.epe_limit": [0.5, 9.0], "algorithm": ["mean", "median"]}),
    ],
)
def test_sweep_equals_single_runs(pairs, truth, shift, base, grid):
    config = {
        **base,
        "preprocess": [{"name": "intensity_capping", "n": 1.0}],
        "postprocess": [{"name": "adaptive_global_filter", "n_sigma": 2.0}, {"name": "average_smoothing", "radius": 1}],
    }
    rows = {r["setting"]: r for r in sweep.sweep(config, grid, pairs, truth, (8, 8)).collect()}
    expected = sweep.settings(config, grid)
    assert sorted(rows) == list(range(len(expected)))
    for k, (values, one) in enumerate(expected):
        assert json.loads(rows[k]["parameters"]) == values
        alone = evaluate.evaluate_field(one, pairs, truth, (8, 8)).first()
        assert rows[k]["frames"] == alone["frames"]
        for name in ("mean", "max", "min"):
            assert rows[k][name] == pytest.approx(alone[name], abs=1e-9), (values, name)


def test_dotted_keys():
    config = {"a": [{"n": 1}, {"n": 2}], "b": {"c": 3}}
    assert sweep.with_value(config, "a.1.n", 9) == {"a": [{"n": 1}, {"n": 9}], "b": {"c": 3}}
    assert sweep.with_value(config, "d.e", 9)["d"] == {"e": 9}
    assert config == {"a": [{"n": 1}, {"n": 2}], "b": {"c": 3}}
    for key in ("a.2.n", "a.x", "b.c.d"):
        with pytest.raises(ValueError):
            sweep.with_value(config, key, 0)
    with pytest.raises(ValueError):
        sweep.settings(config, {"a.0.n": []})


def test_sweep_keeps_to_one_estimator_and_size(pairs, truth, shift):
    with pytest.raises(ValueError, match="one estimator"):
        sweep.sweep({"estimator": "constant"}, {"estimator": ["constant", "dummy"]}, pairs, truth, (8, 8))
    config = {"estimator": "dummy", "preprocess": [{"name": "resize_image", "target_height": 8, "target_width": 8}]}
    with pytest.raises(ValueError, match="image sizes"):
        sweep.sweep(config, {"preprocess.0.target_height": [8, 4]}, pairs, truth, (8, 8))


def test_sweep_takes_statistics_and_members_once(pairs, truth, shift, monkeypatch):
    """Work does not grow with the settings that share it, and truth that lacks pixels is left out as in a single run."""
    counts = {"quantiles": 0, "constant": 0}

    def counted(name, f):
        def call(*args, **kwargs):
            counts[name] += 1
            return f(*args, **kwargs)

        return call

    monkeypatch.setattr(normalize, "quantiles", counted("quantiles", normalize.quantiles))
    monkeypatch.setitem(estimators.ESTIMATORS, "constant", counted("constant", estimators.ESTIMATORS["constant"]))
    config = {
        "estimator": "consensus", "estimators": MEMBERS, "config": {"weights_type": "list", "weights": [1.0, 1.0]},
        "preprocess": [{"name": "intensity_capping", "n": 1.0}, {"name": "stretch_contrast"}],
        "postprocess": [{"name": "average_smoothing", "radius": 1}],
    }
    grid = {"preprocess.0.n": [0.1, 1.0, 5.0], "config.weights.1": [0.25, 1.0], "postprocess.0.radius": [1, 2]}
    part = truth.where("y + x < 9")
    swept = sweep.sweep(config, grid, pairs, part, (8, 8))
    joins = swept._jdf.queryExecution().optimizedPlan().toString().count("Join")
    rows = {r["setting"]: r for r in swept.collect()}
    assert counts == {"quantiles": 2, "constant": 1}  # one for either image of a pair
    assert joins == 0  # no setting's field meets the truth by pixel
    for k, (values, one) in enumerate(sweep.settings(config, grid)):
        alone = evaluate.evaluate_field(one, pairs, part, (8, 8)).first()
        assert (rows[k]["frames"], rows[k]["missing"]) == (alone["frames"], alone["missing"])
        for name in ("mean", "max", "min", "coverage"):
            assert rows[k][name] == pytest.approx(alone[name], abs=1e-9), (values, name)
