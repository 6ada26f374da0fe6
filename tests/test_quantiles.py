import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import metrics, normalize
from driftgrid.quantiles import quantiles
from driftgrid.sources.tables import rank_all

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def samples(rng):
    return {
        0: rng.normal(size=500),
        1: np.repeat([1.0, 2.0, 1e300], [300, 1, 100]),
        2: np.array([3.5]),
        3: np.concatenate([np.zeros(400), rng.exponential(1e-9, 50), [-1e12, 1e12]]),
        4: rng.integers(0, 4, 100).astype(float),
    }


@pytest.mark.parametrize(("bound", "bins"), [(65536, 1024), (3, 2), (3, 16), (150, 64)])
def test_keyed(spark, rng, bound, bins):
    data = samples(rng)
    df = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a], "k long, v double")
    rows = quantiles(df, "v", PROBS, ["k"], bound, bins, extras=[F.max("v").alias("top")]).collect()
    assert len(rows) == len(data)
    for row in rows:
        want = np.quantile(data[row["k"]], PROBS)
        np.testing.assert_allclose([row[f"q{i}"] for i in range(len(PROBS))], want, rtol=1e-12, atol=1e-15)
        assert row["top"] == data[row["k"]].max()


@pytest.mark.parametrize(("bound", "bins"), [(65536, 1024), (3, 2), (3, 8)])
def test_whole_table(spark, rng, bound, bins):
    for a in samples(rng).values():
        df = spark.createDataFrame([(float(v),) for v in a], "v double")
        row = quantiles(df, "v", PROBS, bound=bound, bins=bins).first()
        np.testing.assert_allclose(list(row), np.quantile(a, PROBS), rtol=1e-12, atol=1e-15)


def test_statistics_of_four_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0)], "e double")
    for bound in (65536, 1):
        row = metrics.error_stats(df, "e", 2.5, bound=bound).first()
        assert row["mean"] == 2.5 and row["median"] == 2.5 and row["fraction_below_threshold"] == 0.5
        assert row["lower_quartile"] == 1.75 and row["upper_quartile"] == 3.25
        assert row["lower_whisker"] == -0.5 and row["upper_whisker"] == 5.5
        assert abs(row["std"] - np.std([1, 2, 3, 4])) < 1e-12


def test_capping_and_clipping_literals(spark):
    df = spark.createDataFrame([(0, y, x, v) for (y, x), v in zip([(0, 0), (0, 1), (1, 0), (1, 1)], [10.0, 20.0, 30.0, 100.0])], "frame_id long, y int, x int, i double")
    std = np.std([10, 20, 30, 100])
    capped = sorted(r["i"] for r in normalize.intensity_capping(df, 1.0).collect())
    np.testing.assert_allclose(capped, [10, 20, 30, 25 + std])
    assert max(r["i"] for r in normalize.intensity_capping(df, 0).collect()) == 25
    clipped = sorted(r["i"] for r in normalize.intensity_clipping(df, 0.1).collect())
    np.testing.assert_allclose(clipped, [25 - 0.1 * std, 25 - 0.1 * std, 25 + 0.1 * std, 25 + 0.1 * std])


def test_rank_all_is_a_global_rank(spark, rng):
    values = rng.integers(0, 40, 500).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "pair_id long, v long")
    rows = rank_all(df, [F.col("v"), F.col("pair_id")], "r").collect()
    want = {i: r for r, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {r["pair_id"]: r["r"] for r in rows} == want


ODD = [float("nan"), float("inf"), float("-inf")]


@pytest.mark.parametrize("specials", [[ODD[0]], [ODD[1], ODD[1]], [ODD[2]], ODD * 3, ODD[:1] * 40])
@pytest.mark.parametrize(("bound", "bins"), [(3, 2), (3, 8)])
def test_infinities_and_nan(spark, specials, bound, bins):
    """Below and above the bound the answers are those of ``percentile``, in few rounds."""
    for finite in ([float(v) for v in range(20)], []):
        df = spark.createDataFrame([(k, v) for k in (1, 2) for v in [*finite, *specials, None][k - 1 :]], "k long, v double")
        names = [f"q{i}" for i in range(len(PROBS))]
        want = {r["k"]: [r[q] for q in names] for r in quantiles(df, "v", PROBS, ["k"]).collect()}
        got = {r["k"]: [r[q] for q in names] for r in quantiles(df, "v", PROBS, ["k"], bound, bins).collect()}
        assert want.keys() == got.keys()
        for k in want:
            np.testing.assert_equal(got[k], want[k])
        one = df.where("k = 1").select("v")
        np.testing.assert_equal(list(quantiles(one, "v", PROBS, bound=bound, bins=bins).first()), list(quantiles(one, "v", PROBS).first()))
