"""Per-frame statistics applied to the frame's pixels.

The statistics are one combined aggregation; they return to the pixels by a
join whose broadcast is decided on the measured size of the summary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import at_least, at_most, clip, gaussian_weights
from driftgrid.quantiles import quantiles
from driftgrid.scale import attach
from driftgrid.schema import FRAME
from driftgrid.tiles import along_x, along_y, inside, mirror, own, spread, weighted, TILE


# The statistics of several image columns (``prev`` and ``curr`` of a pair) are
# one row per frame, ``_<what>_<column>``; what a step makes of a pixel is an
# expression of them. A sweep thus takes them once for all parameters.


def bounds(image: DataFrame, columns=("i",), keys=FRAME) -> DataFrame:
    """Smallest and largest value per frame."""
    made = [f(c).alias(f"_{what}_{c}") for c in columns for what, f in (("lo", F.min), ("hi", F.max))]
    return image.groupBy(*keys).agg(*made)


def centre_and_spread(image: DataFrame, columns=("i",), keys=FRAME) -> DataFrame:
    """Median and population deviation per frame."""
    parts = [
        quantiles(image, c, [0.5], keys, extras=[F.stddev_pop(c).alias(f"_std_{c}")]).withColumnRenamed("q0", f"_med_{c}")
        for c in columns
    ]
    return reduce(lambda a, b: a.join(b, list(keys)), parts)


def stretched(column: str = "i") -> Column:
    low, high = F.col(f"_lo_{column}"), F.col(f"_hi_{column}")
    return clip((F.col(column) - low) / (high - low + F.lit(1e-22)), 0.0, 1.0)


def capped(column: str = "i", n: float = 2.0) -> Column:
    return at_most(F.col(column), F.col(f"_med_{column}") + F.lit(float(n)) * F.col(f"_std_{column}"))


def clipped(column: str = "i", n: float = 2.0) -> Column:
    reach = F.lit(float(n)) * F.col(f"_std_{column}")
    low, high = F.col(f"_med_{column}") - reach, F.col(f"_med_{column}") + reach
    return at_most(at_least(F.col(column), low), high)


def stretch_contrast(image: DataFrame, keys=FRAME) -> DataFrame:
    return attach(image, bounds(image, keys=keys), keys).withColumn("i", stretched()).drop("_lo_i", "_hi_i")


def intensity_capping(image: DataFrame, n: float = 2.0, keys=FRAME) -> DataFrame:
    """Cap bright pixels at the frame's median plus ``n`` population deviations."""
    return attach(image, centre_and_spread(image, keys=keys), keys).withColumn("i", capped(n=n)).drop("_med_i", "_std_i")


def intensity_clipping(image: DataFrame, n: float = 2.0, keys=FRAME) -> DataFrame:
    return attach(image, centre_and_spread(image, keys=keys), keys).withColumn("i", clipped(n=n)).drop("_med_i", "_std_i")


def high_pass(
    image: DataFrame, sigma: float, shape: tuple[int, int], truncate: float = 4.0, keys=FRAME, tile: int = TILE
) -> DataFrame:
    """Image minus its Gaussian blur with reflected borders."""
    weights = gaussian_weights(sigma, truncate)
    radius = len(weights) // 2
    grown = mirror(image.select(*keys, "y", "x", "i"), radius, shape)
    # mirrored rows have negative coordinates; shift them so that tiles start at 0
    moved = grown.withColumns({"y": F.col("y") + radius, "x": F.col("x") + radius})
    tiled = spread(moved, radius, keys, tile)
    tiled = tiled.withColumn("_b", weighted("i", weights, along_x(keys), "zero"))
    tiled = tiled.withColumn("_b", weighted("_b", weights, along_y(keys), "zero"))
    back = own(tiled, tile).withColumns({"y": F.col("y") - radius, "x": F.col("x") - radius})
    return inside(back, shape).withColumn("i", F.col("i") - F.col("_b")).drop("_b")


def density_threshold(image: DataFrame, threshold: float, keys=FRAME) -> DataFrame:
    """Share of pixels brighter than ``threshold``."""
    if not 0 <= threshold <= 255:
        raise ValueError(f"threshold must be in [0, 255], got {threshold}")
    above = (F.col("i") > F.lit(float(threshold))).cast("double")
    return image.groupBy(*keys).agg(F.avg(above).alias("density"))


def clahe(
    image: DataFrame,
    shape: tuple[int, int],
    clip_limit: float = 0.01,
    tile_grid_size: tuple[int, int] | None = None,
    nbins: int = 256,
    keys=FRAME,
) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation.

    ``tile_grid_size`` is the height and width of a contextual region (default:
    an eighth of the frame). Each region's histogram is clipped at
    ``max(clip_limit * pixels, 1)``, the excess is spread evenly over all bins,
    and a pixel blends the cumulative histograms of its four nearest regions.
    Those four are the same for all pixels of a cell between region centres, so
    a pixel meets them in one join with a summary of a few arrays per region.
    """
    keys = list(keys)
    region = tuple(tile_grid_size or (max(shape[0] // 8, 1), max(shape[1] // 8, 1)))
    counts = tuple(-(-n // r) for n, r in zip(shape, region))
    binned = stretch_contrast(image.select(*keys, "y", "x", "i"), keys).withColumn(
        "_bin", F.least(F.floor(F.col("i") * nbins).cast("int"), F.lit(nbins - 1))
    )
    levels = _region_levels(binned, region, clip_limit, nbins, keys)

    def place(axis: str, size: int):
        return (F.col(axis) + 0.5) / size - 0.5

    spots = binned
    for axis, size in zip(("y", "x"), region):
        spots = spots.withColumn(f"_c{axis}", F.floor(place(axis, size)).cast("int"))
        spots = spots.withColumn(f"_f{axis}", place(axis, size) - F.col(f"_c{axis}"))
    met = attach(spots, _cells(levels, counts, keys), [*keys, "_cy", "_cx"])

    def level(name: str):
        return F.get(name, F.col("_bin"))

    upper = (1.0 - F.col("_fx")) * level("l00") + F.col("_fx") * level("l01")
    lower = (1.0 - F.col("_fx")) * level("l10") + F.col("_fx") * level("l11")
    blended = (1.0 - F.col("_fy")) * upper + F.col("_fy") * lower
    return met.select(*keys, "y", "x", blended.alias("i"))


def _region_levels(binned: DataFrame, region: tuple[int, int], clip_limit: float, nbins: int, keys) -> DataFrame:
    """Clipped cumulative histogram of every region: ``levels``, an array of ``nbins`` shares."""
    at = [F.floor(F.col(a) / r).cast("int").alias(f"_g{a}") for a, r in zip(("y", "x"), region)]
    by = [*keys, "_gy", "_gx"]
    sized = binned.groupBy(*keys, *at, "_bin").agg(F.count(F.lit(1)).cast("double").alias("n"))
    hist = sized.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "n"))).alias("m"), F.sum("n").alias("total")
    )
    bars = F.transform(F.sequence(F.lit(0), F.lit(nbins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0)))
    limit = F.greatest(F.col("total") * F.lit(float(clip_limit)), F.lit(1.0))
    hist = hist.select(*by, "total", limit.alias("limit"), bars.alias("bars"))
    excess = F.aggregate("bars", F.lit(0.0), lambda acc, n: acc + F.greatest(n - F.col("limit"), F.lit(0.0)))
    hist = hist.withColumn("share", excess / nbins)
    clipped = F.transform("bars", lambda n: F.least(n, F.col("limit")) + F.col("share"))
    long = hist.select(*by, "total", F.posexplode(clipped).alias("_bin", "n"))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = long.select(*by, F.struct("_bin", (F.sum("n").over(upto) / F.col("total")).alias("l")).alias("e"))
    return summed.groupBy(*by).agg(F.sort_array(F.collect_list("e")).alias("e")).select(*by, F.col("e.l").alias("levels"))


def _cells(levels: DataFrame, counts: tuple[int, int], keys) -> DataFrame:
    """Per cell between region centres (-1 before the first): the arrays of its four regions."""

    def roles(axis: str, count: int):
        """Cells in which a region is the nearer (0) or farther (1) one; the outer ones repeat."""
        g = F.col(f"_g{axis}")
        role = [(g, 0, F.lit(True)), (g - 1, 1, F.lit(True)), (g - 1, 0, g == 0), (g, 1, g == count - 1)]
        listed = F.array(*[F.when(ok, F.struct(cell.alias("c"), F.lit(k).alias("k"))) for cell, k, ok in role])
        return F.explode(F.filter(listed, lambda s: s.isNotNull()))

    placed = levels.withColumn("_ry", roles("y", counts[0])).withColumn("_rx", roles("x", counts[1]))
    corners = [
        F.first(F.when((F.col("_ry.k") == a) & (F.col("_rx.k") == b), F.col("levels")), ignorenulls=True).alias(f"l{a}{b}")
        for a in (0, 1)
        for b in (0, 1)
    ]
    return placed.groupBy(*keys, F.col("_ry.c").alias("_cy"), F.col("_rx.c").alias("_cx")).agg(*corners)
