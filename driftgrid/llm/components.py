"""Connected components by alternating large and small stars.

Each round is a few joins and groupings on the links, which combine before
they shuffle; a hub's links are never gathered. Rounds are stored in the shared
folder, so lost executors cost at most the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.scale import durable, release


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; the root is the component's least node.

    Links with a null end and loops are no links; repeated links count once.
    """
    ordered = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = durable(ordered.distinct())
    state = _sum(now)
    while True:
        ends = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = durable(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
        if (found := _sum(after)) == state:
            release(after)
            break
        release(now)
        now, state = after, found
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
