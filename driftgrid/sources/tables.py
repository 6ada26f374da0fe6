"""Reading pixel tables and writing metric tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.functions.columns import mix
from driftgrid.scale import attach, durable
from driftgrid.schema import FIELD, FRAME, IMAGE, PIXEL, require


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """Pixel table of images, columns checked; a batch is a filter on ``frame_id``."""
    return require(spark.read.parquet(path), *IMAGE.fieldNames())


def read_field(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), *FIELD.fieldNames())


def write_pixels(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted by frame and position, so that crops and frame filters skip row groups."""
    ordered = df.repartitionByRange("frame_id", "y").sortWithinPartitions("frame_id", "y", "x")
    ordered.write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, keys=FRAME, mode: str = "errorifexists") -> None:
    """Save as a table bucketed by pixel.

    Two tables with the same number of buckets join by pixel without a shuffle
    (estimate with truth, image with field). Pixels of one frame spread over all
    buckets, so a large frame does not make a large bucket.
    """
    by = [*keys, *PIXEL]
    df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)


def select_truth(mode: str, fields: DataFrame, densities: DataFrame) -> DataFrame:
    """The ground truth that belongs to an estimate type."""
    if mode == "flow":
        return fields
    if mode == "density":
        return densities
    raise ValueError(f"unknown estimate type {mode!r}; expected 'flow' or 'density'")


def assign_batches(
    pairs: DataFrame, batch_size: int, per_batch: int | None = None, seed: int | None = None, loops: int = 1
) -> DataFrame:
    """Add ``epoch`` and ``batch_id`` to the pairs.

    Pairs are numbered in id order, or in the order of the seeded mix. The
    numbering is a range shuffle plus one offset per partition, not a single
    global window; ids must be unique. ``per_batch`` fixes how many pairs of a
    batch share one draw (``draw``).
    """
    if batch_size < 1 or loops < 1:
        raise ValueError("batch_size and loops must be positive")
    order = [F.col("pair_id")] if seed is None else [mix("pair_id", seed), F.col("pair_id")]
    ranked = rank_all(pairs, order, "_rank")
    out = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    out = out.withColumn("batch_id", F.floor(F.col("_rank") / batch_size))
    if per_batch is not None:
        if batch_size % per_batch:
            raise ValueError("batch_size must be a multiple of per_batch")
        out = out.withColumn("draw", F.floor(F.pmod(F.col("_rank"), F.lit(batch_size)) / per_batch))
    return out.drop("_rank")


def rank_all(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """0-based rank over the whole table without a single-partition window.

    A range shuffle sorts the rows; each keeps its partition and its place in
    it. The stored result fixes that assignment, so that counting the partitions
    and reading the rows agree even when tasks are repeated. One offset per
    partition then makes the ranks global.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # upper bits: partition, lower 33 bits: place in the partition
    stored = durable(placed.withColumn("_id", F.monotonically_increasing_id()))
    stored = stored.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as the shuffle has partitions
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return attach(stored, offsets, ["_part"]).withColumn(name, F.col("_base") + F.col("_place")).drop("_id", "_part", "_place", "_base")


def metrics_union(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several metric tables under the sorted union of their columns."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return merged.select(*sorted(merged.columns))


def write_metrics_csv(tables: Sequence[DataFrame], path: str) -> None:
    metrics_union(tables).write.mode("overwrite").option("header", True).csv(path)


def metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide metric columns (nested structs are flattened with ``/``) as ``name, value`` rows."""
    entries = []

    def walk(prefix: str, label: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{prefix}.`{f.name}`", f"{label}/{f.name}", f.dataType)
        else:
            entries.append(F.struct(F.lit(label).alias("name"), F.col(prefix).cast("double").alias("value")))

    for f in wide.schema.fields:
        if f.name not in keys:
            walk(f"`{f.name}`", f.name, f.dataType)
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_m")).select(*keys, "_m.name", "_m.value")


# Columns of the run log (fixed values).
RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("frames", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
    ]
)


def run_log_append(summary: DataFrame, run_id: str, path: str) -> None:
    """Append one run's summary to a log table with a fixed schema."""
    row = summary.withColumn("run_id", F.lit(run_id))
    row.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG.fields]).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(path)
