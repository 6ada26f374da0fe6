"""Column contracts of the pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = ("frame_id",)
PIXEL = ("y", "x")

IMAGE = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("i", T.DoubleType()),
    ]
)
FIELD = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("u", T.DoubleType()),
        T.StructField("v", T.DoubleType()),
    ]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, on the driver, when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def frame_shape(df: DataFrame) -> tuple[int, int]:
    """Height and width of the frames of a table (one aggregate job)."""
    row = df.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    if row is None or row["h"] is None:
        raise ValueError("an empty table has no frame shape")
    return int(row["h"]), int(row["w"])


def sparse_frames(df: DataFrame, keys=FRAME) -> DataFrame:
    """Frames that are not dense rectangles starting at (0, 0); empty when all is well."""
    area = (F.max("y") + 1).cast("long") * (F.max("x") + 1)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), area.alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"))
        .where("n <> area OR y0 <> 0 OR x0 <> 0")
    )
