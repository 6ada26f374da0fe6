import os
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(7)


def pixels(spark, **grids):
    """A pixel table from arrays (frames, height, width); lists of names become columns."""
    first = next(iter(grids.values()))
    frames, height, width = first.shape
    f, y, x = np.meshgrid(range(frames), range(height), range(width), indexing="ij")
    columns = [f.ravel().tolist(), y.ravel().tolist(), x.ravel().tolist()]
    columns += [g.ravel().tolist() for g in grids.values()]
    kinds = {"b": "boolean", "f": "double", "i": "int"}
    schema = "frame_id long, y int, x int, " + ", ".join(f"{n} {kinds[g.dtype.kind]}" for n, g in grids.items())
    return spark.createDataFrame(list(zip(*columns)), schema)


def grid(df, column, shape, fill=np.nan):
    """The array (frames, height, width) of a pixel table; absent pixels get ``fill``."""
    out = np.full(shape, fill, dtype=float)
    for row in df.select("frame_id", "y", "x", column).collect():
        out[row[0], row[1], row[2]] = np.nan if row[3] is None else row[3]
    return out
