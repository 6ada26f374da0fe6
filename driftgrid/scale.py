"""Durable intermediate tables.

Two needs meet here. Loops must cut their lineage on storage that survives a
lost executor, and a table that is to be broadcast must have a measured size.
Both are served by writing a Parquet table below the cluster's checkpoint
folder: Catalyst then knows its real size and picks a broadcast join only
below ``spark.sql.autoBroadcastJoinThreshold``, a shuffled join above it.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOT[app]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/driftgrid-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    With ``by`` a filter on that column reads only its own files; the rows are
    rebalanced first, so that a value has few files and a large one several.
    ``codec`` names another compression than the session's.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    options = {"compression": codec} if codec else {}
    if by is None:
        df.write.options(**options).parquet(path)
    else:
        df.hint("rebalance", by).write.options(**options).partitionBy(by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _PATHS[stored] = path
    return stored


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a durable table: itself if it is one already."""
    return df if df in _PATHS else durable(df)


def release(stored: DataFrame) -> None:
    """Delete a table made by ``durable`` once nothing reads it any more.

    Loops call it for a superseded state, so that their storage does not grow
    with the number of rounds.
    """
    path = _PATHS.pop(stored, None)
    if path is not None:
        _delete(stored.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table ``durable`` made in this application, at its end."""
    _delete(spark, _scratch(spark))


def _delete(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def attach(big: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Join a per-key summary to its pixels without shuffling the pixels if it fits.

    ``small`` is stored first, so the broadcast decision rests on its true
    size; when it is too large the join shuffles and AQE splits skewed keys.
    """
    return big.join(durable(small), list(keys))
