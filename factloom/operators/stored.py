"""Tables that a plan writes between its steps, so that no later step plans or computes the earlier ones again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


@lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"steps-{application}-")


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only a local session without it gets a folder of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is removed when the driver's process ends."""
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clear)
    _paths.append((spark, path))
    return path


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """df, written as Parquet and read back: its lineage is cut in a way that survives lost executors."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _paths:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: S112  the session has ended: the others are still tried
            continue
