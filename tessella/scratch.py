"""Where intermediate tables are written.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; every
executor can reach it, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import TessellaError


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise TessellaError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_scopes = threading.local()


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: the plan behind it is cut.

    In a ``scope`` the table is deleted at its end, with ``keep`` at that of the one around it, if there is one.
    """
    path = new_path(df.sparkSession, label)
    open_scopes: list[list[str]] = getattr(_scopes, "open", [])
    if open_scopes and not (keep and len(open_scopes) == 1):
        open_scopes[-2 if keep else -1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes what is materialised in the block at its end: what outlives it must be kept and may not read the rest.

    Scopes nest, each thread has its own. Gives ``materialise``.
    """
    open_scopes = _scopes.__dict__.setdefault("open", [])
    paths: list[str] = []
    open_scopes.append(paths)
    try:
        yield materialise
    finally:
        open_scopes.remove(paths)
        for path in paths:
            remove(spark, path)


def _located(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, located = _located(spark, path)
    return system.exists(located)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once nothing reads it any more."""
    system, located = _located(spark, path)
    system.delete(located, True)
