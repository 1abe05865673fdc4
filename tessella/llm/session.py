"""Readies a session: the package on the executors' Python workers, and Arrow batches that fit beside each other."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..executors import ship_package

#: Bytes and rows of an Arrow batch. Spark's 64 MB and 10,000 rows take several hundred MB of an executor for each task.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


def prepare(spark: SparkSession) -> None:
    """Bounds the batches, for the whole session: plans read the bounds when they run; and sends the package."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    ship_package(spark)
