"""Storing datasets with a row id, paging through them, and CSV output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyStored
from ..functions.cells import column, timestamps_to_string
from ..functions.names import rename_spaces
from ..operators.row_id import add_fast_id, add_row_id
from ..scratch import exists, new_path, remove
from .readers import CSV_OPTIONS, read_csv

ROW_ID = "id"
# Where a stored dataset keeps which file holds which ids; readers of its rows pass over names with an underscore.
MANIFEST = "_pages"
# Files that a page names one by one; more are found by the scan of the dataset.
PAGE_FILES = 1000


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Values come back as they are: blanks at the ends, quotes, line breaks, and empty text apart from missing text."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**CSV_OPTIONS, **blanks, nullValue="", emptyValue='""').csv(path)
    return path


def store_dataset(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] | None = None,
    mode: str = "errorifexists",
    partitions: int | None = None,
) -> str:
    """Write with ids 1..n in sort order and times as text, in ``partitions`` files (by default one for 256 MB of input).

    One shuffle in all: the ids are read off the sorted files, and copying those files to their final
    place keeps rows with neighbouring ids together, so a page touches few row groups.
    """
    spark, sorted_copy = df.sparkSession, new_path(df.sparkSession, "sorted")
    if mode == "errorifexists" and exists(spark, path):  # found out before the sort, not after it
        raise AlreadyStored(path)
    try:
        numbered = add_row_id(rename_spaces(df), order_by, ROW_ID, partitions, sorted_copy)
        write_parquet(timestamps_to_string(numbered), path, mode)
    finally:
        remove(spark, sorted_copy)
    write_manifest(spark, path)
    return path


def write_manifest(spark: SparkSession, path: str) -> None:
    """file, first, last: the runs of ids in each file of a stored dataset; only the ids are read. Write it again after
    files change. Rows whose ids follow each other have the same distance between id and place in the file."""
    place = F.col("_metadata.row_index")
    ids = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), (F.col(ROW_ID) - place).alias("run"), ROW_ID)
    zones = ids.groupBy("file", "run").agg(F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last")).drop("run")
    zones.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def store_dataset_fast_id(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write with unique ids that may have gaps, in one pass without a shuffle."""
    return write_parquet(add_fast_id(rename_spaces(df), ROW_ID), path, mode)


def page_rows(dataset: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit - 1`` by 1-based id, in order; all rows if either is missing.

    The range reaches the Parquet scan as a filter, so only row groups that hold the page are read.
    """
    if offset is None or limit is None:
        return dataset
    return dataset.where(F.col(ROW_ID).between(offset, offset + limit - 1)).orderBy(ROW_ID)


def read_page(spark: SparkSession, path: str, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """``page_rows`` of a stored dataset. With its manifest, only the files that hold the page are listed and opened."""
    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    if offset is None or limit is None or not exists(spark, manifest):
        return page_rows(spark.read.parquet(path), offset, limit)
    zones = spark.read.schema("file string, first long, last long").parquet(manifest)
    held = zones.where((F.col("first") < offset + limit) & (F.col("last") >= offset))
    names = [r["file"] for r in held.select("file").distinct().limit(PAGE_FILES + 1).collect()]
    if len(names) > PAGE_FILES:
        return page_rows(spark.read.parquet(path), offset, limit)
    # a page without rows still has the columns of some file
    names = names or [r["file"] for r in zones.select("file").limit(1).collect()]
    if not names:
        return page_rows(spark.read.parquet(path), offset, limit)
    return page_rows(spark.read.parquet(*[f"{path.rstrip('/')}/{name}" for name in names]), offset, limit)


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing values are written as null."""
    return df.select(F.to_json(F.struct(*[column(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def read_csv_as(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a CSV written from ``like`` with its column types."""
    return read_csv(spark, path, like.schema)
