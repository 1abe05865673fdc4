"""Column selection, casts and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import column, not_missing, to_double


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[column(c) for c in names])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def cast_to_double(df: DataFrame, *names: str) -> DataFrame:
    """Values that do not read as a number become null."""
    return df.withColumns({c: to_double(c) for c in names})


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def without_target(names: Sequence[str], target: str) -> list[str]:
    return [c for c in names if c != target]


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value that is neither null nor NaN, found in one pass."""
    if not df.columns:
        return []
    present = [
        F.bool_or(not_missing(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(df.schema)
    ]
    row = df.agg(*present).first()
    return [name for name, seen in zip(df.columns, row) if not seen]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))
