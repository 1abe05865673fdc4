"""Splits that depend on a row's key only, so they survive any repartitioning or retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import column

TRAIN_PERCENT = 95
SPLIT, TRAIN, HOLDOUT = "split", "train", "holdout"


def key_slot(key: str, seed: int, slots: int) -> Column:
    """0 .. slots-1 from the hash of key and seed."""
    text = F.concat(column(key).cast("string"), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def with_split(df: DataFrame, key: str, seed: int = 1, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``split``: train or holdout. A null key belongs to the training part."""
    slot = F.coalesce(key_slot(key, seed, 100), F.lit(0))
    return df.withColumn(SPLIT, F.when(slot < train_percent, TRAIN).otherwise(HOLDOUT))


def part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(SPLIT) == name).drop(SPLIT)


def split_frame(df: DataFrame, key: str, seed: int = 1, train_percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Training and holdout part; together they are the frame."""
    marked = with_split(df, key, seed, train_percent)
    return part(marked, TRAIN), part(marked, HOLDOUT)


def with_folds(df: DataFrame, key: str, folds: int, seed: int = 1, name: str = "fold") -> DataFrame:
    # A different text is hashed than for the holdout, otherwise folds would follow the split.
    slot = F.coalesce(key_slot(key, seed * 1000 + 7, folds), F.lit(0))
    return df.withColumn(name, slot)
