"""Tables that give every distinct value of a column a number, and their lookup.

Used for category indices and for ranks. A table that fits a checked byte bound is broadcast. Beyond
the bound the lookup has two parts: values that hold more than 1/HOT of the counted rows, of which
there can be at most HOT, are broadcast; their rows, and the rows without a value, are then spread
over many join partitions because they need no further match. What is left has no frequent value.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import column
from ..scratch import materialise
from .row_id import PART, POSITION, add_row_id, sorted_table, with_offsets

HOT = 1000
BROADCAST_BYTES = 32 * 1024 * 1024
#: Frequent values are broadcast up to these bytes even if the table as a whole is not.
FREQUENT_BYTES = 8 * 1024 * 1024


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """Distinct non-null values with their row counts; counted before the shuffle."""
    return (
        df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    )


def category_table(df: DataFrame, name: str) -> DataFrame:
    """value, n, number: 0 for the most frequent value, ties in alphabetical order."""
    counts = value_counts(df, column(name).cast("string")).select((-F.col("n")).alias("less"), "value")
    ranked = add_row_id(counts, ["less", "value"])
    return ranked.select("value", (-F.col("less")).alias("n"), (F.col("id") - 1).cast("double").alias("number"))


def stored_rank_tables(df: DataFrame, names: Sequence[str], rows: int) -> DataFrame:
    """place (of the column in ``names``), value, n, number: the mean rank (from 1) of all rows holding the value.

    No column has gaps in its ``rows`` rows, so the ranks of a column begin where those of the earlier ones end.
    """
    cells = [F.struct(F.lit(i).alias("place"), F.col(c).alias("value")) for i, c in enumerate(names)]
    counts = df.select(F.inline(F.array(*cells))).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    table = with_offsets(sorted_table(counts, ["place", "value"]), __offset=F.sum("n"))
    in_part = Window.partitionBy(PART).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__offset") + F.sum("n").over(in_part) - F.col("place") * F.lit(rows)
    return materialise(table.select("place", "value", "n", (upto - (F.col("n") - 1) / F.lit(2.0)).alias("number")), "ranks")


class Facts(NamedTuple):
    """Rows counted, distinct values and bytes of a value table, and the bytes of its frequent values."""

    rows: int
    values: int
    size: int
    frequent_size: int


def table_facts(table: DataFrame) -> Facts:
    size = F.octet_length(F.col("value").cast("string")) + F.lit(32)
    rows, values, total = (int(x or 0) for x in table.agg(F.sum("n"), F.count(F.lit(1)), F.sum(size)).first())
    frequent = table.where(F.col("n") * HOT > rows).agg(F.sum(size)).first()[0]
    return Facts(rows, values, total, int(frequent or 0))


def look_up(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    output: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    facts: Facts | None = None,
) -> DataFrame:
    """Add ``output``: the number of the key's value, null for no or an unknown value. ``table`` must be stored.

    Without ``facts`` the table is read for them. Frequent values that are too long to be broadcast are joined like the
    others; adaptive execution then splits their partitions.
    """
    facts = facts or table_facts(table)
    keyed = df.withColumn("__value", key)
    if facts.size <= broadcast_bytes:
        known = F.broadcast(table.select(F.col("value").alias("__value"), F.col("number").alias(output)))
        return keyed.join(known, "__value", "left").drop("__value")
    if facts.frequent_size > max(broadcast_bytes, FREQUENT_BYTES):
        known = table.select(F.col("value").alias("__value"), F.col("number").alias(output))
        return keyed.join(known, "__value", "left").drop("__value")
    frequent = F.col("n") * HOT > facts.rows
    hot = table.where(frequent).select(F.col("value").alias("__value"), F.col("number").alias("__hot"))
    cold = table.where(~frequent).select(
        F.col("value").alias("__value"), F.lit(0).alias("__spread"), F.col("number").alias("__cold")
    )
    settled = F.col("__hot").isNotNull() | F.col("__value").isNull()
    # settled rows need no match: each goes to a partition of its own choice, as many as the session has
    spread = F.when(settled, 1 + F.monotonically_increasing_id()).otherwise(0)
    return (
        keyed.join(F.broadcast(hot), "__value", "left")
        .withColumn("__spread", spread)
        .join(cold.withColumn("__spread", F.col("__spread").cast("long")), ["__value", "__spread"], "left")
        .withColumn(output, F.coalesce("__hot", "__cold"))
        .drop("__value", "__spread", "__hot", "__cold")
    )
