"""Histograms. Ten equal-width bins for numbers, the most frequent values for text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import column, numeric_columns, present_double
from ..functions.kinds import BOOLEAN, TEXT, columns_of

BINS = 10
TOP = 20


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def histogram_numeric(df: DataFrame, names: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """column, bin (0..bins-1), lower, upper, count; empty bins included, last bin closed.

    Pass one finds the finite extremes of all columns, pass two counts. Bins are counted per task
    before the shuffle, so at most columns x bins rows leave a task. Infinite values fall into the
    outermost bins; a constant column has everything in bin 0; a column without a finite value has
    no histogram. Null and NaN are not counted.
    """
    spark = df.sparkSession
    names = list(names) if names is not None else numeric_columns(df)
    values = df.select(*[present_double(c, df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(names)])
    schema = "`column` string, bin int, lower double, upper double"
    if not names:
        return spark.createDataFrame([], schema + ", count long")
    extremes = values.agg(
        *[f(_finite(F.col(v))).alias(f"{v}_{f.__name__}") for v in values.columns for f in (F.min, F.max)]
    ).first()
    limits = {i: (extremes[2 * i], extremes[2 * i + 1]) for i in range(len(names)) if extremes[2 * i] is not None}

    def bin_of(value: Column, low: float, high: float) -> Column:
        if low == high:
            return F.when(value > high, bins - 1).when(value.isNotNull(), 0).cast("int")
        share = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins))
        inside = F.least(share.cast("int"), F.lit(bins - 1))
        return F.when(value >= high, bins - 1).when(value <= low, 0).when(value.isNotNull(), inside)

    edges = []
    for i, (low, high) in limits.items():
        width = (high - low) / bins
        for b in range(bins):
            edges.append((names[i], b, low + width * b, high if b == bins - 1 else low + width * (b + 1)))
    grid = spark.createDataFrame(edges, schema)
    if not limits:
        return grid.withColumn("count", F.lit(0).cast("long"))
    binned = values.select(*[bin_of(F.col(f"v{i}"), *limits[i]).alias(names[i]) for i in limits])
    counted = (
        binned.unpivot([], [column(names[i]) for i in limits], "column", "bin")
        .where("bin is not null")
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")
    )


def histogram_categorical(df: DataFrame, names: Sequence[str] | None = None, top: int = TOP) -> DataFrame:
    """column, value, count, position, values for the ``top`` most frequent values, ties in alphabetical order.

    ``values`` is 1. What is left of a column is one more row at position ``top + 1``, without a value: its ``count`` are
    the rows and its ``values`` the distinct values not shown. Nulls are not counted. Counts are merged per task before
    the shuffle. The top values are picked within slices of each column first, so no task sees all its distinct values.
    """
    names = list(names) if names is not None else columns_of(df.schema, TEXT, BOOLEAN)
    if not names:
        return df.sparkSession.createDataFrame([], "`column` string, value string, count long, position int, values long")
    texts = df.select(*[column(c).cast("string").alias(c) for c in names])
    counted = (
        texts.unpivot([], [column(c) for c in names], "column", "value")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(256)))
    )
    in_slice = Window.partitionBy("column", "slice")
    kept = counted.withColumns(
        {
            "place": F.row_number().over(in_slice.orderBy(F.desc("count"), F.asc("value"))),
            "rows": F.sum("count").over(in_slice),
            "values": F.count(F.lit(1)).over(in_slice),
        }
    ).where(F.col("place") <= top)
    once = F.col("place") == 1
    by_column = kept.groupBy("column").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "value"))), 1, top).alias("best"),
        F.sum(F.when(once, F.col("rows"))).alias("rows"),
        F.sum(F.when(once, F.col("values"))).alias("values"),
    )
    shown = F.transform(
        "best", lambda b, i: F.struct(b["value"].alias("value"), (-b["less"]).alias("count"), (i + 1).alias("position"), F.lit(1).cast("long").alias("values"))
    )
    left_rows = F.col("rows") + F.aggregate("best", F.lit(0).cast("long"), lambda total, b: total + b["less"])
    left_values = F.col("values") - F.size("best")
    rest = F.struct(
        F.lit(None).cast("string").alias("value"), left_rows.alias("count"), F.lit(top + 1).alias("position"), left_values.alias("values")
    )
    lines = F.when(left_values > 0, F.concat(shown, F.array(rest))).otherwise(shown)
    return by_column.select("column", F.inline(lines))
