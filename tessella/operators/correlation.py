"""Pairwise correlation of numeric columns, as rows ``x, y, value`` with x before y."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import numeric_columns, present_double
from .value_table import look_up, stored_rank_tables


# Aggregates of pairs in one pass; more do not compile.
PAIRS_PER_PASS = 200


def _pairs(df: DataFrame, cells: dict[tuple[str, str], Column]) -> DataFrame:
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), v.alias("value")) for (x, y), v in cells.items()]
    if not rows:
        return df.sparkSession.createDataFrame([], "x string, y string, value double")
    blocks = [rows[i : i + PAIRS_PER_PASS] for i in range(0, len(rows), PAIRS_PER_PASS)]
    return reduce(DataFrame.unionAll, [df.agg(F.array(*own).alias("cells")).select(F.inline("cells")) for own in blocks])


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[present_double(c, df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(names)])


def correlation_pearson(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Each pair over the rows where both are present; up to ``PAIRS_PER_PASS`` pairs in one aggregate."""
    names = list(names) if names is not None else numeric_columns(df)

    def value(i: int, j: int) -> Column:
        """Null, not an error, where a column is constant."""
        x, y = F.when(F.col(f"v{j}").isNotNull(), F.col(f"v{i}")), F.when(F.col(f"v{i}").isNotNull(), F.col(f"v{j}"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    cells = {(names[i], names[j]): value(i, j) for i, j in combinations(range(len(names)), 2)}
    return _pairs(_numbers(df, names), cells)


def correlation_spearman(df: DataFrame, names: Sequence[str] | None = None, **lookup_options) -> DataFrame:
    """Over the rows where all columns are present; ties share their mean rank.

    Ranks come from one table of the distinct values of all columns, so repeated values are one row there and never
    gathered in a task; it is sorted and written once. The mean rank is known to be (n + 1) / 2, so sums of centred
    products are enough.
    """
    names = list(names) if names is not None else numeric_columns(df)
    rows = _numbers(df, names).na.drop()
    count = rows.count()
    ranks = stored_rank_tables(rows, [f"v{i}" for i in range(len(names))], count)
    ranked = rows
    for i in range(len(names)):
        table = ranks.where(F.col("place") == i).select("value", "n", "number")
        ranked = look_up(ranked, F.col(f"v{i}"), table, f"r{i}", **lookup_options)
    middle = F.lit((count + 1) / 2.0)
    centred = ranked.select(*[(F.col(f"r{i}") - middle).alias(f"d{i}") for i in range(len(names))])

    def value(i: int, j: int) -> Column:
        a, b = F.col(f"d{i}"), F.col(f"d{j}")
        spread = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
        return F.when(spread > 0, F.sum(a * b) / spread)

    return _pairs(centred, {(names[i], names[j]): value(i, j) for i, j in combinations(range(len(names)), 2)})
