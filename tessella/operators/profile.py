"""Column profiles: types, counts, moments, extremes and missing values in one job.

All figures of a frame come from one global aggregate, so the rows are read once and only one partial
row per task is shuffled. The result has one row per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import can_be_nan, quoted, reading_sql
from ..functions.kinds import NUMERIC, TEXT, is_floating, kind, require_flat
from ..scratch import materialise

# Columns per aggregate: wider frames take several passes, each reading only its own columns. Frames that
# are merged from several sources are written once first.
COLUMNS_PER_PASS = 50

# What is asked of a column, as SQL text: aggregates by name, and the result columns made of them.
# Text keeps the number of calls to the session small, which counts for frames with many columns.
Figures = tuple[dict[str, str], dict[str, str]]


def _one_row_per_column(df: DataFrame, figures: Callable[[int, T.StructField, str, str], Figures]) -> DataFrame:
    """``figures`` gets position, field, the cell and the number it reads as.

    In the result columns ``{name}`` stands for the column's aggregate of that name.
    """
    parts = []
    fields = list(enumerate(df.schema))
    if len(fields) > COLUMNS_PER_PASS and df._jdf.queryExecution().optimizedPlan().collectLeaves().size() > 1:
        df = materialise(df, "profiled")  # several passes would join again
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        # Numbers are read once per cell, in the projection below the aggregate.
        cells, aggregates, structs = [], ["count(1) AS rows"], []
        for i, f in fields[start : start + COLUMNS_PER_PASS]:
            cell, number = f"c{i}", f"cast(c{i} AS double)"
            cells.append(f"{quoted(f.name)} AS {cell}")
            if kind(f.dataType) == TEXT:
                number = f"n{i}"
                cells.append(f"{reading_sql(f.name, f.dataType)} AS {number}")
            wanted, shown = figures(i, f, cell, number)
            aggregates += [f"{sql} AS {name}{i}" for name, sql in wanted.items()]
            names = {"rows": "rows", **{name: f"{name}{i}" for name in wanted}}
            structs.append(", ".join(f"'{label}', {sql.format(**names)}" for label, sql in shown.items()))
        rows = ", ".join(f"named_struct({s})" for s in structs)
        parts.append(df.selectExpr(*cells).selectExpr(*aggregates).selectExpr(f"inline(array({rows}))"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def _text(value: str) -> str:
    """SQL literal that survives ``format``."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'".replace("{", "{{").replace("}", "}}")


def _missing(field: T.StructField, cell: str, number: str) -> Figures:
    nan = can_be_nan(field.dataType)
    wanted = {"count": f"count({cell})", **({"nan": f"count_if(isnan({number}))"} if nan else {})}
    nan_count = "{nan}" if nan else "0L"
    return wanted, {
        "null_count": "{rows} - {count}",
        "nan_count": nan_count,
        "missing_count": f"{{rows}} - {{count}} + {nan_count}",
    }


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type, count, null_count, nan_count, missing_count, mean,
    stddev, min_num, max_num, min_str, max_str.

    ``count`` is the number of non-null cells, NaN included; NaN counts as the largest number and text
    counts as NaN when it reads so. ``mean`` and ``stddev`` of a text column are over the cells that
    read as numbers. Times and booleans show their extremes as text.
    """
    require_flat(df.schema)
    no_number, no_text = "cast(null AS double)", "cast(null AS string)"

    def figures(position: int, field: T.StructField, cell: str, number: str) -> Figures:
        wanted, missing = _missing(field, cell, number)
        wanted |= {"low": f"min({cell})", "high": f"max({cell})"}
        family = kind(field.dataType)
        moments, numeric, exact = family in (NUMERIC, TEXT), family == NUMERIC, not is_floating(field.dataType)
        if moments:
            wanted |= {"mean": f"avg({number})", "stddev": f"stddev_samp({number})"}
        return wanted, {
            "position": str(position),
            "column": _text(field.name),
            "type": _text(field.dataType.simpleString()),
            "count": "{count}",
            **missing,
            "mean": "{mean}" if moments else no_number,
            "stddev": "{stddev}" if moments else no_number,
            "min_num": "cast({low} AS double)" if numeric else no_number,
            "max_num": "cast({high} AS double)" if numeric else no_number,
            "min_str": "cast({low} AS string)" if exact else no_text,
            "max_str": "cast({high} AS string)" if exact else no_text,
        }

    return _one_row_per_column(df, figures)


def missing_values(df: DataFrame) -> DataFrame:
    """column, null_count, nan_count, missing_count."""

    def figures(position: int, field: T.StructField, cell: str, number: str) -> Figures:
        wanted, missing = _missing(field, cell, number)
        return wanted, {"column": _text(field.name), **missing}

    return _one_row_per_column(df, figures)


def column_types(df: DataFrame) -> DataFrame:
    """position, column, type and the number of non-null cells."""

    def figures(position: int, field: T.StructField, cell: str, number: str) -> Figures:
        shown = {
            "position": str(position),
            "column": _text(field.name),
            "type": _text(field.dataType.simpleString()),
            "count": "{count}",
        }
        return {"count": f"count({cell})"}, shown

    return _one_row_per_column(df, figures)


def dataset_summary(df: DataFrame, parents: Sequence[str] = (), links: Sequence[str] = ()) -> DataFrame:
    """One row: rows, number of columns, parent tables and links as text."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(parents)).alias("parents"),
        F.lit(",".join(links)).alias("links"),
    )
