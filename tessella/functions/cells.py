"""Cell-level expressions. All are built-in functions that never raise on bad values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import TEMPORAL, columns_of, is_floating, kind, NUMERIC, TEXT

# The parts a time column is split into, with the function that yields each.
# Day of week counts from 1 = Sunday.
DATE_PARTS = {
    "year": "year",
    "month": "month",
    "day": "dayofmonth",
    "dayofweek": "dayofweek",
    "hour": "hour",
    "minute": "minute",
    "second": "second",
}


# Fixed value: the text a cast to double accepts. Checked first, because a failed cast builds and
# discards an exception per cell, which is slow on columns of ordinary text.
NUMBER_TEXT = (
    r"(?i)^[\x00-\x20]*[+-]?(nan|inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?[fd]?"
    r"|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?\d+[fd]?)[\x00-\x20]*$"
)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column, also when its name holds dots or spaces."""
    return F.col(quoted(name))


def to_second_sql(name: str, data_type: T.DataType, pattern: str | None) -> str:
    """Time to the second as SQL text; unparseable text becomes null."""
    if kind(data_type) == TEMPORAL:
        return f"date_trunc('second', {quoted(name)})"
    text = f"cast({quoted(name)} as string)"
    if pattern is None:
        return f"date_trunc('second', try_to_timestamp({text}))"
    literal = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"date_trunc('second', try_to_timestamp({text}, '{literal}'))"


def parse_timestamp(df: DataFrame, name: str, pattern: str | None = None) -> Column:
    return F.expr(to_second_sql(name, df.schema[name].dataType, pattern))


def date_parts(value: Column, prefix: str) -> list[Column]:
    return [getattr(F, function)(value).alias(f"{prefix}_{part}") for part, function in DATE_PARTS.items()]


def to_double(name: str) -> Column:
    return column(name).try_cast("double")


def not_missing(name: str, data_type: T.DataType) -> Column:
    present = column(name).isNotNull()
    return present & ~F.isnan(column(name)) if is_floating(data_type) else present


def present_double(name: str, data_type: T.DataType) -> Column:
    """Numeric value as double, null where it is null or NaN."""
    value = column(name).cast("double")
    return F.when(~F.isnan(value), value) if is_floating(data_type) else value


def zero_if_missing(value: Column) -> Column:
    """Null and NaN become 0; infinities stay."""
    number = value.cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def reading_sql(name: str, data_type: T.DataType) -> str:
    """Number a cell of a number or text column stands for; null where text does not read as one."""
    if kind(data_type) == TEXT:
        return f"CASE WHEN {quoted(name)} RLIKE r'{NUMBER_TEXT}' THEN try_cast({quoted(name)} AS double) END"
    return f"cast({quoted(name)} AS double)"


def can_be_nan(data_type: T.DataType) -> bool:
    return is_floating(data_type) or kind(data_type) == TEXT


def timestamps_to_string(df: DataFrame) -> DataFrame:
    times = columns_of(df.schema, TEMPORAL)
    return df.withColumns({c: column(c).cast("string") for c in times}) if times else df


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df.schema, NUMERIC)
