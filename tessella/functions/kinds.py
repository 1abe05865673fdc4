"""Type families. Decisions are made by family, so ``timestamp`` and ``timestamp_ntz`` agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

from ..errors import UnsupportedColumn

NUMERIC, TEXT, TEMPORAL, BOOLEAN, OTHER = "numeric", "text", "temporal", "boolean", "other"


def kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def columns_of(schema: T.StructType, *kinds: str) -> list[str]:
    return [f.name for f in schema if kind(f.dataType) in kinds]


def require_flat(schema: T.StructType) -> None:
    nested = [f"{f.name} {f.dataType.simpleString()}" for f in schema if kind(f.dataType) == OTHER]
    if nested:
        raise UnsupportedColumn(f"columns must be flat, flatten or drop first: {nested}")


def parse_type(name: str) -> T.DataType:
    return T.StructType.fromDDL(f"c {name}")[0].dataType


def effective_types(schema: T.StructType, corrections: Mapping[str, str] | None = None) -> dict[str, T.DataType]:
    """Type of each column after the user's corrections; one answer for casting and for indexing."""
    corrections = corrections or {}
    unknown = sorted(set(corrections) - set(schema.names))
    if unknown:
        raise UnsupportedColumn(f"corrected types name unknown columns: {unknown}")
    return {f.name: parse_type(corrections[f.name]) if f.name in corrections else f.dataType for f in schema}
