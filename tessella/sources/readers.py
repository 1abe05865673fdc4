"""Scans of CSV, JSON and Parquet."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TessellaError
from ..functions.cells import column, quoted
from ..functions.names import require_unique, sanitize_columns
from .split_scan import SPLIT_BYTES, csv_records, json_elements


# Quotes in a value are doubled, backslashes are plain characters, and an empty text differs from a missing one.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}
# The reader calls nothing between two commas by this name, and the same name null; quoted nothing is then an empty text.
NOTHING = "\ue000nothing\ue000"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """CSV with a header. Give a schema for large inputs: inferring one reads the file an extra time.

    Values may hold line breaks. Files up to ``split_bytes`` are read by one task each. If there is a larger one, all are
    scanned split by split, first for where each split begins and then for the records (``split_scan``); a folder with
    partition columns is read file by file. ``multiline=False`` reads lines at once, and is right only if no value has a
    line break.
    """
    reader = spark.read.options(**CSV_OPTIONS, nullValue=NOTHING, emptyValue="").option("multiLine", multiline)
    if multiline and _is_split(spark, path, split_bytes):
        return _csv_by_split(spark, path, schema)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def _is_split(spark: SparkSession, path: str, split_bytes: int) -> bool:
    """Whether a file is larger, and the folder has no columns of its own."""
    files = spark.read.format("binaryFile").load(path)
    if files.columns != ["path", "modificationTime", "length", "content"]:
        return False
    return (files.agg(F.max("length")).first()[0] or 0) > split_bytes


def _strings(df: DataFrame):
    """A frame of one text column as the JVM's readers take it, to infer types from."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def _inferred(reader: DataFrameReader, kind: str, rows: DataFrame) -> T.StructType:
    try:
        found = getattr(reader._jreader, kind)(_strings(rows)).schema().json()
    except Py4JJavaError as broken:
        raise TessellaError(f"the records are no {kind.upper()}") from broken
    return T.StructType.fromJson(json.loads(found))


def _csv_by_split(spark: SparkSession, path: str, schema: T.StructType | str | None) -> DataFrame:
    options = {**CSV_OPTIONS, "header": False, "nullValue": NOTHING, "emptyValue": ""}
    records = csv_records(spark, path)
    rows = records.where("not first").select("record")
    if schema is None:
        names = spark.read.options(**CSV_OPTIONS, multiLine=True).csv(path).columns
        found = _inferred(spark.read.options(**options, inferSchema=True), "csv", rows)
        # a file without rows has texts, as have columns behind those of the first rows
        kinds = [f.dataType for f in found.fields] + [T.StringType()] * len(names)
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()} | {"multiLine": "true"}
    return rows.select(F.from_csv("record", schema.toDDL(), options).alias("row")).select("row.*")


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    document: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """JSON lines (split across tasks), or with ``document`` files that each hold one object or array.

    Text that is not JSON raises: when the schema is inferred, or when the rows are read. With a document larger than
    ``split_bytes``, all are scanned split by split for the elements of their arrays (``split_scan``), which must be objects.
    """
    reader = spark.read.option("multiLine", document)
    if document and _is_split(spark, path, split_bytes):
        rows = json_elements(spark, path)
        if schema is None:
            schema = _inferred(spark.read.option("mode", "FAILFAST"), "json", rows)
        elif isinstance(schema, str):
            schema = spark.createDataFrame([], schema).schema
        return rows.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    if schema is not None:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    found = reader.json(path)
    if CORRUPT in found.columns:
        kind = "one JSON document per file" if document else "JSON lines"
        raise TessellaError(f"{path} does not hold {kind}")
    return found


CORRUPT = "_corrupt_record"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Inferred JSON type, as a pattern, and the table type it is read as.
JSON_TYPES = {
    r"\bOBJECT<": "STRUCT<",
    r": VOID\b": ": STRING",
    r": VARIANT\b": ": STRING",
    r"\bDECIMAL\(\d+, ?\d+\)": "DOUBLE",
}


def infer_json_type(df: DataFrame, name: str) -> str:
    """Type of all documents in a text column, merged on the executors in one pass."""
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column(name)))).first()[0]
    for pattern, table_type in JSON_TYPES.items():
        found = re.sub(pattern, table_type, found)
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become columns ``parent_child``, at any depth."""

    def leaves(prefix: Column | None, label: str, schema: T.StructType) -> list[Column]:
        out = []
        for f in schema:
            value = column(f.name) if prefix is None else prefix.getField(f.name)
            name = f"{label}_{f.name}" if label else f.name
            out += leaves(value, name, f.dataType) if isinstance(f.dataType, T.StructType) else [value.alias(name)]
        return out

    flat = df.select(*leaves(None, "", df.schema))
    require_unique(flat.columns)
    return flat


def json_rows(df: DataFrame, name: str, json_type: str | None = None) -> DataFrame:
    """Replace a text column of JSON documents by their fields; a document that is an array gives a row per element."""
    if json_type is None:
        json_type = infer_json_type(df, name)
        if not json_type.startswith(("STRUCT<", "ARRAY<")):
            raise TessellaError(f"{name} holds {json_type}, not objects or arrays of objects")
    parsed = df.withColumn(name, F.from_json(column(name), json_type))
    if isinstance(parsed.schema[name].dataType, T.ArrayType):
        parsed = parsed.withColumn(name, F.explode_outer(column(name)))
    if not isinstance(parsed.schema[name].dataType, T.StructType):
        raise TessellaError(f"{name} holds {json_type}, not objects or arrays of objects")
    others = [column(c) for c in df.columns if c != name]
    return flatten(parsed.select(*others, F.col(f"{quoted(name)}.*")))


def read_json_document(spark: SparkSession, document: str, json_type: str | None = None) -> DataFrame:
    """Rows of one document held in memory."""
    return json_rows(spark.createDataFrame([(document,)], "document string"), "document", json_type)


def ingest(
    spark: SparkSession,
    path: str,
    kind: str = "csv",
    suffix: int | str = 1,
    schema: T.StructType | str | None = None,
    document: bool = False,
    multiline: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Scan an upload and give its columns clean names that are unique across datasets.

    ``document``: JSON files hold one object or array each, over any number of lines. ``multiline`` and ``split_bytes``:
    see ``read_csv``.
    """
    if kind == "csv":
        df = read_csv(spark, path, schema, multiline, split_bytes)
    elif kind == "json":
        df = flatten(read_json(spark, path, schema, document, split_bytes))
    elif kind == "parquet":
        df = read_parquet(spark, path)
    else:
        raise TessellaError(f"unknown kind of source: {kind}")
    return sanitize_columns(df, suffix)
