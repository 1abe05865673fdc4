"""Scans, sinks, naming, row ids, paging and cell functions."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tessella.functions.cells import date_parts, parse_timestamp, timestamps_to_string
from tessella.functions.names import rename_spaces, sanitize_columns
from tessella.operators.projections import (
    cast_to_double,
    drop_columns,
    drop_empty_columns,
    drop_missing_target,
    select_columns,
)
from tessella.operators.row_id import add_row_id, partition_count
from tessella.scratch import materialise, new_path
from tessella.sources.readers import ingest, json_rows, read_csv, read_json
from tessella.sources.store import (
    page_rows,
    read_csv_as,
    read_page,
    rows_as_json,
    store_dataset,
    store_dataset_fast_id,
    write_csv,
    write_parquet,
)

from .tables import (
    EVENTS_WITH_GAPS,
    LINEITEM,
    ORDERS,
    ORDERS_WITH_TEXT_DATES,
    events_with_gaps,
    nulls_first,
    orders_with_text_dates,
    table,
)


def scan_csv(spark, folder):
    orders = table(spark, folder, "orders")
    read = read_csv(spark, write_csv(orders, new_path(spark, "csv")))
    # Inference narrows whole numbers and yields times with zone: bring back the source types.
    return read.select(*[F.col(f.name).cast(f.dataType) for f in orders.schema])


def scan_json(spark, folder):
    return json_rows(table(spark, folder, "events").select("event_id", "props"), "props")


def scan_json_files(spark, folder):
    path = new_path(spark, "json")
    customer = table(spark, folder, "customer")
    customer.write.json(path)
    return read_json(spark, path).select(*customer.columns)


def sink_parquet(spark, folder):
    return spark.read.parquet(write_parquet(table(spark, folder, "part"), new_path(spark, "parquet")))


def sink_csv(spark, folder):
    supplier = table(spark, folder, "supplier")
    return read_csv_as(spark, write_csv(supplier, new_path(spark, "csv")), supplier)


def odd_texts(spark, folder):
    """Whole documents; some without text, with empty text, with blanks, quotes, backslashes and line breaks."""
    text, kind = F.col("text"), F.col("doc_id") % 7
    odd = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit("  "), text, F.lit("\t ")))
        .when(kind == 3, F.concat(F.lit('"a",\\"b"\\n,\r\n'), text, F.lit('\\')))
        .otherwise(text)
    )
    return table(spark, folder, "documents").withColumn("text", odd)


def through_csv(spark, df):
    return read_csv_as(spark, write_csv(df, new_path(spark, "csv")), df)


@contextmanager
def small_splits(spark, split_bytes=64 << 10):
    """Splits of a size that also small files have several of."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, (split_bytes, 0)):
        spark.conf.set(name, value)
    try:
        yield split_bytes
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def split_size(spark, path):
    """A quarter of the largest file, so that several tasks read it, but between 64 KB and 32 MB: a task for each 64 KB
    of a large input would take longer to start than to run."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return min(max(largest // 4, 64 << 10), 32 << 20)


def scan_csv_split(spark, folder):
    """Texts with quoted line breaks, in files that several tasks read."""
    texts = odd_texts(spark, folder)
    path = write_csv(texts, new_path(spark, "csv"))
    with small_splits(spark, split_size(spark, path)) as split_bytes:
        return materialise(read_csv(spark, path, texts.schema, split_bytes=split_bytes), "csv-rows")


def scan_csv_split_inferred(spark, folder):
    conversations = table(spark, folder, "conversations")
    path = write_csv(conversations, new_path(spark, "csv"))
    with small_splits(spark, split_size(spark, path)) as split_bytes:
        found = materialise(read_csv(spark, path, split_bytes=split_bytes), "csv-rows")
    return found.select(*[F.col(f.name).cast(f.dataType) for f in conversations.schema])


def scan_json_split(spark, folder):
    """Arrays of objects with texts full of braces and quotes, in files that several tasks read."""
    path = json_arrays(spark, odd_texts(spark, folder))
    with small_splits(spark, split_size(spark, path)) as split_bytes:
        found = materialise(read_json(spark, path, document=True, split_bytes=split_bytes), "json-rows")
    return found.select("doc_id", "text", "lang", "source", "n_chars")


def json_arrays(spark, df):
    """Files of one indented array each, a file for each slice of the first column; no row holds more than an object."""

    def lines(batches):
        import pyarrow as pa

        def batch(values):
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

        last = None
        yield batch(["["])
        for own in batches:
            objects = own.column("value").to_pylist()
            if objects:
                yield batch([f"  {o}," for o in ([] if last is None else [last]) + objects[:-1]])
                last = objects[-1]
        yield batch(([] if last is None else [f"  {last}"]) + ["]"])

    path = new_path(spark, "json")
    objects = df.repartition(json_files(df), df.columns[0]).select(F.to_json(F.struct(*df.columns)).alias("value"))
    objects.mapInArrow(lines, "value string").write.option("lineSep", "\n").text(path)
    return path


def json_files(df, file_bytes=64 << 20):
    """Eight at least, and one for each 64 MB of the sources."""
    return max(8, partition_count(df, file_bytes))


def ingest_json_documents(spark, folder):
    """Customers as one indented array per file."""
    customer = table(spark, folder, "customer")
    arrays = customer.groupBy((F.col("c_custkey") % 8).alias("part")).agg(
        F.concat(F.lit("[\n  "), F.array_join(F.collect_list(F.to_json(F.struct(*customer.columns))), ",\n  "), F.lit("\n]"))
    )
    path = new_path(spark, "json")
    arrays.write.partitionBy("part").text(path)
    return ingest(spark, f"{path}/part=*", "json", 1, document=True)


def ingest_csv(spark, folder):
    customer = table(spark, folder, "customer")
    path = write_csv(customer, new_path(spark, "csv"))
    return ingest(spark, path, "csv", 1, customer.schema)


def stored_lineitem(spark, folder):
    return spark.read.parquet(store_dataset(table(spark, folder, "lineitem"), new_path(spark, "dataset")))


def stored_orders(spark, folder):
    return store_dataset(table(spark, folder, "orders"), new_path(spark, "dataset"))


def store_fast_id(spark, folder):
    path = store_dataset_fast_id(table(spark, folder, "orders"), new_path(spark, "dataset"))
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("distinct_ids"), F.sum("o_orderkey").alias("key_sum")
    )


def spaced(spark, folder):
    part = table(spark, folder, "part")
    return rename_spaces(part.toDF(*[c.replace("_", " ") for c in part.columns]))


def row_id_null_keys(spark, folder):
    events = table(spark, folder, "events")
    keyed = events.select(F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("k"), "event_id")
    return add_row_id(keyed)


def row_id_texts(spark, folder):
    documents = table(spark, folder, "documents").select("lang", "text", "doc_id")
    return add_row_id(documents).select("doc_id", "id")


def row_id_common_start(spark, folder):
    """Texts that all begin with the same 200 characters, so that only later ones tell them apart."""
    start = F.lit("copyright " * 20)
    texts = table(spark, folder, "documents").select(F.concat(start, "text").alias("text"), "doc_id")
    pages = table(spark, folder, "pages").select(F.concat(start, "html").alias("text"), F.col("page_id").alias("doc_id"))
    return add_row_id(texts.unionAll(pages)).select("doc_id", "id", F.length("text").alias("n"))


def parse_timestamps(spark, folder):
    orders = orders_with_text_dates(spark, folder)
    return orders.select("o_orderkey", parse_timestamp(orders, "o_orderdate", "dd/MM/yyyy").cast("timestamp_ntz").alias("t"))


def target_with_gaps(spark, folder):
    return drop_missing_target(events_with_gaps(spark, folder), "value").select("event_id", "value")


def without_empty(spark, folder):
    supplier = table(spark, folder, "supplier")
    never = F.when(F.col("s_suppkey") < 0, F.col("s_acctbal"))
    return drop_empty_columns(supplier.withColumns({"never": never, "only_nan": F.lit(float("nan"))}))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_csv_split": scan_csv_split,
    "scan_csv_split_inferred": scan_csv_split_inferred,
    "scan_json": scan_json,
    "scan_json_split": scan_json_split,
    "scan_json_files": scan_json_files,
    "scan_parquet": lambda s, d: table(s, d, "lineitem"),
    "sink_parquet": sink_parquet,
    "sink_csv": sink_csv,
    "sink_csv_texts": lambda s, d: through_csv(s, odd_texts(s, d)),
    "sink_csv_pages": lambda s, d: through_csv(s, table(s, d, "pages")),
    "sink_csv_conversations": lambda s, d: through_csv(s, table(s, d, "conversations")),
    "ingest_csv": ingest_csv,
    "ingest_json_documents": ingest_json_documents,
    "sanitize_columns": lambda s, d: sanitize_columns(table(s, d, "orders"), 1),
    "rename_spaces": spaced,
    "timestamps_to_string": lambda s, d: timestamps_to_string(table(s, d, "events")),
    "select_columns": lambda s, d: select_columns(table(s, d, "lineitem"), ["l_orderkey", "l_quantity"]),
    "drop_column": lambda s, d: drop_columns(table(s, d, "customer"), "c_name"),
    "cast_to_double": lambda s, d: cast_to_double(
        table(s, d, "part").select("p_partkey", F.expr("substring(p_brand, 7)").alias("brand"), F.col("p_name").alias("name")),
        "brand", "name",
    ),
    "drop_missing_target": target_with_gaps,
    "drop_empty_columns": without_empty,
    "row_id": lambda s, d: add_row_id(table(s, d, "lineitem")),
    "row_id_by_name": lambda s, d: add_row_id(table(s, d, "part").select("p_name", "p_partkey")),
    "row_id_null_keys": row_id_null_keys,
    "row_id_texts": row_id_texts,
    "row_id_common_start": row_id_common_start,
    "store_dataset": stored_lineitem,
    "store_dataset_fast_id": store_fast_id,
    "page_rows": lambda s, d: read_page(s, stored_orders(s, d), 101, 50),
    "page_all": lambda s, d: read_page(s, stored_orders(s, d)),
    "page_json": lambda s, d: rows_as_json(page_rows(add_row_id(table(s, d, "supplier")), 1, 20)),
    "parse_timestamp": parse_timestamps,
    "date_parts": lambda s, d: table(s, d, "events").select("event_id", *date_parts(F.col("ts"), "ts")),
}

NUMBERED_ORDERS = f"""
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::varchar as o_orderdate, o_orderpriority,
         row_number() over (order by {nulls_first(ORDERS)}) as id
  from orders"""

ODD_TEXTS = """
  select doc_id, case doc_id % 7 when 0 then null when 1 then '' when 2 then '  ' || text || chr(9) || ' '
           when 3 then '"a",' || chr(92) || '"b"' || chr(92) || 'n,' || chr(13) || chr(10) || text || chr(92)
           else text end as text, lang, source, n_chars
  from documents"""

ORACLES = {
    "scan_csv": "select * from orders",
    "scan_csv_split": ODD_TEXTS,
    "scan_csv_split_inferred": "select * from conversations",
    "scan_json_split": ODD_TEXTS,
    "scan_json": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "scan_json_files": "select * from customer",
    "scan_parquet": "select * from lineitem",
    "sink_parquet": "select * from part",
    "sink_csv": "select * from supplier",
    "sink_csv_texts": ODD_TEXTS,
    "sink_csv_pages": "select * from pages",
    "sink_csv_conversations": "select * from conversations",
    "ingest_json_documents": """
        select c_custkey as cacustkey_1, c_name as caname_1, c_nationkey::bigint as canationkey_1, c_acctbal as caacctbal_1,
               c_mktsegment as camktsegment_1
        from customer""",
    "ingest_csv": """
        select c_custkey as cacustkey_1, c_name as caname_1, c_nationkey as canationkey_1, c_acctbal as caacctbal_1,
               c_mktsegment as camktsegment_1
        from customer""",
    "sanitize_columns": """
        select o_orderkey as oaorderkey_1, o_custkey as oacustkey_1, o_orderstatus as oaorderstatus_1,
               o_totalprice as oatotalprice_1, o_orderdate as oaorderdate_1, o_orderpriority as oaorderpriority_1
        from orders""",
    "rename_spaces": "select * from part",
    "timestamps_to_string": "select event_id, ts::varchar as ts, user_id, event_type, value, props from events",
    "select_columns": "select l_orderkey, l_quantity from lineitem",
    "drop_column": "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer",
    "cast_to_double": """
        select p_partkey, try_cast(substr(p_brand, 7) as double) as brand, try_cast(p_name as double) as name from part""",
    "drop_missing_target": f"select event_id, value from ({EVENTS_WITH_GAPS}) where value is not null and not isnan(value)",
    "drop_empty_columns": "select * from supplier",
    "row_id": f"select *, row_number() over (order by {nulls_first(LINEITEM)}) as id from lineitem",
    "row_id_by_name": "select p_name, p_partkey, row_number() over (order by p_name, p_partkey) as id from part",
    "row_id_null_keys": """
        select k, event_id, row_number() over (order by k nulls first, event_id) as id
        from (select case when event_id % 5 <> 0 then user_id end as k, event_id from events)""",
    "row_id_texts": "select doc_id, row_number() over (order by lang, text, doc_id) as id from documents",
    "row_id_common_start": """
        select doc_id, row_number() over (order by text, doc_id) as id, (length(text) + 200)::int as n
        from (select text, doc_id from documents union all select html, page_id from pages)""",
    "store_dataset": f"""
        select {', '.join(LINEITEM[:-1])}, l_shipdate::varchar as l_shipdate,
               row_number() over (order by {nulls_first(LINEITEM)}) as id
        from lineitem""",
    "store_dataset_fast_id": """
        select count(*) as row_count, count(*) as distinct_ids, sum(o_orderkey)::bigint as key_sum from orders""",
    "page_rows": f"select * from ({NUMBERED_ORDERS}) where id between 101 and 150",
    "page_all": NUMBERED_ORDERS,
    "page_json": """
        select to_json(struct_pack(s_suppkey := s_suppkey, s_name := s_name, s_nationkey := s_nationkey,
                                   s_acctbal := s_acctbal, id := id))::varchar as json
        from (select *, row_number() over (order by s_suppkey, s_name) as id from supplier) where id <= 20""",
    "parse_timestamp": f"select o_orderkey, try_strptime(o_orderdate, '%d/%m/%Y') as t from ({ORDERS_WITH_TEXT_DATES})",
    "date_parts": """
        select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day, dayofweek(ts) + 1 as ts_dayofweek,
               hour(ts) as ts_hour, minute(ts) as ts_minute, second(ts) as ts_second
        from events""",
}
