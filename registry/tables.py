"""The given tables and a few columns derived from them on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 5 != 0, F.col("value"))
    kind = F.when(F.col("event_id") % 13 != 0, F.col("event_type"))
    return table(spark, folder, "events").withColumns({"value": value, "event_type": kind})


EVENTS_WITH_GAPS = """
  select event_id, ts, user_id,
         case when event_id % 13 <> 0 then event_type end as event_type,
         case when event_id % 7 = 0 then 'NaN'::double when event_id % 5 <> 0 then value end as value,
         props
  from events"""


def orders_with_text_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 11 == 0, "bad").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, folder, "orders").withColumn("o_orderdate", text)


ORDERS_WITH_TEXT_DATES = """
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         case when o_orderkey % 11 = 0 then 'bad' else strftime(o_orderdate, '%d/%m/%Y') end as o_orderdate,
         o_orderpriority
  from orders"""

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def nulls_first(names) -> str:
    return ", ".join(f"{n} nulls first" for n in names)
