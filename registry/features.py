"""Feature steps, whole preparation, training frames."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tessella.functions.cells import DATE_PARTS
from tessella.operators.features import (
    FeatureSpec,
    fit_features,
    impute_means,
    index_categories,
    load_features,
    numbers_to_double,
    save_features,
    split_date,
    training_frame,
)
from tessella.scratch import new_path

from .tables import EVENTS_WITH_GAPS, ORDERS_WITH_TEXT_DATES, events_with_gaps, orders_with_text_dates, table

EVENT_SPEC = FeatureSpec(columns=("user_id", "value", "event_type", "ts"), time=("ts", None))


def applied(df, stages):
    return Pipeline(stages=stages).fit(df).transform(df)


def date_split(spark, folder):
    orders = orders_with_text_dates(spark, folder).select("o_orderkey", "o_orderdate")
    return applied(orders, split_date(orders, "o_orderdate", "dd/MM/yyyy"))


def to_double(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_size", F.expr("substring(p_brand, 7)").alias("brand"))
    return applied(part, numbers_to_double(["p_size", "brand"]))


def string_index(spark, folder, label_bytes=1 << 20):
    events = events_with_gaps(spark, folder).select("event_id", "event_type")
    return applied(events, index_categories(events, ["event_type"], label_bytes))


def nominal_counts(spark, folder):
    """Number of categories in the metadata of a column, whichever way it is indexed."""
    found = [string_index(spark, folder, limit).schema["event_typeIndex"].metadata["ml_attr"] for limit in (0, 1 << 20)]
    total = events_with_gaps(spark, folder).agg(F.count_distinct("event_type").alias("distinct_values"))
    same = F.lit(found[0] == found[1] and found[0]["type"] == "nominal")
    return total.select("distinct_values", F.lit(found[0]["num_vals"]).cast("long").alias("categories"), same.alias("same"))


def text_index(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return applied(documents, index_categories(documents, ["text"], 0))


def impute(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity")
    )
    return applied(lineitem, impute_means(["l_quantity"])).withColumn("l_quantity", F.round("l_quantity", 6))


def prepared(spark, folder):
    events = events_with_gaps(spark, folder).drop("props")
    return fit_features(events, EVENT_SPEC).transform(events).withColumn("value", F.round("value", 6))


def reloaded(spark, folder):
    """Saved, loaded and applied to other values: the gaps get the mean of the fitted frame."""
    events = events_with_gaps(spark, folder).drop("props")
    path = save_features(fit_features(events, EVENT_SPEC), new_path(spark, "features"))
    other = events.withColumn("value", F.col("value") * 2)
    return load_features(path).transform(other).withColumn("value", F.round("value", 6))


def frame_to_train(spark, folder):
    orders = orders_with_text_dates(spark, folder)
    target = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    spec = FeatureSpec(
        columns=("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"),
        target="o_totalprice",
        time=("o_orderdate", "dd/MM/yyyy"),
    )
    return training_frame(orders.withColumn("o_totalprice", target), spec, keep=["o_orderkey"]).frame


QUERIES = {
    "feat_date_split": date_split,
    "feat_to_double": to_double,
    "feat_string_index": string_index,
    "feat_nominal_counts": nominal_counts,
    "feat_string_index_table": lambda s, d: string_index(s, d, 0),
    "feat_text_index_table": text_index,
    "feat_impute": impute,
    "feat_fit_apply": prepared,
    "feat_fit_reload": reloaded,
    "training_frame": frame_to_train,
}

# SQL for each part of a time.
PART_SQL = {
    "year": "year({0})", "month": "month({0})", "day": "day({0})", "dayofweek": "dayofweek({0}) + 1",
    "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})",
}


def parts_sql(name: str, value: str) -> str:
    return ", ".join(f"({PART_SQL[p].format(value)})::double as {name}_{p}" for p in DATE_PARTS)


def index_sql(source: str, name: str) -> str:
    """Tables: ranked values, and the number of them."""
    return f"""
      (select {name} as v, (row_number() over (order by count(*) desc, {name}) - 1)::double as i
       from ({source}) where {name} is not null group by {name})"""


def indexed(source: str, name: str) -> str:
    return f"""
      select s.*, coalesce(x.i, (select count(distinct {name}) from ({source}))::double) as {name}Index
      from ({source}) s left join {index_sql(source, name)} x on s.{name} = x.v"""


ORDER_TIME = "try_strptime(o_orderdate, '%d/%m/%Y')"

PREPARED_EVENTS = """
  select event_id, user_id::double as user_id,
         round(case when value is null or isnan(value) then (select avg(value) from ({gaps}) where not isnan(value))
                    else {factor} * value end, 6) as value,
         event_typeIndex, {parts}
  from ({indexed})"""

ORACLES = {
    "feat_date_split": f"select o_orderkey, {parts_sql('o_orderdate', ORDER_TIME)} from ({ORDERS_WITH_TEXT_DATES})",
    "feat_to_double": """
        select p_partkey, p_size::double as p_size, try_cast(substr(p_brand, 7) as double) as brand from part""",
    "feat_string_index": f"select event_id, event_typeIndex from ({indexed(EVENTS_WITH_GAPS, 'event_type')})",
    "feat_nominal_counts": f"""
        select count(distinct event_type) as distinct_values, count(distinct event_type) + 1 as categories, true as same
        from ({EVENTS_WITH_GAPS})""",
    "feat_string_index_table": f"select event_id, event_typeIndex from ({indexed(EVENTS_WITH_GAPS, 'event_type')})",
    "feat_text_index_table": f"select doc_id, textIndex from ({indexed('select doc_id, text from documents', 'text')})",
    "feat_impute": """
        select l_orderkey, l_linenumber,
               round(case when l_linenumber = 3 then (select avg(l_quantity) from lineitem where l_linenumber <> 3)
                          else l_quantity end, 6) as l_quantity
        from lineitem""",
    "feat_fit_apply": PREPARED_EVENTS.format(
        gaps=EVENTS_WITH_GAPS, factor=1, parts=parts_sql("ts", "ts"), indexed=indexed(EVENTS_WITH_GAPS, "event_type")
    ),
    "feat_fit_reload": PREPARED_EVENTS.format(
        gaps=EVENTS_WITH_GAPS, factor=2, parts=parts_sql("ts", "ts"), indexed=indexed(EVENTS_WITH_GAPS, "event_type")
    ),
    "training_frame": f"""
        select o_orderkey, o_custkey::double as o_custkey, o_totalprice, a.i as o_orderstatusIndex,
               b.i as o_orderpriorityIndex, {parts_sql('o_orderdate', ORDER_TIME)}
        from ({ORDERS_WITH_TEXT_DATES}) o
        join {index_sql('from orders', 'o_orderstatus')} a on o.o_orderstatus = a.v
        join {index_sql('from orders', 'o_orderpriority')} b on o.o_orderpriority = b.v
        where o_orderkey % 10 <> 0""",
}
