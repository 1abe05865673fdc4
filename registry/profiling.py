"""Profiles, missing values, distributions and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators.correlation import correlation_pearson, correlation_spearman
from tessella.operators.distributions import histogram_categorical, histogram_numeric
from tessella.operators.merge import Link, merge_graph, merge_two
from tessella.operators.profile import column_types, dataset_summary, missing_values, profile

from .tables import EVENTS_WITH_GAPS, LINEITEM, events_with_gaps, table

CHAIN = [
    Link.of("lineitem", "orders", ("l_orderkey", "o_orderkey")),
    Link.of("orders", "customer", ("o_custkey", "c_custkey")),
]


def chain(spark, folder):
    return merge_graph({n: table(spark, folder, n) for n in ("lineitem", "orders", "customer")}, CHAIN)


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


def rounded_value(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


QUERIES = {
    "column_types": lambda s, d: column_types(table(s, d, "lineitem")),
    "profile": lambda s, d: _rounded(profile(table(s, d, "lineitem"))),
    "profile_texts": lambda s, d: _rounded(profile(table(s, d, "documents"))),
    "profile_merged": lambda s, d: _rounded(profile(chain(s, d))),
    "missing_values": lambda s, d: missing_values(events_with_gaps(s, d)),
    "histogram_numeric": lambda s, d: histogram_numeric(table(s, d, "lineitem")),
    "histogram_numeric_gaps": lambda s, d: histogram_numeric(events_with_gaps(s, d), ["user_id", "value"]),
    "histogram_categorical": lambda s, d: histogram_categorical(
        merge_two(table(s, d, "lineitem"), table(s, d, "part"), [("l_partkey", "p_partkey")]),
        ["l_returnflag", "l_linestatus", "p_brand", "p_name"],
    ),
    "correlation_pearson": lambda s, d: rounded_value(
        correlation_pearson(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    ),
    "correlation_spearman": lambda s, d: rounded_value(
        correlation_spearman(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    ),
    "correlation_spearman_spread": lambda s, d: rounded_value(
        correlation_spearman(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], broadcast_bytes=0)
    ),
    "dataset_summary": lambda s, d: dataset_summary(chain(s, d), ["lineitem", "orders", "customer"], [str(c) for c in CHAIN]),
}

NUMBER_TYPES = {"int": "integer", "bigint": "bigint", "double": "double"}

TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
}


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """One branch per column: name shown, and its type."""
    branches = []
    for i, (c, t) in enumerate(columns):
        numeric, text = t in NUMBER_TYPES, t == "string"
        read = f"{c}::double" if numeric else f"try_cast({c} as double)" if text else "null::double"
        nan = f"count(case when isnan({read}) then 1 end)" if t in ("double", "string") else "0"
        branches.append(f"""
          select {i} as position, '{c}' as "column", '{t}' as type, count({c}) as count,
                 count(*) - count({c}) as null_count, {nan} as nan_count, count(*) - count({c}) + {nan} as missing_count,
                 round(avg({read}), 4) as mean, round(stddev_samp({read}), 4) as stddev,
                 {f'min({c})::double' if numeric else 'null::double'} as min_num,
                 {f'max({c})::double' if numeric else 'null::double'} as max_num,
                 {'null::varchar' if t == 'double' else f'min({c})::varchar'} as min_str,
                 {'null::varchar' if t == 'double' else f'max({c})::varchar'} as max_str
          from source""")
    return f"with source as ({source}) " + " union all ".join(branches)


CHAIN_SQL = """
  select l_orderkey as l_orderkey_o_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate, o_custkey as o_custkey_c_custkey, o_orderstatus, o_totalprice,
         o_orderdate, o_orderpriority, c_name, c_nationkey, c_acctbal, c_mktsegment
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""

CHAIN_COLUMNS = [
    ("o_custkey_c_custkey", "bigint"),
    ("l_orderkey_o_orderkey", "bigint"),
    *[(c, TYPES[c]) for c in LINEITEM[1:]],
    *[(c, TYPES[c]) for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")],
    *[(c, TYPES[c]) for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")],
]


def histogram_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
          select '{c}' as "column", bin::int as bin, mn + (mx - mn) / 10 * bin as lower,
                 case when bin = 9 then mx else mn + (mx - mn) / 10 * (bin + 1) end as upper, count(v) as count
          from range(10) bins(bin)
          cross join (select min({c})::double as mn, max({c})::double as mx from {source}) m
          left join (select {c}::double as v from {source}) d
            on least(floor((v - mn) / (mx - mn) * 10)::int, 9) = bin
          group by bin, mn, mx""")
    return " union all ".join(parts)


def categories_sql(source: str, columns: list[str]) -> str:
    counts = " union all ".join(
        f"""select '{c}' as "column", {c} as value, count(*) as count from {source} where {c} is not null group by {c}"""
        for c in columns
    )
    return f"""
      with placed as (select *, row_number() over (partition by "column" order by count desc, value) as place from ({counts}))
      select "column", value, count, place::int as position, 1::bigint as values from placed where place <= 20
      union all
      select "column", null, sum(count)::bigint, 21, count(*) from placed where place > 20 group by "column\""""


def pearson_sql(source: str, names: list[str]) -> str:
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    return " union all ".join(f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as value from {source}" for x, y in pairs)


def spearman_sql(source: str, names: list[str]) -> str:
    ranks = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in names)
    return f"with ranked as (select {ranks} from {source}) {pearson_sql('ranked', names)}"


NUMBERS = [c for c in LINEITEM if TYPES[c] in NUMBER_TYPES]

ORACLES = {
    "column_types": " union all ".join(
        f"""select {i} as position, '{c}' as "column", '{TYPES[c]}' as type, count({c}) as count from lineitem"""
        for i, c in enumerate(LINEITEM)
    ),
    "profile": profile_sql("select * from lineitem", [(c, TYPES[c]) for c in LINEITEM]),
    "profile_texts": profile_sql(
        "select * from documents", [(c, TYPES[c]) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    ),
    "profile_merged": profile_sql(CHAIN_SQL, CHAIN_COLUMNS),
    "missing_values": " union all ".join(
        f"""select '{c}' as "column", {nan} as nan_count, count(*) - count({c}) as null_count,
                   {nan} + count(*) - count({c}) as missing_count from ({EVENTS_WITH_GAPS})"""
        for c, nan in {
            "event_id": "0", "ts": "0", "user_id": "0",
            "event_type": "count(case when isnan(try_cast(event_type as double)) then 1 end)",
            "value": "count(case when isnan(value) then 1 end)",
            "props": "count(case when isnan(try_cast(props as double)) then 1 end)",
        }.items()
    ),
    "histogram_numeric": histogram_sql("lineitem", NUMBERS),
    "histogram_numeric_gaps": histogram_sql(
        f"(select user_id, case when not isnan(value) then value end as value from ({EVENTS_WITH_GAPS}))", ["user_id", "value"]
    ),
    "histogram_categorical": categories_sql(
        "(select * from lineitem join part on l_partkey = p_partkey)", ["l_returnflag", "l_linestatus", "p_brand", "p_name"]
    ),
    "correlation_pearson": pearson_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "correlation_spearman": spearman_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]),
    "correlation_spearman_spread": spearman_sql("lineitem", ["l_quantity", "l_extendedprice"]),
    "dataset_summary": """
        select count(*) as row_count, 20 as column_count, 'lineitem,orders,customer' as parents,
               'lineitem.l_orderkey=orders.o_orderkey,orders.o_custkey=customer.c_custkey' as links
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
}
