"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot behind each one (``com.example.www.``). The hosts that a rule
covers, its own and all below it, are then one interval of the sorted keys. Distinct hosts and rule hosts are dealt out
by key range and swept in key order. The sweep's stack has a slot for each depth of rule hosts: a rule host enters the
slot of its depth, and is popped when the key no longer begins with it. A range begins with the rule hosts that are
still open at its first key. Only hosts are swept; a page gets the stack of its host and compares paths with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULE = "struct<host:string,path:string,verdict:string>"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict from a list of tuples."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    rows = [F.struct(*(F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for an url without ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, PARTS, n), F.lit("")) for n in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _prefixes(key: Column) -> Column:
    """The keys of a host and of all hosts above it."""
    labels = F.split(key, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")),
    )


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """key, stack: for each distinct key of ``hosts`` the rules that are open there, as an array of their fields."""
    spark = hosts.sparkSession
    rule_hosts = rules.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_set(F.struct("host", "path", "verdict")).alias("entries")
    )
    rule_hosts = materialise(rule_hosts.withColumn("depth", F.size(F.split("key", r"\.")) - 1), "url-rules")
    depths = sorted(r[0] for r in rule_hosts.select("depth").distinct().collect())  # labels of a name: few numbers
    if not depths:
        return hosts.select("key").distinct().withColumn("stack", F.expr(f"cast(array() as array<{RULE}>)"))
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = hosts.select("key").distinct().withColumns(
        {"entries": F.lit(None).cast(f"array<{RULE}>"), "depth": F.lit(None).cast("int")}
    )
    events = asked.unionByName(rule_hosts).repartitionByRange(places, "key")
    events = materialise(events.withColumn("place", F.spark_partition_id()), "url-events")
    begins = events.groupBy("place").agg(F.min("key").alias("first"))
    still_open = begins.select("place", F.explode(_prefixes(F.col("first"))).alias("key")).join(rule_hosts, "key")
    sweep = Window.partitionBy("place").orderBy("key", F.col("depth").isNull())
    slots = [
        F.last(F.when(F.col("depth") == d, F.struct("key", "entries")), ignorenulls=True).over(sweep) for d in depths
    ]
    swept = events.unionByName(still_open.select(*events.columns)).withColumn("slots", F.array(*slots))
    stack = F.filter("slots", lambda s: s.isNotNull() & F.startswith(F.col("key"), s["key"]))
    return swept.where("depth is null").select("key", F.flatten(F.transform(stack, lambda s: s["entries"])).alias("stack"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of ``pages``.

    ``rules`` has host, path and verdict, text in any number of rows; the rules of one host are one array. A rule fits
    its host and all hosts below it when the url's path begins with the rule's; the longest text host + path wins, then
    the longer host, and of rules that differ in the verdict only the greater verdict (``block``). Rules with a null or
    empty host fit nothing. Null urls, urls without ``://`` and hosts without a rule get no rule and ``default``.
    Repeated rows are judged each; other columns, whatever their names, are left out; empty tables give no rows.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("key", host_key(F.col("host")))
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    stacks = open_rules(judged.select("key"), known.where("host <> ''"))
    fitting = F.transform(
        F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct(
            F.length(F.concat(r["host"], r["path"])).alias("length"),
            F.length(r["host"]).alias("host_length"),
            r["verdict"].alias("verdict"),
            F.concat(r["host"], r["path"]).alias("rule"),
        ),
    )
    best = judged.join(stacks, "key", "left").withColumn("best", F.array_max(fitting))
    return best.select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
