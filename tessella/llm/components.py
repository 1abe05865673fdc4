"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, new_path, remove


def _directed(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _starred(edges: DataFrame, center: DataFrame) -> DataFrame:
    """Each edge (a, b) moves to (the center of a, b)."""
    return edges.join(center, "a").select(F.col("m").alias("a"), "b").where("a <> b")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is linked with over any number of links) for all nodes of ``links`` (a, b).

    Large and small stars in turn: every node's greater neighbours move to its smallest neighbour, then its smaller ones.
    A few rounds are enough; each is written to the shared folder, and no task sees all links of a node.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ordered.distinct().write.parquet(path)
    now, mark = spark.read.schema(ordered.schema).parquet(path), None
    while True:
        before, mark = mark, _mark(now)
        if mark == before:
            break
        both = _directed(now)
        center = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _starred(both.where("b > a"), center)
        large = large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # of each node b: its smallest neighbour a; all its smaller neighbours, and itself, go there
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        after = new_path(spark, "links")
        small.distinct().write.parquet(after)
        remove(spark, path)
        path, now = after, spark.read.schema(ordered.schema).parquet(after)
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return materialise(stars.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct(), "components")
