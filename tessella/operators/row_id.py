"""Row ids 1..n in sort order, without sending the rows through one partition.

The rows are range partitioned, sorted and written once to the shared folder. A row's id is its
position in its file (the reader supplies it) plus the row count of the earlier partitions. Only
those counts, one per partition, reach the driver. Ids cannot change on a re-read, because they
hang on the written files and not on a recomputed shuffle.

Order is by the first column, then by the others, nulls first. Equal first values, a third of the
table even, are spread by the later columns; rows that are equal in every column are spread by the
input partition they come from, which a retried task reproduces.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column
from ..functions.kinds import TEXT, kind
from ..scratch import new_path, remove

PART, ORIGIN, POSITION = "__part", "__origin", "__position"

# Range boundaries are sampled by the driver, so the text in them is bounded. Sorting uses whole texts.
BOUNDARY_CHARS = 128

# A partition with more than this many times the mean is split again.
UNEVEN = 2.0

# Bytes of input in a partition, if the caller names no number of partitions.
PARTITION_BYTES = 256 << 20

# One row per partition: broadcast up to this many partitions, joined normally beyond.
BROADCAST_PARTS = 500_000


def orderable(schema: T.StructType) -> list[str]:
    """Columns a sort accepts."""
    return [f.name for f in schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def partition_count(df: DataFrame, partition_bytes: int = PARTITION_BYTES) -> int:
    """From the bytes of the sources, and not below the session's number of shuffle partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # beyond: the source does not know
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known // partition_bytes))


def boundary_keys(schema: T.StructType, order_by: Sequence[str], skips: dict[str, Column] | None = None) -> list[Column]:
    """Bounded keys that never contradict the full sort order.

    A cut text is followed by "is longer", and later columns only count while every text so far was whole; rows that
    cannot be told apart within the bound stay in one partition. ``skips``: characters that the rows have in common.
    """
    keys: list[Column] = []
    whole: Column | None = None

    def add(key: Column) -> None:
        keys.append(key if whole is None else F.when(whole, key))

    for name in order_by:
        cell = column(name)
        if kind(schema[name].dataType) != TEXT:
            add(cell)
            continue
        skip = (skips or {}).get(name, F.lit(0))
        longer = F.coalesce(F.length(cell) - skip > BOUNDARY_CHARS, F.lit(False))
        add(F.substring(cell, skip + 1, F.lit(BOUNDARY_CHARS)))
        add(longer)
        whole = ~longer if whole is None else whole & ~longer
    add(F.col(ORIGIN))
    return keys


def _common_start(a: Column, b: Column) -> Column:
    """Number of equal first characters of two texts, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def longer(length: Column, step: Column) -> Column:
        n = length + step
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
        return F.when(same, n).otherwise(length)

    return F.coalesce(F.aggregate(steps, F.lit(0), longer), F.lit(0))


def common_starts(rows: DataFrame, order_by: Sequence[str], partitions: int) -> tuple[DataFrame, list[Column]]:
    """``rows`` and boundary keys that tell apart also large groups of texts with the same start, before they are moved.

    Only a hash of the keys is counted. The rows of a hash with more than its share get the number of characters that
    their texts have in common, and keys from there on; again, until no group is too large or has more to tell.
    """
    spark, schema = rows.sparkSession, rows.schema
    keys = boundary_keys(schema, order_by)
    texts = [name for name in order_by if kind(schema[name].dataType) == TEXT]
    if not texts:
        return rows, keys
    longest = rows.agg(*[F.max(F.length(column(t))).alias(f"n{i}") for i, t in enumerate(texts)]).first()
    if max((n or 0 for n in longest), default=0) <= BOUNDARY_CHARS:
        return rows, keys  # whole texts are in the keys
    settled, origins, sizes_before = keys[:-1], keys[-1:], None
    for level in count():
        mark = f"__start{level}"
        marked = rows.withColumn(mark, F.xxhash64(*settled))
        sizes = marked.groupBy(mark).count()
        fair = (sizes.agg(F.sum("count")).first()[0] or 0) / partitions
        large = {r[0]: r[1] for r in sizes.where(F.col("count") > UNEVEN * fair).collect()}  # fewer than partitions
        if not large or sorted(large.values()) == sizes_before:
            return rows, [*settled, F.coalesce(*origins)]
        sizes_before = sorted(large.values())
        starts = [_common_start(F.min(column(t)), F.max(column(t))).alias(f"__skip{level}_{i}") for i, t in enumerate(texts)]
        found = marked.where(F.col(mark).isin(list(large))).groupBy(mark).agg(*starts).collect()
        names = ", ".join([f"{mark} long", *(f"__skip{level}_{i} int" for i in range(len(texts)))])
        rows = marked.join(F.broadcast(spark.createDataFrame([tuple(r) for r in found], names)), mark, "left").drop(mark)
        skips = {t: F.coalesce(f"__skip{level}_{i}", F.lit(0)) for i, t in enumerate(texts)}
        own = boundary_keys(schema, order_by, skips)
        settled, origins = [*settled, *own[:-1]], [*origins, own[-1]]


def sorted_table(
    df: DataFrame, order_by: Sequence[str], partitions: int | None = None, path: str | None = None
) -> DataFrame:
    """Written, globally sorted copy with the partition number and the position inside it (from 0), below ``path``.

    Texts that begin alike are told apart before the sort (``common_starts``). Partitions that come out too large all the
    same are split again behind what their texts have in common, then by the later columns, then by origin, until they are
    even or all the same.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "sorted")
    partitions = partitions or partition_count(df)
    texts = [name for name in order_by if kind(df.schema[name].dataType) == TEXT]
    schema = T.StructType([*df.schema.fields, T.StructField(ORIGIN, T.IntegerType()), T.StructField(PART, T.IntegerType())])
    rows, keys = common_starts(df.withColumn(ORIGIN, F.spark_partition_id()), order_by, partitions)
    largest_before = None
    for attempt in count():
        own = f"{path}/{attempt}"
        (
            rows.repartitionByRange(partitions, *keys)
            .sortWithinPartitions(*[column(c) for c in order_by])
            .select(*[column(c) for c in df.columns], ORIGIN)
            .withColumn(PART, F.spark_partition_id())
            .write.option("maxRecordsPerFile", 0)  # one file per partition, whatever the session says
            .parquet(own)
        )
        if attempt:
            remove(spark, f"{path}/{attempt - 1}")
        table = spark.read.schema(schema).parquet(own)
        sizes = {r[0]: r[1] for r in table.groupBy(PART).count().collect()}
        largest, fair = max(sizes.values(), default=0), sum(sizes.values()) / partitions
        if not texts or largest <= UNEVEN * fair or largest_before is not None and largest >= largest_before:
            return table.select(*[column(c) for c in df.columns], PART, F.col("_metadata.row_index").alias(POSITION))
        largest_before = largest
        large = [part for part, n in sizes.items() if n > UNEVEN * fair]
        starts = [
            _common_start(F.min(column(t)), F.max(column(t))).alias(f"__skip{i}") for i, t in enumerate(texts)
        ]
        found = table.where(F.col(PART).isin(large)).groupBy(PART).agg(*starts).collect()  # numbers per large partition
        names = ", ".join([f"{PART} int", *(f"__skip{i} int" for i in range(len(texts)))])
        rows = table.join(F.broadcast(spark.createDataFrame([tuple(r) for r in found], names)), PART, "left")
        skips = {t: F.coalesce(f"__skip{i}", F.lit(0)) for i, t in enumerate(texts)}
        keys = [F.col(PART), *boundary_keys(df.schema, order_by, skips)]


def with_offsets(table: DataFrame, **weights: Column) -> DataFrame:
    """Add the weights of all earlier partitions, by name. The driver sees one number per partition and weight."""
    spark = table.sparkSession
    sums = [w.cast("long").alias(name) for name, w in weights.items()]
    rows = sorted(tuple(r) for r in table.groupBy(PART).agg(*sums).collect())
    before = [list(accumulate((r[k] for r in rows), initial=0)) for k in range(1, len(weights) + 1)]
    offsets = spark.createDataFrame(
        [(r[0], *(b[i] for b in before)) for i, r in enumerate(rows)], ", ".join([f"{PART} int", *(f"{n} long" for n in weights)])
    )
    return table.join(F.broadcast(offsets) if len(rows) <= BROADCAST_PARTS else offsets, PART)


def add_row_id(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    name: str = "id",
    partitions: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """The result reads the sorted copy at ``path`` (a new folder in the shared one if not given)."""
    order = list(order_by) if order_by else orderable(df.schema)
    table = with_offsets(sorted_table(df, order, partitions, path), __offset=F.count(F.lit(1)))
    row_id = (F.col("__offset") + F.col(POSITION) + 1).alias(name)
    return table.select(*[column(c) for c in df.columns], row_id)


def add_fast_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Unique ids with gaps; no shuffle and no extra pass."""
    return df.withColumn(name, F.monotonically_increasing_id())
