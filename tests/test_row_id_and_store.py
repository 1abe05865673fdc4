import random

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from tessella.errors import AlreadyStored
from tessella.operators.row_id import BOUNDARY_CHARS, add_row_id
from tessella.sources.store import page_rows, read_page, rows_as_json, store_dataset, store_dataset_fast_id


def expected(rows):
    """Positions in a sort with nulls first."""
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def check(spark, rows, schema, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = sorted((tuple(r) for r in add_row_id(df, **options).collect()), key=lambda r: r[-1])
    assert [r[-1] for r in got] == list(range(1, len(rows) + 1))
    assert [r[:-1] for r in got] == expected(rows)


def test_ids_follow_the_sort_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), i) for i in range(500)]
    check(spark, rows, "k int, s string, n int")


def test_one_first_value_for_a_third_of_the_rows(spark):
    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)]
    check(spark, rows, "k int, n int", partitions=16)


def test_hot_first_value_is_spread_over_partitions(spark):
    df = spark.range(20000).select(F.lit("same").alias("k"), F.col("id").alias("n")).repartition(8)
    files = add_row_id(df, partitions=16).select(F.input_file_name()).distinct().count()
    assert files > 8


def test_equal_rows_are_all_numbered_and_spread(spark):
    df = spark.range(20000).select(F.lit("same").alias("k"), F.lit(1).alias("n")).repartition(8)
    numbered = add_row_id(df, partitions=16)
    assert numbered.select("id").distinct().count() == 20000
    assert numbered.agg(F.min("id"), F.max("id")).first() == (1, 20000)
    assert numbered.select(F.input_file_name()).distinct().count() > 4


def test_long_texts_with_a_shared_beginning(spark):
    start = "x" * BOUNDARY_CHARS
    rng = random.Random(2)
    texts = [start[: BOUNDARY_CHARS - 1], start, start + "a", start + "b" * 300, start + "b" * 299, "w", "y" + start]
    rows = [(rng.choice(texts), rng.choice([None, 5, 6]), i) for i in range(600)]
    check(spark, rows, "s string, k int, n int", partitions=16)


def test_order_by_chosen_columns(spark):
    df = spark.createDataFrame([(1, 9), (2, 8), (3, 7)], "a int, b int")
    assert [(r.b, r.id) for r in add_row_id(df, ["b"]).orderBy("id").collect()] == [(7, 1), (8, 2), (9, 3)]


def test_empty_frame(spark):
    assert add_row_id(spark.createDataFrame([], "a int")).count() == 0


def test_session_limits_on_file_size_do_not_matter(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        check(spark, [(i % 11, i) for i in range(200)], "k int, n int")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_reading_twice_gives_the_same_ids(spark):
    df = add_row_id(spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit("t").alias("s")))
    assert df.collect() == df.collect()


def test_no_window_and_no_single_partition_over_the_rows(spark):
    text = plan_text(add_row_id(spark.range(100).select((F.col("id") % 7).alias("k"))))
    assert "Window" not in text and "SinglePartition" not in text


def stored(spark, tmp_path, rows=1000):
    df = spark.range(rows).select(F.col("id").alias("the key"), F.expr("timestamp_ntz '2020-01-01 00:00:00'").alias("t"))
    return store_dataset(df.repartition(4), str(tmp_path / "data"))


def test_store_renames_casts_and_numbers(spark, tmp_path):
    df = spark.read.parquet(stored(spark, tmp_path))
    assert df.dtypes == [("the_key", "bigint"), ("t", "string"), ("id", "bigint")]
    assert df.where("id <> the_key + 1").isEmpty()


def test_store_refuses_to_overwrite(spark, tmp_path):
    path = stored(spark, tmp_path)
    with pytest.raises(AlreadyStored):
        store_dataset(spark.range(3), path)


@pytest.mark.parametrize(("offset", "limit", "ids"), [(1, 3, [1, 2, 3]), (999, 10, [999, 1000]), (1001, 5, []), (5, 0, [])])
def test_page_edges(spark, tmp_path, offset, limit, ids):
    assert [r.id for r in read_page(spark, stored(spark, tmp_path), offset, limit).collect()] == ids


def test_pages_together_are_the_dataset(spark, tmp_path):
    path = stored(spark, tmp_path, 95)
    seen = [r.id for start in range(1, 96, 10) for r in read_page(spark, path, start, 10).collect()]
    assert seen == list(range(1, 96))
    assert read_page(spark, path, 5, None).count() == 95


def test_page_filter_reaches_the_scan(spark, tmp_path):
    text = plan_text(read_page(spark, stored(spark, tmp_path), 10, 5))
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,10), LessThanOrEqual(id,14)]" in text


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, "x")], "id long, b int, c string")
    assert rows_as_json(page_rows(df, 1, 1)).first()[0] == '{"id":1,"b":null,"c":"x"}'


def test_fast_ids_are_unique(spark, tmp_path):
    df = spark.read.parquet(store_dataset_fast_id(spark.range(1000).toDF("k").repartition(4), str(tmp_path / "fast")))
    assert df.select("id").distinct().count() == 1000


def test_store_leaves_no_intermediate_copy(spark, tmp_path):
    from pathlib import Path

    from tessella.scratch import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("sorted-*"))
    stored(spark, tmp_path)
    assert set(folder.glob("sorted-*")) == before


@pytest.mark.parametrize(
    "cells",
    [
        ["concat(repeat('x', 200), id) t"],
        ["repeat('x', 200) t", "id n"],
        ["repeat('x', 5000) t", "cast(null as string) s", "concat(repeat('y', 300), id) u"],
        ["repeat('x', 200) t"],
        ["array(1, 2) a", "id n"],
        ["cast(repeat('z', 300) as binary) b", "id n"],
    ],
)
def test_long_common_beginnings_are_spread(spark, cells):
    df = spark.range(20000).repartition(8).selectExpr(*cells)
    numbered = add_row_id(df, partitions=8)
    sizes = [r["count"] for r in numbered.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20000 and len(sizes) >= 4 and max(sizes) < 8000
    assert numbered.select("id").distinct().count() == 20000
    ordered = numbered.orderBy(*df.columns, "id").select("id").limit(50).collect()
    assert [r.id for r in ordered] == list(range(1, 51))
