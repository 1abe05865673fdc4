import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.errors import UnsupportedColumn
from tessella.operators.correlation import correlation_pearson, correlation_spearman
from tessella.operators.distributions import histogram_categorical, histogram_numeric
from tessella.operators.profile import column_types, dataset_summary, missing_values, profile


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_nan_and_null_are_counted_apart(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "NaN"), (None, None), (3.0, "2")], "v double, s string")
    v, s = by_column(missing_values(df))["v"], by_column(missing_values(df))["s"]
    assert (v.nan_count, v.null_count, v.missing_count) == (1, 1, 2)
    assert (s.nan_count, s.null_count, s.missing_count) == (1, 1, 2)


def test_profile_of_every_flat_type(spark):
    df = spark.sql(
        """select * from values (true, date '2020-01-02', timestamp '2020-01-02 03:04:05', timestamp_ntz '2020-01-02 03:04:05', 1.50BD, 7, 'x'),
                                (false, date '2021-01-02', null, null, 2.50BD, null, '10') t(b, d, z, n, c, i, s)"""
    )
    got = by_column(profile(df))
    assert [got[c].type for c in df.columns] == ["boolean", "date", "timestamp", "timestamp_ntz", "decimal(3,2)", "int", "string"]
    assert (got["b"].min_str, got["b"].max_str, got["b"].mean) == ("false", "true", None)
    assert (got["d"].min_str, got["z"].max_str, got["z"].null_count) == ("2020-01-02", "2020-01-02 03:04:05", 1)
    assert (got["c"].mean, got["c"].min_num, got["c"].min_str) == (2.0, 1.5, "1.50")
    assert (got["i"]["count"], got["i"].null_count, got["i"].min_num) == (1, 1, 7.0)
    assert (got["s"].min_str, got["s"].max_str, got["s"].mean) == ("10", "x", 10.0)


def test_profile_matches_describe(spark):
    df = spark.range(1000).select((F.col("id") % 17).alias("a"), F.sin("id").alias("b"))
    want = {r["summary"]: r for r in df.describe().collect()}
    got = by_column(profile(df))
    for c in df.columns:
        assert got[c]["count"] == int(want["count"][c])
        for figure, name in (("mean", "mean"), ("stddev", "stddev"), ("min", "min_num"), ("max", "max_num")):
            assert got[c][name] == pytest.approx(float(want[figure][c]))


def test_wide_frames_take_several_passes(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c {i}.x") for i in range(120)])
    got = profile(df).collect()
    assert len(got) == 120 and {r["position"]: r.max_num for r in got}[119] == 9 * 119


def test_nested_columns_are_rejected(spark):
    with pytest.raises(UnsupportedColumn, match="a array<int>"):
        profile(spark.sql("select array(1) a, 1 b"))


def test_empty_frame_profile(spark):
    row = profile(spark.createDataFrame([], "a double")).first()
    assert (row["count"], row.null_count, row.mean) == (0, 0, None)


def test_types_and_summary(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert [(r["column"], r.type, r["count"]) for r in column_types(df).collect()] == [("a", "int", 1), ("b", "string", 0)]
    assert tuple(dataset_summary(df, ["x", "y"], ["x.a=y.a"]).first()) == (1, 2, "x,y", "x.a=y.a")


def test_bins_add_up_and_edges_close(spark):
    values = [0.0, 10.0, 9.999, 5.0, None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v, 3, None) for v in values], "v double, same int, none double")
    rows = histogram_numeric(df).collect()
    v = {r.bin: r["count"] for r in rows if r["column"] == "v"}
    assert v == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 3}
    assert {r.bin: r["count"] for r in rows if r["column"] == "same"}[0] == 8
    assert not [r for r in rows if r["column"] == "none"]


def test_most_frequent_values(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] * 3 + [("c",)] + [(None,)], "s string")
    got = [(r.value, r["count"], r.position) for r in histogram_categorical(df, top=2).orderBy("position").collect()]
    assert got == [("a", 3, 1), ("b", 3, 2), (None, 1, 3)]


def test_most_frequent_values_beyond_any_partial_limit(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id") % 2500).alias("s"))
    found = histogram_categorical(df, top=2000)
    assert found.where("value is not null").count() == 2000
    rest = found.where("value is null").first()
    assert (rest["count"], rest["values"], rest.position) == (1000, 500, 2001)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_spearman_with_ties_and_a_hot_value(spark, broadcast_bytes):
    rng = random.Random(3)
    rows = [(0.0 if i % 3 == 0 else rng.gauss(0, 1), float(rng.randint(0, 5)), rng.random()) for i in range(4000)]
    rows += [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).dropna().corr("spearman")
    for r in correlation_spearman(df, broadcast_bytes=broadcast_bytes).collect():
        assert r.value == pytest.approx(want.loc[r.x, r.y], abs=1e-12)


def test_pearson_is_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, 4.5), (3.0, None), (4.0, 7.0), (float("nan"), 9.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = pd.DataFrame(rows, columns=["a", "b"]).corr().loc["a", "b"]
    assert correlation_pearson(df).first().value == pytest.approx(want)


def test_constant_column_has_no_rank_correlation(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.lit(1).alias("b"))
    value = correlation_spearman(df).first().value
    assert value is None or math.isnan(value)


def test_wide_merged_frames_are_joined_once(spark):
    left = spark.range(100).select("id", *[(F.col("id") * i).alias(f"a{i}") for i in range(30)])
    right = spark.range(100).select("id", *[(F.col("id") + i).alias(f"b{i}") for i in range(30)])
    found = profile(left.join(right.hint("merge"), "id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 61
    assert found.where("column = 'b3'").first().max_num == 102.0


def test_many_pairs_take_several_passes(spark):
    df = spark.range(50).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(31)])
    got = {(r.x, r.y): r.value for r in correlation_pearson(df).collect()}
    want = df.toPandas().corr()
    assert len(got) == 31 * 30 // 2
    assert all(v == pytest.approx(want.loc[x, y], abs=1e-9) for (x, y), v in got.items() if v is not None and v == v)
