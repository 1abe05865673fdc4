import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessella.errors import NameCollision
from tessella.functions.cells import date_parts, parse_timestamp, reading_sql, timestamps_to_string, zero_if_missing
from tessella.functions.names import dataset_names, key_name, rename_spaces
from tessella.operators.projections import cast_to_double, drop_empty_columns, drop_missing_target


def test_dataset_names_replace_runs_and_add_suffix():
    assert dataset_names(["o_orderkey", "unit price %", "x"], 1) == ["oaorderkey_1", "unitapricea_1", "x_1"]
    assert dataset_names(["o_orderkey"], 2, "") == ["oorderkey_2"]


def test_colliding_names_raise():
    with pytest.raises(NameCollision):
        dataset_names(["a b", "a_b"], 1)
    with pytest.raises(NameCollision):
        dataset_names(["Price", "price"], 1)


def test_key_name():
    assert key_name("a", "a") == "a"
    assert key_name("a b", "c-d") == "ab_cd"


def test_rename_spaces(spark):
    assert rename_spaces(spark.createDataFrame([(1, 2)], ["a b", "c"])).columns == ["a_b", "c"]


def test_unparseable_dates_become_null(spark):
    df = spark.createDataFrame([("31/12/2020",), ("bad",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_timestamp(df, "t", "dd/MM/yyyy")).collect()]
    assert got == [dt.datetime(2020, 12, 31), None, None]


def test_time_types_need_no_pattern_and_lose_fractions(spark):
    df = spark.sql("select timestamp_ntz '2020-02-01 10:11:12.5' n, timestamp '2020-02-01 10:11:12.5' z, date '2020-02-01' d")
    for c, value in [("n", dt.datetime(2020, 2, 1, 10, 11, 12)), ("z", dt.datetime(2020, 2, 1, 10, 11, 12)), ("d", dt.datetime(2020, 2, 1))]:
        assert df.select(parse_timestamp(df, c, "ignored")).first()[0] == value


def test_sunday_is_day_one(spark):
    df = spark.sql("select timestamp '2024-06-02 03:04:05' t")
    assert tuple(df.select(*date_parts(F.col("t"), "t")).first()) == (2024, 6, 2, 1, 3, 4, 5)


def test_timestamps_to_string_covers_all_time_types(spark):
    df = spark.sql("select timestamp_ntz '2020-01-02 00:00:00' n, date '2020-01-02' d, 1 x")
    assert dict(timestamps_to_string(df).dtypes) == {"n": "string", "d": "string", "x": "int"}


def test_cast_to_double_never_raises(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in cast_to_double(df, "v").collect()] == [1.5, None, None]


def test_reading_accepts_what_a_cast_accepts(spark):
    texts = ["1", " -2.5e3 ", "+.5", "5.", "NaN", "inf", "-Infinity", "1d", "0x1p3", "1997-10-31", "N", "", "1e", "--1", "1 2", "naN\n", "."]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    rows = df.select("v", F.expr(reading_sql("v", df.schema["v"].dataType)).alias("a"), F.col("v").try_cast("double").alias("b")).collect()
    for r in rows:
        same = (r.a is None and r.b is None) or r.a == r.b or (math.isnan(r.a) and math.isnan(r.b))
        assert same, r


def test_missing_to_zero_keeps_infinities(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,)], "v double")
    assert [r[0] for r in df.select(zero_if_missing(F.col("v"))).collect()] == [0.0, 0.0, float("inf"), 2.0]


def test_drop_missing_target_drops_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "v double")
    assert drop_missing_target(df, "v").count() == 1


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan"), None), (2, None, float("nan"), "x")], "a int, b string, c double, d string")
    assert drop_empty_columns(df).columns == ["a", "d"]
