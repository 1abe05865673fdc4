import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tessella.errors import UnsupportedColumn
from tessella.operators.features import (
    CLASSIFICATION,
    FeatureSpec,
    build_pipeline,
    feature_names,
    fit_features,
    index_categories,
    load_features,
    save_features,
    split_date,
    training_frame,
)
from tessella.operators.indexing import TableIndexer

ROWS = [("b", 1.0, 1, True, "01/02/2020"), ("a", None, 2, False, "bad"), ("a", 3.0, None, None, None), ("b", float("nan"), 4, True, "03/02/2020"), (None, 5.0, 5, True, "04/02/2020")]
SCHEMA = "c string, v double, n int, f boolean, t string"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


SPEC = FeatureSpec(columns=("c", "v", "n", "f", "t"), time=("t", "dd/MM/yyyy"))


def test_all_steps(frame):
    model = fit_features(frame, SPEC)
    out = model.transform(frame)
    assert sorted(out.columns) == sorted(feature_names(frame, SPEC))
    assert set(dict(out.dtypes).values()) == {"double"}
    rows = out.collect()
    assert [r.cIndex for r in rows] == [1.0, 0.0, 0.0, 1.0, 2.0]  # a and b tie, a comes first; null is last
    assert [r.v for r in rows] == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert [r.n for r in rows] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r.f for r in rows] == [1.0, 0.0, 0.75, 1.0, 1.0]
    assert [r.t_day for r in rows] == [1.0, None, None, 3.0, 4.0]


def test_dates_can_be_imputed(frame):
    spec = FeatureSpec(columns=("t",), time=("t", "dd/MM/yyyy"), impute_dates=True)
    assert [r.t_year for r in fit_features(frame, spec).transform(frame).collect()] == [2020.0] * 5


def test_corrected_type_decides_both_cast_and_index(spark):
    df = spark.createDataFrame([("1", 5), ("x", 6), ("2", 5)], "s string, k int")
    spec = FeatureSpec(columns=("s", "k"), corrected_types={"s": "double", "k": "string"})
    out = fit_features(df, spec).transform(df)
    assert sorted(out.columns) == ["kIndex", "s"]
    assert [r.s for r in out.collect()] == [1.0, 1.5, 2.0]
    assert [r.kIndex for r in out.collect()] == [0.0, 1.0, 0.0]


def test_nested_features_are_rejected(frame):
    with pytest.raises(UnsupportedColumn):
        fit_features(frame.withColumn("l", F.array("n")), FeatureSpec(columns=("l",)))


def test_building_twice_gives_the_same_stages(frame):
    first, second = build_pipeline(frame, SPEC), build_pipeline(frame, SPEC)
    assert len(first.getStages()) == len(second.getStages())


def test_unseen_values_get_the_last_index_and_nothing_is_learned_from_new_data(spark, frame, tmp_path):
    path = save_features(fit_features(frame, SPEC), str(tmp_path / "p"))
    new = spark.createDataFrame([("new", None, None, None, "05/02/2020"), ("new", 100.0, 9, True, None)], SCHEMA)
    rows = load_features(path).transform(new).collect()
    assert [r.cIndex for r in rows] == [2.0, 2.0]
    assert [r.v for r in rows] == [3.0, 100.0]
    live = fit_features(frame, SPEC)
    assert rows == live.transform(new).select(*load_features(path).transform(new).columns).collect()


def test_target_is_not_needed_for_scoring(spark, frame):
    spec = FeatureSpec(columns=("c", "n"), target="v")
    model = training_frame(frame, spec).prepare
    assert "v" not in model.transform(frame.drop("v")).columns


def test_time_columns_of_time_types(spark):
    df = spark.sql("select timestamp_ntz '2020-05-06 07:08:09' t, 1 x")
    out = Pipeline(stages=split_date(df, "t", "ignored")).fit(df).transform(df)
    assert out.columns == ["x", *[f"t_{p}" for p in ("year", "month", "day", "dayofweek", "hour", "minute", "second")]]
    assert tuple(out.first())[1:] == (2020, 5, 6, 4, 7, 8, 9)


def test_table_index_equals_string_indexer(spark, tmp_path):
    values = [None if i % 11 == 0 else "hot" if i % 3 == 0 else f"v{i % 700}" for i in range(6000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, s string").repartition(6)
    new = df.union(spark.createDataFrame([(-1, "unseen")], "k int, s string"))
    want = StringIndexer(inputCol="s", outputCol="o", handleInvalid="keep").fit(df).transform(new).orderBy("k").collect()
    for limit in (0, 1 << 20):
        model = TableIndexer(inputCol="s", outputCol="o", broadcastBytes=limit).fit(df)
        assert model.transform(new).select("k", "s", "o").orderBy("k").collect() == want
        path = str(tmp_path / f"m{limit}")
        fitted = Pipeline(stages=[TableIndexer(inputCol="s", outputCol="o", broadcastBytes=limit)]).fit(df)
        fitted.write().save(path)
        assert load_features(path).transform(new).select("k", "s", "o").orderBy("k").collect() == want


def test_long_label_lists_use_the_table(frame):
    kinds = [type(s).__name__ for s in index_categories(frame, ["c"], 1)]
    assert kinds[0] == "TableIndexer"
    assert type(index_categories(frame, ["c"], 100)[0]).__name__ == "StringIndexer"


def test_training_frame(spark, frame):
    df = frame.withColumn("id", F.monotonically_increasing_id()).withColumn("empty", F.lit(None).cast("string"))
    spec = FeatureSpec(columns=("id", "c", "n", "empty"), target="v")
    found = training_frame(df, spec, drop_empty=True, keep=["t"])
    assert found.features == ["n", "cIndex"]
    assert sorted(found.frame.columns) == ["cIndex", "n", "t", "v"]
    assert sorted(r.v for r in found.frame.collect()) == [1.0, 3.0, 5.0]


def test_class_target_stays_text(spark, frame):
    found = training_frame(frame, FeatureSpec(columns=("n",), target="c"), CLASSIFICATION)
    assert sorted(r.c for r in found.frame.collect()) == ["a", "a", "b", "b"]


def test_nominal_keeps_category_metadata(frame):
    spec = FeatureSpec(columns=("c", "n"), nominal=True)
    kept = fit_features(frame, spec).transform(frame).schema["cIndex"].metadata
    plain = fit_features(frame, FeatureSpec(columns=("c", "n"))).transform(frame).schema["cIndex"].metadata
    assert kept["ml_attr"]["type"] == "nominal" and not plain
    table = fit_features(frame, FeatureSpec(columns=("c", "n"), nominal=True, label_bytes=0)).transform(frame)
    assert table.schema["cIndex"].metadata == kept and "vals" not in kept["ml_attr"]
    assert not math.isnan(fit_features(frame, spec).transform(frame).first().n)
