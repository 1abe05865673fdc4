import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import run_plan_text
from tessella.errors import TessellaError
from tessella.operators.evaluate import (
    actual_vs_predicted,
    auc,
    confusion_matrix,
    gains_lift,
    metrics_classification,
    metrics_multiclass,
    metrics_regression,
    roc_curve,
)
from tessella.operators.features import CLASSIFICATION, REGRESSION
from tessella.operators.split import split_frame, with_folds, with_split
from tessella.plans.report import leaderboard, metrics_of, report, store_report
from tessella.plans.score import score, score_axis, score_tables
from tessella.plans.train import (
    LABEL,
    Settings,
    cross_validation_metrics,
    estimator,
    fit_ols,
    label_index,
    labelled,
    load_model,
    rotation,
    save_model,
    train,
    train_family,
    train_stacked,
)

SMALL = Settings(trees=4, depth=3, rounds=3, hidden=4, iterations=20)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((i, a, b, 3 * a - b + rng.gauss(0, 0.05), "yes" if a + b > 0 else "no", "xyz"[int((a + 1) * 1.499)]))
    return spark.createDataFrame(rows, "k int, a double, b double, y double, c string, m string").cache()


def test_split_is_complete_disjoint_and_stable(data):
    train_part, holdout = split_frame(data, "k", 3)
    again = split_frame(data.repartition(7), "k", 3)[1]
    ids = {r.k for r in holdout.collect()}
    assert ids == {r.k for r in again.collect()}
    assert train_part.count() + holdout.count() == 600 and not ids & {r.k for r in train_part.collect()}
    assert 10 < len(ids) < 60
    assert ids != {r.k for r in split_frame(data, "k", 4)[1].collect()}


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None,), (1,)], "k int")
    parts = split_frame(df, "k")
    assert parts[0].count() + parts[1].count() == 2
    assert with_folds(df, "k", 5).where("fold is null").isEmpty()


def test_rotation():
    assert rotation(REGRESSION, 6) == ["DRF", "GLM", "XGBoost", "GBM", "DRF", "GLM"]
    assert rotation(CLASSIFICATION, 5)[-1] == "DeepLearning"
    with pytest.raises(TessellaError):
        estimator("DeepLearning", REGRESSION, 3)


def test_regression_rotation_and_reports(spark, data, tmp_path):
    frame = with_split(labelled(data, "y", REGRESSION), "k", 1)
    models = train(data, "y", ["a", "b"], REGRESSION, settings=SMALL)
    board = leaderboard(models, frame).collect()
    assert {(r.model, r.split) for r in board} == {(m.name, s) for m in models for s in ("train", "holdout")}
    glm = {(r.split, r.metric): r.value for r in board if r.model == "GLM_2"}
    assert glm["train", "Root Mean Square Error"] < 0.1
    for m in models:
        found = report(m, frame, "k", 0)
        curves = {r.curve for r in found.curves.select("curve").distinct().collect()}
        wanted = {"Actual vs Predictions", "Loss vs Iterations"} | ({"Variable Importance"} if m.family != "GLM" else set())
        assert curves == wanted
        store_report(found, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/metrics")).count() == len(board)


def test_loss_curves_match_the_model(data):
    frame = with_split(labelled(data, "y", REGRESSION), "k", 1)
    for m in train(data, "y", ["a", "b"], REGRESSION, settings=SMALL):
        if m.family == "GLM":
            continue
        last = report(m, frame, "k", 0).curves.where("curve = 'Loss vs Iterations' and series = 'training'").orderBy(F.desc("position")).first()
        rmse = metrics_of(m, frame).where("split = 'train' and metric = 'Root Mean Square Error'").first().value
        assert last.y == pytest.approx(rmse, rel=1e-9)


def test_class_loss_curves_match_the_model(data):
    index = label_index(data, "c")
    frame = with_split(labelled(data, "c", CLASSIFICATION, index), "k", 1)
    for m in train(data, "c", ["a", "b"], CLASSIFICATION, settings=SMALL):
        if m.family not in ("DRF", "GBM", "XGBoost"):
            continue
        last = report(m, frame, "k", 0).curves.where("curve = 'Loss vs trees' and series = 'validation'").orderBy(F.desc("position")).first()
        value = metrics_of(m, frame).where("split = 'holdout' and metric = 'logloss'").first().value
        assert last.y == pytest.approx(value, rel=1e-6)


def test_two_class_reports(data):
    index = label_index(data, "c")
    frame = with_split(labelled(data, "c", CLASSIFICATION, index), "k", 1)
    for m in train(data, "c", ["a", "b"], CLASSIFICATION, settings=SMALL):
        found = report(m, frame, "k", 0)
        curves = {r.curve for r in found.curves.select("curve").distinct().collect()}
        extra = {"Loss vs trees"} if m.family in ("DRF", "GBM", "XGBoost") else {"Deviance vs Iter"}
        extra |= {"Variable Importance"} if m.family != "GLM" else set()
        assert curves == {"confusion_matrix", "lift_gain", "roc"} | extra
        matrix = found.curves.where("curve = 'confusion_matrix'").agg(F.sum("y")).first()[0]
        assert matrix == frame.where("split = 'holdout'").count()
        values = {(r.split, r.metric): r.value for r in found.metrics.collect()}
        assert values["train", "auc"] > 0.8


def test_three_classes(data):
    index = label_index(data, "m")
    frame = with_split(labelled(data, "m", CLASSIFICATION, index), "k", 1)
    for m in train(data, "m", ["a", "b"], CLASSIFICATION, settings=SMALL):
        found = report(m, frame, "k", 0).curves
        curves = {r.curve for r in found.select("curve").distinct().collect()}
        assert curves == {"confusion_matrix", "roc", "lift_gain"} | (
            {"Deviance vs Iter"} if m.family in ("GLM", "DeepLearning") else {"Loss vs trees"}
        ) | ({"Variable Importance"} if m.family != "GLM" else set())
        assert {r.label for r in found.where("curve in ('roc', 'lift_gain')").select("label").distinct().collect()} == set("xyz")
        named = {"accuracy", "mean_per_class_error", "precision", "recall", "f1"}
        assert {r.metric for r in metrics_of(m, frame).collect()} - {"logloss"} == named
        matrix = report(m, frame, "k", 0).curves.where("curve = 'confusion_matrix'").select("label").distinct().collect()
        assert {r.label for r in matrix} == set("xyz")
    scored = score(m.model, frame, m.classes)
    assert {r.predicted_class for r in scored.select("predicted_class").distinct().collect()} <= set("xyz")
    assert {"p_x", "p_y", "p_z"} <= set(scored.columns) and "features" not in scored.columns


def test_cross_validation_scores_every_row_once(data):
    frame = labelled(data, "y", REGRESSION)
    got = {r.metric: r.mean for r in cross_validation_metrics(frame, "k", ["a", "b"], "GLM", REGRESSION, 3, settings=SMALL).collect()}
    assert got["Root Mean Square Error"] < 0.1


def test_reloaded_model_predicts_the_same(data, tmp_path):
    m = train(data, "y", ["a", "b"], REGRESSION, max_models=1, settings=SMALL)[0]
    loaded = load_model(save_model(m, str(tmp_path / "m")))
    a = [r.prediction for r in m.score(data).orderBy("k").collect()]
    assert a == [r.prediction for r in loaded.transform(data).orderBy("k").collect()]


def test_batch_scoring_and_axis(spark, data):
    from tessella.operators.features import FeatureSpec, fit_features
    from tessella.operators.merge import Link, merge_two

    left, right = data.select("k", "a"), data.select(F.col("k").alias("j"), "y", F.expr("timestamp '2020-01-01' + make_interval(0,0,0,k)").alias("t"))
    merged = merge_two(left, right, [("k", "j")])
    prepare = fit_features(merged, FeatureSpec(columns=("a",)))
    model = fit_ols(prepare.transform(merged), "y", ["a"]).model
    scored = score_tables({"l": left, "r": right.drop("y")}, [Link.of("l", "r", ("k", "j")).record()], prepare, model)
    assert scored.count() == 600 and "prediction" in scored.columns
    assert score_axis(scored, "t").orderBy("x").first().x == "2020-01-01 00:00:00"
    assert score_axis(scored.withColumnRenamed("k_j", "id"), None).agg(F.min("x")).first()[0] == -1


def test_scoring_accepts_a_stream(spark, data, tmp_path):
    model = fit_ols(data, "y", ["a"]).model
    path = str(tmp_path / "in")
    data.select("k", "a").write.parquet(path)
    stream = spark.readStream.schema("k int, a double").parquet(path)
    out = score(model, stream)
    assert out.isStreaming
    query = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("scored").count() == 600


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (5.0, None)], "y double, p double")
    got = {r.metric: r.value for r in metrics_regression(df, "y", "p").collect()}
    assert got["Mean Square Error"] == 0.5 and got["Mean Absolute Error"] == 0.5 and got["Mean Residual Deviance"] == 0.5
    assert got["Root Mean Square Algorithm Error"] == pytest.approx(math.log(1.5) / math.sqrt(2))


def test_undefined_logarithm_shows(spark):
    df = spark.createDataFrame([(1.0, -2.0), (3.0, 3.0)], "y double, p double")
    got = {r.metric: r.value for r in metrics_regression(df, "y", "p").collect()}
    assert math.isnan(got["Root Mean Square Algorithm Error"])


@pytest.fixture(scope="module")
def binary(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)]
    return rows, spark.createDataFrame([(y, q, int(q > 0.5)) for y, q in rows], "y int, q double, p int")


def test_auc_equals_the_pairwise_definition(binary):
    rows, df = binary
    pos, neg = [q for y, q in rows if y], [q for y, q in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc(df, "y", "q").first()[0] == pytest.approx(want)
    got = {r.metric: r.value for r in metrics_classification(df, "y", "p", "q").collect()}
    assert got["auc"] == pytest.approx(want)
    eps = 1e-15
    loss = [-math.log(min(max(q, eps), 1 - eps) if y else 1 - min(max(q, eps), 1 - eps)) for y, q in rows]
    assert got["logloss"] == pytest.approx(sum(loss) / len(loss))
    assert got["accuracy"] == pytest.approx(sum(y == (q > 0.5) for y, q in rows) / len(rows))


def test_incomplete_rows_do_not_count(spark, binary):
    rows, df = binary
    more = df.union(spark.createDataFrame([(None, 0.5, 1), (1, None, 1), (1, 0.2, None)], df.schema))
    a = {r.metric: r.value for r in metrics_classification(df, "y", "p", "q").collect()}
    b = {r.metric: r.value for r in metrics_classification(more, "y", "p", "q").collect()}
    assert a == pytest.approx(b)


def test_one_class_only_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 0)], "y int, q double, p int")
    got = {r.metric: r.value for r in metrics_classification(df, "y", "p", "q").collect()}
    assert got["auc"] is None and got["recall"] == 0.5


def test_gains_and_roc_end_at_one(binary):
    _, df = binary
    last = gains_lift(df, "y", "q").orderBy(F.desc("group")).first()
    assert (last.cumulative_capture_rate, last.cumulative_data_fraction, last.cumulative_lift) == pytest.approx((1, 1, 1))
    end = roc_curve(df, "y", "q").orderBy("threshold").first()
    assert (end.fpr, end.tpr) == (1.0, 1.0)


def test_confusion_and_multiclass(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "y string, p string")
    assert {(r.label, r.prediction): r["count"] for r in confusion_matrix(df, "y", "p").collect()} == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 2}
    got = {r.metric: r.value for r in metrics_multiclass(df, "y", "p").collect()}
    assert got == pytest.approx({"accuracy": 0.75, "mean_per_class_error": 0.25, "precision": 5 / 6, "recall": 0.75, "f1": (2 / 3 + 4 / 5) / 2})
    with_p = df.withColumn("q", F.when(F.col("p") == F.col("y"), 0.5).otherwise(0.25))
    assert {r.metric: r.value for r in metrics_multiclass(with_p, "y", "p", (), "q").collect()}["logloss"] == pytest.approx((3 * math.log(2) + math.log(4)) / 4)


def test_actual_vs_predicted(spark):
    df = spark.createDataFrame([(i, None if i == 0 else float(i), float("nan") if i == 1 else 2.0 * i) for i in range(500)], "k int, y double, p double")
    rows = actual_vs_predicted(df.repartition(4), "k", "y", "p").orderBy("x").collect()
    assert len(rows) == 300 and [r.x for r in rows] == list(range(300))
    assert (rows[0].y_actual, rows[1].y_prediction, rows[299].y_prediction) == (0.0, 0.0, 598.0)


def test_label_is_indexed_by_frequency(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    assert [r[LABEL] for r in labelled(df, "c", CLASSIFICATION, label_index(df, "c")).collect()] == [0.0, 1.0, 0.0]


def test_classes_are_bounded_by_their_bytes(spark):
    df = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id")).alias("t"))
    assert len(label_index(df, "t").labels) == 20_000
    with pytest.raises(TessellaError):
        label_index(df.select(F.concat(F.repeat(F.lit("x"), F.lit(1000)), "t").alias("t")), "t")


def test_stacked_models(data, tmp_path):
    for target, problem, families in (("y", REGRESSION, ("DRF", "GLM", "GBM")), ("c", CLASSIFICATION, ("DRF", "GLM")), ("m", CLASSIFICATION, ("DRF", "GLM"))):
        index = label_index(data, target) if problem == CLASSIFICATION else None
        classes = list(index.labels) if index else []
        frame = with_split(labelled(data, target, problem, index), "k", 1)
        m = train_stacked(frame.where("split = 'train'"), "k", ["a", "b"], problem, families, 3, classes, SMALL)
        found = report(m, frame, "k", 0)
        curves = {r.curve for r in found.curves.select("curve").distinct().collect()}
        wanted = {"y": {"Actual vs Predictions"}, "c": {"confusion_matrix", "lift_gain", "roc"}, "m": {"confusion_matrix", "lift_gain", "roc"}}
        assert curves == wanted[target]
        values = {(r.split, r.metric): r.value for r in found.metrics.collect()}
        if target == "y":
            assert values["holdout", "Root Mean Square Error"] < 0.2
            loaded = load_model(save_model(m, str(tmp_path / "stacked")))
            assert loaded.transform(data).select("k", "prediction").exceptAll(m.score(data).select("k", "prediction")).isEmpty()
        else:
            assert values["holdout", "accuracy"] > 0.7


def test_report_with_cross_validation(data):
    index = label_index(data, "c")
    frame = with_split(labelled(data, "c", CLASSIFICATION, index), "k", 1)
    m = train(data, "c", ["a", "b"], CLASSIFICATION, max_models=2, settings=SMALL)[1]
    splits = {r.split for r in report(m, frame, "k", 2, Settings(iterations=20)).metrics.select("split").distinct().collect()}
    assert splits == {"train", "holdout", "cross_validation"}


def test_stacked_cross_validation(data):
    frame = labelled(data, "y", REGRESSION)
    got = cross_validation_metrics(frame, "k", ["a", "b"], "StackedEnsemble", REGRESSION, 2, settings=SMALL).collect()
    assert {r.metric: r.mean for r in got}["Root Mean Square Error"] < 0.2


def rare(spark):
    """A positive per thousand, scored above all negatives, everything below one in two thousand."""
    rows = [(i, int(i % 1000 == 0), 4e-4 if i % 1000 == 0 else 2e-4 * i / 10_000) for i in range(10_000)]
    return spark.createDataFrame(rows, "k int, y int, q double").repartition(5)


def test_small_scores_rank_exactly(spark):
    df = rare(spark)
    assert auc(df, "y", "q").first().auc == 1.0
    found = {r.metric: r.value for r in metrics_classification(df.withColumn("p", F.lit(0)), "y", "p", "q").collect()}
    assert found["auc"] == 1.0
    assert roc_curve(df, "y", "q").count() == 9991
    assert gains_lift(df, "y", "q").where("`group` = 1").first().cumulative_capture_rate == 1.0


def test_scores_outside_0_to_1_and_missing_ones(spark):
    rows = [(1, 5.0, "a"), (0, -3.0, "a"), (1, -3.0, "a"), (0, -9.5, "a"), (1, None, "a"), (0, float("nan"), "a"), (None, 2.0, "a"), (1, 1.0, None), (0, 2.0, None)]
    df = spark.createDataFrame(rows, "y int, q double, g string")
    by = {r.g: r.auc for r in auc(df, "y", "q", ["g"]).collect()}
    assert by == {"a": 0.875, None: 0.0}


def test_scoring_happens_once(spark, data):
    """No filter on the score reaches below the model, and no window holds all scores."""
    model = fit_ols(data, "y", ["a", "b"])
    scored = model.score(data).withColumn("hit", (F.col("y") > 0).cast("int"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    roc = roc_curve(scored.withColumn("q", seen("prediction")), "hit", "q")
    assert roc.count() > 500 and calls.value == 600
    lines = [x.strip() for x in run_plan_text(roc).splitlines()]
    alone = [lines[i + 1] for i, x in enumerate(lines[:-1]) if "SinglePartition" in x]
    assert all("partial_sum" in x for x in alone)


def test_positive_class_is_named_and_does_not_follow_the_counts(data):
    index = label_index(data, "c")
    frame = with_split(labelled(data, "c", CLASSIFICATION, index), "k", 1)
    figures = {}
    for positive in (None, "yes", "no"):
        m = train_family(frame, ["a", "b"], "GLM", CLASSIFICATION, list(index.labels), SMALL, positive=positive)
        found = {r.metric: r for r in metrics_of(m, frame).where("split = 'train'").collect()}
        assert {r.positive for r in found.values()} == {positive or "yes"}
        figures[positive] = (found["recall"].value, found["auc"].value)
    assert figures[None] == figures["yes"] and figures["yes"][1] == pytest.approx(figures["no"][1])
    with pytest.raises(TessellaError):
        train_family(frame, ["a", "b"], "GLM", CLASSIFICATION, list(index.labels), SMALL, positive="maybe")
