"""Fits within a budget, pages from their files, and running totals by window or sorted table."""

import time
from dataclasses import replace
from threading import Event

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate
from tessella.operators.curves import deviance_by_iteration, last_stage, permutation_importance, stages, staged_losses
from tessella.operators.features import CLASSIFICATION, REGRESSION
from tessella.plans.train import (
    FEATURES,
    LABEL,
    PROBABILITY,
    SCALED,
    Settings,
    assemble,
    deviance_curve,
    estimator,
    importance_by_permutation,
    train,
    train_family,
    within_budget,
)
from tessella.sources import store
from tessella.sources.store import read_page, store_dataset, write_manifest

SMALL = Settings(trees=3, rounds=3, depth=3, iterations=12)


@pytest.fixture(scope="module")
def rows(spark):
    x, z = F.col("id") % 7, F.col("id") % 11
    df = spark.range(400).select(
        "id", x.cast("double").alias("x"), z.cast("double").alias("z"), F.lit(2.0).alias("same"),
        (3.0 * x + F.sin("id")).alias("y"), F.when(x + z < 5, "a").when(x + z < 10, "b").otherwise("c").alias("kind"),
    )
    return df.cache()


# -- budget


def running_jobs(spark):
    return list(spark.sparkContext.statusTracker().getActiveJobsIds())


def test_models_come_in_slot_order(spark, rows):
    told = []
    found = train(rows, "y", ["x", "z"], REGRESSION, settings=SMALL, parallel=3, progress=told.append)
    assert [m.name for m in found] == ["DRF_1", "GLM_2", "XGBoost_3", "GBM_4"]
    assert sorted(p.finished for p in told) == [1, 2, 3, 4] and all(p.of == 4 and p.left >= 0 for p in told)
    assert told[-1].left == 0
    one = train(rows, "y", ["x", "z"], REGRESSION, settings=SMALL)
    same = [a.score(rows).agg(F.sum("prediction")).first()[0] for a in (found[1], one[1])]
    assert same[0] == pytest.approx(same[1], rel=1e-6)


def test_a_stopped_run_keeps_what_is_finished(spark, rows):
    stop = Event()

    def fit(i):
        if i == 1:  # a job that takes for ever
            spark.range(0, 1 << 40, 1, 2).where("hash(id, id + 1) = 1 and sha2(string(id), 512) = 'x'").count()
        return train_family(rows.withColumn(LABEL, F.col("y")), ["x"], "GLM", REGRESSION, settings=SMALL, name=str(i))

    found = within_budget(spark, fit, 2, parallel=2, stop=stop, progress=lambda p: stop.set())
    assert [m.name for m in found] == ["0"]
    time.sleep(0.5)
    assert running_jobs(spark) == []
    began = time.monotonic()
    found = within_budget(spark, lambda i: fit(1 - i), 2, seconds=2.0)
    assert found == [] and time.monotonic() - began < 20
    time.sleep(0.5)
    assert running_jobs(spark) == []


def test_an_error_ends_the_run(spark):
    def fit(i):
        raise ValueError(str(i))

    with pytest.raises(ValueError):
        within_budget(spark, fit, 3, parallel=2)


# -- pages


def test_a_page_opens_its_files_only(spark, tmp_path, rows):
    path = store_dataset(rows.select("id", "kind").withColumnRenamed("id", "k"), str(tmp_path / "d"), partitions=8)
    assert spark.read.parquet(path).count() == 400
    whole = [tuple(r) for r in store.page_rows(spark.read.parquet(path)).orderBy("id").collect()]
    for offset, limit, files in ((1, 5, 1), (1, 400, None), (396, 50, 1), (1000, 3, 1), (17, 0, None)):
        page = read_page(spark, path, offset, limit)
        assert [tuple(r) for r in page.collect()] == [r for r in whole if offset <= r[-1] < offset + limit]
        if files:
            assert len(page.inputFiles()) == files
    zones = spark.read.parquet(f"{path}/{store.MANIFEST}").orderBy("first").collect()
    border = zones[2]["last"]
    two = read_page(spark, path, border, 2)
    held = {z["file"] for z in zones if z["first"] <= border + 1 and z["last"] >= border}
    assert [r["id"] for r in two.collect()] == [border, border + 1] and len(two.inputFiles()) == len(held) <= 2
    assert sum(z["last"] - z["first"] + 1 for z in zones) == 400
    assert [r[-1] for r in read_page(spark, path).orderBy("id").collect()] == list(range(1, 401))


def test_pages_without_or_beyond_the_manifest(spark, tmp_path, rows, monkeypatch):
    plain = str(tmp_path / "plain")
    rows.select("id").write.parquet(plain)
    assert [r[0] for r in read_page(spark, plain, 5, 2).collect()] == [5, 6]
    write_manifest(spark, plain)
    monkeypatch.setattr(store, "PAGE_FILES", 0)
    assert [r[0] for r in read_page(spark, plain, 5, 2).collect()] == [5, 6]
    empty = store_dataset(rows.limit(0).select("kind"), str(tmp_path / "empty"))
    assert read_page(spark, empty, 1, 10).columns == ["kind", "id"] and read_page(spark, empty, 1, 10).count() == 0


# -- running totals


def test_window_and_sorted_table_agree(spark, rows, monkeypatch):
    scored = rows.select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("p"), (F.sin("id") * 10).alias("s"),
                         (F.col("id") % 4).alias("g"))
    scored = scored.unionByName(spark.createDataFrame([(1, 0, None, 0), (0, 1, float("nan"), 1), (None, 1, 0.5, 2), (1, 1, 0.5, None)], scored.schema))

    def figures():
        return [
            sorted(map(tuple, df.collect()), key=repr)
            for df in (
                evaluate.roc_curve(scored, "y", "s"), evaluate.gains_lift(scored, "y", "s"), evaluate.auc(scored, "y", "s", ["g"]),
                evaluate.gains_lift(scored, "y", "s", 4, ["g"]), evaluate.roc_curve(scored, "y", "s", ["g"]),
            )
        ]

    few = figures()
    monkeypatch.setattr(evaluate, "FEW_SCORES", 0)
    assert figures() == few


# -- deviance by iteration


def prepared(rows, problem):
    label = F.col("y") if problem == REGRESSION else F.col("id") % 5 % 3
    stages_ = assemble(["x", "z"])
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler

    scale = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True)
    frame = rows.withColumn(LABEL, label.cast("double"))
    return Pipeline(stages=[*stages_, scale]).fit(frame).transform(frame)


@pytest.mark.parametrize("family, problem", [("GLM", REGRESSION), ("GLM", CLASSIFICATION), ("DeepLearning", CLASSIFICATION)])
def test_training_deviance_is_the_optimisers_objective(rows, family, problem):
    frame = prepared(rows, problem)

    def fit(iterations):
        return estimator(family, problem, 2, 3, replace(SMALL, iterations=iterations)).fit(frame)

    curve = deviance_by_iteration(fit, 12, frame, frame.where("id < 50"), LABEL, problem == CLASSIFICATION).collect()
    whole = fit(12)
    history = list((whole.summary() if callable(whole.summary) else whole.summary).objectiveHistory)
    found = {r["position"]: r["value"] for r in curve if r["series"] == "training"}
    assert set(found) <= {1, 2, 4, 8, 12} and len(found) > 1
    scale = 2 * frame.agg(F.var_samp(LABEL)).first()[0] if problem == REGRESSION else 1.0
    for position, value in found.items():
        assert value == pytest.approx(history[min(position, len(history) - 1)] * scale, rel=1e-5, abs=1e-7)
    test = [r["value"] for r in curve if r["series"] == "test"]
    assert len(test) == len(found) and test != list(found.values())


def test_stages():
    assert [stages(n) for n in (1, 2, 3, 8, 10)] == [[1], [1, 2], [1, 2, 3], [1, 2, 4, 8], [1, 2, 4, 8, 10]]


def test_deviance_of_a_trained_model(rows):
    frame = rows.withColumn(LABEL, F.col("y"))
    trained = train_family(frame, ["x", "z"], "GLM", REGRESSION, settings=SMALL)
    curve = deviance_curve(trained, frame.where("id >= 80"), frame.where("id < 80"), SMALL)
    assert {r["series"] for r in curve.collect()} == {"training", "test"}


# -- classes and importance


def test_boosting_one_class_against_the_rest(rows):
    frame = rows.withColumn(LABEL, (F.ascii("kind") - 97).cast("double"))
    trained = train_family(frame, ["x", "z"], "GBM", CLASSIFICATION, ["a", "b", "c"], SMALL)
    scored = trained.score(frame)
    p = scored.select(PROBABILITY, LABEL, "prediction").collect()
    assert all(abs(sum(r[PROBABILITY]) - 1) < 1e-9 and r[PROBABILITY].argmax() == r["prediction"] for r in p)
    losses = staged_losses(last_stage(trained.model), scored, LABEL)
    import math

    whole = sum(-math.log(r[PROBABILITY][int(r[LABEL])]) for r in p) / len(p)
    assert len(losses) == SMALL.rounds and losses[-1] == pytest.approx(whole) and losses[0] > losses[-1]


def test_importance_by_permutation(rows):
    frame = rows.withColumn(LABEL, F.col("y"))
    trained = train_family(frame, ["x", "z", "same"], "GLM", REGRESSION, settings=SMALL)
    found = {r["variable"]: r for r in importance_by_permutation(trained, frame).collect()}
    assert found["same"]["relative"] == 0.0 and found["x"]["scaled"] == 1.0 and found["z"]["scaled"] < 0.05
    again = {r["variable"]: r["relative"] for r in importance_by_permutation(trained, frame).collect()}
    assert again["x"] == pytest.approx(found["x"]["relative"], rel=1e-9)
    empty = permutation_importance(trained.score, frame.limit(0), ["x"], F.col("prediction")).collect()
    assert [tuple(r) for r in empty] == [("x", 0.0, 0.0)]


# -- scratch


def test_scopes_delete_what_is_not_kept(spark):
    from tessella.scratch import exists, materialise, scope

    def path(df):
        return df.inputFiles()[0].rsplit("/", 1)[0]

    numbers = spark.range(3)
    with scope(spark) as stored:
        a = path(stored(numbers, "a"))
        with scope(spark):
            b, c = path(materialise(numbers, "b")), path(materialise(numbers, "c", keep=True))
        assert not exists(spark, b) and exists(spark, c) and exists(spark, a)
        kept = materialise(numbers, "d", keep=True)
    assert not exists(spark, a) and not exists(spark, c) and kept.count() == 3
    with pytest.raises(ValueError), scope(spark):
        e = path(materialise(numbers, "e"))
        raise ValueError
    assert not exists(spark, e) and materialise(numbers, "f").count() == 3
