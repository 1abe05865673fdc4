"""What a review found: arrays that shared a file, tasks by the thousand, joins in one task, sorts in one task."""

import json
import os

import pytest
from pyspark.sql import functions as F

from registry.ingest import json_arrays, split_size
from tessella.llm.language import accepted
from conftest import plan_text
from tessella.operators import boosting
from tessella.operators.boosting import SUMS, Boosting, SecondOrderBoosting, Tree, _literals, _node, _task_sums, level_sums
from tessella.operators.merge import Link, merge_graph
from tessella.operators.features import REGRESSION
from tessella.operators.row_id import add_row_id
from tessella.operators.split import HOLDOUT, TRAIN, part, with_split
from tessella.plans import train as train_module
from tessella.plans.report import report
from tessella.plans.train import Settings, train_family, train_stacked


@pytest.fixture
def uneven_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def written(path):
    return [f.read_text() for f in path.iterdir() if f.name.startswith("part-")]


def test_a_file_holds_one_array(spark, tmp_path, uneven_partitions):
    """Also if the rows come from several partitions."""
    from pathlib import Path

    df = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit('}"[\n'), F.col("id").cast("string")).alias("t"))
    arrays = [json.loads(text) for text in written(Path(json_arrays(spark, df)))]
    assert len(arrays) == 8
    assert sorted(r["k"] for own in arrays for r in own) == list(range(3000))


def test_splits_grow_with_the_files(spark, tmp_path):
    for name, size in (("small", 1000), ("large", 4_000_000)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_bytes(b"x" * size)
    assert split_size(spark, str(tmp_path / "small")) == 64 << 10
    assert split_size(spark, str(tmp_path / "large")) == 1_000_000


def test_a_small_table_is_dealt_to_all_tasks(spark, tmp_path):
    """A join that makes many rows of each row of one file does so in many tasks."""
    spark.range(400).select(F.col("id").alias("a"), (F.col("id") % 4).alias("n")).coalesce(1).write.parquet(str(tmp_path / "l"))
    spark.range(40).select(F.col("id").alias("b"), (F.col("id") % 4).alias("m")).coalesce(1).write.parquet(str(tmp_path / "r"))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("l", "r")}
    merged = merge_graph(tables, [Link.of("l", "r", ("n", "m"))])
    assert merged.count() == 400 * 10
    assert merged.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_texts_that_begin_alike_are_sorted_once(spark, tmp_path):
    """All rows share more characters than a boundary holds, half of them many more: the first sort is even."""
    start = F.concat(F.lit("copyright " * 20), F.when(F.col("id") % 2 == 0, F.lit("x" * 500)).otherwise(""))
    df = spark.range(0, 4000, 1, 4).select(F.concat(start, F.sha2(F.col("id").cast("string"), 256)).alias("t"), "id")
    path = str(tmp_path / "sorted")
    numbered = add_row_id(df.toDF("t", "k"), partitions=8, path=path)
    rows = numbered.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 4001)) and [(r["t"], r["k"]) for r in rows] == sorted((r["t"], r["k"]) for r in rows)
    assert [x.name for x in (tmp_path / "sorted").iterdir()] == ["0"]  # nothing had to be split again
    assert max(r["count"] for r in numbered.groupBy(F.input_file_name()).count().collect()) <= 2 * 4000 / 8


def test_boosting_adds_up_rows_in_the_tasks(spark):
    """Sums of a level as the plain aggregate has them, and no row leaves its task."""
    trees = [Tree([1, -1, 0] + [-1] * 4, [0.0] * 7, [0.0] * 7, [0.0] * 7), Tree([0] + [-1] * 6, [0.0] * 7, [0.0] * 7, [0.0] * 7)]
    bins = [[2, 0, 1, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0, 0]]
    gh = F.array(*[F.struct((F.col("id") % k).cast("double").alias("g"), (F.col("id") % 3 + 0.5).alias("h")) for k in (5, 7)])
    rows = spark.range(0, 900, 1, 3).select(F.array((F.col("id") % 4).cast("int"), (F.col("id") * 7 % 5).cast("int")).alias("bins"), gh.alias("gh"))
    for level in (0, 1, 2):
        nodes = [_node(F.col("bins"), F.array(*map(F.lit, t.feature)), F.array(*map(F.lit, b)), level) for t, b in zip(trees, bins)]
        plain = level_sums(rows.withColumn("nodes", F.array(*nodes))).where(F.col("node") >= 2**level - 1)
        parts = rows.mapInArrow(_task_sums(trees, bins, level, 5, 2), SUMS)
        assert parts.count() <= 3 * 2 * 2 * 2**level * 5
        sums = parts.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, plain.collect()))


def test_language_stage_has_an_effect(spark):
    """Rows the net is not sure of go, labelled or not; the others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every, none = (accepted(docs, min_score=score, trust_labels=False).count() for score in (0.0, 1.1))
    assert none == 0 < every
    kept = accepted(docs, min_score=0.9, trust_labels=False)
    assert kept.columns == docs.columns and 0 < kept.count() < every


def test_a_converged_model_is_not_fitted_again(spark, monkeypatch):
    """The curve of a linear model is as before, with fewer fits."""
    from tessella.plans import train as T

    df = spark.range(300).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 3.0 + F.col("id") % 5).alias(T.LABEL))
    trained = T.train_family(df, ["x"], "GLM", T.REGRESSION)
    fits, plain = [], T.estimator
    monkeypatch.setattr(T, "estimator", lambda *a: fits.append(1) or plain(*a))
    found = sorted(map(tuple, T.deviance_curve(trained, df, df).collect()))
    own = len(fits)
    monkeypatch.setattr(T, "_is_whole_run", lambda *a: False)
    again = sorted(map(tuple, T.deviance_curve(trained, df, df).collect()))
    assert len(fits) - own > own
    assert [r[:2] for r in found] == [r[:2] for r in again] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(found, again))


def vectors(spark, classes=0):
    from pyspark.ml.feature import VectorAssembler

    cells = [(F.col("id") * k % 11).cast("double").alias(f"f{k}") for k in (3, 5)]
    label = (F.col("id") * 7 % classes if classes else F.col("id") % 11 * 2 + F.col("id") % 3).cast("double")
    df = spark.range(0, 600, 1, 40).select(label.alias("label"), *cells)
    return VectorAssembler(inputCols=["f3", "f5"], outputCol="features").transform(df)


def test_a_level_has_a_python_task_for_each_core(spark, monkeypatch):
    """Not one for each of many small partitions."""
    seen, plain = [], boosting.split_gains
    monkeypatch.setattr(boosting, "split_gains", lambda sums, s: seen.append(plan_text(sums)) or plain(sums, s))
    SecondOrderBoosting(2, 0, Boosting(1, 2)).fit(vectors(spark))
    assert len(seen) == 3 and all("Coalesce 4" in plan for plan in seen)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosted_scores_are_compiled(spark, classes):
    """The margins that the nodes by number give, without a lambda for a row."""
    df = vectors(spark, classes)
    model = SecondOrderBoosting(2, classes, Boosting(3, 3)).fit(df)
    values = F.array("f3", "f5")
    sums = [F.lit(b) for b in model._state()["base"]]
    for own in model.trees:
        more = [0.3 * F.get(_literals(t.weight, "double"), _node(values, _literals(t.feature, "int"), _literals(t.cut, "double"), 3)) for t in own]
        sums = [a + b for a, b in zip(sums, more)]
    found = model.transform(df)
    assert boosting.VALUES not in found.columns
    raw = found.select(F.array(*sums).alias("m"), "rawPrediction" if classes else "prediction").collect()
    assert all(r[0] == (list(r[1])[-len(r[0]) :] if classes else [r[1]]) for r in raw) and len({tuple(r[0]) for r in raw}) > 3
    assert classes or "lambda" not in plan_text(found)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_loss_by_tree_makes_no_row_for_each_tree(spark, classes, monkeypatch):
    """The last of the losses is the forest's own."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from tessella.operators.curves import staged_losses

    df = vectors(spark, classes)
    model = (RandomForestClassifier if classes else RandomForestRegressor)(numTrees=4, seed=1).fit(df)

    def refused(*_):
        raise AssertionError

    monkeypatch.setattr(F, "posexplode", refused)
    losses = staged_losses(model, df, "label")
    scored = model.transform(df)
    if classes:
        own = -F.log(F.greatest(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(1e-15)))
        expected = scored.agg(F.avg(own)).first()[0]
    else:
        expected = scored.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    assert len(losses) == 4 and losses[-1] == pytest.approx(expected)
    assert staged_losses(model, df.where("label < 0"), "label") == []


def test_rows_are_held_once(spark, monkeypatch):
    """For the fit and the metrics of one model."""
    import registry.models as M
    from tessella.plans import report as R

    calls, plain = [], M.held
    for module in (M, R):
        monkeypatch.setattr(module, "held", lambda df: calls.append(1) or plain(df))
    found = M.QUERIES["train_drf"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and found.groupBy("split").count().count() == 2


def test_a_network_is_not_fitted_twice_for_its_curve(spark, monkeypatch):
    """The curve is that of the network fitted before, to the last digit."""
    from tessella.operators.curves import stages
    from tessella.plans import train as T

    df = vectors(spark, 2).select(T.LABEL, "f3", "f5")
    settings, fits, plain = T.Settings(iterations=6), [], T.estimator
    trained = T.train_family(df, ["f3", "f5"], "DeepLearning", T.CLASSIFICATION, ["0", "1"], settings)
    before = sorted(map(tuple, T.deviance_curve(trained, df, df, settings).collect()))
    monkeypatch.setattr(T, "estimator", lambda *a: fits.append(1) or plain(*a))
    prepared = T.prepare(df, ["f3", "f5"], "DeepLearning")
    found = T.network_deviance_curve(prepared, df, df, ["f3", "f5"], ["0", "1"], settings)
    assert sorted(map(tuple, found.collect())) == before and len(fits) == len(stages(6))


def test_a_round_of_boosting_stands_alone(spark, monkeypatch):
    """No plan holds the rounds before it, cells move once before their gains, and no table of a round is left."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(400).select((F.col("id") % 13).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("z"), (F.col("id") % 17).cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df).persist()
    plans, best = [], boosting._best

    def seen(gains, settings):
        plans.append(gains._jdf.queryExecution().executedPlan().toString())
        return best(gains, settings)

    monkeypatch.setattr(boosting, "_best", seen)
    folder = spark.conf.get("spark.checkpoint.dir")
    model = SecondOrderBoosting(2, 0, Boosting(rounds=3, depth=2)).fit(rows)
    rows.unpersist()
    assert len(model.trees) == 3 and len(plans) == 9
    assert all("InMemoryTableScan" not in p and p.count("Exchange hashpartitioning") == 1 for p in plans)
    assert not [x for x in os.listdir(folder) if x.startswith("boosted")]


@pytest.fixture
def plain(spark):
    cells = (F.col("id") % 13).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("z"), (F.col("id") % 17).cast("double").alias("label")
    return spark.range(400).select(F.col("id").alias("k"), *cells)


def test_a_report_reads_the_unseen_rows_once(spark, plain):
    """Its curves need neither the training part nor the scores of the holdout a second time."""
    marked, calls = with_split(plain, "k", 1, 60), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    training = part(marked, TRAIN)
    trained = train_family(training, ["x", "z"], "DRF", REGRESSION, settings=Settings(trees=2, depth=2))
    found = report(trained, marked.withColumn("x", seen("x")), "k", 0, training=training).curves
    series = {r["series"]: r["count"] for r in found.groupBy("series").count().collect()}
    holdout = part(marked, HOLDOUT).count()
    assert calls.value == holdout and series == {"y_actual": holdout, "y_prediction": holdout, "training": 2, "validation": 2, "scaled": 2}


def test_stacking_applies_the_first_level_once(spark, plain, monkeypatch):
    """The second level's fit reads its rows several times: they are held."""
    levels = []

    class Seen(train_module.Pipeline):
        def fit(self, df):
            levels.append(df.storageLevel.useMemory)
            return super().fit(df)

    monkeypatch.setattr(train_module, "Pipeline", Seen)
    train_stacked(plain, "k", ["x", "z"], REGRESSION, folds=2, settings=Settings(trees=2, depth=2))
    assert levels[-1]
