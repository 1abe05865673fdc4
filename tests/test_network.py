"""The network against Spark ML's own fit."""

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessella.operators import network as N
from tessella.operators.network import Network
from tessella.plans import train as T


def rows(spark, n, parts):
    shift = F.when(F.col("id") % 3 == 1, 0.5).otherwise(0.0)
    df = spark.range(n).select((F.col("id") % 3).cast("double").alias("label"), (F.sin(F.col("id") * 1.7) + shift).alias("a"), F.cos(F.col("id") * 0.3).alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.repartition(parts)).persist()


@pytest.mark.parametrize("n,parts", [(90, 1), (6000, 1), (700, 3)])
def test_a_fit_takes_the_steps_of_spark_ml(spark, n, parts):
    """Last blocks of partitions, more stacks than one, and empty partitions included."""
    df = rows(spark, n, parts)
    own, theirs = Network([2, 5, 3], 25, 2).fit(df), MultilayerPerceptronClassifier(layers=[2, 5, 3], maxIter=25, seed=2).fit(df)
    assert own.summary().objectiveHistory == pytest.approx(theirs.summary().objectiveHistory, rel=1e-7)
    assert own.weights.toArray() == pytest.approx(theirs.weights.toArray(), rel=1e-4, abs=1e-4)
    same = own.transform(df).select("label", "prediction").exceptAll(theirs.transform(df).select("label", "prediction"))
    assert same.count() <= n // 1000


def test_the_curve_of_a_network_is_one_run(spark, monkeypatch):
    """It looks at the objective as often as one fit does, not once more for 1, 2, 4, .. iterations; the points are the fits'."""
    df, looks, plain = rows(spark, 600, 2), [], N.minimise
    settings = T.Settings(hidden=4, iterations=12)
    frame = df.select("label", "a", "b")
    prepared = T.prepare(frame, ["a", "b"], "DeepLearning")
    monkeypatch.setattr(N, "minimise", lambda f, *a: plain(lambda x: looks.append(1) or f(x), *a))
    found = T.network_deviance_curve(prepared, frame, frame, ["a", "b"], ["0", "1", "2"], settings)
    points = {r.position: r.value for r in found.where("series = 'training'").collect()}
    together = len(looks)
    trained = T.train_family(frame, ["a", "b"], "DeepLearning", T.CLASSIFICATION, ["0", "1", "2"], settings)
    assert sorted(points) == [1, 2, 4, 8, 12] and together == len(looks) - together
    scored = trained.score(frame).select(F.element_at(T.vector_to_array("probability"), F.col("label").cast("int") + 1).alias("p"))
    assert points[12] == pytest.approx(scored.agg(F.avg(-F.log("p"))).first()[0], rel=0.02)  # rows are dealt anew


def test_labels_beyond_the_classes_are_refused(spark):
    with pytest.raises(Exception, match="whole numbers below 2"):
        Network([2, 3, 2], 3, 1).fit(rows(spark, 30, 1))


def test_a_search_that_fails_twice_ends_where_it_stands():
    """A slope that lies: no step is good enough, with and without the memory of earlier ones."""
    import numpy as np

    states = list(N.minimise(lambda x: (float(x @ x) + 1, -2 * x), np.array([1.0, 2.0]), 1e-6))
    assert [s[0] for s in states] == [0, 0, 0] and {s[2] for s in states} == {6.0}
