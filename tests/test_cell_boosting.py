"""Boosting on cells against Spark ML's own boosting on rows."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessella.operators import cell_boosting as C
from tessella.operators.cell_boosting import CellBoosting, candidate_cuts
from tessella.operators.curves import last_stage
from tessella.plans import train as T


def rows(spark, n=4000):
    i = F.col("id")
    a, b = F.floor(50 * F.abs(F.sin(i * 1.3))), F.sin(i * 0.7) * 3  # few values and many
    noise = F.xxhash64("id") % 100 / 100
    label = F.when(a + 10 * noise > 30, 2).when(b > noise, 1).otherwise(0).cast("double")
    df = spark.range(n).select("id", label.alias("label"), a.cast("double").alias("a"), b.alias("b"), (i % 2).cast("double").alias("c"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(3)).persist()


def boosted():
    return GBTClassifier(maxIter=3, maxDepth=4, seed=1)


def margins(model, df):
    return {r.id: list(r.rawPrediction) for r in model.transform(df).select("id", "rawPrediction").collect()}


def test_trees_are_those_of_all_rows(spark):
    df = rows(spark)
    own = margins(CellBoosting(3, boosted()).fit(df), df)
    theirs = margins(OneVsRest(classifier=boosted()).fit(df), df)
    assert all(own[i] == pytest.approx(theirs[i], abs=1e-6) for i in theirs)


def test_trees_see_cells_and_not_rows(spark, monkeypatch):
    """Their number is bounded by the bins, however many rows and values there are."""
    seen, plain = [], C.OneVsRest._fit
    monkeypatch.setattr(C.OneVsRest, "_fit", lambda self, cells: seen.append(cells.agg(F.count("label"), F.sum(C.WEIGHT)).first()) or plain(self, cells))
    monkeypatch.setattr(C, "VALUES", 100)
    monkeypatch.setattr(C, "BINS", 32)
    df = rows(spark).select("id", "label", "features")
    trained = T.train_family(df.select("label", *[F.get(T.vector_to_array("features"), F.lit(i)).alias(c) for i, c in enumerate("abc")]),
                             list("abc"), "GBM", T.CLASSIFICATION, ["0", "1", "2"], T.Settings(rounds=2, depth=2))
    (cells, weight), = seen
    assert weight == 4000 and cells <= 32 * 32 * 2 * 3 and cells < 4000
    assert len(last_stage(trained.model).models) == 3


def test_cuts_of_few_and_many_values(spark, monkeypatch):
    df = rows(spark).select(T.vector_to_array("features").alias("x"))
    a, b, c = candidate_cuts(df, F.col("x"), 3)
    assert len(a) <= 31 and len(b) <= 31 and c == [0.5]
    monkeypatch.setattr(C, "VALUES", 100)
    quantiles = candidate_cuts(df, F.col("x"), 3)
    assert quantiles[0] == a and quantiles[2] == c and 20 < len(quantiles[1]) <= 32


def test_a_model_on_cells_is_saved_and_loaded(spark, tmp_path):
    df = rows(spark, 300)
    model = PipelineModel([CellBoosting(3, boosted()).fit(df)])
    model.write().overwrite().save(str(tmp_path / "m"))
    assert margins(PipelineModel.load(str(tmp_path / "m")), df) == margins(model, df)
