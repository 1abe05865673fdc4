"""Second-order boosting against sums and gains that are written out, and against closed forms."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessella.operators.boosting import Boosting, SecondOrderBoosting, level_sums, quantile_cuts, split_gains
from tessella.operators.curves import last_stage, staged_losses, variable_importance


@pytest.fixture(scope="module")
def rows(spark):
    x, z = F.col("id") % 13, F.col("id") * 7 % 31
    df = spark.range(600).select(
        "id", x.cast("double").alias("x"), z.cast("double").alias("z"), F.lit(1.0).alias("same"),
        (F.when(x > 6, 10.0).otherwise(2.0) + z / 31).alias("y"), (x + z > 20).cast("double").alias("two"), F.floor(z / 11).cast("double").alias("three"),
    )
    return VectorAssembler(inputCols=["x", "z", "same"], outputCol="features").transform(df).cache()


def fitted(rows, label, classes, **settings):
    return SecondOrderBoosting(3, classes, Boosting(**{"rounds": 4, "depth": 3, **settings}), labelCol=label).fit(rows)


def plain_gains(bins, g, h, s):
    """Gain of every cut of the root."""
    shrunk = lambda v: math.copysign(max(abs(v) - s.l1, 0.0), v)
    score = lambda a, b: shrunk(a) ** 2 / (b + s.l2)
    out = {}
    for f in range(bins.shape[1]):
        for b in sorted(set(bins[:, f])):
            low = bins[:, f] <= b
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            if min(hl, hr) >= s.min_child:
                out[f, int(b)] = 0.5 * (score(gl, hl) + score(gr, hr) - score(g.sum(), h.sum())) - s.gamma
    return out


@pytest.mark.parametrize("settings", [Boosting(), Boosting(l1=3.0, l2=0.5, gamma=0.25, min_child=20.0)])
def test_gains_of_all_cuts(spark, settings):
    rng = np.random.default_rng(1)
    bins, g, h = rng.integers(0, 6, (200, 3)), rng.normal(size=200), rng.uniform(0.1, 1, 200)
    data = [([int(b) for b in r], [(float(a), float(c))], [0]) for r, a, c in zip(bins, g, h)]
    frame = spark.createDataFrame(data, "bins array<int>, gh array<struct<g:double,h:double>>, nodes array<int>").repartition(5)
    found = {(r["feature"], r["bin"]): r["gain"] for r in split_gains(level_sums(frame), settings).collect() if r["gain"] is not None}
    want = plain_gains(bins, g, h, settings)
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_cut_is_the_mean_of_its_sides(rows):
    model = fitted(rows, "y", 0, rounds=1, depth=1, rate=1.0, l2=0.0)
    tree = model.trees[0][0]
    assert tree.feature[0] == 0 and 6 < tree.cut[0] <= 7 and tree.feature[1:] == [-1, -1]
    means = {r["upper"]: r["m"] for r in rows.groupBy((F.col("x") >= tree.cut[0]).alias("upper")).agg(F.avg("y").alias("m")).collect()}
    for r in model.transform(rows).select("x", "prediction").distinct().collect():
        assert r["prediction"] == pytest.approx(means[r["x"] >= tree.cut[0]])


@pytest.mark.parametrize("label, classes", [("y", 0), ("two", 2), ("three", 3)])
def test_losses_fall_and_end_at_the_models_own(rows, tmp_path, label, classes):
    model = fitted(rows, label, classes)
    losses = staged_losses(model, rows, label)
    scored = model.transform(rows)
    assert len(losses) == 4 and all(a > b for a, b in zip(losses, losses[1:]))
    if classes:
        own = [(r["probability"], int(r[label]), r["prediction"]) for r in scored.select("probability", label, "prediction").collect()]
        assert losses[-1] == pytest.approx(-sum(math.log(p[y]) for p, y, _ in own) / len(own))
        assert all(abs(sum(p) - 1) < 1e-9 and p.argmax() == c for p, _, c in own)
        assert sum(y == c for _, y, c in own) / len(own) > 0.8
    else:
        assert losses[-1] == pytest.approx(scored.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0))))).first()[0])
    pipeline = PipelineModel([model])
    pipeline.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(rows)
    cells = ["id", "prediction"]
    assert sorted(again.select(cells).collect()) == sorted(scored.select(cells).collect())


def test_importance_of_a_constant_is_nothing(spark, rows):
    model = Pipeline(stages=[SecondOrderBoosting(3, 0, Boosting(3, 3), labelCol="y")]).fit(rows)
    found = {r["variable"]: r for r in variable_importance(spark, model, ["x", "z", "same"]).collect()}
    assert found["x"]["scaled"] == 1.0 and found["same"]["relative"] == 0.0 and found["z"]["relative"] > 0
    assert sum(r["relative"] for r in found.values()) == pytest.approx(1.0)
    assert last_stage(model).objective == "squared"


def test_penalties_and_odd_inputs(spark, rows):
    assert all(f == -1 for own in fitted(rows, "y", 0, gamma=1e9).trees for t in own for f in t.feature)
    assert all(w == 0 for own in fitted(rows, "y", 0, l1=1e9).trees for t in own for w in t.weight)
    one = fitted(rows.limit(1), "y", 0)
    assert one.transform(rows.limit(1)).select("prediction").first()[0] == pytest.approx(rows.limit(1).first()["y"])
    only = fitted(rows.withColumn("two", F.lit(1.0)), "two", 2).transform(rows)
    assert only.where("prediction <> 1").count() == 0
    assert quantile_cuts(rows.selectExpr("array(x, z, same) as v"), F.col("v"), 3, 4)[2] == []
