"""Loss curves and importances of fitted models, as rows ``series, position, value``.

Boosted and forest models are replayed tree by tree over the frame: one pass per curve and split, and
only one number per tree comes back.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import column
from ..scratch import new_path, remove, scope
from .boosting import SQUARED, VALUES, SecondOrderModel, probabilities
from .evaluate import PROBABILITY_FLOOR, log_loss
from .row_id import add_row_id

CURVE = "series string, position int, value double"
PLACE, ORDER = "__place", "__order"
# Two means of equal numbers differ by less, in parts of them: they may be added up in another order.
SAME = 1e-9


def last_stage(model: Model) -> Model:
    return last_stage(model.stages[-1]) if isinstance(model, PipelineModel) else model


def _tree_outputs(model, df: DataFrame, label: str) -> tuple[DataFrame, list[Column]]:
    """Rows with y, and the output of every tree."""
    classes = isinstance(model, RandomForestClassificationModel)
    source = df.select(F.col(label).cast("double").alias("y"), F.col(model.getFeaturesCol()).alias("v"))
    several = classes and model.numClasses > 2
    names = []
    for i, tree in enumerate(model.trees):
        own = tree.copy()
        own.setFeaturesCol("v").setPredictionCol(f"p{i}")
        if classes:
            own.setProbabilityCol(f"q{i}").setRawPredictionCol("")
        source = own.transform(source)
        # of more than two classes: the probability of the row's own
        place = F.col("y").cast("int") + 1 if several else F.lit(2)
        names.append(F.element_at(vector_to_array(f"q{i}"), place) if classes else F.col(f"p{i}"))
    return source.select("y", *[c.alias(f"o{i}") for i, c in enumerate(names)]), [F.col(f"o{i}") for i in range(len(names))]


def _prefix_losses(outputs: DataFrame, trees: Sequence[Column], loss) -> list[float]:
    """Mean loss after 1, 2, .. trees; one aggregate of a column for each, so that no row is made anew for a tree."""
    totals = list(accumulate(trees, Column.__add__))
    means = [F.avg(loss(F.col("y"), total / (i + 1))).alias(f"loss{i}") for i, total in enumerate(totals)]
    rows, *losses = outputs.agg(F.count(F.lit(1)).alias("rows"), *means).first()
    return losses if rows else []


def one_vs_rest_probabilities(margins: Column) -> Column:
    """Of an array with the boosted margin of each class: the logistic functions, scaled to a sum of one."""
    odds = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    return F.transform(odds, lambda p: p / F.aggregate(odds, F.lit(0.0), lambda total, q: total + q))


def _one_vs_rest_losses(model: OneVsRestModel, df: DataFrame, label: str) -> list[float]:
    """Log loss after 1, 2, .. trees of every class, all classes in one pass."""
    source = df.select(F.col(label).cast("int").alias("y"), F.col(model.getFeaturesCol()).alias("v"))
    running = []
    for k, boosted in enumerate(model.models):
        names = []
        for i, tree in enumerate(boosted.trees):
            own = tree.copy()
            own.setFeaturesCol("v").setPredictionCol(f"p{k}_{i}")
            source = own.transform(source)
            names.append(F.col(f"p{k}_{i}") * F.lit(boosted.treeWeights[i]))
        running.append(names)
    rounds = max(len(names) for names in running)
    # a class that stopped earlier keeps its last margin
    margins = [[reduce(Column.__add__, names[: i + 1]) for names in running] for i in range(rounds)]
    place = F.col("y") + 1
    losses = []
    for i, margin in enumerate(margins):
        odds = [1 / (1 + F.exp(-2 * m)) for m in margin]  # as in one_vs_rest_probabilities, compiled
        own = F.element_at(F.array(*odds), place) / reduce(Column.__add__, odds, F.lit(0.0))
        losses.append(F.avg(-F.log(F.greatest(own, F.lit(PROBABILITY_FLOOR)))).alias(f"loss{i}"))
    rows, *found = source.agg(F.count(F.lit(1)).alias("rows"), *losses).first()
    return found if rows else []


def _second_order_losses(model: SecondOrderModel, df: DataFrame, label: str) -> list[float]:
    rows = model.values(df).select(F.col(label).cast("double").alias("y"), VALUES)
    staged = rows.select("y", F.posexplode(model.margins(F.col(VALUES))).alias("i", "m"))
    if model.objective == SQUARED:
        error = F.col("y") - F.get("m", F.lit(0))
        loss = F.sqrt(F.avg(error * error))
    else:
        own = F.get(probabilities(model.objective, F.col("m")), F.col("y").cast("int"))
        loss = F.avg(-F.log(F.greatest(own, F.lit(PROBABILITY_FLOOR))))
    return [r["loss"] for r in sorted(staged.groupBy("i").agg(loss.alias("loss")).collect())]


def staged_losses(model, df: DataFrame, label: str) -> list[float]:
    """RMSE (regression) or log loss (classes) after each tree."""
    if isinstance(model, OneVsRestModel):
        return _one_vs_rest_losses(model, df, label)
    if isinstance(model, SecondOrderModel):
        return _second_order_losses(model, df, label)
    if isinstance(model, GBTRegressionModel):
        return [v**0.5 for v in model.evaluateEachIteration(_as_label(model, df, label), "squared")]
    if isinstance(model, GBTClassificationModel):
        # The library's logistic loss for labels -1/+1 is twice the log loss.
        return [v / 2 for v in model.evaluateEachIteration(_as_label(model, df, label))]
    outputs, trees = _tree_outputs(model, df, label)
    if isinstance(model, RandomForestRegressionModel):
        return [v**0.5 for v in _prefix_losses(outputs, trees, lambda y, p: (y - p) * (y - p))]
    if model.numClasses > 2:
        return _prefix_losses(outputs, trees, lambda y, p: -F.log(F.greatest(p, F.lit(PROBABILITY_FLOOR))))
    return _prefix_losses(outputs, trees, log_loss)


def _as_label(model, df: DataFrame, label: str) -> DataFrame:
    return df.select(F.col(label).cast("double").alias(model.getLabelCol()), model.getFeaturesCol())


def _rows(spark: SparkSession, series: dict[str, Sequence[float]]) -> DataFrame:
    return spark.createDataFrame(
        [(name, i, float(v)) for name, values in series.items() for i, v in enumerate(values)], CURVE
    )


def loss_curve_trees(model: Model, train: DataFrame, holdout: DataFrame, label: str) -> DataFrame:
    """Training and validation loss by number of trees; the frames must carry the feature vector."""
    trees = last_stage(model)
    return _rows(
        train.sparkSession,
        {"training": staged_losses(trees, train, label), "validation": staged_losses(trees, holdout, label)},
    )


def stages(iterations: int) -> list[int]:
    """1, 2, 4, .. and ``iterations``."""
    found = [1]
    while 2 * found[-1] < iterations:
        found.append(2 * found[-1])
    return found if iterations <= 1 else [*found, iterations]


def deviance_by_iteration(
    fit: Callable[[int], Model], iterations: int, train: DataFrame, holdout: DataFrame, label: str, probability: bool = False
) -> DataFrame:
    """Mean deviance of both frames after 1, 2, 4, .. iterations, as rows series, position, value.

    ``fit`` gives the model after so many iterations, which the frames carry the features of: a run that is cut there ends
    where a whole run passes, and all runs together take about twice its steps, if one run does not give all models. A run that needs fewer iterations than it
    may take is the last. Deviance: mean squared error, or with ``probability`` the log loss of a row's class. A frame is
    read once for all stages.
    """
    models: dict[int, Model] = {}
    for steps in stages(iterations):
        models[steps] = fit(steps)
        if steps_taken(models[steps]) < steps:
            break
    series = {
        name: _staged_deviances(list(models.values()), df, label, probability) for name, df in (("training", train), ("test", holdout))
    }
    rows = [(name, steps, float(v)) for name, values in series.items() for steps, v in zip(models, values) if v is not None]
    return train.sparkSession.createDataFrame(rows, CURVE)


def steps_taken(model: Model) -> int:
    return len(_history(model)) - 1


def _staged_deviances(models: Sequence[Model], df: DataFrame, label: str, probability: bool) -> list[float]:
    """One pass: every stage adds a column, of which the mean loss is taken."""
    losses = []
    for i, model in enumerate(models):
        own = model.copy()
        own.setPredictionCol(f"__p{i}")
        if probability:
            own.setProbabilityCol(f"__q{i}").setRawPredictionCol("")
        df = own.transform(df)
        if probability:
            p = F.element_at(vector_to_array(f"__q{i}"), column(label).cast("int") + 1)
            losses.append(F.avg(-F.log(F.greatest(p, F.lit(PROBABILITY_FLOOR)))))
        else:
            error = column(label).cast("double") - F.col(f"__p{i}")
            losses.append(F.avg(error * error))
    return list(df.agg(*[loss.alias(f"loss{i}") for i, loss in enumerate(losses)]).first())


def objective_curve(spark: SparkSession, model: Model, drop_first: bool = False) -> DataFrame:
    """Training objective by iteration, as the optimiser recorded it."""
    history = _history(model)
    return _rows(spark, {"training": history[1:] if drop_first else history})


def _history(model: Model) -> list[float]:
    fitted = last_stage(model)
    summary = fitted.summary() if callable(fitted.summary) else fitted.summary
    return list(summary.objectiveHistory)


def variable_importance(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """variable, relative, scaled (largest = 1), in ascending order; coefficients by size for linear models.

    Of models that are boosted one class against the rest: the means over the classes.
    """
    fitted = last_stage(model)
    if isinstance(fitted, OneVsRestModel):
        own = [m.featureImportances.toArray() for m in fitted.models]
        weights = (sum(own) / len(own)).tolist()
    elif hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray().tolist()
    else:
        weights = [abs(float(w)) for w in fitted.coefficients]
    return _importances(spark, names, weights)


def _importances(spark: SparkSession, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    largest = max(weights, default=0.0) or 1.0
    rows = [(name, float(w), float(w) / largest) for name, w in zip(names, weights)]
    return spark.createDataFrame(rows, "variable string, relative double, scaled double").orderBy("scaled", "variable")


def permutation_importance(
    score: Callable[[DataFrame], DataFrame], df: DataFrame, names: Sequence[str], loss: Column, seed: int = 1
) -> DataFrame:
    """variable, relative, scaled (largest = 1), in ascending order, for any model: by how much the mean loss grows when
    the values of one column are dealt anew to the rows; what does not grow is 0.

    Every column moves by a seeded number of places round the rows of ``df``, one to one, so its values stay what they
    are. The rows get numbers once; one join by number moves a column, and no task sees more than its rows. ``score``
    adds what ``loss`` reads.
    """
    cells = [column(c) for c in df.columns]
    hashed = df.select(*cells, F.xxhash64(F.lit(seed), *cells).alias(ORDER))
    with scope(df.sparkSession) as stored:
        sorted_copy = new_path(df.sparkSession, "sorted")
        numbered = stored(add_row_id(hashed, [ORDER], PLACE, path=sorted_copy).drop(ORDER), "numbered")
        remove(df.sparkSession, sorted_copy)
        rows = numbered.count()
        turns = random.Random(seed)
        own = score(numbered.drop(PLACE)).agg(F.avg(loss)).first()[0] or 0.0
        weights = []
        for name in names:
            turn = 1 + turns.randrange(max(rows - 1, 1))
            moved = numbered.select(F.pmod(F.col(PLACE) - 1 + turn, F.lit(max(rows, 1))) + 1, column(name))
            moved = moved.toDF(PLACE, name)
            dealt = numbered.drop(name).join(moved, PLACE).select(*cells)
            grown = (score(dealt).agg(F.avg(loss)).first()[0] or 0.0) - own
            weights.append(grown if grown > SAME * abs(own) else 0.0)
    return _importances(df.sparkSession, names, weights)
