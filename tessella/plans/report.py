"""Reports of trained models as two long tables.

metrics: model, positive, split, metric, value; of two classes, figures are about the positive one
curves:  model, curve, series, position, label, x, y
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import column
from ..operators.curves import loss_curve_trees, variable_importance
from ..operators.evaluate import (
    actual_vs_predicted,
    by_class,
    confusion_matrix,
    gains_lift,
    metrics_regression,
    roc_curve,
)
from ..operators.features import REGRESSION
from ..operators.split import HOLDOUT, SPLIT, TRAIN, part
from ..scratch import materialise
from .train import (
    LABEL,
    PREDICTION,
    PROBABILITY,
    STACKED,
    Settings,
    Trained,
    as_binary,
    class_metrics,
    cross_validation_metrics,
    deviance_curve,
    held,
    importance_by_permutation,
)

CURVE_COLUMNS = ("curve", "series", "position", "label", "x", "y")
TREE_FAMILIES = ("DRF", "XGBoost", "GBM")


def _no_text():
    return F.lit(None).cast("string")


def _no_number():
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Report:
    metrics: DataFrame
    curves: DataFrame


def _curve(df: DataFrame, curve: str, series, position, label, x, y) -> DataFrame:
    cells = (F.lit(curve), series, position.cast("long"), label, x.cast("double"), y.cast("double"))
    return df.select(*[c.alias(n) for c, n in zip(cells, CURVE_COLUMNS)])


def _loss(df: DataFrame, curve: str) -> DataFrame:
    return _curve(df, curve, F.col("series"), F.col("position"), _no_text(), F.col("position"), F.col("value"))


def _series(df: DataFrame, curve: str, position: str, x: str, *series: str) -> list[DataFrame]:
    return [_curve(df, curve, F.lit(s), F.col(position), _no_text(), F.col(x), F.col(s)) for s in series]


def _importance(trained: Trained, df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    table = table if table is not None else variable_importance(df.sparkSession, trained.model, trained.features)
    return _curve(table, "Variable Importance", F.lit("scaled"), F.lit(None), F.col("variable"), _no_number(), F.col("scaled"))


def metrics_of(trained: Trained, frame: DataFrame) -> DataFrame:
    """model, split, metric, value; both splits are scored in the same pass."""
    scored = trained.score(frame)
    if trained.problem == REGRESSION:
        found = metrics_regression(scored, LABEL, PREDICTION, [SPLIT])
    else:
        found = class_metrics(scored, trained.classes, trained.positive, [SPLIT])
    return found.select(*_named(trained), SPLIT, "metric", "value")


def _named(trained: Trained) -> list:
    return [F.lit(trained.name).alias("model"), F.lit(trained.positive).cast("string").alias("positive")]


def _class_name(trained: Trained, index: str):
    """Name of the class with this index; a class without one keeps its number."""
    names = F.array(*[F.lit(c) for c in trained.classes])
    return F.coalesce(F.get(names, F.col(index).cast("int")), F.col(index).cast("string"))


def _class_curves(trained: Trained, scored: DataFrame) -> list[DataFrame]:
    """Gains and ROC of the positive class, or of every class of more than two by its own probability; one sweep for all."""
    names = ("cumulative_lift", "cumulative_data_fraction", "cumulative_capture_rate")
    if len(trained.classes) <= 2:
        with_p = as_binary(scored, trained.classes, trained.positive)
        gains, roc = gains_lift(with_p, "actual", "p1"), roc_curve(with_p, "actual", "p1")
        return [
            *_series(gains, "lift_gain", "group", "group", *names),
            _curve(roc, "roc", F.lit("tpr"), F.lit(None), _no_text(), F.col("fpr"), F.col("tpr")),
        ]
    each = by_class(scored.withColumn(PROBABILITY, vector_to_array(PROBABILITY)), LABEL, PROBABILITY, len(trained.classes))
    gains, roc = gains_lift(each, "actual", "score", keys=["class"]), roc_curve(each, "actual", "score", ["class"])
    name = _class_name(trained, "class")
    lines = [_curve(gains, "lift_gain", F.lit(n), F.col("group"), name, F.col("group"), F.col(n)) for n in names]
    return [*lines, _curve(roc, "roc", F.lit("tpr"), F.lit(None), name, F.col("fpr"), F.col("tpr"))]


def _curves(trained: Trained, seen: DataFrame, unseen: DataFrame, key: str, settings: Settings) -> list[DataFrame]:
    """All curves of a model; ``seen`` and ``unseen`` are the training part and the held rest."""
    scored_train, scored = trained.score(seen), trained.score(unseen)
    trees = trained.family in TREE_FAMILIES
    curves: list[DataFrame] = []
    if trained.problem == REGRESSION:
        facts = materialise(actual_vs_predicted(scored, key, LABEL, PREDICTION), "facts")  # of few rows, read by two series
        curves += _series(facts, "Actual vs Predictions", "x", "x", "y_actual", "y_prediction")
        if trees:
            curves.append(_loss(loss_curve_trees(trained.model, scored_train, scored, LABEL), "Loss vs Iterations"))
            curves.append(_importance(trained, unseen))
        elif trained.family != STACKED:
            curves.append(_loss(deviance_curve(trained, seen, unseen, settings), "Loss vs Iterations"))
    else:
        matrix = materialise(confusion_matrix(scored, LABEL, PREDICTION), "matrix")
        curves.append(
            _curve(
                matrix, "confusion_matrix", _class_name(trained, "prediction"), F.lit(None), _class_name(trained, "label"), _no_number(), F.col("count")
            )
        )
        if PROBABILITY in scored.columns:
            curves += _class_curves(trained, scored)
        if trees:
            curves.append(_loss(loss_curve_trees(trained.model, scored_train, scored, LABEL), "Loss vs trees"))
            curves.append(_importance(trained, unseen))
        elif trained.family != STACKED:
            curves.append(_loss(deviance_curve(trained, seen, unseen, settings), "Deviance vs Iter"))
        if trained.family == "DeepLearning":
            curves.append(_importance(trained, unseen, importance_by_permutation(trained, unseen)))
    return curves


def report(
    trained: Trained, frame: DataFrame, key: str, folds: int = 3, settings: Settings = Settings(), training: DataFrame | None = None
) -> Report:
    """``frame`` carries features, ``label``, ``split`` and the key that orders rows.

    The means of the cross-validated metrics are a split of their own, but for ``folds=0``. ``training`` is its training part
    where that is held already, with features and ``label``: curves by iteration read it instead.
    """
    seen = training if training is not None else part(frame, TRAIN)
    names = dict.fromkeys([LABEL, key, *trained.features])
    with held(part(frame, HOLDOUT).select(*[column(c) for c in names])) as unseen:
        curves = _curves(trained, seen, unseen, key, settings)
    lines = reduce(DataFrame.unionByName, curves).select(F.lit(trained.name).alias("model"), "*")
    metrics = metrics_of(trained, frame)
    if folds:
        training = part(frame, TRAIN)
        found = cross_validation_metrics(
            training, key, trained.features, trained.family, trained.problem, folds, trained.classes, settings, trained.positive
        )
        means = found.select(*_named(trained), F.lit("cross_validation").alias(SPLIT), "metric", F.col("mean").alias("value"))
        metrics = metrics.unionByName(means)
    return Report(metrics, lines)


def leaderboard(models: list[Trained], frame: DataFrame, hold: bool = True) -> DataFrame:
    """The metrics of all models, stored. ``frame`` is held while several models are applied, so that it is read once.

    Without ``hold`` each model reads it anew: for frames that are held already.
    """
    names = dict.fromkeys([LABEL, SPLIT, *(c for m in models for c in m.features)])
    chosen = frame.select(*[column(c) for c in names])
    with held(chosen) if hold and len(models) > 1 else nullcontext(chosen) as rows:
        return materialise(reduce(DataFrame.unionByName, [metrics_of(m, rows) for m in models]), "leaderboard")


def store_report(found: Report, path: str) -> str:
    """Two tables below ``path`` with a part per model. Reports of several models stand side by side; storing one again replaces it."""
    for table, name in ((found.metrics, "metrics"), (found.curves, "curves")):
        writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("model").parquet(f"{path}/{name}")
    return path
