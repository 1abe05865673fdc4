"""Evaluation of scored rows. Only label and score or prediction columns are needed.

Rows are counted per exact score before anything is ordered. Running totals over few scores come from one window; over
more, from a table that is range partitioned and sorted by score: each partition adds up its own part, and only one number
per partition is needed of the others. Null conditions stand behind the counting, so that a model below is applied once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import column, zero_if_missing
from ..scratch import materialise
from .row_id import PART, POSITION, sorted_table, with_offsets

# Metric names as reported to users. The fourth is the root mean squared logarithmic error.
MSE = "Mean Square Error"
RMSE = "Root Mean Square Error"
MAE = "Mean Absolute Error"
RMSLE = "Root Mean Square Algorithm Error"
DEVIANCE = "Mean Residual Deviance"

ACTUAL_ROWS = 300
GROUPS = 16
PROBABILITY_FLOOR = 1e-15
# Counted scores that one task orders; more are spread over a sorted table.
FEW_SCORES = 1 << 9


def _long(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot([column(k) for k in keys], [column(c) for c in names], "metric", "value")


def _log1p(value: Column) -> Column:
    """NaN, not null, where the logarithm is undefined: such rows must show in the average."""
    return F.when(value > -1, F.log1p(value)).when(value.isNotNull(), float("nan"))


def metrics_regression(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """metric, value (per group of ``keys``); rows without label or prediction are left out.

    Averages skip nulls by themselves. A filter would be pushed below the model and score each row twice.
    """
    y, p = column(label).cast("double"), column(prediction).cast("double")
    error = y - p
    mse = F.avg(error * error)
    wide = df.groupBy(*[column(k) for k in keys]).agg(
        mse.alias(MSE),
        F.sqrt(mse).alias(RMSE),
        F.avg(F.abs(error)).alias(MAE),
        F.sqrt(F.avg(F.pow(_log1p(p) - _log1p(y), F.lit(2.0)))).alias(RMSLE),
        mse.alias(DEVIANCE),
    )
    return _long(wide, keys)


def log_loss(label: Column, probability: Column) -> Column:
    """Of one row; ``probability`` belongs to the positive class."""
    clipped = F.least(F.greatest(probability, F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    return -F.log(F.when(label == 1, clipped).otherwise(1 - clipped))


def metrics_classification(
    df: DataFrame, label: str, prediction: str, probability: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """metric, value for labels 0/1: accuracy, precision, recall, f1 and, with a probability, logloss and auc.

    One pass over the rows: they are counted per label, prediction and score, and all figures come from those
    counts. Rows without one of the columns are left out; a score that is NaN counts as missing.
    """
    cells = [column(label).cast("int").alias("y"), column(prediction).cast("int").alias("p")]
    by = [*keys, "y", "p"]
    if probability is not None:
        q = column(probability)
        cells += [_score(q).alias("score"), log_loss(column(label).cast("int"), q).alias("loss")]
        by.append("score")
    rows = df.select(*[column(k) for k in keys], *cells)
    totals = [F.count(F.lit(1)).alias("n")] + ([F.sum("loss").alias("loss")] if probability is not None else [])
    counted = rows.groupBy(*[column(k) for k in by]).agg(*totals)
    complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in by[len(keys) :]])
    counted = counted.withColumns({t: F.when(complete, F.col(t)) for t in ("n", "loss") if t in counted.columns})

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double")

    y, p, n = F.col("y"), F.col("p"), F.col("n")
    hit, positive, called, everything = rows_where((y == 1) & (p == 1)), rows_where(y == 1), rows_where(p == 1), F.sum(n)
    figures = {
        "accuracy": rows_where(y == p) / everything,
        "precision": F.try_divide(hit, called),
        "recall": F.try_divide(hit, positive),
        "f1": F.try_divide(2 * hit, called + positive),
    }
    if probability is not None:
        counted = materialise(counted, "scores")
        figures["logloss"] = F.sum("loss") / everything
    wide = counted.groupBy(*[column(k) for k in keys]).agg(*[v.alias(k) for k, v in figures.items()])
    found = _long(wide, keys)
    if probability is not None:
        bins = counted.groupBy(*[column(k) for k in keys], "score").agg(
            F.sum("n").alias("n"), F.sum(F.when(y == 1, n).otherwise(0)).alias("p")
        )
        found = found.unionByName(_long(_area(_with_totals(bins, keys, counted.count()), keys), keys))
    return found


def _score(score: Column) -> Column:
    value = score.cast("double")
    return F.when(~F.isnan(value), value)


def metrics_multiclass(
    df: DataFrame, label: str, prediction: str, keys: Sequence[str] = (), probability: str | None = None
) -> DataFrame:
    """metric, value: accuracy, mean per-class error, precision, recall and f1 as means over the classes, and logloss.

    ``probability`` is the one given to the row's own class. A class that is never predicted has precision 0, one that
    is only predicted does not count. Rows without label or prediction are left out.
    """
    names = [column(k) for k in keys]
    cells = [column(label).alias("label"), column(prediction).alias("prediction")]
    if probability is not None:
        clipped = F.greatest(column(probability), F.lit(PROBABILITY_FLOOR))
        cells.append((-F.log(clipped)).alias("loss"))
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum("loss").alias("loss")] if probability is not None else [])
    counts = df.select(*names, *cells).groupBy(*names, "label", "prediction").agg(*sums)
    known = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    n, hit = F.when(known, F.col("n")).otherwise(0), known & (F.col("label") == F.col("prediction"))
    loss = F.when(known, F.col("loss")) if probability is not None else F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("label").cast("string").alias("class"), n.alias("n"), F.when(hit, n).otherwise(0).alias("hit"), zero.alias("called"), loss.alias("loss")),
        F.struct(F.col("prediction").cast("string").alias("class"), zero.alias("n"), zero.alias("hit"), n.alias("called"), F.lit(None).cast("double").alias("loss")),
    )
    by_class = (
        counts.select(*names, F.inline(both))
        .groupBy(*names, "class")
        .agg(*[F.sum(c).alias(c) for c in ("n", "hit", "called", "loss")])
        .where("class is not null and n > 0")
    )
    recall = F.col("hit") / F.col("n")
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called")), F.lit(0.0))
    figures = {
        "accuracy": F.sum("hit").cast("double") / F.sum("n"),
        "mean_per_class_error": F.avg(1 - recall),
        "precision": F.avg(precision),
        "recall": F.avg(recall),
        "f1": F.avg(2 * F.col("hit") / (F.col("n") + F.col("called"))),
    }
    if probability is not None:
        figures["logloss"] = F.sum("loss") / F.sum("n")
    return _long(by_class.groupBy(*names).agg(*[v.alias(m) for m, v in figures.items()]), keys)


def summarise_folds(metrics: DataFrame) -> DataFrame:
    """metric, mean, sd over the folds; folds where a metric is undefined do not count."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def by_class(df: DataFrame, label: str, probability: str, classes: int) -> DataFrame:
    """class, actual (1 if ``label`` is the class, else 0), score of every row and class; ``probability`` is an array."""
    known = F.when(column(probability).isNotNull(), column(label).cast("int"))
    cells = [
        F.struct(F.lit(k).alias("class"), (known == k).cast("int").alias("actual"), F.get(column(probability), F.lit(k)).alias("score"))
        for k in range(classes)
    ]
    return df.select(F.inline(F.array(*cells)))


def confusion_matrix(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*[column(k) for k in keys], column(label).alias("label"), column(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def _with_totals(bins: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Adds running totals from the highest score down, and totals, to n and p per key and score.

    ``rows``: at least as many as ``bins`` has. Few are ordered by one window; more are sorted and stored by score.
    """
    if rows <= FEW_SCORES:
        own = Window.partitionBy(*[column(k) for k in keys])
        down = own.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        sums = {f"{kind}_{c}": F.sum(c).over(w) for kind, w in (("cum", down), ("total", own)) for c in ("n", "p")}
        return bins.where("n > 0").withColumns(sums)
    ordered = bins.where("n > 0").withColumn("__down", -F.col("score"))
    table = with_offsets(sorted_table(ordered, [*keys, "__down"]), __n=F.sum("n"), __p=F.sum("p"))
    upto = Window.partitionBy(PART).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    running = table.withColumns({"__n": F.col("__n") + F.sum("n").over(upto), "__p": F.col("__p") + F.sum("p").over(upto)})
    names = [column(k) for k in keys]
    totals = table.groupBy(*names).agg(F.sum("n").alias("total_n"), F.sum("p").alias("total_p"))
    if keys:  # a key's totals begin where those of the keys before it end
        earlier = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)  # over one row per key
        totals = totals.withColumns({f"__before_{c}": F.coalesce(F.sum(f"total_{c}").over(earlier), F.lit(0)) for c in ("n", "p")})
    else:
        totals = totals.withColumns({"__before_n": F.lit(0), "__before_p": F.lit(0)})
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in keys] or [F.lit(True)]
    joined = running.alias("r").join(F.broadcast(totals).alias("t"), reduce(Column.__and__, same))
    return joined.select(
        *[F.col(f"r.`{k}`").alias(k) for k in keys], "score", "n", "p", (F.col("__n") - F.col("__before_n")).alias("cum_n"),
        (F.col("__p") - F.col("__before_p")).alias("cum_p"), "total_n", "total_p",
    )


def score_bins(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per score, with running totals from the highest score down.

    Scores are taken as they are; rows without label or score are left out, and NaN is no score. Ties count together.
    ``keys`` name few groups, such as folds. The counts are stored, so calling this reads ``df`` once.
    """
    value = _score(column(score))
    known = F.when(value.isNotNull(), column(label))
    bins = df.groupBy(*[column(k) for k in keys], value.alias("score")).agg(
        F.count(known).alias("n"), F.sum(known.cast("long")).alias("p")
    )
    stored = materialise(bins, "scores")
    return _with_totals(stored, keys, stored.count())


def _area(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Positives above or level (level ones half) with each negative of the bin.
    pairs = F.sum((F.col("cum_p") - F.col("p") / 2.0) * (F.col("n") - F.col("p")))
    total_p, total_n = F.first("total_p").cast("double"), F.first("total_n").cast("double")
    return bins.groupBy(*[column(k) for k in keys]).agg(F.try_divide(pairs, total_p * (total_n - total_p)).alias("auc"))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    return _area(score_bins(df, label, score, keys), keys)


def roc_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """threshold, fpr, tpr (per group of ``keys``): rates when everything scored at least ``threshold`` is called positive."""
    return score_bins(df, label, score, keys).select(
        *[column(k) for k in keys],
        F.col("score").alias("threshold"),
        F.try_divide((F.col("cum_n") - F.col("cum_p")).cast("double"), F.col("total_n") - F.col("total_p")).alias("fpr"),
        F.try_divide(F.col("cum_p").cast("double"), F.col("total_p")).alias("tpr"),
    )


def gains_lift(df: DataFrame, label: str, score: str, groups: int = GROUPS, keys: Sequence[str] = ()) -> DataFrame:
    """group, cumulative_data_fraction, cumulative_lift, cumulative_capture_rate (per group of ``keys``).

    A score bin belongs to the group its first row falls into, so equal scores are never parted and a
    group may be missing when a bin covers it.
    """
    bins = score_bins(df, label, score, keys)
    group = F.floor((F.col("cum_n") - F.col("n")) * groups / F.col("total_n")).cast("int") + 1
    names = [column(k) for k in keys]
    ends = bins.groupBy(*names, group.alias("group")).agg(
        F.max("cum_n").cast("double").alias("rows"),
        F.max("cum_p").cast("double").alias("hits"),
        F.first("total_n").alias("total_n"),
        F.first("total_p").alias("total_p"),
    )
    fraction, capture = F.col("rows") / F.col("total_n"), F.try_divide(F.col("hits"), F.col("total_p"))
    return ends.select(
        *names,
        "group",
        fraction.alias("cumulative_data_fraction"),
        (capture / fraction).alias("cumulative_lift"),
        capture.alias("cumulative_capture_rate"),
    )


def actual_vs_predicted(df: DataFrame, key: str, label: str, prediction: str, rows: int = ACTUAL_ROWS) -> DataFrame:
    """x, y_actual, y_prediction of the first rows by key; missing values shown as 0."""
    first = (
        df.select(column(key).alias("key"), column(label).alias("y"), column(prediction).alias("p"))
        .orderBy("key", "y", "p")
        .limit(rows)
    )
    place = Window.orderBy("key", "y", "p")  # over the few rows just taken
    return first.select(
        (F.row_number().over(place) - 1).alias("x"),
        zero_if_missing(F.col("y")).alias("y_actual"),
        zero_if_missing(F.col("p")).alias("y_prediction"),
    )
