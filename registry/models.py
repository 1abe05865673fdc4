"""Splits, training, scoring and evaluation."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.cells import zero_if_missing
from tessella.operators.boosting import Boosting, gradients, level_sums, split_gains
from tessella.operators.curves import last_stage, loss_curve_trees, objective_curve, variable_importance
from tessella.operators.evaluate import (
    actual_vs_predicted,
    auc,
    by_class,
    confusion_matrix,
    gains_lift,
    metrics_classification,
    metrics_multiclass,
    metrics_regression,
    roc_curve,
    summarise_folds,
)
from tessella.operators.features import CLASSIFICATION, REGRESSION, FeatureSpec, fit_features, training_frame
from tessella.operators.merge import Link, merge_two
from tessella.operators.row_id import add_row_id
from tessella.operators.split import HOLDOUT, SPLIT, TRAIN, part, split_frame, with_folds, with_split
from tessella.plans.report import leaderboard, report, store_report
from tessella.plans.score import score, score_axis, score_tables, score_to_csv
from tessella.plans.train import (
    LABEL,
    PREDICTION,
    Settings,
    cross_validation_metrics,
    deviance_curve,
    fit_ols,
    held,
    importance_by_permutation,
    label_index,
    labelled,
    load_model,
    network_deviance_curve,
    prepare,
    save_model,
    train,
    train_family,
    train_stacked,
)
from tessella.scratch import new_path
from tessella.sources.readers import read_csv

from .profiling import rounded_value
from .tables import events_with_gaps, table

SEED = 7
PRICE, QUANTITY = "l_extendedprice", "l_quantity"
LINE_KEY = "l_orderkey"
SETTINGS = Settings(trees=10, rounds=8)


# Inputs


def price_frame(spark, folder):
    """Lineitem prepared for predicting the price."""
    spec = FeatureSpec(
        columns=(QUANTITY, "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
        target=PRICE,
        time=("l_shipdate", None),
        impute_dates=True,
    )
    return training_frame(table(spark, folder, "lineitem"), spec, REGRESSION, keep=[LINE_KEY])


def quality_frame(spark, folder):
    """Documents with their label, prepared for predicting it."""
    documents = merge_two(table(spark, folder, "documents").drop("text"), table(spark, folder, "labels"), [("doc_id", "doc_id")])
    spec = FeatureSpec(columns=("lang", "source", "n_chars", "toxic"), target="quality")
    return training_frame(documents, spec, CLASSIFICATION, keep=["doc_id"])


def flag_frame(spark, folder):
    """Lineitem prepared for predicting the return flag, which has three classes."""
    spec = FeatureSpec(columns=(QUANTITY, "l_discount", "l_linestatus"), target="l_returnflag")
    return training_frame(table(spark, folder, "lineitem"), spec, CLASSIFICATION, keep=[LINE_KEY])


class Setting:
    """A prepared frame with its label, split by key."""

    def __init__(self, spark, folder, frame, target, key, problem):
        prepared = frame(spark, folder)
        self.features, self.key, self.problem = prepared.features, key, problem
        index = label_index(prepared.frame, target) if problem == CLASSIFICATION else None
        self.classes = list(index.labels) if index else []
        self.all = labelled(prepared.frame, target, problem, index)
        self.marked = with_split(self.all, key, SEED)
        self.train, self.holdout = part(self.marked, TRAIN), part(self.marked, HOLDOUT)

    def fit(self, family):
        with self.rows() as rows:
            return rows.fit(family)

    def report(self, family, folds):
        with self.rows() as rows:
            return report(rows.fit(family), self.marked, self.key, folds, SETTINGS, rows.train)

    @contextmanager
    def rows(self):
        with held(self.train.select(LABEL, *self.features)) as frame:
            yield Rows(self, frame)


class Rows:
    """The rows of a setting with the training part held, for all that reads it; the few rows of the holdout are scanned."""

    def __init__(self, setting, training):
        self.setting, self.train = setting, training
        self.holdout = setting.holdout.select(LABEL, *setting.features)
        parts = {TRAIN: self.train, HOLDOUT: self.holdout}
        self.marked = reduce(DataFrame.unionByName, [df.withColumn(SPLIT, F.lit(name)) for name, df in parts.items()])

    def fit(self, family):
        s = self.setting
        return train_family(self.train, s.features, family, s.problem, s.classes, SETTINGS)

    def curve(self, trained):
        return loss_curve_trees(trained.model, trained.score(self.train), trained.score(self.holdout), LABEL)

    def board(self, models):
        return leaderboard(models, self.marked, hold=False)


def price(spark, folder):
    return Setting(spark, folder, price_frame, PRICE, LINE_KEY, REGRESSION)


def quality(spark, folder):
    return Setting(spark, folder, quality_frame, "quality", "doc_id", CLASSIFICATION)


def flag(spark, folder):
    return Setting(spark, folder, flag_frame, "l_returnflag", LINE_KEY, CLASSIFICATION)


def scored_documents(spark, folder):
    """Fixed scores, independent of any model."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    longest = documents.agg(F.max("n_chars")).first()[0]
    scored = merge_two(documents, table(spark, folder, "labels"), [("doc_id", "doc_id")])
    return scored.select(
        "doc_id",
        "quality",
        (F.col("n_chars") > 1500).cast("int").alias("called"),
        F.round(F.col("n_chars") / F.lit(longest), 3).alias("score"),
    )


def exact_scores(spark, folder, scale=1.0, shift=0.0):
    """Scores as they come out of a division, scaled and shifted."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    scored = merge_two(documents, table(spark, folder, "labels"), [("doc_id", "doc_id")])
    score_cell = F.col("n_chars") / F.lit(200_000.0) * F.lit(scale) + F.lit(shift)
    return scored.select("doc_id", "quality", (F.col("n_chars") > 1500).cast("int").alias("called"), score_cell.alias("score"))


def rounded_gains(df):
    names = ("cumulative_data_fraction", "cumulative_lift", "cumulative_capture_rate")
    return df.select("group", *[F.round(c, 6).alias(c) for c in names])


def guessed_prices(spark, folder):
    return table(spark, folder, "lineitem").select(LINE_KEY, PRICE, (F.col(QUANTITY) * 1500).alias("guess"))


# Queries


def ols(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    fitted = last_stage(fit_ols(lineitem, PRICE, [QUANTITY]).model)
    row = [(float(fitted.intercept), float(fitted.coefficients[0]))]
    return spark.createDataFrame(row, "intercept double, slope double").select(
        F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope")
    )


def ols_scores(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    scored = score(fit_ols(lineitem, PRICE, [QUANTITY]).model, lineitem)
    return scored.select(LINE_KEY, "l_linenumber", QUANTITY, F.round(PREDICTION, 2).alias(PREDICTION))


def axis(spark, folder, time=None):
    lineitem = table(spark, folder, "lineitem")
    model = fit_ols(lineitem, PRICE, [QUANTITY]).model
    frame = lineitem if time else add_row_id(lineitem)
    return score_axis(score(model, frame), time).withColumn("y", F.round("y", 2))


def batch(spark, folder):
    """Train on the merged tables, then replay the merge, prepare, predict, write CSV and read it back."""
    link = Link.of("lineitem", "orders", (LINE_KEY, "o_orderkey"))
    tables = {"lineitem": table(spark, folder, "lineitem"), "orders": table(spark, folder, "orders")}
    merged = merge_two(tables["lineitem"], tables["orders"], link.pairs)
    prepare = fit_features(merged, FeatureSpec(columns=(QUANTITY,)))
    model = fit_ols(prepare.transform(merged), PRICE, [QUANTITY]).model
    scored = score_tables(tables, [link.record()], prepare, model)
    chosen = scored.select("l_orderkey_o_orderkey", "l_linenumber", QUANTITY, F.round(PREDICTION, 2).alias(PREDICTION))
    return read_csv(spark, score_to_csv(chosen, new_path(spark, "scores")), chosen.schema)


def compared(spark, folder):
    """Trained on one part, compared on the other."""
    lineitem = table(spark, folder, "lineitem").select(LINE_KEY, QUANTITY, PRICE)
    train_part, holdout = split_frame(lineitem, LINE_KEY, SEED)
    scored = score(fit_ols(train_part, PRICE, [QUANTITY]).model, holdout)
    return actual_vs_predicted(scored, LINE_KEY, PRICE, PREDICTION).withColumn("y_prediction", F.round("y_prediction", 2))


def family_metrics(setting, family):
    def query(spark, folder):
        with setting(spark, folder).rows() as rows:
            return rows.board([rows.fit(family)])

    return query


def stacked(setting):
    def query(spark, folder):
        s = setting(spark, folder)
        return leaderboard([train_stacked(s.train, s.key, s.features, s.problem, classes=s.classes, settings=SETTINGS)], s.marked)

    return query


def board(setting, target):
    """The whole rotation on the training part."""

    def query(spark, folder):
        s = setting(spark, folder)
        models = train(s.train.drop(LABEL), target, s.features, s.problem, settings=SETTINGS)
        return leaderboard(models, s.marked)

    return query


def tree_curve(setting, family):
    def query(spark, folder):
        with setting(spark, folder).rows() as rows:
            return rows.curve(rows.fit(family))

    return query


def history(setting, family):
    def query(spark, folder):
        return objective_curve(spark, setting(spark, folder).fit(family).model)

    return query


def importance(spark, folder):
    s = price(spark, folder)
    return variable_importance(spark, s.fit("DRF").model, s.features)


def full_report(setting, family):
    def query(spark, folder):
        return setting(spark, folder).report(family, 0).curves

    return query


def stored_report(spark, folder):
    s = quality(spark, folder)
    path = store_report(s.report("GLM", 3), new_path(spark, "report"))
    return spark.read.parquet(f"{path}/metrics")


def model_reload(spark, folder):
    """Rows on which the saved and the live model disagree, and all rows."""
    s = price(spark, folder)
    trained = s.fit("GBM")
    loaded = load_model(save_model(trained, new_path(spark, "model")))
    both = loaded.transform(trained.score(s.holdout).select(*s.features, F.col(PREDICTION).alias("live")))
    return both.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("live") != F.col(PREDICTION)).alias("different"))


def folds(spark, folder):
    s = quality(spark, folder)
    return cross_validation_metrics(s.all, s.key, s.features, "GLM", CLASSIFICATION, 5, s.classes, SETTINGS)


def metrics_by_fold(spark, folder):
    scored = with_folds(scored_documents(spark, folder), "doc_id", 5, 1)
    found = summarise_folds(metrics_classification(scored, "quality", "called", "score", ["fold"]))
    return found.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# Checks: what must hold for a fitted model, whatever its random choices


def one_feature_glm(spark, folder):
    """The iterative linear model on one feature, to be compared with the closed form."""
    lineitem = table(spark, folder, "lineitem")
    frame = labelled(lineitem, PRICE, REGRESSION).select(LABEL, QUANTITY)
    fitted = last_stage(train_family(frame, [QUANTITY], "GLM", REGRESSION, settings=SETTINGS).model)
    row = [(float(fitted.intercept), float(fitted.coefficients[0]))]
    return spark.createDataFrame(row, "intercept double, slope double").select(
        F.round("intercept", 2).alias("intercept"), F.round("slope", 4).alias("slope")
    )


def beats_constant(s, families, metric, base):
    """model, metrics (their number), rows, better: than the best constant, on the rows the models have seen."""
    with s.rows() as rows:
        board = rows.board([rows.fit(f) for f in families])
    constant = s.marked.groupBy("split").agg(base.alias("base"), F.count(F.lit(1)).alias("rows"))
    own = board.groupBy("model", "split").agg(
        F.count("metric").alias("metrics"), F.max(F.when(F.col("metric") == metric, F.col("value"))).alias("value")
    )
    seen = own.join(constant, "split").where(F.col("split") == TRAIN)
    return seen.select("model", "metrics", "rows", (F.col("value") < F.col("base")).alias("better"))


def entropy(label):
    """Log loss of the constant that fits a split best."""
    p = F.avg(label)
    return -(p * F.log(p) + (1 - p) * F.log(1 - p))


def regression_checks(spark, folder):
    return beats_constant(price(spark, folder), ("DRF", "GLM", "XGBoost", "GBM"), "Root Mean Square Error", F.stddev_pop(LABEL))


def class_checks(spark, folder):
    return beats_constant(quality(spark, folder), ("GLM", "GBM"), "logloss", entropy(F.col(LABEL)))


def three_class_checks(spark, folder):
    return beats_constant(flag(spark, folder), ("DRF", "GBM", "DeepLearning"), "mean_per_class_error", F.lit(2 / 3))


def board_checks(query):
    """model, split, metrics: who is on a leaderboard, and with how many figures."""

    def counted(spark, folder):
        return query(spark, folder).groupBy("model", "split").agg(F.count("metric").alias("metrics"))

    return counted


def curve_checks(spark, folder):
    """model, series, points, falls: the last training loss is below the first, last: it is the model's own metric."""
    found = []
    for setting, family, metric in ((price, "GBM", "Root Mean Square Error"), (price, "DRF", "Root Mean Square Error"), (quality, "GBM", "logloss")):
        s = setting(spark, folder)
        with s.rows() as rows:
            trained = rows.fit(family)
            curve, board = rows.curve(trained), rows.board([trained])
        ends = curve.groupBy("series").agg(
            F.count(F.lit(1)).alias("points"), F.min_by("value", "position").alias("first"), F.max_by("value", "position").alias("end")
        )
        series = F.when(F.col("split") == TRAIN, "training").otherwise("validation")
        own = board.where(F.col("metric") == metric).select(series.alias("series"), F.col("value").alias("metric"))
        name = F.lit(f"{family} {s.problem}")
        found.append(
            ends.join(own, "series").select(
                name.alias("model"), "series", "points", ((F.col("end") <= F.col("first")) | (F.col("series") != "training")).alias("falls"),
                (F.abs(F.col("end") - F.col("metric")) <= 1e-6 * F.abs("metric")).alias("last"),
            )
        )
    return reduce(lambda a, b: a.unionAll(b), found)


def history_checks(spark, folder):
    """model, falls: the optimiser's objective never rises much and ends below its beginning."""
    rows = []
    for setting, family in ((price, "GLM"), (quality, "GLM"), (flag, "DeepLearning")):
        s = setting(spark, folder)
        values = [r["value"] for r in objective_curve(spark, s.fit(family).model).orderBy("position").collect()]  # iterations
        rows.append((f"{family} {s.problem} {len(s.classes)}", len(values) > 1 and values[-1] <= values[0]))
    return spark.createDataFrame(rows, "model string, falls boolean")


def importance_checks(spark, folder):
    """variables, total of the relative importances, largest scaled one."""
    found = importance(spark, folder)
    return found.agg(
        F.count("variable").alias("variables"), F.round(F.sum("relative"), 9).alias("total"), F.max("scaled").alias("largest"),
        F.bool_and(F.col("relative") >= 0).alias("positive"),
    )


def fold_checks(spark, folder):
    """metric, mean, sd of squared and absolute errors (in thousands) of a line through one feature, over five folds."""
    lineitem = labelled(table(spark, folder, "lineitem"), PRICE, REGRESSION).select(LINE_KEY, QUANTITY, LABEL)
    found = cross_validation_metrics(lineitem, LINE_KEY, [QUANTITY], "GLM", REGRESSION, 5, settings=SETTINGS)
    scale = F.when(F.col("metric") == "Mean Square Error", 1e6).otherwise(1e3)
    found = found.where("metric in ('Mean Square Error', 'Root Mean Square Error', 'Mean Absolute Error')")
    return found.select("metric", F.round(F.col("mean") / scale, 4).alias("mean"), F.round(F.col("sd") / scale, 4).alias("sd"))


def deviance_stages(setting, family):
    def query(spark, folder):
        s = setting(spark, folder)
        if family != "DeepLearning":
            return deviance_curve(s.fit(family), s.train, s.holdout, SETTINGS)
        with s.rows() as rows:
            prepared = prepare(rows.train, s.features, family)
        return network_deviance_curve(prepared, s.train, s.holdout, s.features, s.classes, SETTINGS)

    return query


def toxic_frame(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic"))
    return labelled(labels, "quality", CLASSIFICATION, label_index(labels, "quality"))


def deviance_checks(spark, folder):
    """model, series, value: where the deviance ends, of models that have a closed form."""
    found = []
    lineitem = labelled(table(spark, folder, "lineitem"), PRICE, REGRESSION).select(LINE_KEY, QUANTITY, LABEL)
    for frame, key, feature, problem in ((lineitem, LINE_KEY, QUANTITY, REGRESSION), (toxic_frame(spark, folder), "doc_id", "toxic", CLASSIFICATION)):
        marked = with_split(frame, key, SEED)
        training, holdout = part(marked, TRAIN), part(marked, HOLDOUT)
        classes = ["1", "0"] if problem == CLASSIFICATION else []
        trained = train_family(training, [feature], "GLM", problem, classes, SETTINGS)
        curve = deviance_curve(trained, training, holdout, SETTINGS)
        scale = 1e6 if problem == REGRESSION else 1.0
        ends = curve.groupBy("series").agg(F.round(F.max_by("value", "position") / scale, 4).alias("value"))
        found.append(ends.select(F.lit(problem).alias("model"), "series", "value"))
    return found[0].unionAll(found[1])


def staged_checks(spark, folder):
    """model, series, points, falls, last as in ``curve_checks``, for three classes."""
    found = []
    with flag(spark, folder).rows() as rows:
        trained = {family: rows.fit(family) for family in ("GBM", "DRF")}
        curves = {family: (rows.curve(model), rows.board([model])) for family, model in trained.items()}
    for family, (curve, board) in curves.items():
        series = F.when(F.col("split") == TRAIN, "training").otherwise("validation")
        own = board.where("metric = 'logloss'").select(series.alias("series"), F.col("value").alias("metric"))
        ends = curve.groupBy("series").agg(
            F.count(F.lit(1)).alias("points"), F.min_by("value", "position").alias("first"), F.max_by("value", "position").alias("end")
        )
        close = F.abs(F.col("end") - F.col("metric")) <= 1e-6 * F.col("metric")
        # a forest's own probability is the mean of its trees', as in the curve
        found.append(ends.join(own, "series").select(F.lit(family).alias("model"), "series", "points", close.alias("last")))
    return found[0].unionAll(found[1])


def three_scores(spark, folder):
    """class, actual, score: fixed scores of three classes of lineitem, independent of any model."""
    index = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)
    scores = F.array(F.col(QUANTITY) / 50, F.col("l_discount") + F.col("l_tax"), F.col(PRICE) / 100_000)
    return by_class(table(spark, folder, "lineitem").select(index.alias("label"), scores.alias("p")), "label", "p", 3)


def cut_gains(spark, folder):
    """feature, bin, gain (in millions) of all first cuts of a tree for the price, on bins of three columns."""
    lineitem = table(spark, folder, "lineitem")
    mean = lineitem.agg(F.avg(PRICE)).first()[0]
    bins = F.array(F.floor(F.col(QUANTITY) / 5).cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber"))
    gh = gradients("squared", F.array(F.lit(mean)), F.col(PRICE), 1)
    rows = lineitem.select(bins.alias("bins"), gh.alias("gh"), F.array(F.lit(0)).alias("nodes"))
    gains = split_gains(level_sums(rows), Boosting(l1=1e4, l2=2.0, gamma=5.0, min_child=30.0)).where("gain is not null")
    return gains.select("feature", "bin", F.round(F.col("gain") / 1e6, 3).alias("gain"))


def permuted(spark, folder):
    s = flag(spark, folder)
    return importance_by_permutation(s.fit("DeepLearning"), s.holdout)


def permuted_checks(spark, folder):
    """variable, scaled importance of the one feature a model uses, and of one that is constant."""
    lineitem = table(spark, folder, "lineitem").withColumns({"constant": F.lit(1.5), PRICE: 1500 * F.col(QUANTITY) + F.col("l_tax")})
    trained = fit_ols(lineitem, PRICE, [QUANTITY])
    found = importance_by_permutation(replace(trained, features=[QUANTITY, "constant"]), labelled(lineitem, PRICE, REGRESSION))
    # dealt anew, a column's differences have twice its variance on the average
    own = lineitem.agg((2 * F.pow(F.regr_slope(PRICE, QUANTITY), F.lit(2)) * F.var_pop(QUANTITY)).alias("expected"))
    ratio = F.when(F.col("variable") == QUANTITY, F.round(F.col("relative") / F.col("expected"), 1)).otherwise(F.col("relative"))
    return found.join(own, F.lit(True)).select("variable", "scaled", ratio.alias("ratio"))


def report_checks(spark, folder):
    """curve, series, rows of a report; the confusion matrix as its total."""
    s = quality(spark, folder)
    found = s.report("GBM", 0)
    plain = found.curves.where("curve in ('Loss vs trees', 'Variable Importance')")
    counted = plain.groupBy("curve", "series").agg(F.count(F.lit(1)).alias("rows"))
    matrix = found.curves.where("curve = 'confusion_matrix'").groupBy("label").agg(F.sum("y").cast("long").alias("rows"))
    return counted.unionAll(matrix.select(F.lit("confusion_matrix"), "label", "rows"))


def store_checks(spark, folder):
    """split, metrics of a report that was stored twice."""
    s = quality(spark, folder)
    path, found = new_path(spark, "report"), s.report("GLM", 3)
    for _ in range(2):
        store_report(found, path)
    return spark.read.parquet(f"{path}/metrics").groupBy("model", "split").agg(F.count(F.lit(1)).alias("metrics"))


def filled_actuals(spark, folder):
    return events_with_gaps(spark, folder).select("event_id", zero_if_missing(F.col("value")).alias("value"))


QUERIES = {
    "split_train": lambda s, d: split_frame(table(s, d, "orders"), "o_orderkey", SEED)[0],
    "split_holdout": lambda s, d: split_frame(table(s, d, "orders"), "o_orderkey", SEED)[1],
    "label_index": lambda s, d: labelled(
        table(s, d, "orders"), "o_orderstatus", CLASSIFICATION, label_index(table(s, d, "orders"), "o_orderstatus")
    ).select("o_orderkey", "o_orderstatus", LABEL),
    "train_glm_ols": ols,
    "train_drf": family_metrics(price, "DRF"),
    "train_glm": family_metrics(price, "GLM"),
    "train_xgboost": family_metrics(price, "XGBoost"),
    "train_gbm": family_metrics(price, "GBM"),
    "train_drf_classes": family_metrics(flag, "DRF"),
    "train_glm_classes": family_metrics(quality, "GLM"),
    "train_gbm_classes": family_metrics(flag, "GBM"),
    "train_deep_learning_classes": family_metrics(flag, "DeepLearning"),
    "train_stacked": stacked(price),
    "train_stacked_classes": stacked(quality),
    "leaderboard": board(price, PRICE),
    "leaderboard_classes": board(quality, "quality"),
    "cross_validation": folds,
    "model_reload": model_reload,
    "score": ols_scores,
    "score_axis": axis,
    "score_axis_time": lambda s, d: axis(s, d, "l_shipdate"),
    "score_batch": batch,
    "metrics_regression": lambda s, d: rounded_value(metrics_regression(guessed_prices(s, d), PRICE, "guess"), 4),
    "metrics_classification": lambda s, d: rounded_value(
        metrics_classification(scored_documents(s, d), "quality", "called", "score")
    ),
    "metrics_classification_folds": metrics_by_fold,
    "metrics_multiclass": lambda s, d: rounded_value(
        metrics_multiclass(
            table(s, d, "lineitem").withColumn("guess", F.when(F.col(QUANTITY) > 25, "N").otherwise("R")), "l_returnflag", "guess"
        )
    ),
    "actual_vs_predicted": compared,
    "missing_to_zero": filled_actuals,
    "confusion_matrix": lambda s, d: confusion_matrix(scored_documents(s, d), "quality", "called"),
    "gains_lift": lambda s, d: rounded_gains(gains_lift(scored_documents(s, d), "quality", "score")),
    "roc_curve": lambda s, d: roc_curve(scored_documents(s, d), "quality", "score").select(
        "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    ),
    "auc": lambda s, d: auc(scored_documents(s, d), "quality", "score").select(F.round("auc", 6).alias("auc")),
    "auc_exact": lambda s, d: auc(exact_scores(s, d), "quality", "score").select(F.round("auc", 9).alias("auc")),
    "auc_small_scores": lambda s, d: auc(exact_scores(s, d, 1e-4), "quality", "score").select(F.round("auc", 9).alias("auc")),
    "auc_wide_scores": lambda s, d: auc(exact_scores(s, d, 100.0, -7.0), "quality", "score").select(F.round("auc", 9).alias("auc")),
    "roc_curve_exact": lambda s, d: roc_curve(exact_scores(s, d, 1e-4), "quality", "score").select(
        F.round(F.col("threshold") * 1e6, 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    ),
    "gains_lift_exact": lambda s, d: rounded_gains(gains_lift(exact_scores(s, d, 1e-4), "quality", "score")),
    "metrics_classification_exact": lambda s, d: rounded_value(
        metrics_classification(exact_scores(s, d), "quality", "called", "score")
    ),
    "variable_importance": importance,
    "loss_curve_gbt": tree_curve(price, "GBM"),
    "loss_curve_rf": tree_curve(price, "DRF"),
    "loss_curve_glm": history(price, "GLM"),
    "logloss_curve": tree_curve(quality, "GBM"),
    "logloss_curve_rf": tree_curve(quality, "DRF"),
    "deviance_curve": history(quality, "GLM"),
    "deviance_curve_deep_learning": history(flag, "DeepLearning"),
    "model_report": full_report(price, "DRF"),
    "model_report_classes": full_report(quality, "GBM"),
    "model_metrics_store": stored_report,
    "train_glm_one_feature": one_feature_glm,
    "regression_checks": regression_checks,
    "class_checks": class_checks,
    "three_class_checks": three_class_checks,
    "stacked_checks": board_checks(stacked(price)),
    "leaderboard_checks": board_checks(board(quality, "quality")),
    "curve_checks": curve_checks,
    "history_checks": history_checks,
    "importance_checks": importance_checks,
    "fold_checks": fold_checks,
    "deviance_test_curve": deviance_stages(quality, "GLM"),
    "deviance_test_curve_glm": deviance_stages(price, "GLM"),
    "deviance_test_curve_deep_learning": deviance_stages(flag, "DeepLearning"),
    "deviance_checks": deviance_checks,
    "logloss_curve_classes": tree_curve(flag, "GBM"),
    "staged_checks": staged_checks,
    "gains_lift_classes": lambda s, d: gains_lift(three_scores(s, d), "actual", "score", keys=["class"]).select(
        "class", "group", *[F.round(c, 6).alias(c) for c in ("cumulative_data_fraction", "cumulative_lift", "cumulative_capture_rate")]
    ),
    "roc_curve_classes": lambda s, d: roc_curve(three_scores(s, d), "actual", "score", ["class"]).select(
        "class", F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    ),
    "model_report_three_classes": full_report(flag, "GBM"),
    "second_order_cut_gains": cut_gains,
    "variable_importance_permutation": permuted,
    "permutation_checks": permuted_checks,
    "report_checks": report_checks,
    "store_checks": store_checks,
}


# SQL


def slot_sql(key: str, seed: int, slots: int) -> str:
    return f"(('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 8))::bigint % {slots})"


SCORED = """
  select doc_id, quality, (n_chars > 1500)::int as called,
         round(n_chars / (select max(n_chars) from documents), 3) as score
  from documents join labels using (doc_id)"""

LINE = "select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b from lineitem"

CLIPPED = "least(greatest(score, 1e-15), 1 - 1e-15)"


def classification_sql(source: str, keys: str = "") -> str:
    by, also = (f"group by {keys}", f"{keys},") if keys else ("", "")
    part, onkey = (f"partition by {keys}", f"using ({keys})") if keys else ("", "on true")
    return f"""
      with src as ({source}),
      sums as (
        select {also} count(*)::double as n, count(case when quality = called then 1 end)::double as same,
               count(case when quality = 1 and called = 1 then 1 end)::double as hit,
               sum(quality)::double as pos, sum(called)::double as call,
               avg(-ln(case when quality = 1 then {CLIPPED} else 1 - {CLIPPED} end)) as logloss
        from src {by}),
      bins as (select {also} score, count(*) as n, sum(quality) as p from src group by {also} score),
      cum as (
        select *, sum(p) over ({part} order by score desc) as cp, sum(n) over ({part}) as tn, sum(p) over ({part}) as tp
        from bins),
      area as (select {also} (sum((cp - p / 2.0) * (n - p)) / nullif(any_value(tp)::double * (any_value(tn) - any_value(tp)), 0)) as auc
               from cum {by}),
      wide as (select {also} same / n as accuracy, hit / nullif(call, 0) as precision, hit / nullif(pos, 0) as recall,
                      2 * hit / nullif(call + pos, 0) as f1, logloss, auc
               from sums join area {onkey})
      select {also} metric, value from (
        {' union all '.join(f"select {also} '{m}' as metric, {m} as value from wide"
                            for m in ('accuracy', 'precision', 'recall', 'f1', 'logloss', 'auc'))})"""




def exact_sql(scale: str = "1.0::double", shift: str = "0.0::double") -> str:
    return f"""
      select doc_id, quality, (n_chars > 1500)::int as called, n_chars / 200000.0::double * {scale} + {shift} as score
      from documents join labels using (doc_id)"""


def cumulative_sql(source: str) -> str:
    return f"""
      select score, n, p, sum(n) over (order by score desc) as cn, sum(p) over (order by score desc) as cp,
             sum(n) over () as tn, sum(p) over () as tp
      from (select score, count(*) as n, sum(quality) as p from ({source}) group by score)"""


def auc_sql(source: str, digits: int) -> str:
    return f"""
        select round(sum((cp - p / 2.0) * (n - p)) / (any_value(tp)::double * (any_value(tn) - any_value(tp))), {digits}) as auc
        from ({cumulative_sql(source)})"""


def gains_sql(source: str) -> str:
    return f"""
        select grp as "group", round(rows / tn, 6) as cumulative_data_fraction,
               round(hits / tp / (rows / tn), 6) as cumulative_lift, round(hits / tp, 6) as cumulative_capture_rate
        from (select (floor((cn - n) * 16 / tn::double) + 1)::int as grp, max(cn)::double as rows, max(cp)::double as hits,
                     any_value(tn) as tn, any_value(tp) as tp from ({cumulative_sql(source)}) group by 1)"""


def rows_sql(source: str, key: str) -> str:
    """Rows of each split."""
    split = f"case when {slot_sql(key, SEED, 100)} < 95 then 'train' else 'holdout' end"
    return f"select {split} as split, count(*) as rows from {source} group by 1"


SMALL, WIDE = "1e-4::double", "100.0::double"

THREE_SCORES = """
  select class, score, n, p, sum(n) over (partition by class order by score desc) as cn, sum(p) over (partition by class order by score desc) as cp,
         sum(n) over (partition by class) as tn, sum(p) over (partition by class) as tp
  from (select class, score, count(*) as n, sum(actual) as p from (
          select 0 as class, (l_returnflag = 'A')::int as actual, l_quantity / 50 as score from lineitem
          union all select 1, (l_returnflag = 'N')::int, l_discount + l_tax from lineitem
          union all select 2, (l_returnflag = 'R')::int, l_extendedprice / 100000 from lineitem) group by class, score)"""

ORACLES = {
    "split_train": f"select * from orders where {slot_sql('o_orderkey', SEED, 100)} < 95",
    "split_holdout": f"select * from orders where {slot_sql('o_orderkey', SEED, 100)} >= 95",
    "label_index": """
        select o_orderkey, o_orderstatus, i as label
        from orders join (select o_orderstatus, (row_number() over (order by count(*) desc, o_orderstatus) - 1)::double as i
                          from orders group by o_orderstatus) using (o_orderstatus)""",
    "train_glm_ols": f"select round(a, 6) as intercept, round(b, 6) as slope from ({LINE})",
    "score": f"select l_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, 2) as prediction from lineitem, ({LINE})",
    "score_axis": f"""
        select row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                                           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as x,
               round(a + b * l_quantity, 2) as y
        from lineitem, ({LINE})""",
    "score_axis_time": f"select l_shipdate::varchar as x, round(a + b * l_quantity, 2) as y from lineitem, ({LINE})",
    "score_batch": f"""
        select l_orderkey as l_orderkey_o_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, 2) as prediction
        from lineitem join orders on l_orderkey = o_orderkey, ({LINE})""",
    "metrics_regression": """
        with e as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem),
        m as (select avg((y - p) * (y - p)) as mse, avg(abs(y - p)) as mae,
                     sqrt(avg(power(ln(1 + p) - ln(1 + y), 2))) as rmsle from e)
        select 'Mean Square Error' as metric, round(mse, 4) as value from m
        union all select 'Root Mean Square Error', round(sqrt(mse), 4) from m
        union all select 'Mean Absolute Error', round(mae, 4) from m
        union all select 'Root Mean Square Algorithm Error', round(rmsle, 4) from m
        union all select 'Mean Residual Deviance', round(mse, 4) from m""",
    "metrics_classification": f"select metric, round(value, 6) as value from ({classification_sql(SCORED)})",
    "metrics_classification_folds": f"""
        select metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd
        from ({classification_sql(f"select *, {slot_sql('doc_id', 1007, 5)} as fold from ({SCORED})", 'fold')})
        group by metric""",
    "metrics_multiclass": """
        with g as (select l_returnflag as y, case when l_quantity > 25 then 'N' else 'R' end as p from lineitem),
        c as (select y, count(*)::double as n, count(case when y = p then 1 end)::double as hit,
                     (select count(*) from g h where h.p = g.y)::double as called from g group by y),
        m as (select sum(hit) / sum(n) as accuracy, avg(1 - hit / n) as mean_per_class_error, avg(coalesce(hit / nullif(called, 0), 0)) as precision,
                     avg(hit / n) as recall, avg(2 * hit / (n + called)) as f1 from c)
        select 'accuracy' as metric, round(accuracy, 6) as value from m
        union all select 'mean_per_class_error', round(mean_per_class_error, 6) from m
        union all select 'precision', round(precision, 6) from m
        union all select 'recall', round(recall, 6) from m
        union all select 'f1', round(f1, 6) from m""",
    "actual_vs_predicted": f"""
        with f as (select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b
                   from lineitem where {slot_sql('l_orderkey', SEED, 100)} < 95)
        select (row_number() over (order by l_orderkey, l_extendedprice, a + b * l_quantity) - 1)::int as x,
               l_extendedprice as y_actual, round(a + b * l_quantity, 2) as y_prediction
        from lineitem, f where {slot_sql('l_orderkey', SEED, 100)} >= 95
        order by l_orderkey, l_extendedprice, a + b * l_quantity limit 300""",
    "missing_to_zero": """
        select event_id, case when event_id % 7 = 0 or event_id % 5 = 0 then 0.0::double else value end as value from events""",
    "confusion_matrix": f"select quality as label, called as prediction, count(*) as count from ({SCORED}) group by 1, 2",
    "gains_lift": gains_sql(SCORED),
    "gains_lift_exact": gains_sql(exact_sql(SMALL)),
    "roc_curve": f"""
        select score as threshold, round((cn - cp)::double / (tn - tp), 6) as fpr, round(cp::double / tp, 6) as tpr
        from ({cumulative_sql(SCORED)})""",
    "roc_curve_exact": f"""
        select round(score * 1e6::double, 6) as threshold, round((cn - cp)::double / (tn - tp), 6) as fpr,
               round(cp::double / tp, 6) as tpr
        from ({cumulative_sql(exact_sql(SMALL))})""",
    "auc": auc_sql(SCORED, 6),
    "auc_exact": auc_sql(exact_sql(), 9),
    "auc_small_scores": auc_sql(exact_sql(SMALL), 9),
    "auc_wide_scores": auc_sql(exact_sql(WIDE, "-7.0::double"), 9),
    "metrics_classification_exact": f"select metric, round(value, 6) as value from ({classification_sql(exact_sql())})",
    "model_reload": f"select count(*) as row_count, 0::bigint as different from lineitem where {slot_sql('l_orderkey', SEED, 100)} >= 95",
    "train_glm_one_feature": f"select round(a, 2) as intercept, round(b, 4) as slope from ({LINE})",
    "regression_checks": f"""
        select model, 5::bigint as metrics, rows, true as better
        from (values ('DRF'), ('GLM'), ('XGBoost'), ('GBM')) m(model), ({rows_sql('lineitem', 'l_orderkey')}) where split = 'train'""",
    "class_checks": f"""
        select model, 6::bigint as metrics, rows, true as better
        from (values ('GLM'), ('GBM')) m(model), ({rows_sql('documents join labels using (doc_id)', 'doc_id')})
        where split = 'train'""",
    "three_class_checks": f"""
        select model, metrics::bigint as metrics, rows, true as better
        from (values ('DRF', 6), ('GBM', 6), ('DeepLearning', 6)) m(model, metrics), ({rows_sql('lineitem', 'l_orderkey')}) where split = 'train'""",
    "stacked_checks": """
        select 'StackedEnsemble' as model, split, 5::bigint as metrics from (values ('train'), ('holdout')) s(split)""",
    "leaderboard_checks": """
        select model, split, 6::bigint as metrics
        from (values ('DRF_1'), ('GLM_2'), ('XGBoost_3'), ('GBM_4'), ('DeepLearning_5')) m(model),
             (values ('train'), ('holdout')) s(split)""",
    "curve_checks": f"""
        select model, series, points::bigint as points, true as falls, true as last
        from (values ('GBM regression', {SETTINGS.rounds}), ('DRF regression', {SETTINGS.trees}),
                     ('GBM classification', {SETTINGS.rounds})) m(model, points),
             (values ('training'), ('validation')) s(series)""",
    "history_checks": """
        select model, true as falls
        from (values ('GLM regression 0'), ('GLM classification 2'), ('DeepLearning classification 3')) m(model)""",
    "importance_checks": "select 12::bigint as variables, 1.0::double as total, 1.0::double as largest, true as positive",
    "fold_checks": f"""
        with g as (select *, {slot_sql('l_orderkey', 1007, 5)} as fold from lineitem),
        lines as (select f, regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b
                  from range(5) r(f) join g on fold <> f group by f),
        e as (select fold, avg(power(l_extendedprice - a - b * l_quantity, 2)) / 1e6 as mse,
                     avg(abs(l_extendedprice - a - b * l_quantity)) / 1e3 as mae from g join lines on fold = f group by fold),
        m as (select 'Mean Square Error' as metric, mse as value from e union all select 'Root Mean Square Error', sqrt(mse) from e
              union all select 'Mean Absolute Error', mae from e)
        select metric, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd from m group by metric""",
    "deviance_checks": f"""
        with g as (select *, {slot_sql('l_orderkey', SEED, 100)} < 95 as learned from lineitem),
        line as (select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b from g where learned),
        q as (select *, {slot_sql('doc_id', SEED, 100)} < 95 as learned from labels),
        rates as (select toxic, avg(quality) as p from q where learned group by toxic)
        select '{REGRESSION}' as model, if(learned, 'training', 'test') as series,
               round(avg(power(l_extendedprice - a - b * l_quantity, 2)) / 1e6, 4) as value from g, line group by learned
        union all
        select '{CLASSIFICATION}', if(learned, 'training', 'test'), round(avg(-ln(if(quality = 1, p, 1 - p))), 4)
        from q join rates using (toxic) group by learned""",
    "staged_checks": f"""
        select model, series, points::bigint as points, true as last
        from (values ('GBM', {SETTINGS.rounds}), ('DRF', {SETTINGS.trees})) m(model, points), (values ('training'), ('validation')) s(series)""",
    "gains_lift_classes": f"""
        select class, (floor((cn - n) * 16 / tn::double) + 1)::int as "group", round(max(cn)::double / any_value(tn), 6) as cumulative_data_fraction,
               round((max(cp)::double / any_value(tp)) / (max(cn)::double / any_value(tn)), 6) as cumulative_lift,
               round(max(cp)::double / any_value(tp), 6) as cumulative_capture_rate
        from ({THREE_SCORES}) group by 1, 2""",
    "roc_curve_classes": f"""
        select class, round(score, 9) as threshold, round((cn - cp)::double / (tn - tp), 6) as fpr, round(cp::double / tp, 6) as tpr
        from ({THREE_SCORES})""",
    "second_order_cut_gains": """
        with g as (select (select avg(l_extendedprice) from lineitem) - l_extendedprice as g, l_quantity, l_discount, l_linenumber from lineitem),
        b as (select 0 as feature, floor(l_quantity / 5)::int as bin, g from g union all select 1, round(l_discount * 100)::int, g from g
              union all select 2, l_linenumber, g from g),
        s as (select feature, bin, sum(g) as g, count(*)::double as h from b group by all),
        c as (select feature, bin, sum(g) over w as gl, sum(h) over w as hl, sum(g) over (partition by feature) as ga,
                     sum(h) over (partition by feature) as ha from s window w as (partition by feature order by bin))
        select feature, bin, round((0.5 * (power(greatest(abs(gl) - 1e4, 0), 2) / (hl + 2) + power(greatest(abs(ga - gl) - 1e4, 0), 2) / (ha - hl + 2)
                                          - power(greatest(abs(ga) - 1e4, 0), 2) / (ha + 2)) - 5) / 1e6, 3) as gain
        from c where hl >= 30 and ha - hl >= 30""",
    "permutation_checks": """
        select variable, scaled, ratio from (values ('l_quantity', 1.0::double, 1.0::double), ('constant', 0.0, 0.0)) v(variable, scaled, ratio)""",
    "report_checks": f"""
        select 'Loss vs trees' as curve, series, {SETTINGS.rounds}::bigint as rows from (values ('training'), ('validation')) s(series)
        union all select 'Variable Importance', 'scaled', 4
        union all select 'confusion_matrix', quality::varchar, count(*) from documents join labels using (doc_id)
                  where {slot_sql('doc_id', SEED, 100)} >= 95 group by quality""",
    "store_checks": """
        select 'GLM' as model, split, 6::bigint as metrics from (values ('train'), ('holdout'), ('cross_validation')) s(split)""",
}
