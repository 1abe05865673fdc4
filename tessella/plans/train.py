"""Training a rotation of model families with Spark ML.

A training frame holds numeric feature columns and a target. Every family is one pipeline that fills
what is still missing, assembles the vector and fits; the rows never leave the executors.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from threading import Event, Lock

from pyspark import InheritableThread, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TessellaError
from ..functions.cells import column
from ..operators.boosting import Boosting, SecondOrderBoosting
from ..operators.cell_boosting import CellBoosting
from ..operators.curves import deviance_by_iteration, last_stage, one_vs_rest_probabilities, permutation_importance, steps_taken
from ..operators.evaluate import PROBABILITY_FLOOR, metrics_classification, metrics_multiclass, metrics_regression, summarise_folds
from ..operators.features import CLASSIFICATION, REGRESSION
from ..operators.network import Network
from ..operators.split import with_folds
from ..scratch import materialise

# Bytes that the class names of a target may take: models and the driver hold them.
CLASS_BYTES = 16 << 20
# Seconds between two looks at fits that run.
WAIT = 0.05

FEATURES, SCALED, LABEL, PREDICTION, PROBABILITY = "features", "scaled", "label", "prediction", "probability"

# Model families in slot order.
FAMILIES = ("DRF", "GLM", "XGBoost", "GBM", "DeepLearning")
STACKED = "StackedEnsemble"


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 5
    rounds: int = 10
    hidden: int = 16
    iterations: int = 100
    seed: int = 1


def slots(problem: str) -> tuple[str, ...]:
    """Families that can be trained; Spark ML has no neural network for regression."""
    return FAMILIES if problem == CLASSIFICATION else FAMILIES[:-1]


def rotation(problem: str, max_models: int) -> list[str]:
    """The first ``max_models`` slots; starts over after the last one."""
    names = slots(problem)
    return [names[i % len(names)] for i in range(max_models)]


def estimator(family: str, problem: str, features: int, classes: int = 2, settings: Settings = Settings()):
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if problem == REGRESSION:
        if family == "DRF":
            return RandomForestRegressor(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, **common)
        if family == "GLM":
            return LinearRegression(solver="l-bfgs", maxIter=settings.iterations, tol=1e-6, **common)
        if family == "XGBoost":
            return SecondOrderBoosting(features, 0, Boosting(settings.rounds, settings.depth), **common)
        if family == "GBM":
            return GBTRegressor(maxIter=settings.rounds, maxDepth=settings.depth, seed=settings.seed, **common)
    elif problem == CLASSIFICATION:
        if family == "DRF":
            return RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, **common)
        if family == "GLM":
            return LogisticRegression(maxIter=settings.iterations, **common)
        if family == "DeepLearning":
            return Network([features, settings.hidden, classes], settings.iterations, settings.seed, featuresCol=SCALED, labelCol=LABEL)
        if family == "XGBoost":
            return SecondOrderBoosting(features, classes, Boosting(settings.rounds, settings.depth), **common)
        if family == "GBM":
            boosted = GBTClassifier(maxIter=settings.rounds, maxDepth=settings.depth, seed=settings.seed, **common)
            return boosted if classes == 2 else CellBoosting(features, boosted, **common)
    raise TessellaError(f"no {problem} model for family {family}")


def assemble(names: Sequence[str]) -> list:
    """Fill remaining gaps (date parts of unparseable times) and build the vector."""
    filled = [f"{c}__filled" for c in names]
    return [
        Imputer(strategy="mean", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=FEATURES),
    ]


def scaling(family: str) -> list:
    """A network does not converge on features of very different size; the other families do not mind."""
    return [StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True)] if family == "DeepLearning" else []


def prepare(df: DataFrame, names: Sequence[str], family: str) -> PipelineModel:
    """The fitted stages in front of a family's model."""
    return Pipeline(stages=[*assemble(names), *scaling(family)]).fit(df)


def label_index(df: DataFrame, target: str) -> StringIndexerModel:
    """Classes by descending frequency; a class unknown to the model is an error when training.

    The class names are held by the driver, so a target whose names are too long together is refused. They are counted,
    not estimated.
    """
    names = df.select(column(target).cast("string").alias("name")).distinct()
    classes, size = names.agg(F.count("name"), F.sum(F.octet_length("name"))).first()
    if (size or 0) > CLASS_BYTES:
        raise TessellaError(f"{target} has {classes} values of {size} bytes, too many for classes")
    return StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="frequencyDesc", handleInvalid="error").fit(df)


def labelled(df: DataFrame, target: str, problem: str, index: StringIndexerModel | None = None) -> DataFrame:
    if problem == CLASSIFICATION:
        return index.transform(df)
    return df.withColumn(LABEL, column(target).cast("double"))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame that fits read many times; it spills to disk and is rebuilt if an executor is lost.

    The one shuffle in front evens out partition sizes: every pass would wait for the largest one.
    """
    kept = df.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@dataclass(frozen=True)
class Trained:
    name: str
    family: str
    problem: str
    model: PipelineModel
    features: list[str]
    classes: list[str]
    positive: str | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Boosting one class against the rest gives margins only; their scaled logistic functions are probabilities."""
        scored = self.model.transform(df)
        if isinstance(last_stage(self.model), OneVsRestModel):
            margins = vector_to_array("rawPrediction")
            scored = scored.withColumn(PROBABILITY, array_to_vector(one_vs_rest_probabilities(margins)))
        return scored


def positive_class(classes: Sequence[str], wanted: str | None = None) -> str | None:
    """Of two classes the one that precision, recall, AUC and gains are about: the last in alphabetical order, if none is named.

    It does not depend on which class is rarer.
    """
    if wanted is not None and wanted not in classes:
        raise TessellaError(f"{wanted} is none of the classes {list(classes)}")
    return wanted if wanted is not None else max(classes) if len(classes) == 2 else None


def train_family(
    df: DataFrame,
    names: Sequence[str],
    family: str,
    problem: str,
    classes: Sequence[str] = (),
    settings: Settings = Settings(),
    name: str | None = None,
    positive: str | None = None,
    prepared: PipelineModel | None = None,
) -> Trained:
    """``df`` carries the feature columns and ``label``; ``positive`` names one of two classes.

    With ``prepared``, the fitted stages of ``assemble``, ``df`` carries the vector they make instead.
    """
    fit = estimator(family, problem, len(names), max(len(classes), 2), settings)
    if prepared is None:
        model = Pipeline(stages=[*assemble(names), *scaling(family), fit]).fit(df)
    else:
        model = PipelineModel([*prepared.stages, *Pipeline(stages=[*scaling(family), fit]).fit(df).stages])
    return Trained(name or family, family, problem, model, list(names), list(classes), positive_class(classes, positive))


def train(
    df: DataFrame,
    target: str,
    names: Sequence[str],
    problem: str = REGRESSION,
    max_models: int | None = None,
    settings: Settings = Settings(),
    parallel: int = 1,
    seconds: float | None = None,
    stop: Event | None = None,
    progress: Callable[[Progress], None] | None = None,
) -> list[Trained]:
    """Train the rotation on one held copy of the frame: labels and assembled vectors, whose means are fitted once.

    ``parallel`` models are fitted at a time. When ``seconds`` are over, or ``stop`` is set, the jobs of unfinished fits are
    cancelled; what is finished by then is returned, in slot order. ``progress`` is told of every finished model.
    """
    index = label_index(df, target) if problem == CLASSIFICATION else None
    classes = list(index.labels) if index else []
    chosen = rotation(problem, max_models or len(slots(problem)))
    frame = labelled(df, target, problem, index).select(LABEL, *[column(c) for c in names])
    prepared = Pipeline(stages=assemble(names)).fit(frame)
    with held(prepared.transform(frame).select(LABEL, FEATURES)) as ready:

        def fit(i: int) -> Trained:
            family = chosen[i]
            return train_family(ready, names, family, problem, classes, settings, f"{family}_{i + 1}", prepared=prepared)

        return within_budget(df.sparkSession, fit, len(chosen), parallel, seconds, stop, progress)


@dataclass(frozen=True)
class Progress:
    """A finished model, how many of them there are, the seconds so far, and those left at this rate."""

    model: Trained
    finished: int
    of: int
    seconds: float
    left: float


def within_budget(
    spark: SparkSession,
    fit: Callable[[int], Trained],
    count: int,
    parallel: int = 1,
    seconds: float | None = None,
    stop: Event | None = None,
    progress: Callable[[Progress], None] | None = None,
) -> list[Trained]:
    """The models 0 to ``count`` - 1 that are finished in time, in this order.

    Fits run in threads whose jobs carry a tag. An error of one cancels the others and is raised.
    """
    context, tag = spark.sparkContext, f"fits-{uuid.uuid4().hex}"
    began, over, lock = time.monotonic(), Event(), Lock()
    waiting, found, errors = list(range(count)), {}, []

    def work() -> None:
        context.addJobTag(tag)
        while not over.is_set():
            with lock:
                if not waiting:
                    return
                i = waiting.pop(0)
            try:
                model = fit(i)
            except Exception as error:
                if not over.is_set():  # else its jobs were cancelled
                    errors.append(error)
                    over.set()
                return
            with lock:
                if over.is_set():
                    return
                found[i] = model
                took = time.monotonic() - began
                if progress:
                    progress(Progress(model, len(found), count, took, took / len(found) * (count - len(found))))

    threads = [InheritableThread(target=work, session=spark) for _ in range(max(1, min(parallel, count)))]
    for thread in threads:
        thread.start()
    try:
        while any(t.is_alive() for t in threads) and not over.is_set():
            if stop is not None and stop.is_set() or seconds is not None and time.monotonic() - began >= seconds:
                break
            next(t for t in threads if t.is_alive() or t is threads[-1]).join(WAIT)
    finally:
        with lock:
            over.set()
        while any(t.is_alive() for t in threads):  # a fit may start a job just after a cancel
            context.cancelJobsWithTag(tag)
            threads[0].join(WAIT) if threads[0].is_alive() else time.sleep(WAIT)
    if errors:
        raise errors[0]
    return [found[i] for i in sorted(found)]


def deviance_curve(trained: Trained, training: DataFrame, holdout: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Mean deviance on both frames by iteration of a linear model, which is fitted again with fewer iterations, or of a network.

    ``training`` is what the model was fitted on: as many iterations as it took give the model itself.
    """
    prepared = PipelineModel(trained.model.stages[:-1])
    if trained.family == "DeepLearning":
        return network_deviance_curve(prepared, training, holdout, trained.features, trained.classes, settings)
    ready, unseen = (prepared.transform(df).select(LABEL, FEATURES) for df in (training, holdout))

    with held(ready) as kept:

        def fit(iterations: int):
            if _is_whole_run(trained, iterations):
                return last_stage(trained.model)
            cut = replace(settings, iterations=iterations)
            return estimator(trained.family, trained.problem, len(trained.features), max(len(trained.classes), 2), cut).fit(kept)

        return deviance_by_iteration(fit, settings.iterations, kept, unseen, LABEL, trained.problem == CLASSIFICATION)


def network_deviance_curve(
    prepared: PipelineModel, training: DataFrame, holdout: DataFrame, names: Sequence[str], classes: Sequence[str], settings: Settings = Settings()
) -> DataFrame:
    """``deviance_curve`` of a network that is not fitted yet: one run passes all points.

    ``prepared`` holds the stages in front of it, see ``prepare``.
    """
    ready, unseen = (prepared.transform(df).select(LABEL, SCALED) for df in (training, holdout))

    with held(ready) as kept, ExitStack() as runs:
        run = None

        def fit(iterations: int):
            nonlocal run
            cut = replace(settings, iterations=iterations)
            network = estimator("DeepLearning", CLASSIFICATION, len(names), max(len(classes), 2), cut)
            run = run or runs.enter_context(network.run(kept))
            return network.fit_on(run)

        return deviance_by_iteration(fit, settings.iterations, kept, unseen, LABEL, True)


def _is_whole_run(trained: Trained, iterations: int) -> bool:
    """Whether the fit of a model ended within so many iterations, and would so again."""
    whole = last_stage(trained.model)
    if not whole.hasSummary:
        return False
    taken = steps_taken(whole)
    return taken == iterations or taken < min(iterations, whole.getMaxIter())


def importance_by_permutation(trained: Trained, df: DataFrame, seed: int = 1) -> DataFrame:
    """``permutation_importance`` of the features: growth of the squared error, or of the log loss of a row's class."""
    if trained.problem == REGRESSION:
        error = F.col(LABEL) - F.col(PREDICTION)
        loss = error * error
    else:
        loss = -F.log(F.greatest(F.element_at(vector_to_array(PROBABILITY), F.col(LABEL).cast("int") + 1), F.lit(PROBABILITY_FLOOR)))
    rows = df.select(LABEL, *[column(c) for c in trained.features])
    return permutation_importance(trained.score, rows, trained.features, loss, seed)


def fit_ols(df: DataFrame, target: str, names: Sequence[str]) -> Trained:
    """Least squares in closed form, for up to 4096 features."""
    stages = [*assemble(names), GeneralizedLinearRegression(family="gaussian", featuresCol=FEATURES, labelCol=LABEL)]
    model = Pipeline(stages=stages).fit(labelled(df, target, REGRESSION))
    return Trained("OLS", "GLM", REGRESSION, model, list(names), [])


def _base(family: str, problem: str, features: int, classes: int, settings: Settings, position: int):
    """Estimator with output columns of its own, and the one the second level reads."""
    fit = estimator(family, problem, features, classes, settings)
    fit.setPredictionCol(f"base{position}")
    if problem == REGRESSION:
        return fit, f"base{position}"
    fit.setProbabilityCol(f"base{position}_p").setRawPredictionCol(f"base{position}_raw")
    return fit, f"base{position}_p"


def train_stacked(
    df: DataFrame,
    key: str,
    names: Sequence[str],
    problem: str,
    families: Sequence[str] = ("DRF", "GLM"),
    folds: int = 3,
    classes: Sequence[str] = (),
    settings: Settings = Settings(),
) -> Trained:
    """Linear model over the predictions of other families.

    The second level learns from rows scored by models that have not seen them. All families of a fold
    are applied one after the other, so a row carries its predictions along and nothing is joined.
    Families without probabilities (boosting of more than two classes) cannot be stacked.
    """
    count = max(len(classes), 2)
    marked = with_folds(df, key, folds, settings.seed).select(LABEL, "fold", *[column(c) for c in names])
    prepare = Pipeline(stages=assemble(names)).fit(marked)
    bases = [_base(f, problem, len(names), count, settings, i) for i, f in enumerate(families)]
    outputs = [output for _, output in bases]
    unseen = []
    with held(prepare.transform(marked).select(LABEL, "fold", FEATURES)) as frame:
        first = [fit.fit(frame) for fit, _ in bases]
        for i in range(folds):
            scored = frame.where(F.col("fold") == i)
            for fit, _ in bases:
                scored = fit.fit(frame.where(F.col("fold") != i)).transform(scored)
            unseen.append(scored.select(LABEL, *outputs))
        gather = VectorAssembler(inputCols=outputs, outputCol="base_features")
        second = estimator("GLM", problem, len(outputs), count, settings).setFeaturesCol("base_features")
        # a fit reads its rows three times: without this the models of all folds would be applied each time
        rows = reduce(DataFrame.unionByName, unseen).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            level = Pipeline(stages=[gather, second]).fit(rows)
        finally:
            rows.unpersist()
    model = PipelineModel([*prepare.stages, *first, *level.stages])
    return Trained(STACKED, STACKED, problem, model, list(names), list(classes), positive_class(classes))


def as_binary(df: DataFrame, classes: Sequence[str], positive: str | None) -> DataFrame:
    """Adds actual and called (1 for the positive class, else 0) and p1, the probability of the positive class."""
    place = list(classes).index(positive) if positive in classes else 1
    return df.withColumns(
        {
            "actual": (F.col(LABEL) == place).cast("int"),
            "called": (F.col(PREDICTION) == place).cast("int"),
            "p1": vector_to_array(PROBABILITY)[place],
        }
    )


def class_metrics(scored: DataFrame, classes: Sequence[str], positive: str | None, keys: Sequence[str]) -> DataFrame:
    """metric, value of scored rows, for two classes or more."""
    if len(classes) <= 2:
        return metrics_classification(as_binary(scored, classes, positive), "actual", "called", "p1", keys)
    own = PROBABILITY if PROBABILITY in scored.columns else None
    if own:
        scored = scored.withColumn(own, F.element_at(vector_to_array(own), F.col(LABEL).cast("int") + 1))
    return metrics_multiclass(scored, LABEL, PREDICTION, keys, own)


def cross_validated(
    df: DataFrame, key: str, names: Sequence[str], family: str, problem: str, folds: int = 5, classes: Sequence[str] = (), settings: Settings = Settings()
) -> DataFrame:
    """label, fold, prediction (and probability) of every row, by a model that has not seen it. Folds hang on the key.

    Models are fitted and applied to one held copy of the frame, and the scores are stored.
    """
    marked = with_folds(df, key, folds, settings.seed)

    def fit(frame: DataFrame) -> Trained:
        if family == STACKED:
            return train_stacked(frame, key, names, problem, classes=classes, settings=settings)
        return train_family(frame, names, family, problem, classes, settings)

    with held(marked.select(LABEL, "fold", *[column(c) for c in dict.fromkeys([key, *names])])) as frame:
        parts = [fit(frame.where(F.col("fold") != i)).score(frame.where(F.col("fold") == i)) for i in range(folds)]
        wanted = [c for c in (LABEL, "fold", PREDICTION, PROBABILITY) if all(c in p.columns for p in parts)]
        return materialise(reduce(DataFrame.unionByName, [p.select(*wanted) for p in parts]), "folds")


def cross_validation_metrics(
    df: DataFrame,
    key: str,
    names: Sequence[str],
    family: str,
    problem: str,
    folds: int = 5,
    classes: Sequence[str] = (),
    settings: Settings = Settings(),
    positive: str | None = None,
) -> DataFrame:
    """metric, mean, sd over the folds."""
    scored = cross_validated(df, key, names, family, problem, folds, classes, settings)
    if problem == REGRESSION:
        return summarise_folds(metrics_regression(scored, LABEL, PREDICTION, ["fold"]))
    return summarise_folds(class_metrics(scored, classes, positive_class(classes, positive), ["fold"]))


def save_model(trained: Trained, path: str) -> str:
    trained.model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
