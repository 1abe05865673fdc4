"""A network of sigmoid layers and a softmax, fitted step for step like Spark ML's multilayer perceptron.

Spark ML's own fit takes a pass for each look at the objective, whose small matrix products cost it most of a second per
million rows and core, and shows no weights on the way. Here the rows are stored as stacks of some thousand, the tasks add up
objective and gradient of a stack with numpy, and the driver sees a number for each weight. Starting weights and the finished
model are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import column

# Rows of a partition whose mean loss counts as one, as in Spark ML.
BLOCK = 128
# Rows of a stored stack: its matrices stay in a core's cache.
STACK = 32 * BLOCK
STACKED, SUMS = "x binary, y binary", "sums binary"

# Fixed values of the optimiser, as in Spark ML.
MEMORY, WINDOW, TRIES = 10, 20, 10
DECREASE, CURVATURE = 1e-4, 0.9


def _stacks(width: int, classes: int):
    """Rows of y and x (array) as stacks: a feature after the other, and the labels."""

    def stack(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        cells = [pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary()), pa.array([y.astype(np.int32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["x", "y"])

    def stacked(batches):
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            y, x = batch.column("y"), batch.column("x")
            if y.null_count or x.null_count:
                raise ValueError("a row to learn from has no label or no features")
            y, x = y.to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if ((y < 0) | (y >= classes) | (y != np.floor(y))).any():
                raise ValueError(f"labels must be whole numbers below {classes}")
            waiting.append((x, y))
            if sum(len(y) for _, y in waiting) >= STACK:
                x, y = (np.concatenate(parts) for parts in zip(*waiting))
                whole = len(y) // STACK * STACK
                for i in range(0, whole, STACK):
                    yield stack(x[i : i + STACK], y[i : i + STACK])
                waiting = [(x[whole:], y[whole:])]
        x, y = (np.concatenate(parts) for parts in zip(*waiting)) if waiting else ((), ())
        if len(y):
            yield stack(x, y)

    return stacked


def _layers(weights: np.ndarray, layers: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrix (a row for each output) and constants of every layer, as views."""
    at = 0
    for ins, outs in zip(layers, layers[1:]):
        yield weights[at : at + ins * outs].reshape(ins, outs).T, weights[at + ins * outs : at + (ins + 1) * outs]
        at += (ins + 1) * outs


def _add_stack(sums: np.ndarray, weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray) -> None:
    """Adds to the sums of a stack's blocks: mean losses, then their gradient, then the number of blocks."""
    n, every = len(y), np.arange(len(y))
    tail = n % BLOCK
    share = np.full(n, 1.0 / BLOCK)
    share[n - tail :] = 1.0 / (tail or 1)
    own, values = list(_layers(weights, layers)), [x]
    for matrix, constant in own:
        z = matrix @ values[-1]
        z += constant[:, None]
        if len(values) < len(own):  # sigmoid
            np.exp(np.negative(z, z), z)
            z += 1.0
            np.reciprocal(z, z)
        values.append(z)
    p = values.pop()
    p -= p.max(axis=0)
    np.exp(p, p)
    p /= p.sum(axis=0)
    sums[0] -= share @ np.log(p[y, every])
    p[y, every] -= 1.0
    p *= share
    for (matrix, _), (grown, constant), value in zip(own[::-1], list(_layers(sums[1:-1], layers))[::-1], values[::-1]):
        grown += p @ value.T
        constant += p.sum(axis=1)
        if value is not x:
            p = matrix.T @ p
            p *= value
            p *= 1.0 - value
    sums[-1] += -(-n // BLOCK)


def _task_sums(weights: np.ndarray, layers: Sequence[int]):
    def summed(batches):
        sums = np.zeros(len(weights) + 2)
        with np.errstate(all="ignore"):
            for batch in batches:
                for x, y in zip(batch.column("x"), batch.column("y")):
                    labels = np.frombuffer(y.as_buffer(), np.int32)
                    _add_stack(sums, weights, layers, np.frombuffer(x.as_buffer()).reshape(layers[0], len(labels)), labels)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    return summed


Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class _SearchFailed(Exception):
    """No step along the direction is good enough."""


def _step(look: Callable[[float], tuple[float, float, float]], first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``look`` gives step, value and slope."""
    start = low = look(0.0)
    if start[2] > 0:
        raise _SearchFailed

    def between(left, right) -> float:
        """Where the cubic through both ends is lowest, not too near to either."""
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        d2 = np.sqrt(d1 * d1 - left[2] * right[2])
        width = right[0] - left[0]
        t = right[0] - width * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2)
        return left[0] + 0.1 * width if t < left[0] + 0.1 * width else left[0] + 0.9 * width if t > left[0] + 0.9 * width else t

    def zoom(low, high) -> float:
        for _ in range(TRIES):
            now = look(between(high, low) if low[0] > high[0] else between(low, high))
            if now[1] > start[1] + DECREASE * now[0] * start[2] or now[1] >= low[1]:
                high = now
                continue
            if abs(now[2]) <= CURVATURE * abs(start[2]):
                return now[0]
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
        raise _SearchFailed

    t = first
    for i in range(TRIES):
        now = look(t)
        if not np.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > start[1] + DECREASE * t * start[2] or now[1] >= low[1] and i > 0:
            return zoom(low, now)
        if abs(now[2]) <= CURVATURE * abs(start[2]):
            return now[0]
        if now[2] >= 0:
            return zoom(now, low)
        low, t = now, 1.5 * t
    raise _SearchFailed


def _direction(gradient: np.ndarray, steps: Sequence[np.ndarray], changes: Sequence[np.ndarray]) -> np.ndarray:
    """Of the quasi-Newton method with limited memory, the newest pair first."""
    found, parts = gradient.copy(), []
    scale = (steps[0] @ changes[0]) / (changes[0] @ changes[0]) if len(steps) else 1.0
    if not scale >= 0:
        raise _SearchFailed
    for s, y in zip(steps, changes):
        parts.append((s @ found) / (s @ y))
        found -= parts[-1] * y
    found *= scale
    for s, y, part in list(zip(steps, changes, parts))[::-1]:
        found += (part - (y @ found) / (s @ y)) * s
    return -found


def minimise(objective: Objective, start: np.ndarray, tolerance: float) -> Iterator[tuple[int, np.ndarray, float]]:
    """Iteration, place and value of every state on the way, the first one included; a failed search comes as a state of its own."""
    last: list = [None, None]

    def known(x: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], x):
            last[:] = x.copy(), objective(x)
        return last[1]

    x, (value, gradient) = start, known(start)
    begin, window, steps, changes, failed, i = value, [np.inf], [], [], False, 0
    while True:
        yield i, x, value
        flat = np.linalg.norm(gradient) <= max(tolerance * value, 1e-8)
        if flat or len(window) > 1 and abs(value - max(window)) <= tolerance * begin:
            return
        try:
            way = _direction(gradient, steps, changes)

            def look(t: float) -> tuple[float, float, float]:
                v, g = known(x + way * t)
                return t, v, float(g @ way)

            t = _step(look, 1.0 if i else 1.0 / np.linalg.norm(way))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise _SearchFailed
        except _SearchFailed:
            if failed:
                yield i, x, value
                return
            failed, steps, changes = True, [], []
            continue
        after = x + way * t
        value, grown = known(after)
        steps, changes = [after - x, *steps][:MEMORY], [grown - gradient, *changes][:MEMORY]
        x, gradient, failed, i = after, grown, False, i + 1
        window = [*window, value][-WINDOW:]


@dataclass(frozen=True)
class Summary:
    """How a model came about, by the names of Spark ML's training summaries."""

    objectiveHistory: list[float]
    totalIterations: int


class Run:
    """States of a fit, worked out as they are asked for."""

    def __init__(self, spark: SparkSession, states: Iterator[tuple[int, np.ndarray, float]]):
        self.spark, self.states = spark, states
        self.iteration, self.weights, self.history = -1, None, []

    def until(self, iterations: int) -> tuple[np.ndarray, list[float]]:
        """Weights after so many iterations, or where the run ends before, and the objective up to there."""
        while self.iteration < iterations and (state := next(self.states, None)):
            self.iteration, self.weights, value = state
            self.history.append(value)
        return self.weights, list(self.history)


class Network(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Fits Spark ML's ``MultilayerPerceptronClassificationModel``."""

    def __init__(self, layers: Sequence[int], iterations: int, seed: int, featuresCol: str = "features", labelCol: str = "label", tolerance: float = 1e-6):
        super().__init__()
        self.layers, self.iterations, self.seed, self.tolerance = list(layers), iterations, seed, tolerance
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str):
        return self._set(rawPredictionCol=value)

    def _fit(self, df: DataFrame) -> MultilayerPerceptronClassificationModel:
        with self.run(df) as run:
            return self.fit_on(run)

    @contextmanager
    def run(self, df: DataFrame) -> Iterator[Run]:
        """A run on stored stacks of the rows."""
        cells = F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(column(self.getFeaturesCol())).alias("x")
        stacks = df.select(*cells).mapInArrow(_stacks(self.layers[0], self.layers[-1]), STACKED).persist(StorageLevel.MEMORY_AND_DISK)
        few = stacks.coalesce(df.sparkSession.sparkContext.defaultParallelism)  # a Python task costs as much as ten thousand rows

        def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
            found = few.mapInArrow(_task_sums(weights, self.layers), SUMS).collect()  # a number for each weight and task
            total = np.sum([np.frombuffer(r["sums"]) for r in found], axis=0)
            if not np.any(total):
                raise ValueError("there are no rows to learn from")
            return float(total[0] / total[-1]), total[1:-1] / total[-1]

        try:
            start = self._model(df.sparkSession, None).weights.toArray()
            yield Run(df.sparkSession, minimise(objective, start, self.tolerance))
        finally:
            stacks.unpersist()

    def fit_on(self, run: Run) -> MultilayerPerceptronClassificationModel:
        """The model after this many iterations of a run, which goes on from where it stands."""
        return self._model(run.spark, *run.until(self.iterations))

    def _model(self, spark: SparkSession, weights: np.ndarray | None, history: Sequence[float] = ()) -> MultilayerPerceptronClassificationModel:
        """Spark ML's model of these weights, or of those it begins with: a fit of one row that takes no iteration."""
        start = {} if weights is None else {"initialWeights": DenseVector(weights)}
        names = {n: self.getOrDefault(n) for n in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol")}
        fit = MultilayerPerceptronClassifier(layers=self.layers, maxIter=0, seed=self.seed, **start, **names)
        one = spark.createDataFrame([(DenseVector([0.0] * self.layers[0]), 0.0)], [names["featuresCol"], names["labelCol"]])
        model, summary = fit.fit(one), Summary(list(history), len(history) - 1)
        model.summary = lambda: summary  # not that of the one row
        return model
