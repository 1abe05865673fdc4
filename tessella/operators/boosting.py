"""Second-order boosted trees, grown level by level from sums of gradients and Hessians.

Values are cut into few bins by quantiles once. For each level of a tree, one aggregate adds up gradient and Hessian per
node, feature and bin; the tasks add up their own rows first, stack by stack. Running sums over a feature's bins then give the gain of
every cut, and the best one of each node is all that the driver sees. Trees of all classes of a round grow together.

Bins and margins are stored as stacks of some ten thousand rows, which the tasks read as arrays, anew for each round; the
table before is deleted: no plan holds that of the rounds before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..executors import ship_package
from ..functions.cells import column
from ..scratch import new_path, remove

SQUARED, LOGISTIC, SOFTMAX = "squared", "logistic", "softmax"
VALUES = "__values"
# Rows of a stored stack: the arrays of one are in a core's cache, sums of cells are not added up for a few rows.
STACK = 1 << 15
# Two features are added up together if no feature has more bins, and a task holds no more cells then.
PAIRED, CELLS = 64, 1 << 22
# Bytes of a row group of stored stacks, some of them.
GROUP_BYTES = 4 << 20
STACKED = "bins binary, margin binary, y binary, unknown binary"


@dataclass(frozen=True)
class Boosting:
    """``l1`` and ``l2`` shrink a leaf's weight, ``gamma`` is what a cut must gain, ``min_child`` the Hessian a child needs."""

    rounds: int = 10
    depth: int = 5
    rate: float = 0.3
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    bins: int = 32


@dataclass(frozen=True)
class Tree:
    """By heap number of the node: feature (-1: leaf), cut (values from it on go to the upper child), weight, gain."""

    feature: list[int]
    cut: list[float]
    weight: list[float]
    gain: list[float]


def _literals(values: Sequence, kind: str) -> Column:
    """One expression for all values: a column for each would take longer to build than a level takes to add up."""
    cells = ", ".join(f"{float(v)!r}D" if kind == "double" else str(int(v)) for v in values)
    return F.expr(f"cast(array({cells}) as array<{kind}>)")


def _node(values: Column, feature: Column, cut: Column, depth: int) -> Column:
    """The node a row ends in."""

    def step(node: Column, _: Column) -> Column:
        own = F.get(feature, node)
        return F.when(own >= 0, 2 * node + 1 + (F.get(values, own) >= F.get(cut, node)).cast("int")).otherwise(node)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)


def quantile_cuts(df: DataFrame, values: Column, features: int, bins: int) -> list[list[float]]:
    """Ascending cuts of each feature; a constant one has none."""
    names = [f"v{i}" for i in range(features)]
    cells = df.select(*[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])
    found = cells.approxQuantile(names, [k / bins for k in range(bins + 1)], 0.25 / bins)
    return [sorted(set(q) - {min(q)}) if q else [] for q in found]


def gradients(objective: str, margin: Column, y: Column, classes: int) -> Column:
    """Array of (g, h) of every class."""
    if objective == SQUARED:
        return F.array(F.struct((F.get(margin, F.lit(0)) - y).alias("g"), F.lit(1.0).alias("h")))
    if objective == LOGISTIC:
        p = 1 / (1 + F.exp(-F.get(margin, F.lit(0))))
        return F.array(F.struct((p - y).alias("g"), (p * (1 - p)).alias("h")))
    p = probabilities(objective, margin)
    return F.transform(p, lambda q, k: F.struct((q - (k == y).cast("int")).alias("g"), (2 * q * (1 - q)).alias("h")))


def probabilities(objective: str, margin: Column) -> Column:
    if objective == LOGISTIC:
        p = 1 / (1 + F.exp(-F.get(margin, F.lit(0))))
        return F.array(1 - p, p)
    odds = F.transform(margin, lambda m: F.exp(m - F.array_max(margin)))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda total, x: total + x))


def level_sums(rows: DataFrame) -> DataFrame:
    """class, node, feature, bin, g, h from rows of bins (array), gh and nodes (arrays by class)."""
    by_class = rows.select("bins", F.posexplode(F.arrays_zip("gh", "nodes")).alias("class", "own"))
    each = by_class.select("class", F.col("own.nodes").alias("node"), F.col("own.gh.g").alias("g"), F.col("own.gh.h").alias("h"),
                           F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


SUMS = "class int, node int, feature int, bin int, g double, h double"


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _plain(batch: pa.RecordBatch) -> Iterator[Sums]:
    """Bins by feature, gradients and Hessians by class, of rows of bins and gh (arrays)."""
    if batch.num_rows:
        gh = batch.column("gh").flatten()
        g, h = (pc.fill_null(gh.field(c), 0.0).to_numpy().reshape(batch.num_rows, -1).T for c in ("g", "h"))
        yield batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1).T, g, h


def _nodes(values: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node each row ends in, at most so deep."""
    flat, every = values.ravel(), np.arange(values.shape[1])
    node = np.zeros(len(every), int)
    for _ in range(depth):
        own = feature[node]
        upper = flat[np.maximum(own, 0) * len(every) + every] >= cut[node]
        node = np.where(own >= 0, 2 * node + 1 + upper, node)
    return node


def _task_sums(trees: Sequence[Tree], bins: Sequence[Sequence[int]], level: int, width: int, features: int, read: Callable[..., Iterator[Sums]] = _plain):
    """Sums of a task's rows as in ``level_sums``, for the first ``features`` and the nodes of a level."""
    feature, cut = np.array([t.feature for t in trees]), np.array(bins)
    first, nodes = 2**level - 1, 2**level
    # cells of two features at once take half the passes; the sums of each are the totals over the other
    together = 2 if width <= PAIRED and len(trees) * features * (nodes + 1) * width * width <= CELLS else 1
    groups = [range(f, min(f + together, features)) for f in range(0, features, together)]

    def summed(batches):
        # rows that ended in a leaf above go to one more node, which is left out
        found = [[np.zeros((2, (nodes + 1) * width ** len(own))) for own in groups] for _ in feature]
        for batch in batches:
            for values, g, h in read(batch):
                codes = [values[own[0]].astype(int) if len(own) == 1 else values[own[0]].astype(int) * width + values[own[1]] for own in groups]
                for k, sums in enumerate(found):
                    node = _nodes(values, feature[k], cut[k], level) - first
                    node[node < 0] = nodes
                    starts = {n: node * width**n for n in {len(own) for own in groups}}
                    same = h[k][0] if (h[k] == h[k][0]).all() else None
                    for own, code, total in zip(groups, codes, sums):
                        place = starts[len(own)] + code
                        total[0] += np.bincount(place, g[k], total.shape[1])
                        counted = np.bincount(place, None if same is not None else h[k], total.shape[1])
                        total[1] += counted if same is None else counted * same
        cells = np.zeros((2, len(feature), features, nodes, width))
        for k, sums in enumerate(found):
            for own, total in zip(groups, sums):
                parts = total.reshape(2, nodes + 1, *[width] * len(own))[:, :nodes]
                for i, f in enumerate(own):
                    cells[:, k, f] = parts.sum(axis=3 - i) if len(own) > 1 else parts
        k, f, node, at = np.nonzero((cells != 0).any(axis=0))
        names = [c.split()[0] for c in SUMS.split(", ")]
        sums = [pa.array(cells[i][k, f, node, at]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in (k, node + first, f, at)], *sums], names)

    return summed


def _stack(values: np.ndarray, margin: np.ndarray, y: np.ndarray, unknown: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (values, margin, y, unknown if unknown.any() else unknown[:0])]
    return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in STACKED.split(", ")])


def _stacks(cuts: Sequence[Sequence[float]], base: Sequence[float], objective: str):
    """Rows of y and x (array) as stacks: how many of its cuts each feature reaches, the first margins, and the labels.

    Of a number only the difference of margin and label is kept, in place of the margin: its gradient.
    """
    kind, edges = _bin_type(cuts), [np.array(c, float) for c in cuts]

    def stack(x: np.ndarray, y: np.ndarray, unknown: np.ndarray) -> pa.RecordBatch:
        values = np.array([np.searchsorted(own, cells, "right") for own, cells in zip(edges, x.T)]).astype(kind)
        margin = np.repeat(np.array(base, float)[:, None], len(y), axis=1)
        return _stack(values, margin - y if objective == SQUARED else margin, y[:0] if objective == SQUARED else y, unknown)

    def stacked(batches):
        waiting: list[Sums] = []
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            full = np.full((batch.num_rows, len(edges)), -np.inf)  # a row without a vector reaches no cut
            full[pc.is_valid(x).to_numpy(zero_copy_only=False)] = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            waiting.append((full, pc.fill_null(y, 0.0).to_numpy(zero_copy_only=False), pc.is_null(y).to_numpy(zero_copy_only=False)))
            if sum(len(y) for _, y, _ in waiting) >= STACK:
                parts = [np.concatenate(p) for p in zip(*waiting)]
                whole = len(parts[1]) // STACK * STACK
                for i in range(0, whole, STACK):
                    yield stack(*[p[i : i + STACK] for p in parts])
                waiting = [tuple(p[whole:] for p in parts)]
        if sum(len(y) for _, y, _ in waiting):
            yield stack(*[np.concatenate(p) for p in zip(*waiting)])

    return stacked


def _bin_type(cuts: Sequence[Sequence[float]]) -> np.dtype:
    return np.min_scalar_type(max((len(c) for c in cuts), default=0))


def _unstacked(batch: pa.RecordBatch, kind: np.dtype, features: int, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins by feature, margins by class, labels and which are unknown, of each stack."""
    for cells in zip(*[batch.column(c.split()[0]) for c in STACKED.split(", ")]):
        values, margin, y, unknown = (np.frombuffer(c.as_buffer(), k) for c, k in zip(cells, (kind, float, float, bool)))
        margin = margin.reshape(classes, -1)
        yield values.reshape(features, margin.shape[1]), margin, y, unknown


def _gradients(objective: str, margin: np.ndarray, y: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As in ``gradients``; a row without a label has no gradient."""
    if objective == SQUARED:
        g, h = margin, np.ones(margin.shape)
    elif objective == LOGISTIC:
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
    else:
        odds = np.exp(margin - margin.max(axis=0))
        p = odds / odds.sum(axis=0)
        g, h = p - (np.arange(len(p))[:, None] == y), 2 * p * (1 - p)
    return np.where(unknown, 0.0, g) if len(unknown) else g, h


def _reader(objective: str, kind: np.dtype, features: int, classes: int) -> Callable[..., Iterator[Sums]]:
    def read(batch):
        with np.errstate(over="ignore"):
            for values, *own in _unstacked(batch, kind, features, classes):
                yield values, *_gradients(objective, *own)

    return read


def _moved(trees: Sequence[Tree], bins: Sequence[Sequence[int]], settings: Boosting, kind: np.dtype, features: int):
    """The stacks with the margins that the trees of a round add to."""
    feature, cut, weight = np.array([t.feature for t in trees]), np.array(bins), np.array([t.weight for t in trees])

    def moved(batches):
        for batch in batches:
            for values, margin, y, unknown in _unstacked(batch, kind, features, len(feature)):
                more = [w[_nodes(values, f, c, settings.depth)] for f, c, w in zip(feature, cut, weight)]
                yield _stack(values, margin + settings.rate * np.array(more), y, unknown)

    return moved


def _leaf(values: Column, tree: Tree, cut: Sequence[float], node: int = 0) -> Column:
    """The weight of the leaf a row ends in, as nested conditions."""
    own = tree.feature[node]
    if own < 0:
        return F.lit(float(tree.weight[node]))
    upper = F.get(values, F.lit(own)) >= F.lit(cut[node])
    return F.when(upper, _leaf(values, tree, cut, 2 * node + 2)).otherwise(_leaf(values, tree, cut, 2 * node + 1))


def _shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0)) if l1 else g


def split_gains(sums: DataFrame, settings: Boosting) -> DataFrame:
    """class, node, feature, bin (the last of the lower child), gain, g, h (of the node) of every cut."""
    ordered = Window.partitionBy("class", "node", "feature").orderBy("bin")
    below = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("class", "node", "feature")
    cut = sums.select(
        "class", "node", "feature", "bin",
        *[F.sum(c).over(w).alias(n) for c, w, n in (("g", below, "gl"), ("h", below, "hl"), ("g", whole, "g"), ("h", whole, "h"))],
    )

    def score(g: Column, h: Column) -> Column:
        kept = _shrunk(g, settings.l1)
        return F.try_divide(kept * kept, h + settings.l2)

    gl, hl, g, h = (F.col(c) for c in ("gl", "hl", "g", "h"))
    gain = 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - settings.gamma
    allowed = (hl >= settings.min_child) & (h - hl >= settings.min_child)
    return cut.select("class", "node", "feature", "bin", F.when(allowed, gain).alias("gain"), "g", "h")


def _best(gains: DataFrame, settings: Boosting) -> DataFrame:
    """Of each node the best cut, of equal ones that of the first feature and bin, and its weight as a leaf."""
    known = F.when(F.col("gain") > 0, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    weight = F.try_divide(-_shrunk(F.first("g"), settings.l1), F.first("h") + settings.l2)
    found = gains.groupBy("class", "node").agg(F.max(known).alias("best"), weight.alias("weight"))
    return found.select("class", "node", F.col("best.gain"), (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "weight")


def _stored(rows: DataFrame) -> tuple[DataFrame, str]:
    """The stacks as a table of their own, and where it is. Bins take few of their bits, which this compression sees.

    A task holds a row group to write or read it: the default is for short rows, and would not end one before 100 of them.
    """
    path = new_path(rows.sparkSession, "boosted")
    options = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def grow(stacks: DataFrame, read: Callable[..., Iterator[Sums]], cuts: list[list[float]], settings: Boosting, classes: int) -> list[tuple[Tree, list[int]]]:
    """One tree for each class from stored stacks, with the bins its cuts lie behind."""
    size = 2 ** (settings.depth + 1) - 1
    trees = [Tree([-1] * size, [0.0] * size, [0.0] * size, [0.0] * size) for _ in range(classes)]
    bins = [[0] * size for _ in range(classes)]
    width = 1 + max((len(c) for c in cuts), default=0)
    stacks = stacks.coalesce(stacks.sparkSession.sparkContext.defaultParallelism)  # a Python task costs as much as ten thousand rows
    for level in range(settings.depth + 1):
        # the last level has weights only: one feature's sums are those of the node
        features = len(cuts) if level < settings.depth else 1
        parts = stacks.mapInArrow(_task_sums(trees, bins, level, width, features, read), SUMS)
        # dealt as the running sums need them: a task has few cells, and nothing moves between sums and gains
        dealt = parts.repartition("class", "node", "feature")
        sums = dealt.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        for r in _best(split_gains(sums, settings), settings).collect():  # a row for each node of the level
            tree, node = trees[r["class"]], r["node"]
            tree.weight[node] = r["weight"] or 0.0
            if level < settings.depth and r["feature"] is not None:
                tree.feature[node], tree.gain[node] = r["feature"], r["gain"]
                bins[r["class"]][node] = r["bin"] + 1
                tree.cut[node] = cuts[r["feature"]][r["bin"]]
    return list(zip(trees, bins))


class SecondOrderModel(
    Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Trees as JSON, so that the model is saved and loaded like any stage of a pipeline."""

    state = Param(Params._dummy(), "state", "objective, classes, features, base, rate, depth and trees", TypeConverters.toString)

    def __init__(self, state: str | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def trees(self) -> list[list[Tree]]:
        """By round, then class."""
        return [[Tree(**t) for t in own] for own in self._state()["trees"]]

    @property
    def objective(self) -> str:
        return self._state()["objective"]

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, scaled to a sum of one."""
        gains = [0.0] * self._state()["features"]
        for own in self.trees:
            for tree in own:
                for f, g in zip(tree.feature, tree.gain):
                    if f >= 0:
                        gains[f] += g
        total = sum(gains) or 1.0
        return DenseVector([g / total for g in gains])

    def _steps(self, values: Column) -> list[list[Column]]:
        """By round, then class: what a tree adds to a margin. ``values``: array of the features, best a column that is there."""
        rate = self._state()["rate"]
        return [[rate * _leaf(values, t, t.cut) for t in own] for own in self.trees]

    def margins(self, values: Column) -> Column:
        """Array by round of arrays by class: the margins after 1, 2, .. rounds."""
        rounds = F.array(*[F.array(*own) for own in self._steps(values)])
        first = F.array(_literals(self._state()["base"], "double"))

        def add(sums: Column, more: Column) -> Column:
            return F.concat(sums, F.array(F.zip_with(F.element_at(sums, -1), more, lambda a, b: a + b)))

        return F.slice(F.aggregate(rounds, first, add), 2, len(self.trees))

    def values(self, df: DataFrame) -> DataFrame:
        """Adds the array of the features: taken from the vector once, not in every node."""
        return df.withColumn(VALUES, vector_to_array(column(self.getFeaturesCol())))

    def _transform(self, df: DataFrame) -> DataFrame:
        sums = [F.lit(float(b)) for b in self._state()["base"]]
        for own in self._steps(F.col(VALUES)):
            sums = [a + b for a, b in zip(sums, own)]
        margin, df = F.array(*sums), self.values(df)
        if self.objective == SQUARED:
            return df.withColumn(self.getPredictionCol(), sums[0]).drop(VALUES)
        names = [c for c in (self.getRawPredictionCol(), self.getProbabilityCol()) if c]
        both = df.withColumn("__margin", margin).withColumn("__p", probabilities(self.objective, F.col("__margin")))
        raw = F.array(-F.get("__margin", F.lit(0)), F.get("__margin", F.lit(0))) if self.objective == LOGISTIC else F.col("__margin")
        cells = dict(zip((self.getRawPredictionCol(), self.getProbabilityCol()), (array_to_vector(raw), array_to_vector("__p"))))
        place = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return both.withColumns({n: cells[n] for n in names} | {self.getPredictionCol(): place}).drop("__margin", "__p", VALUES)


class SecondOrderBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """Boosted trees of a number (``classes`` 0), of two classes or of more (labels 0, 1, ..)."""

    def __init__(self, features: int, classes: int = 0, settings: Boosting = Boosting(), featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.features, self.classes, self.settings = features, classes, settings
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str):
        return self._set(rawPredictionCol=value)

    def _base(self, rows: DataFrame, trees: int) -> list[float]:
        """Where the margins begin: the mean of a number, the log odds of two classes, 0 for more."""
        if trees > 1:
            return [0.0] * trees
        mean = rows.agg(F.avg("y")).first()[0] or 0.0
        if self.classes == 0:
            return [float(mean)]
        clipped = min(max(mean, 1e-6), 1 - 1e-6)
        return [math.log(clipped / (1 - clipped))]

    def _fit(self, df: DataFrame) -> SecondOrderModel:
        settings, trees = self.settings, self.classes if self.classes > 2 else 1
        objective = SQUARED if self.classes == 0 else LOGISTIC if self.classes <= 2 else SOFTMAX
        rows = df.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(column(self.getFeaturesCol())).alias("x"))
        cuts = quantile_cuts(rows, F.col("x"), self.features, settings.bins)
        base = self._base(rows, trees)
        kind = _bin_type(cuts)
        read = _reader(objective, kind, self.features, trees)
        ship_package(df.sparkSession)
        now, path = _stored(rows.mapInArrow(_stacks(cuts, base, objective), STACKED))
        grown: list[list[Tree]] = []
        try:
            for _ in range(settings.rounds):
                own = grow(now, read, cuts, settings, trees)
                grown.append([t for t, _ in own])
                if len(grown) < settings.rounds:
                    before = path
                    now, path = _stored(now.mapInArrow(_moved(*zip(*own), settings, kind, self.features), STACKED))
                    remove(df.sparkSession, before)
        finally:
            remove(df.sparkSession, path)
        state = {
            "objective": objective, "features": self.features, "base": base, "rate": settings.rate, "depth": settings.depth,
            "trees": [[vars(t) for t in own] for own in grown],
        }
        model = SecondOrderModel(json.dumps(state))
        names = ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")
        return model._set(**{n: self.getOrDefault(n) for n in names})
