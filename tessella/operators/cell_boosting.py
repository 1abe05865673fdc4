"""Boosting one class against the rest on cells: rows whose features fall into the same bins and that share a label.

A tree of Spark ML sees of a value only between which two of its candidate cuts it lies. So the rows of a cell are alike to all
trees of all classes, and a cell with their number as weight stands for them: nothing is left out. There are at most as many
cells as rows, and at most bins ** features * classes of them, whatever the values.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import column
from .boosting import quantile_cuts

BINS, BINNED, WEIGHT = 32, "__binned", "__rows"
# Classes that are fitted side by side: passes over cells are short, and most of their time is not work.
PARALLEL = 4
# Features with at most so many values, by estimate, have them counted one by one.
VALUES = 10_000


def candidate_cuts(df: DataFrame, values: Column, features: int, bins: int = BINS) -> list[list[float]]:
    """Ascending candidate cuts of each feature, by Spark ML's rule but of all rows: halfway between two values, all of them
    if there are few, else such that about equally many rows lie between two cuts. Of features with more than ``VALUES``
    values: quantiles.
    """
    cells = [F.get(values, F.lit(i)) for i in range(features)]
    sizes = df.agg(*[F.approx_count_distinct(c) for c in cells]).first()
    few = [i for i in range(features) if sizes[i] <= VALUES]
    found: list[list[float]] = [[] for _ in range(features)]
    if len(few) < features:
        for i, own in enumerate(quantile_cuts(df, values, features, bins)):
            found[i] = own
    if few:
        each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), cells[i].alias("value")) for i in few])).alias("c"))
        counts: dict[int, list[tuple[float, int]]] = {i: [] for i in few}
        for r in each.groupBy("c.feature", "c.value").count().orderBy("feature", "value").collect():  # a row for each of few values
            counts[r["feature"]].append((r["value"], r["count"]))
        for i in few:
            found[i] = _between(counts[i], bins)
    return found


def _between(counts: list[tuple[float, int]], bins: int) -> list[float]:
    """Cuts between values with their numbers of rows, in ascending order."""
    halfway = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(halfway) < bins:
        return halfway
    stride = sum(n for _, n in counts) / bins
    seen, wanted, found = counts[0][1], stride, []
    for cut, (_, n) in zip(halfway, counts[1:]):
        if abs(seen - wanted) < abs(seen + n - wanted):
            found.append(cut)
            wanted += stride
        seen += n
    return found


class Bins(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector of how many cuts each feature reaches."""

    first = Param(Params._dummy(), "first", "place of each feature's first cut, and of the end", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "ascending cuts of all features", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, first=None, cuts=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        first, cuts = self.getOrDefault(self.first), self.getOrDefault(self.cuts)
        places = [f"__bin{i}" for i in range(len(first) - 1)]
        values = [f"{p}_value" for p in places]
        ends = [[-math.inf, *(cuts[a:b] or [0.0]), math.inf] for a, b in zip(first, first[1:])]
        cells = df.withColumn("__bins", vector_to_array(column(self.getInputCol())))
        cells = cells.withColumns({v: F.get("__bins", F.lit(i)) for i, v in enumerate(values)})
        placed = Bucketizer(splitsArray=ends, inputCols=values, outputCols=places).transform(cells)
        return VectorAssembler(inputCols=places, outputCol=self.getOutputCol()).transform(placed).drop("__bins", *values, *places)


class CellBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Spark ML's boosted trees of one class against the rest, fitted on cells; the model bins its features first."""

    def __init__(self, features: int, boosted: GBTClassifier, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.features, self.boosted = features, boosted
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def _fit(self, df: DataFrame) -> PipelineModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        cuts = candidate_cuts(df.select(vector_to_array(column(features)).alias("x")), F.col("x"), self.features)
        first = [sum(len(c) for c in cuts[:i]) for i in range(len(cuts) + 1)]
        bins = Bins(inputCol=features, outputCol=BINNED, first=first, cuts=[c for own in cuts for c in own])
        rows = bins.transform(df).select(column(label), vector_to_array(BINNED).alias(BINNED))
        counted = rows.groupBy(column(label), BINNED).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
        cells = counted.select(column(label), array_to_vector(BINNED).alias(BINNED), WEIGHT).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            names = {"featuresCol": BINNED, "labelCol": label, "predictionCol": self.getPredictionCol()}
            own = self.boosted.copy().setFeaturesCol(BINNED).setLabelCol(label)
            model = OneVsRest(classifier=own, weightCol=WEIGHT, parallelism=PARALLEL, **names).fit(cells)
        finally:
            cells.unpersist()
        return PipelineModel([bins, model])
