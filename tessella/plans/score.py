"""Batch scoring as one lazy plan and one write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import column
from ..operators.merge import replay
from ..sources.store import ROW_ID, write_csv
from .train import PREDICTION, PROBABILITY


def score(model: Model, df: DataFrame, classes: Sequence[str] = (), extra: Sequence[str] = ("features", "scaled", "rawPrediction")) -> DataFrame:
    """Input columns plus ``prediction``; with classes, also ``predicted_class`` and one probability each."""
    scored = model.transform(df)
    if classes:
        names = F.array(*[F.lit(c) for c in classes])
        scored = scored.withColumn("predicted_class", F.element_at(names, F.col(PREDICTION).cast("int") + 1))
        if PROBABILITY in scored.columns:
            p = vector_to_array(PROBABILITY)
            scored = scored.withColumns({f"p_{c}": p[i] for i, c in enumerate(classes)}).drop(PROBABILITY)
    helpers = [c for c in scored.columns if c in extra or (c.endswith("__filled") and c not in df.columns)]
    return scored.drop(*helpers)


def score_axis(scored: DataFrame, time: str | None = None) -> DataFrame:
    """x, y from the same row: the time as text, or the row's place counted from 0."""
    x = column(time).cast("string") if time else (F.col(ROW_ID) - 1)
    return scored.select(x.alias("x"), F.col(PREDICTION).alias("y"))


def score_tables(
    tables: Mapping[str, DataFrame], records: Sequence[Mapping], prepare: PipelineModel, model: Model, classes: Sequence[str] = ()
) -> DataFrame:
    """Merge along stored links (or take the only table), prepare, predict."""
    frame = replay(records, tables) if records else next(iter(tables.values()))
    return score(model, prepare.transform(frame), classes)


def score_to_csv(scored: DataFrame, path: str) -> str:
    return write_csv(scored, path)
