"""Feature preparation as a Spark ML pipeline.

The steps keep a fixed order: split the time column, cast numbers, index categories, fill gaps with
means. Each step is one multi-column stage. Plain steps are SQLTransformer stages, so a saved
pipeline needs no Python classes to load, except for categories (CategoryCount, TableIndexer).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import DATE_PARTS, column, quoted, to_second_sql
from ..functions.kinds import BOOLEAN, NUMERIC, TEXT, effective_types, kind, require_flat
from .indexing import CategoryCount, TableIndexer
from .projections import cast_to_double, drop_empty_columns, drop_missing_target, select_columns, without_target

CLASSIFICATION, REGRESSION = "classification", "regression"

# Bytes that a column's labels may take on the driver and in the model; beyond, they live in a table.
LABEL_BYTES = 8 << 20
# Allowance for the error of the estimated number of labels.
MARGIN = 1.3


@dataclass(frozen=True)
class FeatureSpec:
    """What to prepare. ``time`` is (column, pattern); the pattern may be None for a time type."""

    columns: tuple[str, ...]
    target: str | None = None
    time: tuple[str, str | None] | None = None
    corrected_types: Mapping[str, str] | None = None
    impute_dates: bool = False
    nominal: bool = False  # keep category metadata: categories are then not passed through the imputer
    label_bytes: int = LABEL_BYTES

    def inputs(self) -> list[str]:
        return without_target(self.columns, self.target) if self.target else list(self.columns)


@dataclass(frozen=True)
class _Roles:
    numbers: list[str]  # cast to double
    recast: dict[str, str]  # read as text first
    categories: list[str]
    times: list[str]  # the nominated time column

    def outputs(self) -> list[str]:
        return [*self.numbers, *[index_name(c) for c in self.categories], *date_names(self.times)]


def index_name(name: str) -> str:
    return f"{name}Index"


def date_names(times: Sequence[str]) -> list[str]:
    return [f"{c}_{part}" for c in times for part in DATE_PARTS]


def _roles(df: DataFrame, spec: FeatureSpec) -> _Roles:
    inputs = df.select(*[column(c) for c in spec.inputs()])
    require_flat(inputs.schema)
    corrections = {c: t for c, t in (spec.corrected_types or {}).items() if c in inputs.columns}
    types = effective_types(inputs.schema, corrections)
    times = [spec.time[0]] if spec.time else []
    numbers, categories, recast = [], [], {}
    for name, data_type in types.items():
        if name in times:
            continue
        if kind(data_type) in (NUMERIC, BOOLEAN):
            numbers.append(name)
        else:
            # Text, and times that were not nominated: those are categories by their text.
            categories.append(name)
            if kind(inputs.schema[name].dataType) != TEXT:
                recast[name] = "string"
    return _Roles(numbers, recast, categories, times)


def feature_names(df: DataFrame, spec: FeatureSpec) -> list[str]:
    """Columns that come out of the prepared frame, in feature order."""
    return _roles(df, spec).outputs()


def _replace(cells: Mapping[str, str], dropped: Sequence[str] = ()) -> SQLTransformer:
    gone = ", ".join(quoted(c) for c in dict.fromkeys([*dropped, *cells]))
    new = "".join(f", {sql} AS {quoted(name)}" for name, sql in cells.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}){new} FROM __THIS__")


def split_date(df: DataFrame, name: str, pattern: str | None = None) -> list[SQLTransformer]:
    """Replace a time column by its parts, as doubles; text that does not parse gives nulls."""
    parsed = f"{name}__parsed"
    parts = ", ".join(
        f"cast({function}({quoted(parsed)}) AS double) AS {quoted(f'{name}_{part}')}" for part, function in DATE_PARTS.items()
    )
    sql = to_second_sql(name, df.schema[name].dataType, pattern)
    return [
        SQLTransformer(
            statement=f"SELECT * EXCEPT ({quoted(name)}, {quoted(parsed)}), {parts} "
            f"FROM (SELECT *, {sql} AS {quoted(parsed)} FROM __THIS__)"
        )
    ]


def numbers_to_double(names: Sequence[str]) -> list[SQLTransformer]:
    return [_replace({c: f"try_cast({quoted(c)} AS double)" for c in names})] if names else []


def _label_bytes(df: DataFrame, names: Sequence[str]) -> list[float]:
    """Bytes of all labels at most: their number times the longest one."""
    figures = [f for c in names for f in (F.approx_count_distinct(column(c)), F.max(F.octet_length(column(c).cast("string"))))]
    row = df.agg(*figures).first()
    return [MARGIN * row[2 * i] * (row[2 * i + 1] or 0) for i in range(len(names))]


def index_categories(df: DataFrame, names: Sequence[str], label_bytes: int = LABEL_BYTES) -> list:
    """Index by descending frequency, ties alphabetical; null and unseen values share the last index.

    The bytes of the labels decide where they live: in an array of the model, or in a table. Index and metadata (the
    number of categories) are the same for both.
    """
    if not names:
        return []
    sizes = dict(zip(names, _label_bytes(df, names)))
    short = [c for c in names if sizes[c] <= label_bytes]
    stages: list = []
    if short:
        stages.append(
            StringIndexer(
                inputCols=short,
                outputCols=[index_name(c) for c in short],
                handleInvalid="keep",
                stringOrderType="frequencyDesc",
            )
        )
        stages += [CategoryCount(inputCol=index_name(c)) for c in short]
    stages += [TableIndexer(inputCol=c, outputCol=index_name(c)) for c in names if c not in short]
    return [*stages, _replace({}, names)]


def impute_means(names: Sequence[str]) -> list[Imputer]:
    """Null and NaN become the column's mean, in place."""
    return [Imputer(strategy="mean", inputCols=list(names), outputCols=list(names))] if names else []


def build_pipeline(df: DataFrame, spec: FeatureSpec) -> Pipeline:
    """Unfitted stages for the spec; reads the data only to estimate the number of labels."""
    roles = _roles(df, spec)
    filled = list(roles.numbers)
    if not spec.nominal:
        filled += [index_name(c) for c in roles.categories]
    if spec.impute_dates:
        filled += date_names(roles.times)
    recast = {c: f"cast({quoted(c)} AS string)" for c in roles.recast}
    return Pipeline(
        stages=[
            *[s for c in roles.times for s in split_date(df, c, spec.time[1])],
            *numbers_to_double(roles.numbers),
            *([_replace(recast)] if recast else []),
            *index_categories(df, roles.categories, spec.label_bytes),
            *impute_means(filled),
        ]
    )


def fit_features(df: DataFrame, spec: FeatureSpec) -> PipelineModel:
    return build_pipeline(df, spec).fit(df)


def save_features(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_features(path: str) -> PipelineModel:
    """The fitted stages as saved; nothing is learned from the frame they are applied to."""
    return PipelineModel.load(path)


@dataclass(frozen=True)
class TrainingFrame:
    frame: DataFrame
    features: list[str]
    prepare: PipelineModel


def training_frame(
    df: DataFrame, spec: FeatureSpec, problem: str = REGRESSION, keep: Sequence[str] = (), drop_empty: bool = False
) -> TrainingFrame:
    """Select, prepare, cast the target unless it is a class, drop rows without a target.

    ``keep`` names columns, such as a key, that travel along without being features.
    """
    names = list(dict.fromkeys([*spec.columns, *([spec.target] if spec.target else [])]))
    names = [c for c in names if c != "id" or c in keep]
    chosen = select_columns(df, names)
    if drop_empty:
        chosen = drop_empty_columns(chosen)
    extra = [column(c) for c in keep if c not in chosen.columns]
    inputs = [c for c in spec.inputs() if c in chosen.columns]
    spec = FeatureSpec(
        tuple(inputs), spec.target, spec.time, spec.corrected_types, spec.impute_dates, spec.nominal, spec.label_bytes
    )
    model = fit_features(chosen, spec)
    frame = model.transform(df.select(*[column(c) for c in chosen.columns], *extra))
    if spec.target:
        if problem != CLASSIFICATION:
            frame = cast_to_double(frame, spec.target)
        frame = drop_missing_target(frame, spec.target)
    return TrainingFrame(frame, feature_names(chosen, spec), model)


__all__ = [
    "CLASSIFICATION",
    "REGRESSION",
    "FeatureSpec",
    "TrainingFrame",
    "build_pipeline",
    "feature_names",
    "fit_features",
    "impute_means",
    "index_categories",
    "load_features",
    "numbers_to_double",
    "save_features",
    "split_date",
    "training_frame",
]
