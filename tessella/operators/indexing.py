"""Category indexing for columns with too many values for a label array on the driver."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import column
from ..scratch import new_path
from .value_table import BROADCAST_BYTES, Facts, category_table, look_up, table_facts


def _counted(dataset: DataFrame, name: str, count: int) -> DataFrame:
    """Metadata that a column is a category of ``count`` values; the labels are not repeated there."""
    attribute = {"ml_attr": {"name": name, "type": "nominal", "num_vals": count}}
    return dataset.withMetadata(name, attribute)


class CategoryCount(Estimator, HasInputCol, DefaultParamsReadable, MLWritable):
    """Replaces the labels in a category's metadata, which can be long, by their number. Reads no rows."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CategoryCountModel:
        labels = dataset.schema[self.getInputCol()].metadata["ml_attr"]["vals"]
        return self._copyValues(CategoryCountModel()._set(count=len(labels)))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)


class CategoryCountModel(Model, HasInputCol, DefaultParamsReadable, MLWritable):
    count = Param(Params._dummy(), "count", "number of categories", typeConverter=TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return _counted(dataset, self.getInputCol(), self.getOrDefault(self.count))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)


class _TableIndexerParams(HasInputCol, HasOutputCol):
    broadcastBytes = Param(
        Params._dummy(), "broadcastBytes", "largest index table that is broadcast", typeConverter=TypeConverters.toInt
    )

    def __init__(self):
        super().__init__()
        self._setDefault(broadcastBytes=BROADCAST_BYTES)


class TableIndexer(Estimator, _TableIndexerParams, DefaultParamsReadable, MLWritable):
    """Same indices as StringIndexer with ``keep``, held in a written table instead of driver memory."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, broadcastBytes: int = BROADCAST_BYTES):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TableIndexerModel:
        path = new_path(dataset.sparkSession, "index")
        category_table(dataset, self.getInputCol()).write.parquet(path)
        model = TableIndexerModel(path)
        model._set(facts=[float(x) for x in table_facts(model.table())])
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)


class TableIndexerModel(Model, _TableIndexerParams, MLWritable, MLReadable):
    """Looks values up in the index table; null and unseen values get the next free index. Applying it starts no job."""

    facts = Param(Params._dummy(), "facts", "figures of the index table", typeConverter=TypeConverters.toListFloat)

    def __init__(self, path: str = ""):
        super().__init__()
        self.path = path

    def table(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.path)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, output, table = self.getInputCol(), self.getOutputCol(), self.table()
        facts = Facts(*(int(x) for x in self.getOrDefault(self.facts)))
        key = column(source).cast("string")
        found = look_up(dataset, key, table, output, self.getOrDefault(self.broadcastBytes), facts)
        filled = found.withColumn(output, F.coalesce(column(output), F.lit(float(facts.values))))
        return _counted(filled, output, facts.values + 1)

    def write(self) -> MLWriter:
        return _TableIndexerModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableIndexerModelReader(cls)


class _TableIndexerModelWriter(MLWriter):
    """The table is copied into the model's folder, so the model does not depend on the scratch folder."""

    def __init__(self, instance: TableIndexerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table().write.parquet(f"{path}/table")


class _TableIndexerModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableIndexerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(f"{path}/table")
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
