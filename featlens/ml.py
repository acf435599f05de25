"""Discretizer and feature selector as stages of pyspark.ml pipelines, with parameters, models and persistence.

Features are a vector or an array column, labels any column whose values can be
ordered. Rows without a label are no part of a fit, and are transformed. A
model is stored as its parameters and one Parquet table: the thresholds of each
feature, or the ranking. An empty table can't be fitted: it raises ValueError.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.functions import info
from featlens.operators import mdlp, select
from featlens.operators.bins import Thresholds
from featlens.operators.select import Selection
from featlens.sources.files import stored


class _Columns(HasFeaturesCol, HasLabelCol, HasOutputCol):
    """Where features and labels are, and where the result goes."""

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setOutputCol(self, value: str):
        return self._set(outputCol=value)

    def _array(self, df: DataFrame) -> Column:
        name = self.getFeaturesCol()
        return F.col(name).cast("array<double>") if df.schema[name].dataType.typeName() == "array" else vector_to_array(name)

    def _labelled(self, df: DataFrame, features: Column, name: str) -> DataFrame:
        """(y, name): label codes and features of the rows that have a label. One row for each class is joined."""
        rows = df.select(F.col(self.getLabelCol()).alias("label"), features.alias(name)).where("label IS NOT NULL")
        # each reading of the rows would look for the labels again
        codes = stored(info.label_codes(rows), "codes")
        return rows.join(F.broadcast(codes) if codes.count() <= MAX_CLASSES else codes, "label").select("y", name)

    def _put(self, df: DataFrame, column: Column) -> DataFrame:
        """df with column as a vector if features are vectors, as an array if not."""
        is_array = df.schema[self.getFeaturesCol()].dataType.typeName() == "array"
        return df.withColumn(self.getOutputCol(), column if is_array else array_to_vector(column))


#: Classes that are broadcast at most.
MAX_CLASSES = 1_000_000


class _TableWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table(self.sparkSession).coalesce(1).write.parquet(f"{path}/data")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.kind.learned(self.sparkSession.read.parquet(f"{path}/data")))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _TableModel(Model, MLReadable, MLWritable):
    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Cuts(_Columns):
    maxBins = Param(Params._dummy(), "maxBins", "at most one more cut than this; 0: no limit", TypeConverters.toInt)
    maxByPart = Param(Params._dummy(), "maxByPart", "features with more candidates are searched level by level", TypeConverters.toInt)
    maxLevels = Param(Params._dummy(), "maxLevels", "levels of halves that are cut; 0: no limit", TypeConverters.toInt)
    continuous = Param(Params._dummy(), "continuous", "places of the features that are cut; none given: all", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="bins", maxBins=mdlp.MAX_BINS, maxByPart=mdlp.MAX_BY_PART, maxLevels=0, continuous=[])


class Discretizer(Estimator, _Cuts, DefaultParamsReadable, DefaultParamsWritable):
    """Cuts continuous features by entropy and description length."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> DiscretizerModel:
        rows = self._labelled(dataset, self._array(dataset), "features")
        of = {p: self.getOrDefault(p) for p in ("maxBins", "maxByPart", "maxLevels", "continuous")}
        cuts = mdlp.fit(rows, only=of["continuous"] or None, max_bins=of["maxBins"] or None, max_by_part=of["maxByPart"], max_levels=of["maxLevels"] or None)
        if not cuts.cuts:
            raise ValueError("no rows with features and a label")
        return self._copyValues(DiscretizerModel(cuts))


class DiscretizerModel(_TableModel, _Cuts):
    """thresholds: of each feature; features without any pass through."""

    def __init__(self, thresholds: Thresholds | None = None):
        super().__init__()
        self.thresholds = thresholds

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.thresholds.cuts)), "feature int, thresholds array<float>")

    @staticmethod
    def learned(table: DataFrame) -> Thresholds:
        return Thresholds([None if r.thresholds is None else list(r.thresholds) for r in table.orderBy("feature").collect()])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dense = self.thresholds.transform(dataset.withColumn("_dense", self._array(dataset)), "_dense", "_binned")
        return self._put(dense, F.col("_binned")).drop("_dense", "_binned")


class _Chosen(_Columns):
    criterion = Param(Params._dummy(), "criterion", "name of the criterion", TypeConverters.toString)
    numTopFeatures = Param(Params._dummy(), "numTopFeatures", "features to select", TypeConverters.toInt)
    beta = Param(Params._dummy(), "beta", "weight of redundancy, for mifs", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="bins", outputCol="selected", criterion="mrmr", numTopFeatures=25, beta=0.0)


class FeatureSelector(Estimator, _Chosen, DefaultParamsReadable, DefaultParamsWritable):
    """Selects features that are whole numbers by a criterion of information theory; of fewer features than wanted, all."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> FeatureSelectorModel:
        # read once for the check and once a round; the stages before this one make it once
        doubles = stored(self._labelled(dataset, self._array(dataset), "bins"), "bins")
        width = select.check_bins(doubles)
        rows = doubles.withColumn("bins", F.col("bins").cast("array<int>"))
        n = min(self.getOrDefault("numTopFeatures"), width)
        return self._copyValues(FeatureSelectorModel(select.select_features(rows, self.getOrDefault("criterion"), n, self.getOrDefault("beta"), width=width)))


class FeatureSelectorModel(_TableModel, _Chosen):
    """selection: ranking with scores; places are kept in ascending order."""

    def __init__(self, selection: Selection | None = None):
        super().__init__()
        self.selection = selection

    def table(self, spark) -> DataFrame:
        return self.selection.table(spark)

    @staticmethod
    def learned(table: DataFrame) -> Selection:
        return Selection([(r.feature, r.score) for r in table.orderBy("rank").collect()])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if dataset.schema[self.getFeaturesCol()].dataType.typeName() == "array":
            return self.selection.transform(dataset, self.getFeaturesCol(), self.getOutputCol())
        return self.selection.transform(dataset.withColumn(self.getOutputCol(), F.col(self.getFeaturesCol())), self.getOutputCol())
