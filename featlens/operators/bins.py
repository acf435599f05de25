"""Thresholds of continuous features, and bins from them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlens.functions.scan import below


def bin_of(value: Column, thresholds: Column) -> Column:
    """The number of thresholds below value, as floats: bins are closed at their right end."""
    return F.size(F.filter(thresholds, lambda t: t < value.cast("float")))


#: Up to so many features, each is an expression of its own in generated code; beyond, one expression searches the thresholds of all.
UNROLLED = 64
#: Thresholds of a feature that are compared one by one; more are searched by halving.
SCANNED = 8


@dataclass
class Thresholds:
    """cuts: for each feature its ascending thresholds; None where the feature is not continuous and passes through."""

    cuts: list[list[float] | None]

    def table(self, spark: SparkSession) -> DataFrame:
        """(feature, thresholds)."""
        schema = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("thresholds", T.ArrayType(T.FloatType()))])
        return spark.createDataFrame([(i, c) for i, c in enumerate(self.cuts) if c is not None], schema)

    @staticmethod
    def read(df: DataFrame, width: int) -> Thresholds:
        cuts: list[list[float] | None] = [None] * width
        for r in df.collect():
            cuts[r.feature] = sorted(float(t) for t in r.thresholds)
        return Thresholds(cuts)

    def _one(self, value: Column, feature: int) -> Column:
        cuts = self.cuts[feature]
        if not cuts:
            return value.cast("float").cast("double")
        if len(cuts) <= SCANNED:
            return sum((F.when(F.lit(c).cast("float") < value.cast("float"), 1.0).otherwise(0.0) for c in cuts), F.lit(0.0))
        return bin_of(value, F.array(*[F.lit(c).cast("float") for c in cuts])).cast("double")

    def _literal(self) -> Column:
        """All thresholds as one constant array of arrays."""
        return F.from_json(F.lit(json.dumps(self.cuts)), "array<array<float>>")

    def _each(self, value: Column, feature: Column) -> Column:
        """_one() of a feature that differs by row: its thresholds are searched by halving."""
        cuts = F.get(self._literal(), feature)
        most = max((len(c) for c in self.cuts if c), default=1)
        if most <= SCANNED:
            single = value.cast("float")
            below_it = F.aggregate(cuts, F.lit(0.0), lambda n, t: F.when(t < single, n + 1).otherwise(n))
            return F.when(F.size(cuts) > 0, below_it).otherwise(single.cast("double"))
        passes = cuts.isNull() | (F.size(cuts) == 0)
        return F.when(passes, value.cast("float").cast("double")).otherwise(below(cuts, value.cast("float"), most).cast("double"))

    def transform(self, df: DataFrame, features: str = "features", output: str = "bins") -> DataFrame:
        """df with the bins of an array column; NaN and null have no bin. Sparse entries (array<struct<i, v>>): see transform_sparse."""
        if len(self.cuts) > UNROLLED:
            return df.withColumn(output, F.transform(F.slice(features, 1, len(self.cuts)), lambda v, i: F.when(v.isNotNull() & ~F.isnan(v), self._each(v, i))))
        return df.withColumn(output, F.array(*[F.when(F.col(features)[i].isNull() | F.isnan(F.col(features)[i]), None).otherwise(self._one(F.col(features)[i], i)) for i in range(len(self.cuts))]))

    def transform_sparse(self, df: DataFrame, entries: str = "entries", keep_zeros: bool = False) -> DataFrame:
        """df with binned entries, by place, of stored entries only. Implicit zeros get zero's bin, so features whose zero lies above the first threshold become dense; keep_zeros leaves them 0. Entries of null have none, entries beyond the thresholds go."""
        stored = F.filter(entries, lambda e: (e["i"] >= 0) & (e["i"] < len(self.cuts)) & e["v"].isNotNull())
        cells = F.transform(stored, lambda e: F.struct(e["i"].cast("int").alias("i"), self._each(e["v"], e["i"]).alias("v")))
        zeros = [{"i": i, "v": float(sum(c < 0 for c in cuts))} for i, cuts in enumerate(self.cuts) if cuts and cuts[0] < 0 and not keep_zeros]
        if zeros:
            gaps = F.from_json(F.lit(json.dumps(zeros)), "array<struct<i: int, v: double>>")
            present = F.transform(stored, lambda e: e["i"].cast("int"))
            cells = F.concat(cells, F.filter(gaps, lambda z: ~F.array_contains(present, z["i"])))
        return df.withColumn(entries, F.array_sort(F.filter(cells, lambda e: e["v"] != 0)))


ONE_BIN = [math.inf]
