"""Readers and writers of labelled tables, and stores for what an experiment learns."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.operators.bins import Thresholds
from featlens.operators.select import Selection


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints/featlens"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: it is computed once, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_libsvm(spark: SparkSession, path: str, dense: bool = False, n_features: int | None = None) -> DataFrame:
    """(label, features): label -1 becomes 0; features a vector, or an array if dense."""
    reader = spark.read.format("libsvm")
    df = (reader.option("numFeatures", n_features) if n_features else reader).load(path)
    features = vector_to_array("features").alias("features") if dense else F.col("features")
    return df.select(F.when(F.col("label") == -1, 0.0).otherwise(F.col("label")).alias("label"), features)


def write_libsvm(df: DataFrame, path: str) -> None:
    features = array_to_vector(F.col("features").cast("array<double>")) if df.schema["features"].dataType.typeName() == "array" else F.col("features")
    df.select(F.col("label").cast("double").alias("label"), features.alias("features")).write.mode("overwrite").format("libsvm").save(path)


def read_delimited(spark: SparkSession, path: str, columns: int, sep: str = ",") -> DataFrame:
    """(label, features) of a text table whose first column is the label; all numbers."""
    schema = ", ".join(f"c{i} double" for i in range(columns))
    df = spark.read.schema(schema).csv(path, sep=sep, mode="FAILFAST")
    return df.select(F.col("c0").alias("label"), F.array(*[F.col(f"c{i}") for i in range(1, columns)]).alias("features"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sparse_entries(df: DataFrame, features: str = "features") -> DataFrame:
    """df with entries array<struct<i, v>> of an array's non-zero places in place of it."""
    pairs = F.filter(F.transform(features, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    return df.withColumn("entries", pairs).drop(features)


def write_thresholds(spark: SparkSession, thresholds: Thresholds, path: str) -> None:
    write_table(thresholds.table(spark).coalesce(1), path)


def read_thresholds(spark: SparkSession, path: str, width: int) -> Thresholds:
    return Thresholds.read(spark.read.parquet(path), width)


def write_selection(spark: SparkSession, selection: Selection, path: str) -> None:
    write_table(selection.table(spark).coalesce(1), path)


def read_selection(spark: SparkSession, path: str) -> Selection:
    return Selection([(r.feature, r.score) for r in spark.read.parquet(path).orderBy("rank").collect()])


def fold_paths(folder: str, leaf: str, folds: int) -> list[tuple[str, str]]:
    """(train, test) files of each fold: 'fold' in leaf becomes 1, 2, ..."""
    return [(f"{folder}/{name}tra.data", f"{folder}/{name}tst.data") for name in (leaf.replace("fold", str(i)) for i in range(1, folds + 1))]
