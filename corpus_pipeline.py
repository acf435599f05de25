"""A corpus pipeline: toxic documents go, near-duplicates go, secrets are masked, sources are mixed, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.llm import mixing, pieces, queries, secretscan, simhash, toxicity
from featlens.llm.storage import setting, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity model rejects."""
    return toxicity.rejecting(docs, queries.toxic_model(docs, table(spark, sf_dir, "labels")), queries.TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each SimHash component."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked, n_chars as the text is then."""
    masked = secretscan.redacted(docs, secretscan.train(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as many times as the mix takes it."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document: doc_id, ids, n_units."""
    return pieces.encode_documents(docs, pieces.load(queries.PIECES))


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("secrets", secrets), ("mixing", mixed), ("sentencepiece", encoded)]

#: Documents that pass to Python at once: an executor holds a batch for each of its tasks, twice.
BATCH = 1000

#: No stage is expressible in SQL: two fit models, one finds components, one iterates, one folds merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
