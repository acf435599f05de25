"""Histograms of a stream: counts are additive, so relevance of all that has come in so far is a query over a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from featlens.functions import info


def running_hist2(stream: DataFrame, name: str, bins: str = "bins") -> StreamingQuery:
    """Keeps (feature, x, y, n) of a stream of rows (y, bins) in the in-memory table name; its state is one row for each cell."""
    return info.hist2(info.long_form(stream, bins)).writeStream.outputMode("complete").format("memory").queryName(name).start()


def running_relevance(query: StreamingQuery) -> DataFrame:
    """(feature, mi) of what the query has counted."""
    return info.mutual_information(query.sparkSession.table(query.name) if hasattr(query, "sparkSession") else _table(query))


def _table(query: StreamingQuery) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().table(query.name)
