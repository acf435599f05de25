"""Dictionaries of nominal attributes as tables, for values too many for the driver.

Distinct values are sorted by range, each partition numbers its own, and a small
table of the partitions' sizes says where each begins: codes run from 0 in the
order of the values. Values of other rows that the dictionary lacks are added
behind. Null is no value. Coding is a join, by broadcast where the dictionary
is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.sources.files import stored

#: Values of a dictionary that is broadcast at most.
BROADCAST_VALUES = 200_000


def _numbered(values: DataFrame, first: int) -> DataFrame:
    """(value, code) of distinct values, from first on in their order."""
    placed = values.repartitionByRange("value").sortWithinPartitions("value").select("value", F.monotonically_increasing_id().alias("at"))
    # written, so that each value keeps its place
    placed = stored(placed, "dictionary")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(sizes), "part").select("value", (F.lit(first) + F.col("start") + place).alias("code"))


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("string").alias("value")).where("value IS NOT NULL").distinct()


def dictionary(df: DataFrame, name: str) -> DataFrame:
    """(value, code): the values of a column, numbered from 0 in their order."""
    return _numbered(_values(df, name), 0)


def extended(known: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """known with the values that only df has, numbered behind it in their order."""
    added = _values(df, name).join(known.select("value"), "value", "left_anti")
    return known.unionByName(_numbered(added, known.count()))


def _joined(df: DataFrame, known: DataFrame, on) -> DataFrame:
    return df.join(F.broadcast(known) if known.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else known, on, "left")


def coded(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """df with each column that has a dictionary replaced by its code; a value that the dictionary lacks is null."""
    for name, known in dictionaries.items():
        k = known.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = _joined(df, k, F.col(name).cast("string") == F.col("_value")).withColumn(name, F.col("_code")).drop("_value", "_code")
    return df


def decoded(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The way back: codes to values. A number that is no code is null."""
    for name, known in dictionaries.items():
        k = known.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = _joined(df, k, F.col(name) == F.col("_code")).withColumn(name, F.col("_value")).drop("_value", "_code")
    return df
