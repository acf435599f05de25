"""Histograms, entropy, mutual information (MI) and conditional MI, in bits.

The long form of a labelled table has one row for each instance and feature:
(feature int, x int, y int). Histograms are grouped counts of it, everything
else is sums over histograms, so after the first aggregation tables hold one
row for each non-empty cell and no longer grow with the instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, y): dense codes from 0 in the labels' order; null labels get none."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return labels.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("y"))


def encoded(df: DataFrame, label: str = "label") -> DataFrame:
    """df with y in place of label; rows without a label are dropped. One row for each class is broadcast."""
    return df.join(F.broadcast(label_codes(df, label)), label).drop(label)


def long_form(df: DataFrame, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """(feature, x, y) of dense rows (y, bins array); only some features, if given, leave the scan."""
    if features is None:
        return df.select("y", F.posexplode(bins).alias("feature", "x")).where("x IS NOT NULL").select("feature", "x", "y")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(bins)[f].alias("x")) for f in features])
    return df.select("y", F.explode(cells).alias("c")).select("c.feature", "c.x", "y").where("x IS NOT NULL")


def long_form_sparse(df: DataFrame, entries: str = "entries") -> DataFrame:
    """(feature, x, y) of the stored, non-zero entries array<struct<i, v>>."""
    return df.select("y", F.explode(entries).alias("e")).where("e.v <> 0").select(F.col("e.i").alias("feature"), F.col("e.v").alias("x"), "y")


def hist2(long: DataFrame) -> DataFrame:
    """(feature, x, y, n)."""
    return long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))


#: Cells over all instances that are broadcast at most.
BROADCAST_CELLS = 1_000_000


def complete_zeros(stored: DataFrame, totals: DataFrame, others: list[str], value: str = "x", zero: Column | None = None) -> DataFrame:
    """Adds to a histogram of stored entries the cells of implicit zeros, by subtraction.

    stored: (feature, value, *others, n); totals: (*others, n) over all
    instances, which is small. Cells that come out 0 are left out, and an
    explicitly stored zero joins the implicit ones.
    """
    zero = F.lit(0) if zero is None else zero
    features = stored.select("feature").distinct()
    own = stored.where(F.col(value) != zero).groupBy("feature", *others).agg(F.sum("n").alias("_own"))
    # each feature meets each cell of totals: that many cells are the result
    few = totals.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    every = features.crossJoin(F.broadcast(totals.withColumnRenamed("n", "_all")) if few else totals.withColumnRenamed("n", "_all"))
    missing = every.join(own, ["feature", *others], "left").withColumn("n", F.col("_all") - F.coalesce("_own", F.lit(0))).where("n > 0")
    cells = missing.select("feature", zero.cast(stored.schema[value].dataType).alias(value), *others, "n")
    return stored.where(F.col(value) != zero).select(*cells.columns).unionByName(cells)


def class_distribution(df: DataFrame) -> DataFrame:
    """(y, n)."""
    return df.groupBy("y").agg(F.count("*").alias("n"))


def entropy_of(counts: list[Column], total: Column) -> Column:
    """Entropy of columns of counts; 0 log 0 is 0."""
    out = F.lit(0.0)
    for c in counts:
        out = out - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0)
    return out


def entropy(hist: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, h): entropy of value within each group, from counts n."""
    cells = hist.groupBy(*by, value).agg(F.sum("n").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return cells.select(*by, (-p * F.log2(p)).alias("t")).groupBy(*by).agg(F.sum("t").alias("h"))


def _over(*keys: str) -> Column:
    return F.sum("n").over(Window.partitionBy(*keys))


def mutual_information(hist: DataFrame) -> DataFrame:
    """(feature, mi) from (feature, x, y, n): sum of p(x, y) log2(p(x, y) / (p(x) p(y)))."""
    h = hist.withColumn("n", F.col("n").cast("double"))
    h = h.select("feature", "n", _over("feature", "x").alias("nx"), _over("feature", "y").alias("ny"), _over("feature").alias("nt"))
    return h.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.log2(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))).alias("mi"))


def relevance(df: DataFrame, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """(feature, mi): MI of every feature with the label."""
    return mutual_information(hist2(long_form(df, bins, features)))


def hist3(df: DataFrame, pick: int, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """(feature, x, y, z, n): feature values, values of feature pick, and labels. Both others travel in the row: no join."""
    long = long_form(df.select(F.struct(F.col(bins)[pick].alias("p"), F.col("y").alias("z")).alias("y"), bins), bins, features)
    return long.where((F.col("feature") != pick) & F.col("y.p").isNotNull()).groupBy("feature", "x", F.col("y.p").alias("y"), F.col("y.z").alias("z")).agg(F.count("*").alias("n"))


def pair_information(hist: DataFrame) -> DataFrame:
    """(feature, mi, cmi) from (feature, x, y, z, n): I(X; Y) and I(X; Y | Z), from one histogram."""
    h = hist.withColumn("n", F.col("n").cast("double"))
    h = h.select("feature", "x", "y", "n", _over("feature", "x", "z").alias("nxz"), _over("feature", "y", "z").alias("nyz"), _over("feature", "z").alias("nz"), _over("feature").alias("nt"))
    cmi = h.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.log2(F.col("n") * F.col("nz") / (F.col("nxz") * F.col("nyz")))).alias("cmi"))
    return mutual_information(hist.groupBy("feature", "x", "y").agg(F.sum("n").alias("n"))).join(cmi, "feature")


def redundancy(df: DataFrame, pick: int, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """(feature, mi, cmi) of every other feature with feature pick, given the label."""
    return pair_information(hist3(df, pick, bins, features))


def cardinality(long: DataFrame) -> DataFrame:
    """(feature, n_values): largest value + 1."""
    return long.groupBy("feature").agg((F.max("x") + 1).cast("bigint").alias("n_values"))


# ---- the same over stored entries only ----


def relevance_sparse(df: DataFrame, entries: str = "entries") -> DataFrame:
    """relevance() of rows (y, entries): the zeros are recovered from the label's distribution."""
    return mutual_information(complete_zeros(hist2(long_form_sparse(df, entries)), class_distribution(df), ["y"]))


def redundancy_sparse(df: DataFrame, pick: int, entries: str = "entries") -> DataFrame:
    """redundancy() of rows (y, entries)."""
    own = F.coalesce(F.get(F.filter(entries, lambda e: e["i"] == pick), F.lit(0))["v"], F.lit(0))
    rows = df.select(own.alias("p"), F.col("y").alias("z"), entries)
    totals = rows.groupBy(F.col("p").alias("y"), "z").agg(F.count("*").alias("n"))
    stored = rows.select("p", "z", F.explode(entries).alias("e")).where((F.col("e.v") != 0) & (F.col("e.i") != pick))
    stored = stored.groupBy(F.col("e.i").alias("feature"), F.col("e.v").alias("x"), F.col("p").alias("y"), "z").agg(F.count("*").alias("n"))
    return pair_information(complete_zeros(stored, totals, ["y", "z"]))
