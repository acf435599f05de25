"""Greedy forward selection by information theory, selection by chi-square, and projection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.functions import dense, info
from featlens.functions.criteria import Criterion, criterion


@dataclass
class Selection:
    """ranking: (feature, score) in the order of selection; max_relevance: the same by relevance alone."""

    ranking: list[tuple[int, float]]
    max_relevance: list[tuple[int, float]] = field(default_factory=list)

    @property
    def features(self) -> list[int]:
        """Ascending, as transform() keeps them."""
        return sorted(f for f, _ in self.ranking)

    def table(self, spark: SparkSession) -> DataFrame:
        """(rank, feature, score)."""
        return spark.createDataFrame([(i + 1, f, float(s)) for i, (f, s) in enumerate(self.ranking)], "rank int, feature int, score double")

    def transform(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        """Keeps the selected places of a vector or array column. Sparse vectors stay sparse."""
        output = output or column
        if df.schema[column].dataType.typeName() == "array":
            return df.withColumn(output, F.array(*[F.col(column)[f] for f in self.features]))
        kept = VectorSlicer(inputCol=column, outputCol="_selected", indices=self.features).transform(df)
        return kept.drop(output).withColumnRenamed("_selected", output)


def check_bins(df: DataFrame, bins: str = "bins") -> int:
    """The number of features; raises unless all values are whole, not negative, and rows are equally long."""
    x = F.col(bins)
    bad = F.exists(x, lambda v: (v < 0) | (v % 1 != 0))
    row = df.agg(F.min(F.size(x)).alias("a"), F.max(F.size(x)).alias("b"), F.max(bad.cast("int")).alias("bad")).first()
    if row.a is None:
        raise ValueError("the table is empty")
    if row.bad:
        raise ValueError("features must be whole numbers of 0 or more: discretize them first")
    if row.a != row.b:
        raise ValueError("rows differ in their number of features")
    return row.a


def check_entries(df: DataFrame, entries: str = "entries") -> int:
    """The number of features of sparse rows, the largest place and 1; raises unless all values are whole and not negative, and no row has a place twice or below 0."""
    e = F.col(entries)
    bad = F.exists(e, lambda x: x["v"].isNull() | (x["v"] < 0) | (x["v"] % 1 != 0))
    places = F.transform(e, lambda x: x["i"])
    row = df.agg(F.max(F.array_max(places)).alias("last"), F.max(bad.cast("int")).alias("bad"), F.max(((F.size(F.array_distinct(places)) < F.size(e)) | F.exists(places, lambda i: i.isNull() | (i < 0))).cast("int")).alias("twice"), F.count("*").alias("n")).first()
    if not row.n:
        raise ValueError("the table is empty")
    if row.bad:
        raise ValueError("features must be whole numbers of 0 or more: discretize them first")
    if row.twice:
        raise ValueError("a row has a feature twice, or one without a place")
    return 0 if row["last"] is None else row["last"] + 1


def select_features(df: DataFrame, by: str | Criterion = "mrmr", n: int = 25, beta: float = 0.0, bins: str = "bins", sparse: bool = False, n_features: int | None = None, width: int | None = None) -> Selection:
    """Selects up to n features of rows (y, bins), or (y, entries) if sparse, one at a time.

    Each round is one aggregation of the histogram against the last pick only;
    earlier rounds' numbers, one pair for each feature, stay on the driver.
    Wide rows are counted by partitions, without a row for each of their values.
    width: of dense rows that are known to be valid, their number of features. Ties go to the smaller feature. Fewer features than n: all are ranked.
    """
    if sparse:
        width = max(n_features or 0, check_entries(df))
    else:
        width = width or check_bins(df, bins)
    wide = not sparse and width >= dense.WIDE and dense.whole(df, bins)
    if not 0 < n <= width:
        raise ValueError(f"n must lie between 1 and {width}")
    chosen = criterion(by, beta)
    rows = (info.relevance_sparse(df) if sparse else info.mutual_information(dense.hist2(df, bins)) if wide else info.relevance(df, bins)).collect()
    rel = np.full(width, -np.inf)
    for r in rows:
        rel[r.feature] = r.mi
    by_relevance = [(int(f), float(rel[f])) for f in np.lexsort((np.arange(width), -rel)) if np.isfinite(rel[f])]
    if not chosen.needs_pairs:
        return Selection(by_relevance[:n], by_relevance[:n])
    picked = by_relevance[:1]
    mi, cmi = [], []
    while picked and len(picked) < n:
        left = np.isfinite(rel)
        left[[f for f, _ in picked]] = False
        if not left.any():
            break
        last = picked[-1][0]
        open_ = [int(f) for f in np.flatnonzero(left)]
        if wide:
            pairs = info.pair_information(dense.hist3(df, last, bins, open_)).collect()
        else:
            pairs = (info.redundancy_sparse(df, last) if sparse else info.redundancy(df, last, bins, open_ if len(open_) <= 512 else None)).collect()
        a, b = np.zeros(width), np.zeros(width)
        for r in pairs:
            a[r.feature], b[r.feature] = r.mi, r.cmi
        mi.append(a)
        cmi.append(b)
        score = np.where(left, chosen.score(np.where(left, rel, 0), np.array(mi), np.array(cmi)), -np.inf)
        best = int(np.round(score, 12).argmax())
        picked.append((best, float(score[best])))
    return Selection(picked, by_relevance[:n])


def scored(relevances: DataFrame, pairs: DataFrame, by: str | Criterion, beta: float = 0.0) -> DataFrame:
    """(feature, score) by a criterion's Spark expression, from (feature, mi) and (feature, step, mi, cmi)."""
    joined = pairs.join(relevances.withColumnRenamed("mi", "rel"), "feature")
    return joined.groupBy("feature").agg(criterion(by, beta).expression().alias("score"))


def chi_square(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(feature, statistic, p_value, degrees) of Pearson's test, by falling statistic, then feature."""
    out = ChiSquareTest.test(df, features, label, flatten=True)
    return out.select(F.col("featureIndex").alias("feature"), "statistic", F.col("pValue").alias("p_value"), F.col("degreesOfFreedom").alias("degrees")).orderBy(F.desc("statistic"), "feature")


def chi_square_select(df: DataFrame, n: int, features: str = "features", label: str = "label") -> Selection:
    """The n features with the largest statistics; the p-value plays no part."""
    return Selection([(r.feature, r.statistic) for r in chi_square(df, features, label).limit(n).collect()])
