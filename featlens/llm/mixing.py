"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. Among all rates r of a source's
documents with sum(r * size) = target and 0 <= r <= cap, the one nearest to
"every document once" in relative entropy is r = min(cap, exp(l * size / mean)):
one multiplier l a source, the root of the convex dual's gradient. Newton's
method finds all multipliers together; each round is one distributed
aggregation over the histogram (source, size, documents), and only the sums of
each source come to the driver. The number of sources is checked against
MAX_SOURCES. Multipliers are rounded to 10 digits, so reruns agree although
sums of doubles may come in another order.

Rates become copies: per source, sizes from large to small, the documents of
one size take the whole number of copies that brings the words taken nearest to
the sum of rates, so errors of large sizes are made good by small ones. Within
a size, blocks of documents chosen by a hash share the copies in proportion;
the order of another hash in a block says who gets one more. A block has about
BLOCK rows whatever the size's share of all rows.

Null and empty texts have size 0; documents of size 0 are taken once and count
nothing. Very long texts are counted whole, and are a size of their own. A null
source is a source of its own, the last. Repeated rows are documents of their
own; a doc_id, or its lack, that over one in HOT_SHARE rows have is spread over
the blocks by row. Of equal hashes the smaller doc_id, then the earlier row,
gets one more. The different sizes of one source (not its documents) are one
group. An empty table gives an empty result. Extra columns are ignored, or kept
by repeated(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.llm.storage import HOT_SHARE, WORD, fresh, written

WEIGHTS, TOTAL, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
MAX_SOURCES, BLOCK, ROUNDS = 1_000_000, 1000, 100


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> list[float]:
    """Words for each source: its weight's part of total * sum(sizes), at most cap * its size, the excess shared again by weight until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes)]
    left = total * sum(sizes)
    while open_ and left > 0:
        whole = sum(weights[i % len(weights)] for i in open_)
        part = {i: left * weights[i % len(weights)] / whole for i in open_}
        full = [i for i in open_ if part[i] >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = part[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return out


def _frame(spark, stats: pd.DataFrame) -> DataFrame:
    # an Arrow table takes no Python workers on the executors; a pandas one would
    kinds = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "mean": pa.float64(), "l": pa.float64()}
    return spark.createDataFrame(pa.table({c: pa.array(stats[c].to_list(), t) for c, t in kinds.items()}))


def multipliers(histogram: DataFrame, stats: pd.DataFrame, cap: float) -> pd.DataFrame:
    """stats with l of each source; inf where every document is taken cap times."""
    spark = histogram.sparkSession
    low, high = np.full(len(stats), -np.inf), np.full(len(stats), np.inf)
    full = (stats.target >= cap * stats.source_size * (1 - 1e-12)).to_numpy()
    none = (stats.target <= 0).to_numpy() & ~full
    l, done = np.where(full, np.inf, np.where(none, -np.inf, 0.0)), full | none
    for _ in range(ROUNDS):
        if done.all():
            break
        now = _frame(spark, stats.assign(l=l)[~done])
        h = histogram.join(F.broadcast(now), histogram["source"].eqNullSafe(now["source"])).drop(histogram["source"])
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("l") * x, F.lit(math.log(cap) + 1)))
        words = F.col("size") * F.col("docs")
        sums = h.groupBy("source").agg(F.sum(words * F.least(tilt, F.lit(cap))).alias("got"), F.sum(F.when(tilt < cap, words * tilt * x).otherwise(0.0)).alias("slope")).toPandas()
        sums = stats[["source"]].merge(sums, "left", "source")
        gap = (sums.got - stats.target).to_numpy(float)
        slope = sums.slope.to_numpy(float)
        live = ~done
        high = np.where(live & (gap > 0), l, high)
        low = np.where(live & (gap <= 0), l, low)
        done = done | (np.abs(gap) <= 1e-9 * np.maximum(stats.target.to_numpy(float), 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = l - gap / slope
            middle = np.where(np.isfinite(low) & np.isfinite(high), (low + high) / 2, np.nan)
        width = np.where(np.isfinite(low), np.abs(low), 0) + np.where(np.isfinite(high), np.abs(high), 0) + 1
        middle = np.where(np.isfinite(middle), middle, np.where(np.isfinite(low), low + width, high - width))
        l = np.where(done, l, np.where(np.isfinite(step) & (step > low) & (step < high) & (np.abs(step - l) < 50), step, middle))
        done = done | (np.isfinite(low) & np.isfinite(high) & (high - low <= 1e-12 * np.maximum(1, np.abs(l))))
    return stats.assign(l=[float(f"{v:.9e}") if np.isfinite(v) else v for v in l])


def rate(size, mean, l, cap: float):
    """min(cap, exp(l * size / mean)) as a column."""
    return F.when(l == F.lit(float("inf")), F.lit(cap)).when(l == F.lit(float("-inf")), F.lit(0.0)).otherwise(F.least(F.lit(cap), F.exp(F.least(l * size / mean, F.lit(math.log(cap) + 1)))))


def _rounded(cap: float):
    def of_source(part: pd.DataFrame) -> pd.DataFrame:
        """One row for each size of a source -> the copies that all its documents take together."""
        part = part.sort_values("size", ascending=False)
        owed, copies = 0.0, []
        for size, docs, r in zip(part["size"], part["docs"], part["rate"], strict=True):
            exact = size * docs * r
            m = min(max(math.floor((exact + owed) / size + 0.5), 0), math.floor(cap * docs))
            owed += exact - m * size
            copies.append(m)
        return part.assign(copies=copies)[["source", "size", "copies"]]

    return of_source


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """documents' doc_id and source, size (words), source_size, target (of the source), rate, copies and taken = copies * size.

    cap must be a whole number. Sources are ranked by code point, null last;
    weights repeat over them.
    """
    rows = documents.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    return _mixed(rows, "row", weights, total, cap).drop("row")


def _mixed(documents: DataFrame, row: str, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """mix() with the number of each row, column row of documents, as column row."""
    spark = documents.sparkSession
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    sized = written(documents.select(F.col(row).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    histogram = written(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "size-histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    stats = pd.DataFrame({"source": pd.Series([r.source for r in found], dtype=object), "source_size": np.array([r.source_size for r in found], np.int64)})
    stats["target"] = np.array(targets(stats.source_size.tolist(), weights, total, cap), float)
    stats["mean"] = np.array([max(r.source_size / r.docs, 1e-9) for r in found], float)
    stats["l"] = 0.0
    words = histogram.where("size > 0")
    stats = multipliers(words, stats, cap)
    # one row for each source; its size is checked above
    known = _frame(spark, stats) if len(stats) else spark.createDataFrame([], "source string, source_size bigint, target double, mean double, l double")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    known = F.broadcast(known.withColumn("key", key).drop("source"))
    rated = words.withColumn("key", key).join(known, "key").withColumn("rate", F.round(rate(F.col("size"), F.col("mean"), F.col("l"), cap), 9))
    copies = rated.groupBy("key").applyInPandas(_rounded(cap), "source string, size bigint, copies bigint")
    # documents of one size in blocks
    most = histogram.agg(F.max("docs")).first()[0] or 1
    # at most HOT_SHARE rows
    hot = sized.groupBy("doc_id").count().where(F.col("count") * HOT_SHARE > sized.count()).where("count > 1").select(F.col("doc_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = sized.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("hot_id")), "left")
    salt = F.when(F.col("hot"), F.col("row"))
    sized = marked.withColumn("key", key).withColumn("block", F.pmod(F.xxhash64("doc_id", salt, F.lit("block")), F.lit(-(-most // BLOCK))))
    counted = sized.where("size > 0").groupBy("key", "size", "block").agg(F.count("*").alias("n"))
    run = Window.partitionBy("key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    shared = counted.join(copies.withColumn("key", key).drop("source"), ["key", "size"]).withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy("key", "size")))
    part = lambda n: F.floor(F.col("copies") * n / F.col("all"))
    shared = shared.select("key", "size", "block", "n", (part(F.col("upto")) - part(F.col("upto") - F.col("n"))).alias("mine"))
    order = Window.partitionBy("key", "size", "block").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "row")
    ranked = sized.join(shared, ["key", "size", "block"], "left").withColumn("rank", F.row_number().over(order))
    each = F.floor(F.col("mine") / F.col("n"))
    taken = F.when(F.col("size") == 0, F.lit(1)).otherwise(each + F.when(F.col("rank") <= F.col("mine") - each * F.col("n"), 1).otherwise(0)).cast("bigint")
    out = ranked.withColumn("copies", taken).join(known, "key")
    return out.select("row", F.col("doc_id").cast(doc_id).alias("doc_id"), "source", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate(F.col("size"), F.col("mean"), F.col("l"), cap)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(documents: DataFrame, **options) -> DataFrame:
    """documents, all their columns, each row as many times as mix() says. Rows are told apart by a number written beside them."""
    row, copies = fresh("row", documents), fresh("copies", documents)
    rows = written(documents.withColumn(row, F.monotonically_increasing_id()), "mixing-rows")
    taken = _mixed(rows, row, **options).select(F.col("row").alias(row), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    joined = rows.join(taken, row)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in documents.columns])
