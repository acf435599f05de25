"""Supervised discretization by entropy and minimum description length.

Candidate cuts are the middles between neighbouring values whose classes differ.
Neighbours, the numbers of runs and cumulative counts come from a prefix scan,
so one feature of any size uses all tasks. Each candidate carries cumulative
class counts over all candidates of its feature, computed once. An open interval
of cuts is then two cumulative rows and a total; each candidate finds its own
interval by binary search, so a level of the search is one small broadcast join
and one aggregation, whatever the number of features and cuts. Features with few candidates are
searched by numpy instead, one group each, from the same rows.

Kept on purpose: at most max_bins + 1 cuts; the candidate that is chosen
belongs to neither side; the acceptance tolerance of 1e-5. max_bins=None takes
every accepted cut, max_levels ends the search after so many levels of halves.

Values beside each other as floats can have the same middle. Candidates with
equal cuts are one place: each counts all of them to its left, none lies in a
half once one is chosen, and the first in the order of values is the one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.functions import scan
from featlens.functions.info import complete_zeros, entropy_of
from featlens.operators.bins import ONE_BIN, Thresholds
from featlens.sources.files import stored

MAX_BINS, MAX_BY_PART, TOLERANCE = 15, 100_000, -1e-5


def point_hist(df: DataFrame, features: str = "features", only: list[int] | None = None) -> DataFrame:
    """(feature, v float, y, n) of dense rows (y, features array)."""
    if only is None:
        long = df.select("y", F.posexplode(features).alias("feature", "v"))
    else:
        long = df.select("y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(features)[f].alias("v")) for f in only])).alias("c")).select("y", "c.*")
    return long.select("feature", F.col("v").cast("float").alias("v"), "y").where("v IS NOT NULL AND NOT isnan(v)").groupBy("feature", "v", "y").agg(F.count("*").alias("n"))


def point_hist_sparse(df: DataFrame, entries: str = "entries") -> DataFrame:
    """The same of rows (y, entries array<struct<i, v>>); zeros by subtraction."""
    stored = df.select("y", F.explode(entries).alias("e")).select(F.col("e.i").alias("feature"), F.col("e.v").cast("float").alias("v"), "y").groupBy("feature", "v", "y").agg(F.count("*").alias("n"))
    return complete_zeros(stored, df.groupBy("y").agg(F.count("*").alias("n")), ["y"], "v", F.lit(0.0).cast("float"))


def candidates(points: DataFrame, classes: int, part_rows: int | None = None) -> DataFrame:
    """(feature, run, cut float, c0 .. c{classes-1}): class counts since the candidate before, run in the order of values; the last value of a feature is always one. part_rows: distinct values that one task takes."""
    counts = [F.sum(F.when(F.col("y") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(classes)]
    values = stored(points.groupBy("feature", "v").agg(F.min("y").alias("low"), F.max("y").alias("high"), *counts), "values")
    near = scan.beside(scan.parts(values, ["feature"], "v", part_rows), ["feature"], "v", ["low", "high"])
    pure = F.least("low", F.col("_before.low")) == F.greatest("high", F.col("_before.high"))
    marked = near.withColumn("starts", F.when(F.col("_before").isNotNull() & ~pure, 1).otherwise(0)).withColumn("after", F.col("_after.v")).drop("_before", "_after")
    # what is summed is read twice: a part's rows, and all parts' sums
    runs = scan.running(stored(marked, "marked"), ["feature"], "v", {"starts": "run"})
    runs = runs.groupBy("feature", "run").agg(F.max(F.struct("v", "after")).alias("last"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(classes)])
    cut = F.when(F.col("last.after").isNull(), F.col("last.v")).otherwise(((F.col("last.v").cast("double") + F.col("last.after").cast("double")) / 2).cast("float"))
    return runs.select("feature", "run", cut.alias("cut"), *[f"c{i}" for i in range(classes)])


def cumulative(cands: DataFrame, classes: int) -> DataFrame:
    """cands with l0 ..: class counts up to and with the candidate and those of the same cut, over its whole feature."""
    sums = scan.running(scan.parts(cands, ["feature"], "cut"), ["feature"], "cut", {f"c{i}": f"l{i}" for i in range(classes)})
    return sums.select("feature", "run", "cut", *[f"c{i}" for i in range(classes)], *[f"l{i}" for i in range(classes)])


def _accepts(gain, s, k, hs, k1, h1, k2, h2, log2, power, infinite):
    """The description length rule, for columns or arrays."""
    delta = log2(power(3.0, k) - 2) - (k * hs - k1 * h1 - k2 * h2)
    return infinite | (gain - (log2(s - 1) + delta) / s > TOLERANCE)


def split_costs(cum: DataFrame, nodes: DataFrame, classes: int, most: int = 1 << 16) -> DataFrame:
    """For every candidate strictly inside an open interval: node, cut, run, w (weighted entropy after the cut), accepted, and its own counts c0 .., l0 ...

    nodes: (feature, node, lo, hi, b0 .., t0 ..): class counts up to and with lo, and between lo and hi. No two of a feature overlap; a feature has most at most.
    """
    each = nodes.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("lo", *[c for c in nodes.columns if c not in ("feature", "lo")]))).alias("open"))
    with_open = cum.join(F.broadcast(each), "feature")
    own = F.get(F.col("open"), scan.below(F.col("open.lo"), F.col("cut"), most) - 1)
    inside = with_open.withColumn("_own", own).where(F.col("cut") < F.col("_own.hi")).select(*cum.columns, "_own.*")
    left = [F.col(f"l{i}") - F.col(f"b{i}") for i in range(classes)]
    total = [F.col(f"t{i}") for i in range(classes)]
    right = [t - a for t, a in zip(total, left, strict=True)]

    def number(counts):
        return sum((F.when(c > 0, 1.0).otherwise(0.0) for c in counts), F.lit(0.0))

    s, s1, s2 = (sum(c, F.lit(0)).cast("double") for c in (total, left, right))
    hs, h1, h2 = entropy_of(total, s), entropy_of(left, s1), entropy_of(right, s2)
    w = (s1 * h1 + s2 * h2) / s
    ok = _accepts(hs - w, s, number(total), hs, number(left), h1, number(right), h2, F.log2, lambda a, b: F.pow(F.lit(a), b), s <= 1)
    return inside.select("feature", "node", "cut", "run", w.alias("w"), F.coalesce(ok & (F.col("cut") != F.coalesce("forbidden", F.lit(float("nan")))), F.lit(False)).alias("accepted"), *[f"{x}{i}" for x in "cl" for i in range(classes)])


def _bounds(max_bins: int | None, max_levels: int | None) -> tuple[float, float]:
    """The most cuts and the most levels."""
    return float("inf") if max_bins is None else max_bins + 1, float("inf") if max_levels is None else max_levels


def search_levels(cum: DataFrame, classes: int, max_bins: int | None = MAX_BINS, max_levels: int | None = None) -> dict[int, list[float]]:
    """Cuts of every feature, level by level. Only one row for each open interval reaches the driver: one more than cuts so far, a feature."""
    most, levels = _bounds(max_bins, max_levels)
    spark = cum.sparkSession
    names = [f"c{i}" for i in range(classes)]
    found: dict[int, list[float]] = {}
    roots = cum.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names]).collect()
    # interval: feature -> [(lo, hi, counts up to lo, counts inside)] from left to right
    open_ = {r.feature: [(float("-inf"), float("inf"), [0] * classes, [r[c] for c in names])] for r in roots}
    schema = "feature int, node int, lo float, hi float, forbidden float, " + ", ".join([f"b{i} bigint" for i in range(classes)] + [f"t{i} bigint" for i in range(classes)])
    level = 0
    while open_ and level < levels:
        level += 1
        rows = [(f, k, lo, hi, None, *base, *total) for f, parts in open_.items() for k, (lo, hi, base, total) in enumerate(parts)]
        costs = split_costs(cum, spark.createDataFrame(rows, schema), classes, max(len(p) for p in open_.values())).where("accepted")
        best = costs.groupBy("feature", "node").agg(F.min(F.struct("w", "cut", "run", *[f"{x}{i}" for x in "cl" for i in range(classes)])).alias("m"))
        chosen = {(r.feature, r.node): r for r in best.select("feature", "node", "m.*").collect()}
        following: dict[int, list] = {}
        for f, parts in open_.items():
            for k, (lo, hi, base, total) in enumerate(parts):
                r = chosen.get((f, k))
                cuts = found.setdefault(f, [])
                if r is None or len(cuts) >= most:
                    continue
                cuts.append(r.cut)
                upto = [r[f"l{i}"] for i in range(classes)]
                left = [u - r[c] - b for u, c, b in zip(upto, names, base, strict=True)]
                right = [b + t - u for b, t, u in zip(base, total, upto, strict=True)]
                following.setdefault(f, []).extend(p for p in ((lo, r.cut, base, left), (r.cut, hi, upto, right)) if sum(p[3]) > 0)
        open_ = {f: p for f, p in following.items() if len(found[f]) < most}
    return {f: sorted(c) for f, c in found.items()}


def search(cuts: np.ndarray, counts: np.ndarray, max_bins: int | None = MAX_BINS, max_levels: int | None = None) -> list[float]:
    """Cuts of one feature: cuts ascending, counts (cuts, classes)."""
    most, levels = _bounds(max_bins, max_levels)
    sums = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)])
    # behind the last candidate of the same cut
    upto = sums[np.searchsorted(cuts, cuts, "right")]
    found: list[float] = []
    # interval: first and last candidate (exclusive), counts before it, counts inside
    level, done = [(0, len(cuts), sums[0], sums[-1])], 0

    def entropies(c, s):
        with np.errstate(divide="ignore", invalid="ignore"):
            p = c / s[:, None]
            return -np.where(c > 0, p * np.log2(p), 0).sum(1)

    while level and done < levels:
        done += 1
        following = []
        for lo, hi, base, total in level:
            if lo >= hi or total.sum() <= 0 or len(found) >= most:
                continue
            left = upto[lo:hi] - base
            right = total - left
            s, s1, s2 = float(total.sum()), left.sum(1).astype(float), right.sum(1).astype(float)
            hs = float(entropies(total[None], np.array([s]))[0])
            h1, h2 = entropies(left, s1), np.where(s2 > 0, entropies(right, s2), 0)
            w = (s1 * h1 + s2 * h2) / s
            with np.errstate(divide="ignore", invalid="ignore"):
                ok = _accepts(hs - w, s, float((total > 0).sum()), hs, (left > 0).sum(1), h1, (right > 0).sum(1), h2, np.log2, np.power, s <= 1)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            best = lo + int(at[np.lexsort((at, w[at]))[0]])
            found.append(float(cuts[best]))
            first, behind = (int(np.searchsorted(cuts, cuts[best], side)) for side in ("left", "right"))
            following += [(lo, first, base, upto[best] - counts[best] - base), (behind, hi, upto[best], base + total - upto[best])]
        level = following
    return sorted(found)


def _grouped(classes: int, max_bins: int | None, max_levels: int | None):
    def of_feature(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cut", "run"])
        counts = part[[f"c{i}" for i in range(classes)]].to_numpy(np.int64)
        return pd.DataFrame({"feature": [int(part.feature.iloc[0])], "thresholds": [search(part.cut.to_numpy(np.float32), counts, max_bins, max_levels)]})

    return of_feature


def fit(df: DataFrame, features: str = "features", only: list[int] | None = None, max_bins: int | None = MAX_BINS, max_by_part: int = MAX_BY_PART, sparse: bool = False, n_features: int | None = None, passthrough: bool = False, max_levels: int | None = None) -> Thresholds:
    """Thresholds of dense rows (y, features) or sparse rows (y, entries), y a class code.

    only: the continuous features, all if not given. A continuous feature
    without an accepted cut gets one bin, or passes through if passthrough.
    """
    if sparse:
        width = n_features or (df.agg(F.max(F.array_max("entries.i"))).first()[0] or 0) + 1
    else:
        first = df.select(F.size(features).alias("n")).first()
        width = first.n if first else 0
    if only is not None and (len(set(only)) != len(only) or any(not 0 <= f < width for f in only)):
        raise ValueError("continuous features must be different places in the row")
    wanted = list(range(width)) if only is None else list(only)
    classes = (df.agg(F.max("y")).first()[0] or 0) + 1
    points = point_hist_sparse(df) if sparse else point_hist(df, features, only)
    if sparse and only is not None:
        points = points.where(F.col("feature").isin(wanted))
    cands = candidates(points, classes).persist()
    sizes = {r.feature: r.n for r in cands.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    big = [f for f, n in sizes.items() if n > max_by_part]
    small = cands.where(~F.col("feature").isin(big)) if big else cands
    found = {r.feature: list(r.thresholds) for r in small.groupBy("feature").applyInPandas(_grouped(classes, max_bins, max_levels), "feature int, thresholds array<float>").collect()}
    if big:
        cum = cumulative(cands.where(F.col("feature").isin(big)), classes).persist()
        found |= search_levels(cum, classes, max_bins, max_levels)
        cum.unpersist()
    cands.unpersist()
    cuts: list[list[float] | None] = [None] * width
    for f in wanted:
        cuts[f] = found.get(f) or ([] if passthrough else ONE_BIN)
    return Thresholds(cuts)
