"""Linear classifiers by stochastic gradient descent.

Equal rows are counted once, before the first step. Each step is one job over the
different rows: every task adds up the gradients of its rows that are in the
step's batch, each as often as it stands there, and Spark adds up the tasks' sums, place by place.
Step t moves the weights by step / sqrt(t) against the mean gradient, after
shrinking them by step / sqrt(t) * reg. A row is in a batch by a hash of itself
and the step's number, so reruns agree, and repeated rows go together. A batch
without rows moves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From margins and labels (0 or 1), the losses and their derivatives by the margin.
LOSSES = {
    "hinge": lambda m, y: (np.maximum(0, 1 - (2 * y - 1) * m), np.where((2 * y - 1) * m < 1, -(2 * y - 1), 0.0)),
    "logistic": lambda m, y: (np.logaddexp(0, -(2 * y - 1) * m), 1 / (1 + np.exp(-np.clip(m, -500, 500))) - y),
}


@dataclass(frozen=True)
class Options:
    """iterations: steps at most. fraction: share of the rows in a batch. tolerance: the descent ends when a step moves the weights by less than this share of their length."""

    iterations: int = 100
    step: float = 1.0
    reg: float = 1.0
    fraction: float = 1.0
    tolerance: float = 0.001
    intercept: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Linear:
    """weights, the last being the intercept if there is one; losses: mean loss and penalty before each step."""

    weights: np.ndarray
    intercept: float
    losses: list[float]

    def margin(self, features: str) -> Column:
        """Of an array column."""
        each = F.zip_with(features, F.array(*[F.lit(float(w)) for w in self.weights]), lambda x, w: x * w)
        return F.aggregate(each, F.lit(self.intercept), lambda s, v: s + v)


def _batch(rows: DataFrame, t: int, o: Options) -> DataFrame:
    if o.fraction >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64("label", "x", F.lit(o.seed), F.lit(t)), F.lit(1_000_000)) < int(o.fraction * 1_000_000))


def _sums(rows: DataFrame, w: np.ndarray, loss) -> np.ndarray:
    """Number of rows, sum of losses, and sums of gradients."""

    def of(batches):
        total = np.zeros(len(w) + 2)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if x.shape[1] < len(w):
                x = np.hstack([x, np.ones((len(x), 1))])
            n = b.column("n").to_numpy(zero_copy_only=False)
            values, slopes = loss(x @ w, b.column("label").to_numpy(zero_copy_only=False))
            total += np.concatenate([[n.sum(), n @ values], (n * slopes) @ x])
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["s"])

    each = rows.mapInArrow(of, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    return np.array([r.v for r in each.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])


def descend(df: DataFrame, loss: str = "hinge", options: Options = Options(), features: str = "features") -> Linear:
    """Weights for rows (label 0 or 1, features an array without nulls). The driver holds one number a feature. An empty table raises."""
    o = options
    rows = df.select(F.col("label").cast("double").alias("label"), F.col(features).cast("array<double>").alias("x"))
    rows = rows.groupBy("label", "x").agg(F.count("*").alias("n")).persist()
    try:
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("the table is empty")
        w = np.zeros(first.n + o.intercept)
        losses: list[float] = []
        for t in range(1, o.iterations + 1):
            s = _sums(_batch(rows, t, o), w, LOSSES[loss])
            if not len(s) or not s[0]:
                continue
            losses.append(float(s[1] / s[0] + o.reg * (w @ w) / 2))
            rate = o.step / np.sqrt(t)
            moved = w * (1 - rate * o.reg) - rate * s[2:] / s[0]
            still = np.linalg.norm(moved - w) < o.tolerance * max(np.linalg.norm(moved), 1)
            w = moved
            if still:
                break
    finally:
        rows.unpersist()
    return Linear(w[: first.n], float(w[first.n]) if o.intercept else 0.0, losses)
