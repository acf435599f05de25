"""Synthetic tables with known relevant, redundant and random features. Every row depends on its id and the seed alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A decision (feature < threshold: left) or, with left None, a label."""

    label: int = 0
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def decide(self, row) -> int:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] < node.threshold else node.right
        return node.label

    def column(self, values: Column) -> Column:
        if self.left is None:
            return F.lit(self.label)
        return F.when(values[self.feature] < self.threshold, self.left.column(values)).otherwise(self.right.column(values))

    def stats(self) -> dict:
        """leaves, min_depth, max_depth and the features that it asks for."""
        if self.left is None:
            return {"leaves": 1, "min_depth": 0, "max_depth": 0, "features": set()}
        a, b = self.left.stats(), self.right.stats()
        return {"leaves": a["leaves"] + b["leaves"], "min_depth": 1 + min(a["min_depth"], b["min_depth"]), "max_depth": 1 + max(a["max_depth"], b["max_depth"]), "features": a["features"] | b["features"] | {self.feature}}


def random_tree(features: int, bins: int, max_depth: int, seed: int, early: float = 0.1) -> Tree:
    """A tree whose every branch can be reached, with unlike labels in sibling leaves."""
    rng = np.random.default_rng(seed)

    def grow(low, high, depth, label):
        free = [f for f in range(features) if high[f] - low[f] > 1]
        if depth == max_depth or not free or (depth and rng.random() < early):
            return Tree(label)
        f = int(rng.choice(free))
        t = int(rng.integers(low[f] + 1, high[f]))
        return Tree(feature=f, threshold=float(t), left=grow(low, high[:f] + [t] + high[f + 1 :], depth + 1, label), right=grow(low[:f] + [t] + low[f + 1 :], high, depth + 1, 1 - label))

    return grow([0] * features, [bins] * features, 0, int(rng.integers(2)))


def _uniform(seed: int, *what) -> Column:
    """Uniform in [0, 1) from the row id."""
    return F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed), *[F.lit(w) for w in what]), 11).cast("double") * F.lit(2.0**-53)


def discrete(spark: SparkSession, rows: int, relevant: int, redundant_noises: list[float], random: int, bins: int, label_noise: float = 0.0, max_depth: int = 5, seed: int = 1) -> tuple[DataFrame, Tree]:
    """(row_id, y, bins) and the tree that gave the labels. Feature order: relevant, redundant (noisy copies of relevant ones), random."""
    tree = random_tree(relevant, bins, max_depth, seed)
    draw = lambda *what: F.floor(_uniform(seed, *what) * bins).cast("int")
    own = F.array(*[draw("x", i) for i in range(relevant)])
    df = spark.range(rows).withColumnRenamed("id", "row_id").withColumn("own", own)
    copies = [F.when(_uniform(seed, "flip", i) < noise, draw("copy", i)).otherwise(F.col("own")[i % relevant]) for i, noise in enumerate(redundant_noises)]
    others = [draw("random", i) for i in range(random)]
    true = tree.column(F.col("own"))
    y = F.when(_uniform(seed, "label") < label_noise, 1 - true).otherwise(true).alias("y")
    return df.select("row_id", y, F.concat("own", F.array(*copies).cast("array<int>"), F.array(*others).cast("array<int>")).alias("bins")), tree


def gaussian(spark: SparkSession, rows: int, relevant: int, redundant: int, random: int, noise: float = 0.0, max_span: float = 1.0, norm: float = 10.0, seed: int = 1) -> DataFrame:
    """(row_id, y, features): two normal classes at least 2 * max_span apart, redundant features as orthonormal mixes of the relevant ones with a share of noise, and random ones."""
    rng = np.random.default_rng(seed)
    while True:
        means = rng.uniform(-norm, norm, (2, relevant))
        means *= np.minimum(1, norm / np.linalg.norm(means, axis=1, keepdims=True))
        if np.linalg.norm(means[0] - means[1]) >= 2 * max_span:
            break
    spans = rng.uniform(0, max_span, (2, relevant))
    blocks = [np.linalg.qr(rng.normal(size=(relevant, relevant)))[0] for _ in range(-(-redundant // relevant))]
    weights = np.concatenate(blocks)[:redundant] if redundant else np.zeros((0, relevant))
    normal = lambda *what: F.sqrt(-2 * F.log(1 - _uniform(seed, "r", *what))) * F.cos(2 * np.pi * _uniform(seed, "a", *what))
    y = (F.col("row_id") % 2).cast("int")
    own = F.array(*[F.when(y == 0, F.lit(float(means[0][i])) + normal(i) * float(spans[0][i])).otherwise(F.lit(float(means[1][i])) + normal(i) * float(spans[1][i])) for i in range(relevant)])
    df = spark.range(rows).withColumnRenamed("id", "row_id").withColumn("own", own)
    mixes = [F.when(_uniform(seed, "flip", i) < noise, (_uniform(seed, "mix", i) * 2 - 1) * norm).otherwise(sum((F.col("own")[j] * float(w) for j, w in enumerate(row)), F.lit(0.0))) for i, row in enumerate(weights)]
    others = [(_uniform(seed, "random", i) * 2 - 1) * norm for i in range(random)]
    return df.select("row_id", y.alias("y"), F.concat("own", F.array(*mixes).cast("array<double>"), F.array(*others).cast("array<double>")).alias("features"))
