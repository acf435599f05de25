"""Multivariate discretization by an evolutionary search over masks of cut points.

Features are dealt into chunks; every partition evolves one chunk on a
stratified sample with a CHC search (elitist, no mating of near relatives,
half-uniform crossover, restarts, and a reduction of long masks), and the
chunks' winners vote. Fitness weighs the share of kept points against the
resubstitution error of a categorical naive Bayes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.operators import mdlp
from featlens.operators.bins import ONE_BIN, Thresholds

SEED = 20_260_101


@dataclass(frozen=True)
class Options:
    """evaluations: fitness calls of a search; alpha: weight of the share of points; factor: features of a chunk relative to the largest feature; rate: sample; votes: points kept in all; on_rate: P(1) of redrawn bits."""

    population: int = 50
    evaluations: int = 5000
    alpha: float = 0.7
    factor: int = 1
    rate: float = 0.1
    votes: int = 100
    on_rate: float = 0.35
    restarts: int = 5
    reduce_above: int = 1000
    seed: int = SEED


def naive_bayes_error(codes: np.ndarray, y: np.ndarray, classes: int) -> float:
    """Share of rows that a categorical naive Bayes with add-one counts, fitted on them, gets wrong."""
    n = len(y)
    prior = np.bincount(y, minlength=classes) + 1.0
    score = np.tile(np.log(prior / prior.sum()), (n, 1))
    for x in codes.T:
        table = np.ones((classes, int(x.max()) + 1))
        np.add.at(table, (y, x), 1)
        score += np.log(table / table.sum(1, keepdims=True)).T[x]
    return float((score.argmax(1) != y).mean())


class Search:
    """CHC over one chunk. points: cut points and, for each, the feature it belongs to; values (rows, features)."""

    def __init__(self, cuts: np.ndarray, of_feature: np.ndarray, values: np.ndarray, y: np.ndarray, options: Options, seed: int):
        self.cuts, self.of, self.values, self.y, self.o = cuts, of_feature, values, y, options
        self.classes = int(y.max()) + 1 if len(y) else 1
        self.total, self.calls = len(cuts), 0
        self.rng = np.random.default_rng(seed)
        self.known: dict[bytes, float] = {}
        self.kept_log = np.zeros(len(cuts))

    def fitness(self, mask: np.ndarray) -> float:
        key = np.packbits(mask).tobytes()
        if key not in self.known:
            self.calls += 1
            codes = [np.searchsorted(np.sort(self.cuts[mask & (self.of == f)]), v, "left") for f, v in enumerate(self.values.T)]
            error = naive_bayes_error(np.stack(codes, 1), self.y, self.classes) if len(self.y) and codes else 0.0
            self.known[key] = self.o.alpha * mask.sum() / max(self.total, 1) + (1 - self.o.alpha) * error
        return self.known[key]

    def ordered(self, masks: list[np.ndarray]) -> list[np.ndarray]:
        """Best first; of equals the one with more points."""
        return sorted(masks, key=lambda m: (self.fitness(m), -int(m.sum())))

    def crossed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half of the differing bits change sides; a bit turned on survives by on_rate."""
        c, d = a.copy(), b.copy()
        differ = np.flatnonzero(a != b)
        swap = self.rng.permutation(differ)[: len(differ) // 2]
        c[swap], d[swap] = b[swap], a[swap]
        for child, parent in ((c, a), (d, b)):
            on = child & ~parent
            child[on] &= self.rng.random(int(on.sum())) < self.o.on_rate
        return c, d

    def reduced(self, people: list[np.ndarray], live: np.ndarray) -> np.ndarray:
        """Half of the live points: those of the best mask, then those that masks have kept most; ties at random."""
        goal = max(self.o.reduce_above // 2, int(live.sum()) // 2)
        rank = np.lexsort((self.rng.random(self.total), -self.kept_log, ~people[0], ~live))
        out = np.zeros(self.total, bool)
        out[rank[:goal]] = True
        return out & live

    def run(self) -> np.ndarray:
        n = self.total
        if not n:
            return np.zeros(0, bool)
        live = np.ones(n, bool)
        people = self.ordered([np.ones(n, bool), *(self.rng.random((self.o.population - 1, n)) < 0.5)])
        gap, stale, budget = n / 4, 0, self.o.evaluations
        while self.calls < budget and stale < self.o.restarts:
            before = self.calls
            order = self.rng.permutation(len(people))
            children = []
            for i, j in zip(order[::2], order[1::2], strict=False):
                if (people[i] != people[j]).sum() / 2 > gap:
                    children += self.crossed(people[i], people[j])
            best = self.fitness(people[0])
            merged = self.ordered([*people, *children])[: self.o.population]
            if not children or all(any(m is p for p in people) for m in merged):
                gap -= 1
            people = merged
            self.kept_log += np.sum(people, 0)
            if gap < 0:
                stale = stale + 1 if self.fitness(people[0]) >= best else 0
                if live.sum() / 2 > self.o.reduce_above and self.calls > budget // 4:
                    live = self.reduced(people, live)
                    people = [m & live for m in people]
                redrawn = [np.where(self.rng.random(n) < self.o.on_rate, self.rng.random(n) < 0.5, people[0]) & live for _ in range(self.o.population - 1)]
                people = self.ordered([people[0], *redrawn])
                gap = round(0.8 * 0.2 * n)
            elif self.calls == before and not children:
                continue
        return people[0]


def chunks(sizes: dict[int, int], partitions: int, factor: int, seed: int) -> list[list[int]]:
    """Features dealt into chunks, the large ones spread over them."""
    if not sizes:
        return []
    largest = max(sizes.values())
    room = max(1, max(-(-sum(sizes.values()) // max(partitions, 1)), largest) * max(factor, 1))
    number = max(1, -(-sum(sizes.values()) // room))
    rng = np.random.default_rng(seed)
    out: list[list[int]] = [[] for _ in range(number)]
    ranked = sorted(sizes, key=lambda f: (-sizes[f], f))
    for lo in range(0, len(ranked), number):
        for f, c in zip(ranked[lo : lo + number], rng.permutation(number), strict=False):
            out[c].append(f)
    return [c for c in out if c]


def fit(df: DataFrame, features: str = "features", only: list[int] | None = None, partitions: int = 8, options: Options | None = None) -> Thresholds:
    """Thresholds of rows (row_id, y, features). Every part of the rows, hashed by row_id, evolves one chunk on its sample."""
    o = options or Options()
    first = df.select(F.size(features).alias("n")).first()
    width = first.n if first else 0
    if only is not None and (len(set(only)) != len(only) or any(not 0 <= f < width for f in only)):
        raise ValueError("continuous features must be different places in the row")
    wanted = list(range(width)) if only is None else list(only)
    classes = (df.agg(F.max("y")).first()[0] or 0) + 1
    points = mdlp.candidates(mdlp.point_hist(df, features, wanted), classes).select("feature", "cut").collect()
    by_feature: dict[int, list[float]] = {}
    for r in points:
        by_feature.setdefault(r.feature, []).append(r.cut)
    plan = chunks({f: len(c) for f, c in by_feature.items()}, partitions, o.factor, o.seed)
    cuts: list[list[float] | None] = [None] * width
    for f in wanted:
        cuts[f] = ONE_BIN
    if not plan:
        return Thresholds(cuts)

    def evolve(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part.part.iloc[0])
        own = plan[number % len(plan)]
        part = part.sort_values("row_id")
        values = np.array([[row[f] for f in own] for row in part[features]], np.float32)
        at = np.concatenate([np.sort(np.array(by_feature[f], np.float32)) for f in own])
        of = np.repeat(np.arange(len(own)), [len(by_feature[f]) for f in own])
        mask = Search(at, of, values, part.y.to_numpy(np.int64), o, o.seed + number).run()
        return pd.DataFrame({"chunk": number % len(plan), "feature": np.array(own)[of[mask]].astype(np.int32), "cut": at[mask]})

    sample = df.sampleBy("y", {c: o.rate for c in range(classes)}, o.seed).select("row_id", "y", features, F.pmod(F.xxhash64("row_id"), F.lit(max(partitions, len(plan)))).cast("int").alias("part"))
    votes = sample.groupBy("part").applyInPandas(evolve, "chunk int, feature int, cut float").groupBy("chunk", "feature", "cut").count().collect()
    each = max(1, o.votes // len(plan))
    for c in range(len(plan)):
        ranked = sorted((r for r in votes if r.chunk == c), key=lambda r: (-r["count"], r.feature, r.cut))[:each]
        for r in ranked:
            cuts[r.feature] = sorted([*(cuts[r.feature] if cuts[r.feature] is not ONE_BIN else []), r.cut])
    return Thresholds(cuts)
