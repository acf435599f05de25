"""Connected components by contraction, without edges or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.storage import merging, written


def _roots(labels: DataFrame) -> DataFrame:
    """labels (node, root), each root smaller than its node or equal -> the same with the ends of the chains, by pointer jumping."""
    while True:
        step = written(labels.join(merging(labels.toDF("root", "far")), "root").select("node", F.col("root").alias("old"), F.col("far").alias("root")), "labels")
        moved = step.where("root <> old").limit(1).count()
        labels = step.select("node", "root")
        if not moved:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigint nodes -> (node, root): for every node of an edge the smallest node it can reach.

    Each round hangs every node on the smallest of its neighbours and itself,
    follows these chains to their ends, and goes on with the edges between the
    ends, which are few: every edge is joined to labels once. A round at least
    halves the nodes of a component that is not done. Nulls, loops and repeated
    edges are no edges. No edges: no rows.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        hung = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        labels = _roots(written(hung, "labels"))
        if found is None:
            found = labels
        else:
            found = written(found.join(merging(labels.toDF("root", "next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = e.join(merging(labels.toDF("a", "x")), "a").join(merging(labels.toDF("b", "y")), "b").where("x <> y")
        e = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if e.limit(1).count() == 0:
            return found
