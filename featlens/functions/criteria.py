"""Selection criteria: scores of features from their relevance and their pairs with the features selected so far.

A criterion is an aggregate over the pair table (feature, step, mi, cmi): here
as a Spark expression (over columns rel, mi, cmi, grouped by feature), and as
the same function of arrays, which the greedy loop uses on the few numbers
that reach the driver. Any object with both can be passed instead of a name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    """score: (rel [features], mi [steps, features], cmi) -> [features]; expression: the same as a Spark aggregate."""

    name: str
    score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    expression: Callable[[], Column]
    needs_pairs: bool = True


def _rel() -> Column:
    return F.first("rel")


def mim() -> Criterion:
    return Criterion("mim", lambda rel, mi, cmi: rel, _rel, needs_pairs=False)


def mifs(beta: float = 0.0) -> Criterion:
    return Criterion("mifs", lambda rel, mi, cmi: rel - beta * mi.sum(0), lambda: _rel() - beta * F.sum("mi"))


def jmi() -> Criterion:
    return Criterion("jmi", lambda rel, mi, cmi: rel - mi.mean(0) + cmi.mean(0), lambda: _rel() - F.avg("mi") + F.avg("cmi"))


def mrmr() -> Criterion:
    return Criterion("mrmr", lambda rel, mi, cmi: rel - mi.mean(0), lambda: _rel() - F.avg("mi"))


def cmim(name: str = "cmim") -> Criterion:
    return Criterion(name, lambda rel, mi, cmi: rel - np.maximum((mi - cmi).max(0), 0), lambda: _rel() - F.greatest(F.lit(0.0), F.max(F.col("mi") - F.col("cmi"))))


def informative_fragments() -> Criterion:
    return cmim("if")


def icap() -> Criterion:
    return Criterion("icap", lambda rel, mi, cmi: rel - np.maximum(mi - cmi, 0).sum(0), lambda: _rel() - F.sum(F.greatest(F.lit(0.0), F.col("mi") - F.col("cmi"))))


CRITERIA: dict[str, Callable[..., Criterion]] = {"mim": mim, "mifs": mifs, "jmi": jmi, "mrmr": mrmr, "cmim": cmim, "if": informative_fragments, "icap": icap}


def criterion(name: str | Criterion, beta: float = 0.0) -> Criterion:
    if isinstance(name, Criterion):
        return name
    if name not in CRITERIA:
        raise ValueError(f"criterion unknown: {name}")
    return mifs(beta) if name == "mifs" else CRITERIA[name]()
