"""Whitening of embeddings by their leading principal components.

Entries are counted in whole numbers, floor(SCALE * c), so that equal rows are
equal and sums are exact. The fit list has each different vector once. Its
covariance V (divisor n) is never made: a random block of more columns than
components wanted is multiplied with it, again and again, each pass being one
job over all centred rows of the fit list whose partial products are added up.
Between passes the block is made orthonormal; Rayleigh-Ritz in the block's
range gives eigenvalues and eigenvectors, and the residuals of V bound the
vectors' errors. If these bounds fail, that is, if they don't fall so fast that
they are below TOLERANCE after PASSES passes, the block is expanded to the full
dimension, in which Rayleigh-Ritz is exact.

Rows whose vector is null, empty, or holds null or non-finite entries are left
out. Vectors of different lengths raise an error. Repeated rows and ties stay:
each row has its own results, and equal vectors count once in the fit. Of equal
eigenvalues any basis is returned, the same for all rows. A component along
which nothing varies has no unit variance: its values and explained share are
null and 0. A row without id keeps its null. An entry or a sum of squares beyond
64 bits raises an error. No rows: an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.storage import written

COMPONENTS, OVERSAMPLING, SCALE = 4, 8, 256
PASSES, TOLERANCE, SEED = 24, 1e-12, 42
#: Passes after which the rate of convergence is judged.
SETTLED = 3
#: Values of a batch's vectors that are held as doubles at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Model:
    """mean and sums of n vectors; vectors: a column for each component; values: its eigenvalue; trace of the covariance; error: of the whitened covariance against the identity; full: whether the block had to be expanded."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float
    passes: int
    full: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt of each eigenvalue; 0 where nothing varies."""
        varies = self.values > self.trace * len(self.sums) * 1e-15
        return np.where(varies, 1 / np.sqrt(np.where(varies, self.values, 1)), 0)


def whole(embeddings: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id_column, x array<bigint>) of the rows with a vector of finite entries."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = embeddings.where((F.size(column) > 0) & finite)
    return kept.select(id_column, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("x"))


def matrices(column: pa.Array, d: int):
    """The vectors as matrices of whole numbers, some rows at a time."""
    step = max(1, STEP // d)
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        yield lo, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _added(fit: DataFrame, d: int, mean: np.ndarray | None, product) -> np.ndarray:
    """The sum of product(centred rows) over all rows; each task adds up its own first. Partial sums are added by place, so a task's result is never one row on one machine."""
    centre = np.zeros(d) if mean is None else mean

    def partial(batches):
        total = None
        for b in batches:
            for _, x in matrices(b.column("x"), d):
                p = product(x - centre).ravel()
                total = p if total is None else total + p
        if total is not None:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["p"])

    parts = fit.select("x").mapInArrow(partial, "p array<double>").select(F.posexplode("p").alias("i", "v"))
    return np.array([r.v for r in parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])


def fit(vectors: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> Model | None:
    """The model of whole()'s rows (x); None of no rows. Driver and tasks hold a few matrices of dimension by dimension at most."""
    rows = written(vectors.select("x").distinct(), "whitening-fit")
    lengths = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("d"), F.count("*").alias("n")).first()
    if not lengths.n:
        return None
    if lengths.low != lengths.d:
        raise ValueError(f"vectors have between {lengths.low} and {lengths.d} entries")
    d, n = lengths.d, lengths.n
    summed = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    sums = [r.v for r in summed]
    mean = np.array([s / n for s in sums])
    k = min(components, d)
    width = min(d, k + oversampling)

    def image(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and V's trace."""
        out = _added(rows, d, mean, lambda a: np.append(a.T @ (a @ q), (a * a).sum()))
        return out[:-1].reshape(q.shape) / n, out[-1] / n

    def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        return values, q @ turn, np.linalg.norm(vq @ turn - q @ turn * values, axis=0), vq @ turn

    def bound(values: np.ndarray, residuals: np.ndarray) -> float:
        """The largest error of a component wanted: residual / gap."""
        behind = np.append(values[1:], 0.0) if len(values) < d else np.append(values[1:], -np.inf)
        ahead = np.append(np.inf, values[:-1])
        gaps = np.minimum(ahead - values, values - behind)[:k]
        return float(np.max(residuals[:k] / np.maximum(gaps, 1e-300)))

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    done, full, trace, before = 0, width == d, 0.0, math.inf
    while True:
        vq, trace = image(q)
        done += 1
        values, ritz_vectors, residuals, images = ritz(q, vq)
        error = bound(values, residuals)
        if full or error <= TOLERANCE or not trace:
            break
        # at this pass's rate, the bound after all passes; the first passes tell nothing yet
        falls = math.log(min(error / before, 1.0)) if done > SETTLED else -math.inf
        before = error
        if done < passes and math.log(error / TOLERANCE) + falls * (passes - done) <= 0:
            q = np.linalg.qr(images)[0]
        else:
            q = np.linalg.qr(np.hstack([ritz_vectors, np.random.default_rng(SEED + 1).standard_normal((d, d - width))]))[0]
            full = True
    u, e = ritz_vectors[:, :k], np.maximum(values[:k], 0)
    model = Model(n, sums, u, e, float(trace), 0.0, done, full)
    varies = np.flatnonzero(model.scales)
    turned = (u * model.scales)[:, varies]
    covariance = _added(rows, d, mean, lambda a: (a @ turned).T @ (a @ turned)).reshape(len(varies), len(varies)) / n if len(varies) else np.zeros((0, 0))
    return Model(n, sums, u, e, float(trace), float(np.abs(covariance - np.eye(len(varies))).max(initial=0)), done, full)


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2 of each row, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
    if most**2 * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def apply(vectors: DataFrame, model: Model | None, id_column: str = "vec_id") -> DataFrame:
    """(id_column, component, n, deviation, whitened, explained, identity_error): for each row of whole() and each component its projection over its standard deviation. deviation: how far from the mean the row is, the sum over dimensions of (n * x - S)**2."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, deviation bigint, w array<double>"
    if model is None:
        scored = vectors.where("false").select(id_column, F.lit(0).cast("bigint").alias("deviation"), F.array(F.lit(0.0)).alias("w"))
        n, shares, error = 0, [0.0], 0.0
    else:
        n, sums, mean, error = model.n, model.sums, model.mean, model.error
        turned, varies = model.vectors * model.scales, model.scales > 0
        shares = [float(v) / model.trace if model.trace else 0.0 for v in model.values]

        def of(batches):
            for b in batches:
                for lo, x in matrices(b.column("x"), len(sums)):
                    w = ((x - mean) @ turned).tolist()
                    w = [[v if ok else None for v, ok in zip(r, varies, strict=True)] for r in w]
                    yield pa.record_batch([b.column(id_column).slice(lo, len(x)), pa.array(_squares(x, n, sums), pa.int64()), pa.array(w, pa.list_(pa.float64()))], [id_column, "deviation", "w"])

        scored = vectors.select(id_column, "x").mapInArrow(of, schema)
    parts = scored.select(id_column, "deviation", F.posexplode("w").alias("i", "whitened"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("i") + 1)
    return parts.select(id_column, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def whiten(embeddings: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """apply() of the embeddings' own fit."""
    vectors = whole(embeddings, column, id_column)
    return apply(vectors, fit(vectors, components), id_column)
