import math

import numpy as np
import pytest

from featlens.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, x string, w double")


def brute(x, k=4):
    """Distinct rows' n, sums, eigenvalues, vectors, trace."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    a = fit - sums / n
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    return n, sums, e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


def check(rows, got, k):
    ids = [i for i, _ in rows]
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 256).astype(np.int64)
    n, sums, e, u, trace = brute(x, k)
    w = (x - sums / n) @ u / np.sqrt(e)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, len(e) + 1))
    for c, rs in by.items():
        rs = sorted(rs, key=lambda r: (r.vec_id, r.whitened))
        mine = np.array([r.whitened for r in rs])
        want = {s: [v for _, v in sorted(zip(ids, s * w[:, c - 1], strict=True))] for s in (1, -1)}
        assert min(np.abs(mine - want[s]).max() for s in want) < 1e-8
        assert all(r.n == n and math.isclose(r.explained, e[c - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-9 for r in rs)
        squares = sorted((i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))) for i, v in zip(ids, x, strict=True))
        assert sorted((r.vec_id, r.deviation) for r in rs) == squares


def test_query_is_the_direct_computation(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, queries.op12_whitening(spark, SF).collect(), 4)


@pytest.mark.parametrize("spread", [np.geomspace(3, 0.05, 40), np.array([3.0, 2.5, 2.0, 1.5] + [0.02] * 36), np.ones(40)])
def test_steep_and_flat_spectra(spark, spread):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((600, 40)) * spread).astype(np.float32)
    v[300:] = v[np.arange(300) % 7]  # copies count once in the fit
    rows = list(enumerate(v.tolist()))
    vectors = whitening.whole(frame(spark, rows))
    model = whitening.fit(vectors)
    assert model.n == 300
    # a steep spectrum is settled in the block, a flat one needs the full dimension
    assert model.full == (spread.min() == spread.max())
    check(rows, whitening.apply(vectors, model).collect(), 4)


def test_rows_without_a_vector_go_and_others_stay(spark):
    good = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, [-1.0, 0.0, 2.0]), (3, [3.0, 1.5, -0.001]), (None, [0.1, 0.1, 0.1]), (5, [0.5, -0.25, 1.0])]
    bad = [(6, None), (7, [0.1, None, 0.2]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good for _ in range(3))
    assert {r.n for r in got} == {4} and {r.component for r in got} == {1, 2, 3}
    for c in (1, 2, 3):
        assert len({r.whitened for r in got if r.component == c and r.vec_id in (1, 5)}) == 1


def test_nothing_varies_and_nothing_there(spark):
    same = whitening.whiten(frame(spark, [(i, [0.5, 0.5]) for i in range(3)])).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in same} == {(1, 0, None, 0.0)}
    line = whitening.whiten(frame(spark, [(i, [float(i), 0.0]) for i in range(5)])).collect()
    assert {r.whitened for r in line if r.component == 2} == {None}
    assert math.isclose(sum(r.whitened**2 for r in line if r.component == 1), 5)
    empty = frame(spark, [(1, [1.0])]).where("false")
    out = whitening.whiten(empty)
    assert out.count() == 0 and out.columns == whitening.whiten(frame(spark, [(1, [1.0])])).columns


def test_lengths_that_differ_raise(spark):
    with pytest.raises(ValueError, match="between 1 and 2"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_beyond_64_bits_of_products_are_exact_or_raise(spark):
    big = [(1, [2.0e6, -1.0]), (2, [-2.0e6, 1.0]), (3, [0.0, 0.5])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, big)).collect()}
    assert got[1] == (3 * 512_000_000 - 0) ** 2 + (3 * -256 - 128) ** 2
    assert whitening._squares(np.array([[2**40]]), 2**20, [0]) == [2**120]
