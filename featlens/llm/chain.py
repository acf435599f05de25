"""Linear-chain conditional random fields over many texts at once.

All tokens of a batch are one chain in which a text's first token forgets what
came before. The chain is cut into about sqrt(n) pieces; one pass multiplies
the transfer matrices of all pieces in step, a short loop joins the pieces, and
a second pass fills them in. So one very long text costs no more than many
short ones.
"""

from __future__ import annotations

import numpy as np


def _pieces(score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, piece, state) scores and (step, piece) first flags; the padding at the end is texts of its own."""
    n, k = score.shape
    steps = max(1, int(np.sqrt(n)))
    m = -(-n // steps)
    e = np.zeros((m * steps, k))
    e[:n] = score
    f = np.ones(m * steps, bool)
    f[:n] = first
    return np.ascontiguousarray(e.reshape(m, steps, k).transpose(1, 0, 2)), np.ascontiguousarray(f.reshape(m, steps).T)


def _back(x: np.ndarray, n: int) -> np.ndarray:
    return x.transpose(1, 0, *range(2, x.ndim)).reshape(-1, *x.shape[2:])[:n]


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """P(state) of each token by forward-backward. With pairs also the log likelihood's normaliser and the expected transitions and starts."""
    n, k = score.shape
    if n == 0:
        return np.zeros((0, k))
    top = score.max(1)
    e, f = _pieces(np.exp(score - top[:, None]), first)
    e[e.sum(2) == 0] = 1  # padding
    a, pi = np.exp(trans), np.exp(start)
    steps, m = f.shape

    def matrix(t):
        return np.where(f[t][:, None, None], pi[None, None, :], a[None]) * e[t][:, None, :]

    whole = np.broadcast_to(np.eye(k), (m, k, k))
    for t in range(steps):
        whole = whole @ matrix(t)
        whole = whole / whole.max((1, 2), keepdims=True)
    before, after = np.full((m, k), 1.0 / k), np.full((m, k), 1.0 / k)
    for s in range(1, m):
        v = before[s - 1] @ whole[s - 1]
        before[s] = v / v.sum()
        w = whole[m - s] @ after[m - s]
        after[m - s - 1] = w / w.sum()
    alpha, beta, size = np.empty((steps, m, k)), np.empty((steps, m, k)), np.empty((steps, m))
    v = before
    for t in range(steps):
        v = np.where(f[t][:, None], pi, v @ a) * e[t]
        size[t] = v.sum(1)
        v = v / size[t][:, None]
        alpha[t] = v
    w = after
    for t in range(steps - 1, -1, -1):
        beta[t] = w
        w = e[t] * w
        w = np.where(f[t][:, None], 1.0, w @ a.T)
        w = w / w.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    p, alpha, beta, e = _back(p, n), _back(alpha, n), _back(beta, n), _back(e, n)
    if not pairs:
        return p
    z = np.log(_back(size, n)).sum() + top.sum()
    at = np.flatnonzero(~first)
    both = alpha[at - 1][:, :, None] * a[None] * (e[at] * beta[at])[:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    return p, z, both.sum(0), p[first].sum(0)


def viterbi(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest states."""
    n, k = score.shape
    if n == 0:
        return np.zeros(0, np.int64)
    e, f = _pieces(score, first)
    steps, m = f.shape

    def matrix(t):
        return np.where(f[t][:, None, None], start[None, None, :], trans[None]) + e[t][:, None, :]

    whole = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(m, 0)
    for t in range(steps):
        x = matrix(t)
        whole = np.stack([(whole[:, :, :] + x[:, :, j][:, None, :]).max(2) for j in range(k)], 2)
        whole = whole - whole.max((1, 2), keepdims=True)
    before = np.zeros((m, k))
    for s in range(1, m):
        v = (before[s - 1][:, None] + whole[s - 1]).max(0)
        before[s] = v - v.max()
    pointer, v = np.empty((steps, m, k), np.int8), before
    for t in range(steps):
        x = v[:, :, None] + matrix(t)
        pointer[t] = x.argmax(1)
        v = x.max(1)
        v = v - v.max(1, keepdims=True)
    # which state before a piece each of its last states comes from
    from_last = np.broadcast_to(np.arange(k), (m, k)).copy()
    rows = np.arange(m)
    for t in range(steps - 1, -1, -1):
        from_last = pointer[t][rows[:, None], from_last]
    last = np.empty(m, np.int64)
    last[m - 1] = v[m - 1].argmax()
    for s in range(m - 1, 0, -1):
        last[s - 1] = from_last[s, last[s]]
    out, now = np.empty((steps, m), np.int64), last
    for t in range(steps - 1, -1, -1):
        out[t] = now
        now = pointer[t][rows, now]
    return _back(out, n)


def fit(features: list[np.ndarray], sizes: list[int], labels: np.ndarray, first: np.ndarray, states: int, rounds: int = 60, l2: float = 1e-5, rate: float = 0.3):
    """(weights, trans, start) by Adam on the mean log likelihood of the labelled chain; features: for each kind, one id of each token; all starts at 0, so reruns agree."""
    n = len(labels)
    weights = [np.zeros((v, states)) for v in sizes]
    params = [*weights, np.zeros((states, states)), np.zeros(states)]
    m1, m2 = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    told = np.zeros((n, states))
    told[np.arange(n), labels] = 1
    at = np.flatnonzero(~first)
    seen = np.zeros((states, states))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    begun = np.bincount(labels[first], minlength=states).astype(float)
    for r in range(1, rounds + 1):
        score = sum(w[f] for w, f in zip(weights, features, strict=True))
        p, _, both, starts = marginals(score, first, params[-2], params[-1], pairs=True)
        off = told - p
        grads = [np.stack([np.bincount(f, off[:, s], v) for s in range(states)], 1) for f, v in zip(features, sizes, strict=True)]
        grads += [seen - both, begun - starts]
        for i, g in enumerate(grads):
            g = g / n - l2 * params[i]
            m1[i] += 0.1 * (g - m1[i])
            m2[i] += 0.01 * (g * g - m2[i])
            params[i] += rate * (m1[i] / (1 - 0.9**r)) / (np.sqrt(m2[i] / (1 - 0.99**r)) + 1e-9)
    return weights, params[-2], params[-1]
