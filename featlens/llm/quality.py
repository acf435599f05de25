"""Quality rules: fixed statistics of whole texts, and gradient-boosted trees over them.

The trees are fitted on labelled documents (a bounded sample) with monotonic
constraints: the score may only fall as the shares of symbols, of repeated
words, of repeated lines and of capitals rise. They are kept as flat numpy
arrays of nodes, and all rows of a batch walk down a tree together.

Null and empty texts have no words: they fail the base rules. Very long texts
are counted whole. Repeated rows are judged each, null doc_ids are kept, extra
columns are ignored. Without labels of both classes the trees are one leaf and
the base rules alone decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm import text
from featlens.llm.storage import sampled

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: The base rules: at least so many words, at most so many repeated ones of a hundred.
MIN_WORDS, MAX_REPEATED = 20, 30
#: Labelled documents that the trees are fitted on at most, as an expected number.
SAMPLE_DOCS = 8_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees use, and the direction in which each may move the score (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": -1, "stop_share": 0, "line_length": 0}

_SPACE = np.zeros(256, bool)
_SPACE[list(text.SPACE)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def repeated_words(ids: list[int]) -> int:
    """How many words lie in windows of WINDOW words that occur twice or more.

    Windows get exact numbers by doubling: pairs of words, pairs of those, and
    so on. Only places whose shorter window already repeats go on.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    v = np.asarray(ids, np.int64)
    size = 1
    rank, alive = v, np.arange(len(v))
    while size < WINDOW:
        at = alive[alive + size < len(rank)]
        at = at[(rank[at] >= 0) & (rank[at + size] >= 0)]
        key = rank[at] * (len(v) + 1) + rank[at + size]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        rank = np.full(len(v), -1, np.int64)
        alive = at[twice]
        rank[alive] = inverse[twice]
        size *= 2
        if not len(alive):
            return 0
    edge = np.zeros(len(v) + 1, np.int64)
    edge[alive] += 1
    np.add.at(edge, alive + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 5) counts and (texts, features) statistics."""
    data = buf.tobytes()
    space = _SPACE[buf]

    def per_text(flag):
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[offs[1:]] - sums[offs[:-1]]

    n = len(offs) - 1
    counts = np.zeros((n, 5), np.int64)
    counts[:, 1] = per_text(~space & ((buf & 0xC0) != 0x80))
    counts[:, 2] = per_text(_SYMBOL[buf])
    upper, digit, ends = per_text((buf >= 65) & (buf <= 90)), per_text((buf >= 48) & (buf <= 57)), per_text(_ENDS[buf])
    lines, distinct = np.zeros(n), np.zeros(n)
    for d in range(n):
        doc = data[offs[d] : offs[d + 1]]
        words = doc.split()
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        full = [x for x in doc.split(b"\n") if x and not x.isspace()]
        counts[d, 0] = len(words)
        counts[d, 3] = len(full) - len(set(full))
        counts[d, 4] = repeated_words(ids) if len(number) < len(ids) else 0
        lines[d], distinct[d] = len(full), len(number)
    w, c = np.maximum(counts[:, 0], 1), np.maximum(counts[:, 1], 1)
    stats = np.stack([np.log1p(counts[:, 0]), counts[:, 1] / w, counts[:, 2] / c, counts[:, 3] / np.maximum(lines, 1), counts[:, 4] / w, distinct / w, upper / c, digit / c, ends / w, w / np.maximum(lines, 1)], 1)
    return counts, stats


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


@dataclass
class Trees:
    """Nodes of all trees: feature (-1: leaf), cut (rows at or below go left), left (right is left + 1), value. roots: first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The log odds of label 1 for each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.cut[at]), at)
            out += self.value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over binned statistics.

    A split that goes against its feature's direction is not considered, and a
    child's values stay on its side of the middle between it and its sibling,
    so the whole score is monotonic in every constrained feature.
    """
    prior = float(y.mean()) if len(y) else 1.0
    lists: tuple[list, ...] = ([], [], [], [])
    feature, cut, left, value = lists
    roots: list[int] = []
    flat = 0 < prior < 1
    base = float(np.log(prior / (1 - prior))) if flat else (20.0 if prior == 1 else -20.0)
    if flat:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        score = np.full(len(y), base)
    for _ in range(trees if flat else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        for part, v in zip(lists, (-1, 0.0, 0, 0.0), strict=True):
            part.append(v)
        todo = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, depth)]
        while todo:
            node, rows, low, high, deep = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(gs / (hs + l2), low, high))
            best = (1e-6, None)
            for f, e in enumerate(edges if deep else []):
                if not len(e):
                    continue
                a = np.bincount(code[rows, f], g[rows], len(e) + 1).cumsum()[:-1]
                b = np.bincount(code[rows, f], h[rows], len(e) + 1).cumsum()[:-1]
                lv, rv = np.clip(a / (b + l2), low, high), np.clip((gs - a) / (hs - b + l2), low, high)
                gain = (a * lv - (b + l2) * lv * lv / 2) + ((gs - a) * rv - (hs - b + l2) * rv * rv / 2) - (gs * v - (hs + l2) * v * v / 2)
                gain[(b < least) | (hs - b < least) | (directions[f] * (rv - lv) < 0)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, lv[k], rv[k]))
            if best[1] is None:
                value[node] = rate * v
                score[rows] += rate * v
                continue
            f, k, lv, rv = best[1]
            feature[node], cut[node], left[node] = f, float(edges[f][k]), len(feature)
            for part, u in zip(lists, (-1, 0.0, 0, 0.0), strict=True):
                part += [u, u]
            goes = code[rows, f] > k
            middle, d = (lv + rv) / 2, directions[f]
            todo.append((left[node], rows[~goes], middle if d < 0 else low, middle if d > 0 else high, deep - 1))
            todo.append((left[node] + 1, rows[goes], middle if d > 0 else low, middle if d < 0 else high, deep - 1))
    return Trees(np.array(roots, np.int64), np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), base)


def _measured(batches):
    for b in batches:
        stats = [statistics(buf, offs)[1] for _, _, buf, offs in text.slices(b.column("text"))]
        flat = np.concatenate(stats) if stats else np.zeros((0, len(FEATURES)))
        yield pa.record_batch([b.column("label"), pa.array(flat.tolist(), pa.list_(pa.float64()))], ["label", "stats"])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Fits on documents (doc_id, text) whose doc_id labels gives; about sample_docs of them, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = sampled(known, ["doc_id"], sample_docs, known.count())
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(_measured, "label int, stats array<double>").toArrow()
    x = np.array(rows.column("stats").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same whatever order the rows came in
    return boost(x[order], y[order], list(FEATURES.values()))


def judge(documents: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """documents' doc_id, the counts, base_failed, score (P of label 1) and kept: not base_failed, and score is threshold or more."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def judged(batches):
        model = shared.value
        for b in batches:
            parts = [statistics(buf, offs) for _, _, buf, offs in text.slices(b.column("text"))]
            counts = np.concatenate([c for c, _ in parts]) if parts else np.zeros((0, 5), np.int64)
            score = 1 / (1 + np.exp(-model(np.concatenate([s for _, s in parts])))) if parts else np.zeros(0)
            failed = base_failed(counts)
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(judged, f"doc_id {doc_id}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
