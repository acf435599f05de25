"""Toxic spans by a linear-chain conditional random field, and scores of whole documents.

Tokens are runs of bytes between ASCII punctuation and white space, A-Z lowered.
Labels are given for documents. Words that labelled toxic documents hold
markedly more often than others become the labelled tokens of those documents;
the field is fitted on the tokens of a bounded sample. Its states are "toxic"
and "other"; a token's features are itself and its two neighbours.
Forward-backward gives each token's P(toxic); a document's evidence is
-sum(log(1 - P^2)) (the square keeps thousands of near-zero P from adding
up), which a logistic curve, fitted on the sample's labels, turns
into a score.

Null and empty texts have no tokens: they get the score of no evidence. Very
long texts are scored whole. Repeated rows are scored each, and count once for
the fit; of a doc_id with two labels the larger counts. Null doc_ids are kept
and count as not held out. Labels that are null, or not 0 or 1, are not used.
With no labels of one of the classes all scores are the share of label 1 (0
with no labels). An empty table gives no rows. Extra columns, whatever their
names, are ignored, or kept by rejecting().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm import chain, text
from featlens.llm.storage import sampled

TABLE = text.byte_table(text.SPACE + b"!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~")
#: Labelled documents that the fit reads at most, as an expected number.
SAMPLE_DOCS = 8_000
#: Tokens that the field is fitted on at most; a longer sampled text gives RUNS runs of RUN tokens, evenly spread over it.
FIT_TOKENS, RUNS, RUN = 250_000, 12, 1000


@dataclass
class Model:
    """words: sorted hashes; weights of a token for being toxic by its own, previous and next word (row 0: other words)."""

    words: np.ndarray
    own: np.ndarray
    previous: np.ndarray
    following: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    slope: float
    level: float

    def tokens(self, toks: text.Tokens) -> np.ndarray:
        """P(toxic) of each token."""
        if not len(toks.start) or not len(self.words):
            return np.zeros(len(toks.start))
        first = toks.first()
        ids = text.Lookup(self.words)(toks.hash)
        return chain.marginals(self._scores(ids, first), first, self.trans, self.start)[:, 1]

    def _scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        before, after = neighbours(ids, first)
        s = np.zeros((len(ids), 2))
        s[:, 1] = self.own[ids] + self.previous[before] + self.following[after]
        return s

    def documents(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.log(evidence + 1e-3) + self.level)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def neighbours(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.zeros_like(ids), np.zeros_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[first] = 0
    after[:-1][first[1:]] = 0
    return before, after


def evidence_of(p: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-9) ** 2))])
    return np.maximum(sums[of_doc[1:]] - sums[of_doc[:-1]], 0)


def learn(docs: list[np.ndarray], labels: np.ndarray) -> Model:
    """docs: token hashes of each sampled text. Near copies count once: they share one of three minima over hashed word triples."""
    labels = np.asarray(labels, np.int64)
    none = np.zeros(0, np.uint64)
    prior = float(labels.mean()) if len(labels) else 0.0
    flat = Model(none, *[np.zeros(1)] * 3, np.zeros((2, 2)), np.zeros(2), 0.0, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 40.0 * (prior * 2 - 1))
    if not 0 < prior < 1:
        return flat
    taken, seen = [], set()
    for i, d in enumerate(docs):
        if len(d) < 3:
            continue
        t = text.mix(d[:-2] ^ text.mix(d[1:-1] ^ text.mix(d[2:])))
        keys = {(s, int(text.mix(t ^ np.uint64(s)).min())) for s in (1, 2, 3)}
        if not keys & seen:
            taken.append(i)
        seen |= keys
    if not taken:
        return flat
    y = labels[taken]
    sets = [np.unique(docs[i]) for i in taken]
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(y, [len(s) for s in sets])
    df1 = np.bincount(inverse[of == 1], minlength=len(every)).astype(float)
    df0 = np.bincount(inverse[of == 0], minlength=len(every)).astype(float)
    share = y.mean()
    if not 0 < share < 1:
        return flat
    n, q = df1 + df0, df1 / (df1 + df0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(df1 > 0, df1 * np.log(q / share), 0) + np.where(df0 > 0, df0 * np.log((1 - q) / (1 - share)), 0))
    seeds = every[(gain >= 15) & (q >= 0.6) & (df1 >= 3)]
    words = every[(n >= 5) | np.isin(every, seeds)]
    look = text.Lookup(words)
    # toxic and other documents in turn, as far as the bound on tokens goes
    order, left = [], FIT_TOKENS
    for a, b in zip(*[np.resize(np.flatnonzero(y == v), len(y)) for v in (1, 0)], strict=True):
        for j in (a, b):
            if j not in order[-400:] and left >= len(docs[taken[j]]):
                order.append(j)
                left -= len(docs[taken[j]])
        if left < 500 or len(order) >= 2 * max((y == 1).sum(), (y == 0).sum()) or len(order) > 4000:
            break
    if not order:
        return flat
    order = list(dict.fromkeys(order))
    lengths = np.array([len(docs[taken[j]]) for j in order])
    ids = look(np.concatenate([docs[taken[j]] for j in order]))
    first = np.zeros(len(ids), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    is_seed = np.concatenate([[False], np.isin(look.known, seeds)])
    tags = (is_seed[ids] & (np.repeat(y[order], lengths) == 1)).astype(np.int64)
    before, after = neighbours(ids, first)
    # most documents are shown without neighbours, so that a word counts by itself where they are new
    hidden = np.repeat(np.arange(len(order)) % 4 != 0, lengths)
    before[hidden] = after[hidden] = 0
    v = len(look.known) + 1
    (own, prev, nxt), trans, start = chain.fit([ids, before, after], [v] * 3, tags, first, 2)
    model = Model(look.known, own[:, 1] - own[:, 0], prev[:, 1] - prev[:, 0], nxt[:, 1] - nxt[:, 0], trans, start, 1.0, 0.0)
    # the curve, on all sampled documents that count, some at a time
    found = []
    for lo in range(0, len(taken), 256):
        part = [docs[i] for i in taken[lo : lo + 256]]
        of_doc = np.concatenate([[0], np.cumsum([len(d) for d in part])])
        ids = look(np.concatenate(part))
        first = np.zeros(len(ids), bool)
        first[of_doc[:-1]] = True
        found.append(evidence_of(chain.marginals(model._scores(ids, first), first, trans, start)[:, 1], of_doc))
    x = np.log(np.concatenate(found) + 1e-3)
    b = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], 1)

    def loss(b):
        return np.logaddexp(0, z @ b).sum() - y @ (z @ b) + 5e-4 * b @ b

    for _ in range(100):
        s = sigmoid(z @ b)
        g = z.T @ (y - s) - 1e-3 * b
        h = (z * (s * (1 - s))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-9:
            step /= 2
        b = b + step
    model.slope, model.level = float(max(b[0], 0)), float(b[1])
    return model


def _spread(tokens: np.ndarray) -> np.ndarray:
    if len(tokens) <= RUNS * RUN:
        return tokens
    return np.concatenate([tokens[a : a + RUN] for a in np.linspace(0, len(tokens) - RUN, RUNS).astype(int)])


def _hashed(batches):
    for b in batches:
        out = []
        for lo, hi, buf, offs in text.slices(b.column("text")):
            t = text.Tokens(buf, offs, TABLE)
            h = t.hash
            out += [_spread(h[t.of_doc[i] : t.of_doc[i + 1]]).tobytes() for i in range(hi - lo)]
        yield pa.record_batch([b.column("label"), pa.array(out, pa.binary())], ["label", "tokens"])


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on documents (doc_id, text) whose doc_id labels gives; about sample_docs of them, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = sampled(known, ["doc_id"], sample_docs, known.count())
    # at most about sample_docs rows of known; repeated rows count once
    joined = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id").distinct()
    rows = joined.orderBy("doc_id", "text").select("label", "text").mapInArrow(_hashed, "label int, tokens binary").toArrow()
    docs = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("tokens")]
    return learn(docs, np.array(rows.column("label").to_pylist(), np.int64))


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """documents' doc_id, score (0 to 1) and spans: [start, end) code points of the tokens whose P(toxic) is threshold or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        m = shared.value
        for b in batches:
            scores, spans = [], []
            for lo, hi, buf, offs in text.slices(b.column("text")):
                t = text.Tokens(buf, offs, TABLE)
                p = m.tokens(t)
                scores.append(m.documents(evidence_of(p, t.of_doc)))
                found = [[] for _ in range(hi - lo)]
                hits = np.flatnonzero(p >= threshold)
                of = np.searchsorted(t.of_doc, hits, "right") - 1
                for d in np.unique(of):
                    h = hits[of == d]
                    at = np.stack([t.start[h], t.end[h]], 1).ravel() - offs[d]
                    found[d] = text.code_points(buf[offs[d] : offs[d + 1]], at).reshape(-1, 2).tolist()
                spans += found
            yield pa.record_batch([b.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "score", "spans"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {doc_id}, score double, spans array<array<bigint>>")


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def rejecting(documents: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """documents, all their columns, without those whose score is threshold or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def kept(batches):
        m = shared.value
        for b in batches:
            scores = [m.documents(evidence_of(m.tokens(t), t.of_doc)) for t in (text.Tokens(buf, offs, TABLE) for _, _, buf, offs in text.slices(b.column(at)))]
            yield b.filter(pa.array(np.concatenate(scores) < threshold)) if scores else b

    return documents.mapInArrow(kept, documents.schema)
