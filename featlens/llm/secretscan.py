"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that adds spans.

Patterns are searched left to right without overlaps, each kind by itself;
matches that are too short are dropped. The field tags tokens (runs without
white space, quotes and most punctuation) as outside, begin or inside. Features
are the token's shape (length, share of digits, letter cases, symbols, hex
only), its left and right neighbours' words (hashed), and the file: how much of
it is digits and symbols. Viterbi decodes.

It is fitted on a bounded sample of documents: on the patterns' matches and on
secrets of other alphabets behind other words (ALPHABETS, LEADS), which
are put into every fourth document of the sample (by a hash of its text).
Three quarters of the documents are shown without neighbours. So it
finds what no pattern matches: upper-case hex, base64, tokens behind "bearer"
or in connection strings. With an empty table it adds nothing.

Offsets are code points, ends exclusive. Null is an empty text: no spans. Very
long texts are scanned whole. Repeated rows have the same spans; null doc_ids
are kept. A span of the field that overlaps a pattern's is left out; spans that
start together are in the order of their kinds. An empty table gives no rows.
Extra columns, whatever their names, are ignored, or kept by redacted().
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm import chain, text
from featlens.llm.storage import sampled

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_KEYS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Documents that the fit reads at most, as an expected number; tokens on each side of a secret, and secrets of one document, that it takes; tokens that it is fitted on.
SAMPLE_DOCS, SLICE, SLICES, FIT_TOKENS = 12_000, 50, 3, 160_000
#: Bytes of texts that are scanned at once, or one text.
SLICE_BYTES = 1 << 20
#: What planted secrets are made of, and the words before them.
ALPHABETS = (b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
LEADS = (b"", b"Authorization: Bearer ", b"bearer ", b"auth=", b"pwd: ", b"credential ", b"private_key: ", b"signing key ", b"postgres://svc:", b"login ", b"passphrase: ", b"session=", b"key: ")
TABLE = text.byte_table(text.SPACE + b"!\"#$%&'()*,:;<=>?@[\\]^`{|}~")
BUCKETS, SHAPES, FILES = 4096, 1600, 24
_LENGTHS = np.array([4, 8, 12, 16, 20, 32, 40, 41, 64])


def base_matches(buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its pattern matches as (start byte, kind index, end byte), by start, then kind."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    s, e = text.runs(HEX[buf], offs)
    long = e - s >= MIN_HEX
    s, e = s[long], e[long]
    for d, a, b in zip(np.searchsorted(offs, s, "right") - 1, s, e, strict=True):
        found[d].append((int(a - offs[d]), 2, int(b - offs[d])))
    data = buf.tobytes()
    for d in range(len(offs) - 1):
        doc = data[offs[d] : offs[d + 1]]
        low = doc.lower()
        if any(k in low for k in ASSIGN_KEYS):
            found[d] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(doc) if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if b"AKIA" in doc:
            found[d] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(doc) if m.end() - m.start() >= MIN_ACCESS]
        found[d].sort()
    return found


_CLASS = np.zeros((6, 256), np.int32)  # digit, upper, lower, symbol, hex, non-ASCII
_CLASS[0, 48:58] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 97:123] = 1
_CLASS[3, list(b"+/_.-=")] = 1
_CLASS[4] = HEX
_CLASS[5, 128:] = 1


def features(buf: np.ndarray, offs: np.ndarray, toks: text.Tokens) -> list[np.ndarray]:
    """Shape, previous word, the word before that, next word and file of each token, as ids."""
    n = np.maximum(toks.end - toks.start, 1)
    count = []
    for i, c in enumerate(_CLASS):
        sums = np.concatenate([[0], np.cumsum(c[buf], dtype=np.int64)])
        count.append(sums[toks.end] - sums[toks.start])
        if i in (0, 3):
            of_doc = sums[offs[1:]] - sums[offs[:-1]]
            size = np.maximum(offs[1:] - offs[:-1], 1)
            share = np.searchsorted([0.002, 0.01, 0.05], of_doc / size)
            file = share if i == 0 else file * 4 + share
    digit, upper, lower, symbol, hexa, other = count
    shape = np.searchsorted(_LENGTHS, n, "right") * 5 + np.searchsorted([0.0, 0.2, 0.5, 0.9], digit / n)
    for flag in (upper > 0, lower > 0, symbol > 0, hexa == n, other > 0):
        shape = shape * 2 + flag
    word = (toks.hash % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    first = toks.first()
    at = np.arange(len(n))
    begun = np.maximum.accumulate(np.where(first, at, 0))
    previous, second, following = np.zeros_like(word), np.zeros_like(word), np.zeros_like(word)
    previous[1:], second[2:], following[:-1] = word[:-1], word[:-2], word[1:]
    previous[at - begun < 1] = 0
    second[at - begun < 2] = 0
    following[:-1][first[1:]] = 0
    return [shape, previous, second, following, np.repeat(file, np.diff(toks.of_doc))]


SIZES = [SHAPES, BUCKETS, BUCKETS, BUCKETS, FILES]


@dataclass
class Model:
    """weights of each kind of feature and state (outside, begin, inside); None: adds nothing."""

    weights: list[np.ndarray] | None
    trans: np.ndarray | None = None
    start: np.ndarray | None = None

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each text, the bytes of the secrets that Viterbi finds."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(offs) - 1)]
        toks = text.Tokens(buf, offs, TABLE)
        if self.weights is None or not len(toks.start):
            return found
        score = sum(w[f] for w, f in zip(self.weights, features(buf, offs, toks), strict=True))
        tags = chain.viterbi(score, toks.first(), self.trans, self.start)
        hits = np.flatnonzero(tags)
        for t, d in zip(hits, np.searchsorted(toks.of_doc, hits, "right") - 1, strict=True):
            a, b = int(toks.start[t] - offs[d]), int(toks.end[t] - offs[d])
            if tags[t] == 2 and found[d] and t > toks.of_doc[d] and tags[t - 1]:
                found[d][-1] = (found[d][-1][0], b)
            else:
                found[d].append((a, b))
        return found


def tagged(buf: np.ndarray, offs: np.ndarray, toks: text.Tokens, found: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Tags of the tokens from the patterns' matches; of an assignment only the value counts."""
    tags = np.zeros(len(toks.start), np.int64)
    data = None
    for d, spans in enumerate(found):
        for a, kind, b in spans:
            if kind == 0:
                data = data or buf.tobytes()
                a = ASSIGN.match(data, offs[d] + a, offs[d] + b).start(2) - offs[d]
            lo = np.searchsorted(toks.start, a + offs[d])
            hi = np.searchsorted(toks.start, b + offs[d])
            if lo < hi and not tags[lo]:
                tags[lo] = 1
                tags[lo + 1 : hi] = 2
    return tags


def _planted(doc: bytes) -> tuple[bytes, int, int]:
    """doc with a made secret between two of its words, and the secret's place; all chosen by a hash of doc."""
    rng = np.random.default_rng(zlib.crc32(doc))
    alphabet = np.frombuffer(ALPHABETS[rng.integers(len(ALPHABETS))], np.uint8)
    value = alphabet[rng.integers(0, len(alphabet), int(rng.integers(16, 65)))].tobytes()
    gaps = [m.start() for m in re.finditer(rb"[ \n]", doc)] or [len(doc)]
    at = gaps[int(rng.integers(len(gaps)))]
    lead = b" " + LEADS[rng.integers(len(LEADS))]
    return doc[:at] + lead + value + doc[at:], at + len(lead), at + len(lead) + len(value)


def _taught(doc: bytes) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(has a secret, features, tags) of the stretches of a document that the fit takes."""
    key = zlib.crc32(doc, 1)
    place = None
    if key % 4 == 0:
        doc, *place = _planted(doc)
    buf, offs = np.frombuffer(doc, np.uint8), np.array([0, len(doc)])
    toks = text.Tokens(buf, offs, TABLE)
    found = base_matches(buf, offs)
    feats, tags = np.stack(features(buf, offs, toks)).astype(np.int16), tagged(buf, offs, toks, found)
    if place:
        inside = (toks.start >= place[0]) & (toks.start < place[1])
        tags[inside] = 2
        tags[np.flatnonzero(inside)[:1]] = 1
    if key // 16 % 4:
        feats[1:4] = 0
    at = np.flatnonzero(tags == 1)
    if not len(at) and key % 16 != 1 or not len(tags):
        return []
    centres = at[:SLICES] if len(at) else [key // 64 % len(tags)]
    return [(len(at) > 0, feats[:, s], tags[s]) for s in (slice(max(0, c - SLICE), c + SLICE) for c in centres)]


def _labelled(batches):
    for b in batches:
        hit, feats, tags = [], [], []
        for lo, hi, buf, offs in text.slices(b.column("text")):
            for d in range(hi - lo):
                for has, f, y in _taught(buf[offs[d] : offs[d + 1]].tobytes()):
                    hit.append(has)
                    feats.append(f.tobytes())
                    tags.append(y.astype(np.int8).tobytes())
        yield pa.record_batch([pa.array(hit, pa.bool_()), pa.array(feats, pa.binary()), pa.array(tags, pa.binary())], ["hit", "feats", "tags"])


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on about sample_docs documents, chosen by a hash of doc_id and text; repeated rows count once. At most SLICES stretches of 2 * SLICE tokens of each come to the driver."""
    d = documents.select("doc_id", "text").where("text <> ''")
    rows = sampled(d, ["doc_id", "text"], sample_docs, d.count()).select("text").distinct()
    rows = rows.mapInArrow(_labelled, "hit boolean, feats binary, tags binary").toArrow().to_pylist()
    rows = sorted({(zlib.crc32(r["feats"]), r["feats"], r["tags"], r["hit"]) for r in rows})
    used = []
    for has, room in ((True, FIT_TOKENS // 2), (False, FIT_TOKENS // 2)):
        for _, f, y, hit in rows:
            if hit == has and len(y) <= room:
                used.append((f, y))
                room -= len(y)
    if not any(any(y) for _, y in used):
        return Model(None)
    feats = np.concatenate([np.frombuffer(f, np.int16).reshape(5, -1) for f, _ in used], 1).astype(np.int64)
    tags = np.concatenate([np.frombuffer(y, np.int8) for _, y in used]).astype(np.int64)
    first = np.zeros(len(tags), bool)
    first[np.concatenate([[0], np.cumsum([len(y) for _, y in used])[:-1]])] = True
    return Model(*chain.fit(list(feats), SIZES, tags, first, 3, rounds=50))


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """documents' doc_id and spans: array of (start, end, kind) in code points, by start, then kind; kind is assign, access, hex or, for spans of the field that no pattern overlaps, crf."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = (*KINDS, "crf")
    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def scanned(batches):
        m = shared.value
        for b in batches:
            out = []
            for lo, hi, buf, offs in text.slices(b.column("text"), SLICE_BYTES):
                base, more = base_matches(buf, offs), m.spans(buf, offs)
                for d in range(hi - lo):
                    spans = base[d] + [(s, 3, e) for s, e in more[d] if not any(s < y and x < e for x, _, y in base[d])]
                    if not spans:
                        out.append([])
                        continue
                    spans.sort()
                    edges = np.array([x for s, _, e in spans for x in (s, e)])
                    points = text.code_points(buf[offs[d] : offs[d + 1]], edges).tolist()
                    out.append([{"start": points[2 * i], "end": points[2 * i + 1], "kind": kinds[k]} for i, (_, k, _) in enumerate(spans)])
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(one))], ["doc_id", "spans"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scanned, f"doc_id {doc_id}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redacted(documents: DataFrame, model: Model, mask: str = "[secret]") -> DataFrame:
    """documents, all their columns, with every span of text replaced by mask; overlapping spans are one."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def masked(batches):
        m = shared.value
        for b in batches:
            for lo, hi, buf, offs in text.slices(b.column(at), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                base, more = base_matches(buf, offs), m.spans(buf, offs)
                for d, (x, y) in enumerate(zip(base, more, strict=True)):
                    spans = sorted([(s, e) for s, _, e in x] + y)
                    if not spans:
                        continue
                    doc, out, end = buf[offs[d] : offs[d + 1]].tobytes(), [], 0
                    for s, e in spans:
                        if s >= end:
                            out += [doc[end:s], mask.encode()]
                        end = max(end, e)
                    texts[d] = b"".join([*out, doc[end:]]).decode()
                columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.record_batch(columns, b.schema.names)

    return documents.mapInArrow(masked, documents.schema)


def digest(spans, kinds: tuple[str, ...] | None = None) -> F.Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
