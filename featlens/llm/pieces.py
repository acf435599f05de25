"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units which no piece of the model crosses: between two
characters that stand side by side in no piece, or that are no piece themselves
and stand in none together with the character before or behind them. Each distinct unit is encoded once: its substrings of at most the longest piece's length are exploded and
equi-joined to the piece table, the edges are grouped by unit, and a Spark
higher-order aggregate folds them. For unigram models the fold is Viterbi over
the pieces' scores. For BPE models Viterbi over scores gives other pieces than
SentencePiece does, because its scores are merge ranks: there the fold runs the
merges on the same edges, always the best-scored edge that spans exactly
two of the pieces so far, leftmost first. Where all edges are of pieces that two parts
of better scores make, that is one pass over the edges in order. Characters that are no piece become
byte pieces, or where the model has none the unknown piece, one for a run of
them.

A document is then put together from its units. The most frequent units (at
most FREQUENT, and COMMON_LONG longer ones, whatever the corpus) are known to
every task by number, so a text becomes a string of short numbers where it
lies; its other units are joined to their pieces by a shuffle and return to
their places, by a row number that is written beside both. Texts are cut in Arrow
batches, once to count units and once to number them. Numbers and seldom units are
written apart, so that the latter are gone when the numbers are shuffled. The whole document's ids are decoded again from the pieces' bytes.
Units of more than MAX_FOLD code points, which are too long for the fold's
64-bit sets, are encoded by the same rules in Python, in Arrow batches.

Null and empty texts have no pieces. Very long texts are one row like any
other. Equal scores go to the leftmost merge. Repeated rows are encoded each;
null doc_ids are kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.llm.storage import forget, join_split, releasing, setting, written, written_apart

SPACE = "▁"
MAX_FOLD, MAX_PIECES = 60, 1 << 20
#: Units that every task knows: of at most MAX_FOLD code points, and longer ones of at most LONG.
FREQUENT, COMMON_LONG, LONG = 3 << 18, 1 << 10, 4096
#: Documents in an Arrow batch; bytes of text whose units are in memory at once (one document at least), and that are cut at once.
BATCH, AT_ONCE, BLOCK = 2048, 8 << 20, 1 << 18
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    """pieces: (piece, id, score) of normal pieces; first_byte: id of byte piece 0, or None; kind: UNIGRAM or BPE."""

    pieces: tuple[tuple[str, int, float], ...]
    first_byte: int | None
    unknown: int
    kind: int

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


def load(path: str) -> Model:
    """Reads a .model file of SentencePiece; only on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return from_proto(proto)


def from_proto(proto) -> Model:
    kind = proto.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normalizer, kept white space and a dummy prefix")
    if any(p.type == 4 for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    if len(proto.pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    pieces = tuple((p.piece, i, float(p.score)) for i, p in enumerate(proto.pieces) if p.type == 1)
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece crosses words")
    first_byte = next((i for i, p in enumerate(proto.pieces) if p.type == 6), None)
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
    return Model(pieces, first_byte if proto.trainer_spec.byte_fallback else None, unknown, kind)


def _normal() -> F.Column:
    """Column text with the dummy prefix; a space stands for both itself and the piece's sign for it. Empty for null."""
    return F.when(F.col("text") != "", F.concat(F.lit(" "), F.replace(F.make_valid_utf8("text"), F.lit(SPACE), F.lit(" ")))).otherwise("").alias("text")


class Cuts:
    """Where texts are cut. Pairs and runs of three characters are looked up by a hash: two of one hash may keep a place whole, and never cut one that a piece crosses."""

    BITS = 22
    #: Pairs: in no piece, in longer pieces only, a piece.
    ABSENT, INSIDE, PIECE = 0, 1, 2

    def __init__(self, model: Model):
        self.pairs, self.threes = np.zeros(1 << self.BITS, np.uint8), np.zeros(1 << self.BITS, bool)
        codes = [_codes(p.replace(SPACE, " ").encode()) for p, _, _ in model.pieces]
        for c in codes:
            if len(c) > 2:
                self.pairs[self._place(c[:-1], c[1:])] = self.INSIDE
                self.threes[self._place(c[:-2], c[1:-1], c[2:])] = True
        for c in codes:
            if len(c) == 2:
                self.pairs[self._place(c[:1], c[1:])] = self.PIECE

    def _place(self, *codes: np.ndarray) -> np.ndarray:
        mixed = codes[0] * np.uint32(0x9E3779B1)
        for c, odd in zip(codes[1:], (0x85EBCA77, 0xC2B2AE3D), strict=False):
            mixed = mixed ^ (c * np.uint32(odd))
        return mixed >> np.uint32(32 - self.BITS)

    def _begins(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether each character begins a unit, those of starts a text."""
        begins = starts.copy()
        pair = self.pairs[self._place(c[:-1], c[1:])]
        begins[1:] |= pair == self.ABSENT
        at = np.flatnonzero((pair == self.INSIDE) & ~starts[1:]) + 1
        held = np.zeros(len(at), bool)
        # a window that reaches into another text is none
        before = np.flatnonzero(~starts[at - 1] & (at > 1))
        i = at[before]
        held[before] = self.threes[self._place(c[i - 2], c[i - 1], c[i])]
        after = np.flatnonzero(~np.append(starts, True)[at + 1])
        i = at[after]
        held[after] |= self.threes[self._place(c[i - 1], c[i], c[i + 1])]
        begins[at[~held]] = True
        return begins

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and where in them each text's begin, and end."""
        texts = texts.cast(pa.string())
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        first = at[:-1][at[:-1] < at[1:]]
        found, lo = [np.zeros(0, np.int32)], 0
        while lo < len(data):
            hi = _border(data, min(lo + BLOCK, len(data)), 1)
            # two characters before the block and one behind it tell what its own ends need
            low = _border(data, _border(data, lo - 1, -1) - 1, -1)
            part = data[low : _border(data, hi + 1, 1)]
            place = np.flatnonzero((part & 0xC0) != 0x80) + low
            starts = np.zeros(len(place), bool)
            starts[np.searchsorted(place, first[np.searchsorted(first, low) : np.searchsorted(first, low + len(part))])] = True
            begins = self._begins(_codes(part.tobytes()), starts) & (place >= lo) & (place < hi)
            found.append(place[begins].astype(np.int32))
            lo = hi
        found = np.concatenate(found)
        ends = np.append(found, np.int32(len(data))).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), np.searchsorted(found, at)


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def _border(data: np.ndarray, at: int, step: int) -> int:
    """The first place from at on, in this direction, where a character begins or data ends."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return min(max(at, 0), len(data))


def _parts(batches):
    """Slices of batches with at most AT_ONCE bytes in column text, or one row."""
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)])
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + AT_ONCE, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _counts(batches, cuts: Cuts):
    """(text) -> unit, seen: what units each part holds, how many times."""
    for b in _parts(batches):
        found = cuts.units(b.column("text"))[0].value_counts()
        yield pa.record_batch([found.field("values"), found.field("counts")], ["unit", "seen"])


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, cost = -score, rank: the cost's place among all costs, late: as late() has it for BPE models. At most MAX_PIECES rows."""
    place = {c: i for i, c in enumerate(sorted({-s for _, _, s in model.pieces}))}
    names, ids, scores = zip(*model.pieces, strict=True) if model.pieces else ((), (), ())
    behind = late(model) if model.kind == BPE else set()
    columns = [pa.array([p.replace(SPACE, " ") for p in names], pa.string()), pa.array(ids, pa.int32()), pa.array([-s for s in scores], pa.float64()), pa.array([place[-s] for s in scores], pa.int64()), pa.array([p in behind for p in names], pa.bool_())]
    # an Arrow table takes no Python workers on the executors; a list would
    return spark.createDataFrame(pa.table(columns, ["piece", "id", "cost", "rank", "late"]))


def late(model: Model) -> set[str]:
    """The pieces of a BPE model that may be merged after others of a higher rank: those whose own characters the merges of lower ranks don't leave as two parts."""
    table = {p: s for p, _, s in model.pieces}
    out = set()
    for piece, score in table.items():
        ends = list(range(len(piece) + 1))
        while True:
            steps = [(-s, i) for i in range(len(ends) - 2) if (s := table.get(piece[ends[i] : ends[i + 2]])) is not None and s > score]
            if not steps:
                break
            del ends[min(steps)[1] + 1]
        if len(ends) > 3:
            out.add(piece)
    return out


def lattice(distinct: DataFrame, model: Model) -> DataFrame:
    """distinct (unit, seen) -> unit, seen, edges: array of edges as _edge() packs them (for unigram models of structs edge, cost), in order; odd: GAP if a character is no piece, LATE if an edge is late."""
    n = F.char_length("unit")
    # dealt by unit once: neither the explodes nor the broadcast join move rows, so the grouping needs no further shuffle;
    # in order before the rows are many, so that the grouping's sort finds them sorted;
    # so many units to a partition that their edges fit in memory
    dealt = distinct.select("unit", "seen").repartition(max(1, distinct.count() // 20_000), "unit").sortWithinPartitions("unit")
    starts = dealt.select("unit", "seen", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("unit", "seen", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + model.longest, n))).alias("e"))
    spans = spans.select("unit", "seen", "s", "e", F.substring(F.col("unit"), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    edges = spans.join(F.broadcast(piece_table(distinct.sparkSession, model)), "piece", "left").where((F.col("e") == F.col("s") + 1) | F.col("id").isNotNull())
    packed = _edge(F.col("rank"), F.col("s"), F.col("e"), F.col("id"))
    edge = F.when(F.col("id").isNotNull(), F.struct(packed.alias("edge"), "cost") if model.kind == UNIGRAM else packed)
    odd = F.when(F.col("id").isNull(), GAP).when(F.col("late"), LATE).otherwise(0)
    return edges.groupBy("unit").agg(F.any_value("seen").alias("seen"), F.sort_array(F.collect_list(edge)).alias("edges"), F.bit_or(odd).alias("odd"))


#: What a unit has.
GAP, LATE = 1, 2


def _edge(rank: F.Column, s: F.Column, e: F.Column, piece: F.Column) -> F.Column:
    """An edge as one number, which sorts as its rank, s, e and id do."""
    place = [F.call_function("shiftleft", c.cast("bigint"), F.lit(by)) for c, by in ((rank, 32), (s, 26), (e, 20), (piece, 0))]
    return place[0] + place[1] + place[2] + place[3]


def _field(x: F.Column, by: int, bits: int) -> F.Column:
    return F.call_function("shiftright", x, F.lit(by)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _start(x: F.Column) -> F.Column:
    return _field(x, 26, 6)


def _end(x: F.Column) -> F.Column:
    return _field(x, 20, 6)


def _odd(what: int) -> F.Column:
    return F.col("odd").bitwiseAND(F.lit(what)) != 0


def _bit(i) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _bytes(model: Model, char: F.Column) -> F.Column:
    """Ids for a character that is no piece."""
    if model.first_byte is None:
        return F.array(F.lit(model.unknown))
    hexa = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(hexa), F.lit(2)), lambda i: F.conv(F.substring(hexa, i, F.lit(2)), 16, 10).cast("int") + F.lit(model.first_byte))


def _merged(model: Model) -> F.Column:
    """BPE: the set of boundaries that is left, as bits.

    Merges come in the order of their edges, so one fold over the edges makes
    them: when an edge's turn has come, it spans two of the pieces so far, or it
    never will. Only units with a late edge are folded merge by merge.
    """
    return F.when(_odd(LATE), _merged_in_steps()).otherwise(_merged_in_order())


def _merged_in_order() -> F.Column:
    def step(cuts, x):
        s, e = _bit(_start(x)), _bit(_end(x))
        # the boundaries from s to before e: s, and one within
        two = (F.bit_count(cuts.bitwiseAND(e - s)) == 2) & (cuts.bitwiseAND(s) != 0) & (cuts.bitwiseAND(e) != 0)
        return F.when(two, cuts.bitwiseAND(F.bitwise_not(e - s)).bitwiseOR(s)).otherwise(cuts)

    return F.aggregate("edges", _bit(F.char_length("unit") + 1) - F.lit(1), step)


def _merged_in_steps() -> F.Column:
    """Folded over merges. An edge leaves the state when one of its ends is merged away, or all that it spans."""
    n = F.char_length("unit")

    def within(x, cuts):
        return cuts.bitwiseAND(x["outer"]) == x["outer"]

    def step(state, _):
        cuts, wide = state["cuts"], state["wide"]
        best = F.get(F.filter(wide, lambda x: within(x, cuts) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)), F.lit(0))["inner"]
        left = F.filter(wide, lambda x: within(x, cuts) & (cuts.bitwiseAND(x["inner"]) != 0))
        return F.struct(cuts.bitwiseAND(F.bitwise_not(F.coalesce(best, F.lit(0).cast("bigint")))).alias("cuts"), left.alias("wide"))

    wide = F.filter(F.transform("edges", lambda x: F.struct(_bit(_start(x)).bitwiseOR(_bit(_end(x))).alias("outer"), (_bit(_end(x)) - _bit(_start(x) + 1)).alias("inner"))), lambda x: x["inner"] != 0)
    whole = (_bit(n + 1) - F.lit(1)).alias("cuts")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), F.struct(whole, wide.alias("wide")), step, lambda s: s["cuts"])


def _viterbi(model: Model) -> F.Column:
    """Unigram: the boundaries of the best path over column known (s, e, cost), as bits. The state holds for each end the best score and the start of its last piece."""
    n = F.char_length("unit")
    unknown = F.lit(min((s for _, _, s in model.pieces), default=0.0) - UNKNOWN_PENALTY)
    known = F.col("known")

    def at_end(state, e):
        steps = F.transform(F.filter(known, lambda x: x["e"] == e), lambda x: F.struct((F.get(state, x["s"])["score"] - x["cost"]).alias("score"), x["s"].alias("s")))
        single = F.exists(known, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        gap = F.array(F.struct((F.get(state, e - 1)["score"] + unknown).alias("score"), (e - 1).alias("s")))
        return F.concat(state, F.array(F.array_max(F.when(single, steps).otherwise(F.concat(steps, gap)))))

    table = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"))), at_end)
    back = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), _bit(n).alias("cuts"), table.alias("t")), lambda st, _: F.when(st["at"] == 0, st).otherwise(F.struct(F.get(st["t"], st["at"])["s"].alias("at"), st["cuts"].bitwiseOR(_bit(F.get(st["t"], st["at"])["s"])).alias("cuts"), st["t"].alias("t"))), lambda s: s["cuts"])
    return back


def _ids(model: Model) -> F.Column:
    """Piece ids from the boundaries in column cuts."""
    n = F.char_length("unit")
    edges = F.col("edges.edge") if model.kind == UNIGRAM else F.col("edges")
    ends = F.filter(F.sequence(F.lit(0), n), lambda i: F.col("cuts").bitwiseAND(_bit(i)) != 0)
    tokens = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    def of(t):
        found = _field(F.get(F.filter(edges, lambda x: (_start(x) == t["s"]) & (_end(x) == t["e"])), F.lit(0)), 0, 20)
        return F.when(found.isNotNull(), F.array(found)).otherwise(_bytes(model, F.substring(F.col("unit"), t["s"] + 1, F.lit(1))))

    def taken(x):
        s, e = _bit(_start(x)), _bit(_end(x))
        return (F.col("cuts").bitwiseAND(e - s) == s) & (F.col("cuts").bitwiseAND(e) != 0)

    # without their ranks edges sort by their places
    placed = F.sort_array(F.transform(F.filter(edges, taken), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))))
    return F.when(_odd(GAP), F.flatten(F.transform(tokens, of))).otherwise(F.transform(placed, lambda x: _field(x, 0, 20)))


def encode_long(model: Model, unit: str, table: dict[str, tuple[int, float]]) -> list[int]:
    """The same rules without Spark, for units of any length; BPE in n log n steps."""
    n = len(unit)
    if model.kind == BPE:
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(i):
            j = nxt[i] if i >= 0 else n
            if i >= 0 and j < n and (p := table.get(unit[i : end[j]])):
                heapq.heappush(heap, (-p[1], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or end[i] != a or a >= n or not alive[a] or end[a] != b:
                continue
            alive[a] = False
            end[i], nxt[i] = b, nxt[a]
            if nxt[i] < n:
                prev[nxt[i]] = i
            offer(i)
            offer(prev[i])
        cuts = [(i, end[i]) for i in range(n) if alive[i]]
    else:
        unknown = min((s for _, _, s in model.pieces), default=0.0) - UNKNOWN_PENALTY
        best = [(0.0, 0)]
        for e in range(1, n + 1):
            steps = [(best[s][0] + table[unit[s:e]][1], s) for s in range(max(0, e - model.longest), e) if unit[s:e] in table]
            if unit[e - 1] not in table:
                steps.append((best[e - 1][0] + unknown, e - 1))
            best.append(max(steps))
        cuts, e = [], n
        while e:
            cuts.append((best[e][1], e))
            e = best[e][1]
        cuts.reverse()
    out: list[int] = []
    for s, e in cuts:
        if p := table.get(unit[s:e]):
            out.append(p[0])
        elif model.first_byte is None:
            out += [model.unknown] if out[-1:] != [model.unknown] else []
        else:
            out += [model.first_byte + b for b in unit[s:e].encode()]
    return out


def encode_units(distinct: DataFrame, model: Model) -> DataFrame:
    """distinct (unit, seen, further columns), each unit once -> unit, seen, ids; dealt by unit."""
    short = distinct.where(F.char_length("unit") <= MAX_FOLD)
    found = lattice(short, model)
    if model.kind == UNIGRAM:
        found = found.withColumn("known", F.transform("edges", lambda x: F.struct(_start(x["edge"]).alias("s"), _end(x["edge"]).alias("e"), x["cost"].alias("cost"))))
    fold = _merged(model) if model.kind == BPE else _viterbi(model)
    return found.withColumn("cuts", fold).select("unit", "seen", _ids(model).alias("ids"))


def encode_long_units(distinct: DataFrame, model: Model) -> DataFrame:
    """The same for the units that are too long for encode_units."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def encoded(batches):
        m = shared.value
        table = {p.replace(SPACE, " "): (i, s) for p, i, s in m.pieces}
        for b in batches:
            ids = [encode_long(m, u, table) for u in b.column("unit").to_pylist()]
            yield pa.record_batch([b.column("unit"), b.column("seen"), pa.array(ids, pa.list_(pa.int32()))], ["unit", "seen", "ids"])

    rest = distinct.select("unit", "seen").where(F.char_length("unit") > MAX_FOLD).repartition("unit")
    return rest.mapInArrow(encoded, "unit string, seen bigint, ids array<int>")


def counted(documents: DataFrame, cuts) -> DataFrame:
    """Written table of the corpus's distinct units: unit, seen (occurrences). cuts: the broadcast Cuts."""
    rows = documents.select(_normal()).mapInArrow(lambda batches: _counts(batches, cuts.value), "unit string, seen bigint")
    return written(rows.groupBy("unit").agg(F.sum("seen").alias("seen")), "units", "zstd")


def vocabulary(documents: DataFrame, model: Model, cuts) -> DataFrame:
    """Written table of the corpus's distinct units: unit, seen (occurrences), ids."""
    found = counted(documents, cuts)
    known = written(encode_units(found, model).unionByName(encode_long_units(found, model)), "vocabulary", "zstd")
    forget(found)
    return known


def frequent(known: DataFrame) -> F.Column:
    """Whether a unit of known (unit, seen) is known to every task: at most FREQUENT short and COMMON_LONG longer units are."""
    step = F.floor(F.log2("seen") * 4)
    size = F.char_length("unit")
    short = size <= MAX_FOLD
    # at most 512 rows, as a count has 64 bits
    rows = known.where(size <= LONG).groupBy(short.alias("short"), step.alias("step")).count().collect()
    least = {}
    for kind, most in ((True, FREQUENT), (False, COMMON_LONG)):
        least[kind], above = 1 << 31, 0
        for r in sorted((r for r in rows if r["short"] == kind), key=lambda r: -r["step"]):
            above += r["count"]
            if above > most:
                break
            least[kind] = r["step"]
    return (size <= LONG) & (step >= F.when(short, least[True]).otherwise(least[False]))


def _short_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers below 2**28, seven bits to a byte, all but the last marked; and how many bytes each takes."""
    size = np.ones(len(x), np.uint8)
    for k in range(1, 4):
        size += x >= 1 << 7 * k
    end = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        at = size > k
        out[end[at] - 1 - k] = ((x[at] >> 7 * k) & 127) | (128 if k else 0)
    return out, size


def _numbers(data: np.ndarray) -> np.ndarray:
    """The numbers of _short_numbers."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        at = first + k
        inside = at <= last
        out[inside] = (out[inside] << 7) | (data[at[inside]] & 127)
    return out


def _key(unit) -> F.Column:
    """What a unit is joined by: itself, or a digest if it is long, told by a sign that no unit holds."""
    return F.when(F.char_length(unit) > MAX_FOLD, F.concat(F.lit(SPACE), F.md5(unit))).otherwise(F.col(unit))


def _keys(units: pa.Array) -> pa.Array:
    """The same of an array."""
    long = np.flatnonzero(pc.greater(pc.utf8_length(units), MAX_FOLD).to_numpy(zero_copy_only=False))
    if not len(long):
        return units
    digests = pa.array([SPACE + hashlib.md5(u.encode()).hexdigest() for u in units.take(pa.array(long)).to_pylist()], pa.string())
    mask = np.zeros(len(units), bool)
    mask[long] = True
    return pc.replace_with_mask(units, pa.array(mask), digests)


def _numbered(batches, cuts: Cuts, names: pa.Array):
    """(row, text, other columns) -> of each text a row of its columns but text and numbers (bytes: for each unit its place in names and 1, or 0); and of each text with units that names lacks a row of row and their keys, in the text's order. seldom tells them apart."""
    for b in _parts(batches):
        flat, ends = cuts.units(b.column("text"))
        number = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy() + np.int32(1)
        data, size = _short_numbers(number)
        cut = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends]
        numbers = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
        at = np.flatnonzero(number == 0)
        borders = np.searchsorted(at, ends)
        text = np.flatnonzero(np.diff(borders))
        others = [c for c in b.schema.names if c != "text"]
        names_of = [*others, "numbers", "keys", "seldom"]
        yield pa.record_batch([*[b.column(c) for c in others], numbers, pa.nulls(len(b), pa.list_(pa.string())), pa.array(np.zeros(len(b), np.int8))], names_of)
        if len(text):
            empty = [b.column("row").take(pa.array(text)) if c == "row" else pa.nulls(len(text), b.schema.field(c).type) for c in others]
            keys = pa.ListArray.from_arrays(pa.array(borders[[*text, -1]].astype(np.int32)), _keys(flat.take(pa.array(at))))
            yield pa.record_batch([*empty, pa.nulls(len(text), pa.binary()), keys, pa.array(np.ones(len(text), np.int8))], names_of)


class Pieces:
    """What putting documents together needs: the frequent units' ids, and every id's bytes."""

    def __init__(self, model: Model, ids: pa.ListArray):
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.ends = np.concatenate([[0, 0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64)])  # number 0 has none here
        of = {i: p.replace(SPACE, " ").encode() for p, i, _ in model.pieces} | {model.unknown: "\u2047".encode()}
        if model.first_byte is not None:
            of |= {model.first_byte + b: bytes([b]) for b in range(256)}
        texts = [of.get(i, b"") for i in range(max(of) + 1)]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.joined = model.unknown if model.first_byte is None else None

    def whole(self, numbers: np.ndarray, rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of a text: numbers' ids, and for number 0 the next sizes[i] ids of rest."""
        start, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        missing = np.flatnonzero(numbers == 0)
        if len(missing) != len(sizes):
            raise ValueError("documents gave other texts when they were read again")
        size[missing] = sizes
        out = self.ids.take(_spread(start, size), mode="clip") if len(self.ids) else rest.copy()
        out[_spread((np.cumsum(size) - size)[missing], size[missing])] = rest
        if self.joined is not None:
            unknown = out == self.joined
            out = out[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return out

    def decoded(self, ids: np.ndarray) -> str:
        start, end = self.byte_ends[ids], self.byte_ends[ids + 1]
        return self.bytes[_spread(start, end - start)].tobytes().decode("utf-8", "replace")[1:]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at start and are size long."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _whole(batches, table: Pieces, decode: bool):
    for b in batches:
        for lo in range(0, len(b), 256):
            part = b.slice(lo, 256)
            ids, texts, count = [], [], []
            for numbers, rest, sizes in zip(part.column("numbers"), part.column("rest"), part.column("sizes"), strict=True):
                number = _numbers(np.frombuffer(numbers.as_buffer(), np.uint8))
                found = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in (rest, sizes)]
                ids.append(table.whole(number, *found).astype(np.int32))
                count.append(len(number))
                if decode:
                    texts.append(table.decoded(ids[-1]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            kept = [c for c in b.schema.names if c not in ("numbers", "rest", "sizes")]
            cols = [*[part.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())), pa.array(count, pa.int32())]
            yield pa.record_batch([*cols, *([pa.array(texts, pa.string())] if decode else [])], [*kept, "ids", "n_units", *(["decoded"] if decode else [])])


def _is_scan(documents: DataFrame) -> bool:
    """Whether documents is a file table, narrowed to rows or columns at most: Spark reads its rows in the same order each time, whichever columns are wanted."""
    open_ = [documents._jdf.queryExecution().optimizedPlan()]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() not in ("Project", "Filter", "LogicalRelation"):
            return False
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return True


def encode_documents(documents: DataFrame, model: Model, decode: bool = False) -> DataFrame:
    """documents' doc_id, ids (of the whole text), n_units and, if asked for, decoded: the text of the ids. Documents are read twice, and must give the same texts each time, in any order; those that don't come straight from a table are written to one first."""
    spark = documents.sparkSession
    if not _is_scan(documents):
        documents = written(documents.select("doc_id", "text"), "pieces-documents")
    cuts = spark.sparkContext.broadcast(Cuts(model))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
        known = vocabulary(documents, model, cuts)
    chosen = frequent(known)
    # at most FREQUENT + COMMON_LONG rows
    with releasing(spark):
        often = known.where(chosen).orderBy(F.desc("seen"), "unit").select("unit", "ids").toArrow()
    names = spark.sparkContext.broadcast(often.column("unit").combine_chunks())
    table = spark.sparkContext.broadcast(Pieces(model, often.column("ids").combine_chunks()))
    del often
    kinds = f"row bigint, doc_id {documents.schema['doc_id'].dataType.simpleString()}{', text_md5 binary' if decode else ''}"
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", *([F.unhex(F.md5("text")).alias("text_md5")] if decode else []), _normal())
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        numbered, seldom = written_apart(rows.mapInArrow(lambda batches: _numbered(batches, cuts.value, names.value), f"{kinds}, numbers binary, keys array<string>, seldom tinyint"), "seldom", "numbered", "zstd")
    rest = known.where(~chosen).select(_key("unit").alias("key"), "seen", "ids")
    total = rest.agg(F.sum("seen")).first()[0] or 0
    others = written(join_split(seldom.select("row", F.posexplode("keys").alias("n", "key")), rest, ["key"], "seen", total, "row").select("row", "n", "ids"), "seldom-units", "zstd")
    # what follows shuffles numbers: the keys need not lie beside them
    forget(known, seldom)
    gathered = others.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("x"))
    gathered = gathered.select("row", F.flatten("x.ids").alias("rest"), F.transform("x", lambda v: F.size(v["ids"])).alias("sizes"))
    numbered = numbered.drop("keys")
    both = numbered.join(gathered, "row", "left")
    return both.mapInArrow(lambda batches: _whole(batches, table.value, decode), f"{kinds}, ids array<int>, n_units int{', decoded string' if decode else ''}").drop("row")


def decode_documents(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text: what encode_documents encoded."""
    table = encoded.sparkSession.sparkContext.broadcast(Pieces(model, pa.array([], pa.list_(pa.int32()))))

    def texts(batches):
        for b in batches:
            ids = [np.array(x, np.int64) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([table.value.decoded(x) for x in ids], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, model: Model) -> DataFrame:
    """Every document's doc_id, n_units, n_pieces, ids, decoded (the text of the ids) and round_trip: whether that is its text (null: empty)."""
    out = encode_documents(documents, model, True)
    same = F.unhex(F.md5("decoded")) == F.coalesce("text_md5", F.unhex(F.md5(F.lit(""))))
    return out.select("doc_id", F.col("n_units").cast("bigint").alias("n_units"), F.size("ids").cast("bigint").alias("n_pieces"), "ids", "decoded", same.alias("round_trip"))
