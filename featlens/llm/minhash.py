"""Near-duplicates by b-bit MinHash over 4-word shingles.

A sketch has a number of hash functions; of each a document keeps the smallest
value over its distinct shingles, and of that only the low bits, packed in words
of 64. Two packed signatures agree in a share e = J + (1 - J) * c of their lanes,
c = 2**-bits, so J is estimated as (e - c) / (1 - c) by exclusive or and bit
counts. A pair whose estimate is SLACK standard errors below the threshold is
left; every other pair is confirmed on the whole sets.

BANDS keys, each of ROWS whole minima of the coarse sketch, bring documents
together. Documents with equal sets are one node, so copies never meet in pairs.
The nodes of a band key meet in two steps. First each meets the key's hub, the
node that shares most keys with others: the least edited of a group of near
copies. What is confirmed is contracted into components. Then, for keys whose
nodes are in several components, pairs of different components meet: all but the
key's most frequent component against the whole key, in squares of BLOCK by
BLOCK nodes at most, judged by a fine sketch that only these nodes get. So a key
of n nodes that are near copies of its hub costs n comparisons, and no pair of
different components is left out.

Two documents of similarity 0.8 share no band key with a chance of 5e-8; the
estimates lose them with a chance below 1e-6. Every link that is found is exact.

Null and empty texts, and texts of white space, have an empty set and are linked
with nothing. Texts of fewer than four words are one shingle. Very long texts
are read whole, a bounded number of shingles at a time. Repeated rows are copies;
rows that repeat a doc_id with another text are documents of their own. A row
without doc_id is linked like any other, and names a component (null) only if
nothing else is in it. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.llm import text
from featlens.llm.components import components
from featlens.llm.storage import forget, having, join_many, join_split, merging, written

SHINGLE, BANDS, ROWS = 4, 32, 4
#: Links have at least PERCENT of 100 shingles of their union in common.
PERCENT, SLACK = 80, 5.0
#: Hash values that are held at once; nodes of a key that meet as many others in one group at most.
STEP, BLOCK = 1 << 19, 1024


class Sketch:
    """So many hash functions (a multiple of 64 / bits), of whose minima the low bits are kept."""

    def __init__(self, hashes: int, bits: int, seed: int):
        draw = np.random.default_rng(seed)
        self.hashes, self.bits, self.lanes = hashes, bits, 64 // bits
        self.words = hashes // self.lanes
        self._times = draw.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._plus = draw.integers(0, 1 << 63, hashes, dtype=np.uint64)
        self._shifts = (np.arange(self.lanes, dtype=np.uint64) * np.uint64(bits))[None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest value of every hash function over a set that isn't empty."""
        least, step = None, max(STEP // self.hashes, 1)
        for lo in range(0, len(shingles), step):
            m = (shingles[lo : lo + step, None] * self._times + self._plus).min(0)
            least = m if least is None else np.minimum(least, m)
        return least

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of the minima; a hash value is the upper half of its 64 bits."""
        low = (minima >> np.uint64(32)) & np.uint64((1 << self.bits) - 1)
        return np.bitwise_or.reduce(low.reshape(self.words, self.lanes) << self._shifts, 1)

    def estimate(self, a: str, b: str) -> Column:
        """Jaccard similarity estimated from two packed signatures, corrected for lanes that agree by chance."""
        ones = int("".join("0" * (self.bits - 1) + "1" for _ in range(self.lanes)), 2)
        differ = F.lit(0)
        for k in range(self.words):
            x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
            any_bit = x
            for i in range(1, self.bits):
                any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
            differ = differ + F.bit_count(any_bit if self.bits == 1 else any_bit.bitwiseAND(F.lit(ones)))
        c = 2.0**-self.bits
        return (F.lit(1.0) - differ / F.lit(float(self.hashes)) - F.lit(c)) / F.lit(1 - c)

    def least_estimate(self) -> float:
        """SLACK standard errors below the threshold."""
        j, c = PERCENT / 100, 2.0**-self.bits
        e = j + (1 - j) * c
        return j - SLACK * math.sqrt(e * (1 - e) / self.hashes) / (1 - c)

    def plausible(self, n1: str, n2: str, marks1: str, marks2: str) -> Column:
        """Whether sets of these sizes and signatures may be linked."""
        sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT
        return sizes & (self.estimate(marks1, marks2) >= self.least_estimate())


#: The first brings documents together and judges them, the second judges nodes of keys that hold several components.
COARSE, FINE = Sketch(BANDS * ROWS, 4, 20), Sketch(2048, 1, 21)
_TABLE = text.byte_table(text.SPACE)
_TABLE[0] = 0xFF  # NUL is part of a word; no UTF-8 text has this byte


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct shingles."""
    t = text.Tokens(buf, offs, _TABLE)
    w, first = t.hash, t.of_doc
    joined = text.mix(w + np.uint64(SHINGLE))[: max(len(w) - SHINGLE + 1, 0)]
    for k in range(1, SHINGLE):
        joined = text.mix(joined * np.uint64(3) + w[k : k + len(joined)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(joined[a : b - SHINGLE + 1]))
        else:
            h = w[a : min(a + 1, b)]
            for k in range(a, b):
                h = text.mix(h * np.uint64(5) + w[k : k + 1] + np.uint64(b - a))
            out.append(h)
    return out


def keys(m: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of a band's number and its minima."""
    h = np.arange(BANDS, dtype=np.uint64)
    for part in m.reshape(BANDS, ROWS).T:
        h = text.mix(h * np.uint64(3) + part)
    return h


def _printed(batches):
    zero = np.zeros(0, np.uint64)
    for b in batches:
        for lo, hi, buf, offs in text.slices(b.column("text")):
            sets = shingle_sets(buf, offs)
            # two sums tell sets apart: the sums of two hashes of their members
            sums = [[int(text.mix(s + np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (1, 2)]
            ms = [COARSE.minima(s) if len(s) else None for s in sets]
            lists = [pa.array([(zero if m is None else f(m)).view(np.int64) for m in ms], pa.list_(pa.int64())) for f in (keys, COARSE.packed)]
            number = pa.array([len(s) for s in sets], pa.int64())
            digests = [pa.array(np.array(s, np.uint64).view(np.int64)) for s in sums]
            yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo), number, *digests, *lists], ["doc_id", "text", "n_shingles", "d1", "d2", "keys", "marks"])


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_shingles, d1, d2, keys, marks): the set's size, what tells it from other sets, its band keys and its packed signature; no keys or marks for an empty set."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_printed, f"doc_id {kind}, text string, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, marks array<bigint>")


def _refined(batches):
    for b in batches:
        marks = [FINE.packed(FINE.minima(x)).view(np.int64) for _, _, buf, offs in text.slices(b.column("text")) for x in shingle_sets(buf, offs)]
        yield pa.record_batch([b.column("node"), pa.array(marks, pa.list_(pa.int64()))], ["node", "marks"])


def _confirmed(batches):
    for b in batches:
        a, c = ([s for _, _, buf, offs in text.slices(b.column(x)) for s in shingle_sets(buf, offs)] for x in ("text_a", "text_b"))
        keep = []
        for x, y in zip(a, c, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
        yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those pairs (a, b) of row numbers whose sets are alike enough, from the whole texts of rows (row, text)."""
    needed = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    texts = written(having(rows.select("row", "text"), needed), "minhash-texts")
    seen = pairs.groupBy("a").agg(F.count("*").alias("seen"))
    few = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")).join(merging(seen), "a")
    left = join_split(pairs, few, ["a"], "seen", pairs.count(), "b")
    both = left.join(merging(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))), "b")
    out = written(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a bigint, b bigint"), "minhash-links")
    forget(texts)
    return out


def _crossing(members: DataFrame) -> DataFrame:
    """Plausible pairs (a, b), a < b, of members (key, node, root, n_shingles, marks, keys) of a key whose roots differ, each once: under the least of the keys that both have.

    All members of a key but those of its most frequent root meet the whole
    key; keys are dealt into squares of BLOCK by BLOCK members.
    """
    of_root = members.groupBy("key", "root").agg(F.count("*").alias("seen"))
    top = of_root.groupBy("key").agg(F.max(F.struct("seen", "root")).alias("top"), F.sum("seen").alias("all"))
    open_ = top.where("top.seen < all").select("key", F.col("top.root").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("top.seen")) / BLOCK).cast("int").alias("high"), F.col("all").alias("seen"))
    total = members.count()
    own = join_many(members, open_, ["key"], "seen", total)

    def dealt(side: str, few: bool) -> DataFrame:
        """The members, or those not of the major root, with the squares that they are in."""
        x = own.where(F.col("root") != F.col("major")) if few else own
        mine, other = ("high", "wide") if few else ("wide", "high")
        place = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")
        x = x.withColumn("mine", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("mine", "other") if few else ("other", "mine")
        names = ["node", "root", "n_shingles", "marks", "keys"] + ([] if few else ["major"])
        return x.select("key", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{c}_{side}") for c in names])

    met = dealt("x", True).join(merging(dealt("y", False)), ["key", "i", "j"])
    first = F.col("key") == F.array_min(F.array_intersect("keys_x", "keys_y"))
    met = met.where((F.col("root_x") != F.col("root_y")) & ((F.col("root_y") == F.col("major_y")) | (F.col("node_x") < F.col("node_y"))) & FINE.plausible("n_shingles_x", "n_shingles_y", "marks_x", "marks_y") & first)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents: the size of the set, and the smallest doc_id that links reach from it."""
    rows = written(signatures(documents).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    sets = rows.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("name"), F.count("*").alias("seen"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"))
    nodes = written(sets, "minhash-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("seen")).where("seen > 1"), "minhash-keys")
    held = shared.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first().n
    met = written(join_many(keyed, shared.select("key", "seen", F.col("seen").alias("n")), ["key"], "seen", held), "minhash-met")
    central = met.join(merging(met.groupBy("node").agg(F.sum("n").alias("near"))), "node").groupBy("key").agg(F.max(F.struct("near", F.negate("node").alias("node"))).alias("top"), F.count("*").alias("seen"))
    hubs = written(central.select("key", F.negate("top.node").alias("hub"), "seen"), "minhash-hubs")
    # a hub may be many nodes' partner
    stars = written(join_many(met, hubs, ["key"], "seen", held).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "minhash-stars")
    marks = nodes.select("node", "n_shingles", "marks")
    few = marks.toDF("a", "n_a", "marks_a").join(merging(stars.groupBy("a").agg(F.count("*").alias("seen"))), "a")
    both = join_many(stars, few, ["a"], "seen", stars.count()).join(merging(marks.toDF("b", "n_b", "marks_b")), "b")
    likely = written(both.where(COARSE.plausible("n_a", "n_b", "marks_a", "marks_b")).select("a", "b"), "minhash-likely")
    links = confirmed(likely, rows)
    roots = components(links)
    members = met.select("key", "node").join(merging(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the two nodes of a key of two have met; of others, only keys that hold several roots are of interest
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("seen")).where("low < high AND seen > 2").select("key", "seen")
    apart = written(join_many(members, written(several, "minhash-open"), ["key"], "seen", held), "minhash-apart")
    texts = having(rows.select(F.col("row").alias("node"), "text"), apart.select("node"))
    fine = written(texts.mapInArrow(_refined, "node bigint, marks array<bigint>"), "minhash-fine")
    sized = fine.join(merging(nodes.select("node", "n_shingles")), "node").join(merging(apart.groupBy("node").agg(F.collect_list("key").alias("keys"))), "node")
    crossing = _crossing(written(apart.join(merging(sized), "node"), "minhash-members"))
    tried = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    further = written(crossing.join(merging(tried), ["a", "b"], "left_anti"), "minhash-further")
    if further.limit(1).count():
        links = links.union(confirmed(further, rows))
        roots = components(links)
    named = nodes.select("d1", "d2", "n_shingles", "node", "name", "seen").join(merging(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "minhash-roots")
    names = named.groupBy("root").agg(F.min("name").alias("component_id"))
    final = written(named.join(merging(names), "root").select("d1", "d2", "n_shingles", "component_id", "seen"), "minhash-names")
    forget(nodes, shared, met, hubs, stars, likely, apart, fine, further, named)
    full = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2")
    linked = join_many(full, final, ["d1", "d2", "n_shingles"], "seen", rows.count()).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
