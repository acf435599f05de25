"""Near-duplicates by SimHash fingerprints, found through deletion-variant signatures.

A fingerprint has 64 bits over 4-word shingles. Two that differ in at most 4
bits differ in at most one bit in one of three segments (21, 21 and 22 bits).
So each fingerprint is indexed under every segment with one bit left out, 64
signatures; fingerprints that share a signature are compared by an equality
join, whose condition counts the bits that differ. Equal fingerprints are one
node from the start, so copies never meet in pairs.

Null and empty texts, and texts of white space, have fingerprint zero, which
links like any other. Texts of fewer than four words have one shingle; very
long ones are hashed whole, a bounded number of shingles at a time. Repeated
rows are linked as copies; a null doc_id is never a component's name unless
nothing else is in it. A bit that exactly half of the shingles set is 0. A
fingerprint that many rows share is one node, and its rows are named where they
lie. Signatures have 20 or 21 bits, so the pairs that are compared grow with the
square of the different fingerprints, divided by 2**20: three segments of 64
bits allow no longer ones. An empty table gives no rows. Extra columns are
ignored, or kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from featlens.llm import text
from featlens.llm.components import components
from featlens.llm.storage import forget, fresh, join_many, merging, written

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and length of the segments: one more than half as many as MAX_BITS.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(doc: bytes) -> int:
    words = doc.translate(_LOWER).split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _printed(batches):
    for b in batches:
        out: list[int] = []
        for lo, hi, buf, offs in text.slices(b.column("text")):
            data = buf.tobytes()
            out += [fingerprint(data[offs[d] : offs[d + 1]]) for d in range(hi - lo)]
        yield pa.record_batch([b.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "bits"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """documents' doc_id and bits: the fingerprint as a signed bigint."""
    return documents.select("doc_id", "text").mapInArrow(_printed, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, bits bigint")


def links(nodes: DataFrame) -> DataFrame:
    """nodes (bits), each once -> pairs (a, b), a < b, that differ in at most MAX_BITS bits, each once.

    A pair that shares several signatures is kept at the first of them only:
    the first segment that differs in one bit at most, and in it that bit, or
    bit 0 if none differs.
    """
    variants = [F.struct(F.lit(lo + i).alias("bit"), (F.col("bits").bitwiseAND(F.lit(_signed((((1 << n) - 1) << lo) & ~(1 << (lo + i)))))).alias("rest")) for lo, n in SEGMENTS for i in range(n)]
    keyed = nodes.select("bits", F.explode(F.array(*variants)).alias("v")).select("bits", "v.bit", "v.rest")
    x = F.col("a").bitwiseXOR(F.col("b"))
    own = F.lit(None)
    for lo, n in reversed(SEGMENTS):
        part = x.bitwiseAND(F.lit(_signed(((1 << n) - 1) << lo)))
        own = F.when(F.bit_count(part) == 0, F.lit(lo)).when(F.bit_count(part) == 1, F.bit_count(part - 1) if lo + n < 64 else F.bit_count(F.when(part < 0, F.lit((1 << 63) - 1)).otherwise(part - 1))).otherwise(own)
    left, right = keyed.select(F.col("bits").alias("a"), "bit", "rest"), keyed.select(F.col("bits").alias("b"), F.col("bit").alias("bit2"), F.col("rest").alias("rest2"))
    return left.join(merging(right), (F.col("bit") == F.col("bit2")) & (F.col("rest") == F.col("rest2")) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= MAX_BITS) & (own == F.col("bit"))).select("a", "b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(documents: DataFrame) -> DataFrame:
    """documents' doc_id, bits and component_id: the smallest doc_id that links reach from it."""
    prints = written(fingerprints(documents), "simhash")
    nodes = written(prints.groupBy("bits").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("seen")), "simhash-nodes")
    roots = components(links(nodes.select("bits")))
    of = written(nodes.join(merging(roots.withColumnRenamed("node", "bits")), "bits", "left").withColumn("root", F.coalesce("root", "bits")), "simhash-roots")
    names = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(of.drop("doc_id").join(merging(names), "root").select("bits", "component_id", "seen"), "simhash-names")
    forget(nodes, of)
    return join_many(prints, named, ["bits"], "seen", prints.count()).select("doc_id", "bits", "component_id")


def hexadecimal(bits) -> F.Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents, all their columns, with one row of each component: the one with the smallest doc_id (null last), of several the one with the smallest hash of its text, of equal rows any one.

    Rows are told apart by a number that is written beside them, so rows that
    repeat a doc_id, or have none, stay if their texts are in components of
    their own. An empty table stays empty.
    """
    row = fresh("row", documents)
    rows = written(documents.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("row"))
    marked = near_duplicates(rows.select(name.alias("doc_id"), "text"))
    kept = written(marked.where("doc_id.row = component_id.row").select(F.col("doc_id.row").alias(row)), "simhash-kept")
    return rows.join(merging(kept), row, "left_semi").drop(row)
