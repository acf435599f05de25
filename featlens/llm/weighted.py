"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each of
SAMPLES samples and each term, gamma variates r and c and a uniform b, drawn
from the term's hash, give t = floor(ln(weight) / r + b), y = exp(r * (t - b))
and a = c / (y * exp(r)); the sample is the term with the smallest a, together
with t. Two texts agree on a sample with probability sum(min) / sum(max) of
their weights, the generalised Jaccard similarity, so the share of equal
samples estimates it.

The gamma variates are -ln(u1 * u2) of uniform variates. A sample is kept as one
bigint: the upper 32 bits order ln a, the lower 32 are a hash of term and t,
which is what is compared.

Null and empty texts have no terms: their samples are null, and two such
fingerprints are alike (1.0); against a text with terms they are not (0.0).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.llm.storage import setting, written

SAMPLES = 16
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Documents of one bucket of the order by doc_id, about, and the number of buckets at most.
BUCKET_DOCS, MAX_BUCKETS = 500, 65_536


def samples(term, weight, number: int = SAMPLES) -> list[F.Column]:
    """For a term (its 64-bit hash) of this weight, one bigint for each sample; the smallest of a text's terms is its sample."""
    ln_w = F.log(weight.cast("double"))

    def uniform(h, bit: int) -> F.Column:
        """In (0, 1), from 32 bits of h."""
        return (F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + F.lit(0.5)) * F.lit(2.0**-32)

    out = []
    for k in range(number):
        h, g, f = (F.xxhash64(term, F.lit(3 * k + i)) for i in range(3))
        r = -F.log(uniform(h, 0) * uniform(h, 32))
        c = -F.log(uniform(g, 0) * uniform(g, 32))
        t = F.floor(ln_w / r + uniform(f, 0))
        ln_a = F.log(c) - r * (t - uniform(f, 0)) - r
        rank = F.floor((ln_a + F.lit(200.0)) * F.lit(float(1 << 22)))  # 200: below the least ln a; 2**22 steps a unit
        mark = F.xxhash64(f, t).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(F.shiftleft(rank, 32).bitwiseOR(mark))
    return out


def likeness(x: str, y: str, number: int = SAMPLES) -> F.Column:
    """Share of equal samples of two fingerprints, arrays of marks."""
    same = F.aggregate(F.zip_with(x, y, lambda a, b: F.when(a.eqNullSafe(b), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return same.cast("double") / F.lit(float(number))


def fingerprints(texts: DataFrame, keys: list[str], number: int = SAMPLES) -> DataFrame:
    """texts (keys, text) -> keys and marks: an array of number samples' 32-bit marks. Where texts is dealt by some of keys, no further shuffle."""
    words = texts.select(*keys, F.explode_outer(F.split(F.coalesce("text", F.lit("")), SEPARATORS)).alias("word"))
    words = words.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = words.groupBy(*keys, "term").agg(F.count("*").alias("weight"))
    values = samples(F.col("term"), F.col("weight"), number)
    # each minimum holds its expression: Spark gives every aggregate function a method of its own, small enough to be compiled
    least = counted.groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), v)).alias(f"s{k}") for k, v in enumerate(values)])
    return least.select(*keys, F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(number)]).alias("marks"))


def in_order(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) with their next texts: bucket, place, doc_id, text, next_text, is_guest.

    The order is descending doc_id, null last; the last document's next is the
    first. Buckets are ranges of doc_id between quantiles. Each bucket gets the
    first document of the following one as a guest, so that all that a document
    needs lies in its bucket.
    """
    d = documents.select("doc_id", "text")
    n = d.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_DOCS))
    cuts = d.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), max(10_000, 4 * buckets))).first()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []))
    if cuts:
        d = Bucketizer(splits=[-math.inf, *[float(c) for c in cuts], math.inf], inputCol="x", outputCol="b", handleInvalid="keep").transform(d.withColumn("x", F.col("doc_id").cast("double")))
        d = d.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("b").cast("int")).alias("bucket"))
    else:
        d = d.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0)).alias("bucket"))
    # one row for each bucket: at most MAX_BUCKETS + 1
    heads = d.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("head")).select("bucket", "head.*")
    line = Window.orderBy(F.col("bucket").desc())
    first = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = heads.select("doc_id", "text", F.coalesce(F.lag("bucket").over(line), F.last("bucket").over(first)).alias("bucket"))
    rows = d.withColumn("is_guest", F.lit(False)).unionByName(above.withColumn("is_guest", F.lit(True))).repartition(buckets, "bucket")
    order = Window.partitionBy("bucket").orderBy("is_guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    return rows.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "is_guest")


def edited(text, next_text) -> F.Column:
    """text with its last floor(n / 2) code points replaced by as many of next_text's first, or all."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def compare(documents: DataFrame, number: int = SAMPLES) -> DataFrame:
    """documents' doc_id, n_chars, edited (the edited text), marks and edited_marks (arrays), near_edited and near_next.

    Each document is compared with its text edited as edited() says, and with
    the next document. A single document is its own next. Repeated rows are
    documents of their own, in the order of their texts. Extra columns are
    ignored; an empty table gives an empty result.
    """
    placed = in_order(documents)
    own = F.coalesce("text", F.lit(""))
    both = placed.select("bucket", "place", "doc_id", "is_guest", own.alias("text"), F.when(~F.col("is_guest"), edited(own, F.coalesce("next_text", F.lit("")))).alias("edited"))
    sides = both.select("bucket", "place", F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("s")).select("bucket", "place", "s.*").where(F.col("text").isNotNull())
    prints = fingerprints(sides, ["bucket", "place", "is_edited"], number)
    pair = prints.groupBy("bucket", "place").agg(F.first(F.when(~F.col("is_edited"), F.col("marks")), True).alias("marks"), F.first(F.when(F.col("is_edited"), F.col("marks")), True).alias("edited_marks"))
    near = pair.withColumn("next_marks", F.lead("marks").over(Window.partitionBy("bucket").orderBy("place")))
    facts = both.where(~F.col("is_guest")).select("bucket", "place", "doc_id", F.length("text").cast("bigint").alias("n_chars"), "edited")
    out = facts.join(near, ["bucket", "place"]).select("doc_id", "n_chars", "edited", "marks", "edited_marks", likeness("marks", "edited_marks", number).alias("near_edited"), likeness("marks", "next_marks", number).alias("near_next"))
    # both sides are dealt by bucket already: the texts need not move again to be joined by place, too
    with setting(documents.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return written(out, "compared")


def hexadecimal(marks: str) -> F.Column:
    """The marks as 8 lower-case hex digits each; - for none."""
    return F.array_join(F.transform(marks, lambda m: F.when(m.isNull(), "-" * 8).otherwise(F.lower(F.lpad(F.hex(m), 8, "0")))), "")
