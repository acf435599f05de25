"""The queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.llm import infill, licenses, minhash, mixing, passages, pieces, quality, secretscan, simhash, toxicity, warc, weighted, whitening
from featlens.llm.storage import table

#: The SentencePiece model that op1 and the pipeline encode with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
TOXIC = 0.7


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.load(model_path))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(spans, ",").alias("spans"), F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("score", 6).alias("score"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = weighted.compare(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), weighted.hexadecimal("marks").alias("fingerprint"), weighted.hexadecimal("edited_marks").alias("edited_fingerprint"), "near_edited", "near_next")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hexadecimal(F.col("bits")).alias("fingerprint"), "component_id")


def toxic_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learns only from labels that aren't held out."""
    return toxicity.train(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_model(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), spans.alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.train(docs))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    n = [number(k) for k in secretscan.KINDS]
    return found.select("doc_id", *n, F.sha2(secretscan.digest(F.col("spans"), secretscan.KINDS), 256).alias("base_sha256"), secretscan.digest(F.col("spans")).alias("spans"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_licenses, op3_quality, op4_fingerprints, op5_mixing, op6_simhash, op7_toxicity, op8_secrets, op9_passages, op10_warc, op11_infill, op12_whitening, op13_minhash)}

ORACLE_SQL = {
    "op10_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
""",
    "op11_infill": """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', coalesce(doc_id::VARCHAR, ''))) AS d FROM documents
), l AS (
  SELECT doc_id, t, CASE WHEN t = '' THEN [] WHEN t LIKE '%' || chr(10) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS lines,
    [('0x' || substr(d, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS h
  FROM h
), c AS (
  SELECT doc_id, t, lines, h, len(lines) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi FROM l
), p AS (
  SELECT doc_id, t, n, h, CASE WHEN lo = n THEN t WHEN lo = 0 THEN '' ELSE array_to_string(lines[1:lo], chr(10)) || chr(10) END AS a,
    CASE WHEN hi = n THEN t WHEN hi = 0 THEN '' ELSE array_to_string(lines[1:hi], chr(10)) || chr(10) END AS ab
  FROM c
), f AS (
  SELECT doc_id, t, n, a, substr(ab, length(a) + 1) AS m, substr(t, length(ab) + 1) AS s,
    CASE WHEN t = '' OR h[3] % 100 >= 100 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM p
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
""",
    "op13_minhash": """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), u AS (
  SELECT r, len(words) AS n, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w
), g AS (
  SELECT r, n, i, lead(x, 3) OVER o AS last, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS x FROM u WINDOW o AS (PARTITION BY r ORDER BY i)
), d AS (
  SELECT DISTINCT r, x FROM g WHERE last IS NOT NULL OR (n < 4 AND i = 1)
), s AS (
  SELECT w.r, w.doc_id, count(d.r) AS n FROM w LEFT JOIN d ON d.r = w.r GROUP BY w.r, w.doc_id
), e AS (SELECT d.r, x, n FROM d JOIN s ON s.r = d.r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.r, b.r),
links AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(r, far) AS (SELECT r, r FROM s UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.far)
SELECT s.doc_id, any_value(s.n)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, s.doc_id = min(o.doc_id) AS kept
FROM reach JOIN s USING (r) JOIN s o ON o.r = far GROUP BY s.r, s.doc_id
""",
}
