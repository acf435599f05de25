"""A content-addressed WARC archive.

An archive is a folder of two Parquet stores. payloads holds the bytes of every
payload once, by its strong digest (SHA-256, with the length); records holds a
row for every page with the exact bytes of its WARC and HTTP headers, and the
digest of its payload. Of the pages with equal payloads the one with the
smallest page_id is a response, the others revisits that name it; payloads of
fewer than min_bytes bytes always get responses. An original record is its
headers and the payload found by a join on the digest; what is read back is
parsed from the rebuilt bytes, and its digests and lengths are verified.
export() writes the records as WARC/1.1 files, whose size is bounded, and
read_files() parses such files by Content-Length.

Null html is an empty payload; a null page_id is kept (its record has no
page number) and never named by a revisit unless the payload has no other page,
when all its records are responses. Rows that share the smallest page_id of a
payload are all responses, so repeated rows get a record each. Payloads of any
length are one value of a row; a payload that most pages share is stored once
and its headers are joined where they lie. Carriage returns and WARC headers
inside payloads are data. Extra columns, whatever their names, are ignored. An
empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.llm.storage import join_many, releasing, shared_folder, written

BREAK = "\r\n"
RECORD_ID = "urn:uuid:"
#: Records of up to so many bytes, and how many of them one exported file holds; longer ones have files of their own.
FILE_CLASSES = ((1 << 16, 2000), (1 << 20, 125))


def base32_sha1(html) -> F.Column:
    """Upper-case base32 of SHA-1: eight times 20 bits as four digits, from Spark's base 32."""
    hexa = F.sha1(html)
    digits = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(name: str, page, digest) -> F.Column:
    """A URN from page and payload: the same page gets the same id in every run."""
    h = F.md5(F.concat_ws(" ", F.lit(name), F.coalesce(page.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit(f"<{RECORD_ID}"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _payload() -> F.Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, sha1 (base32), sha256, payload_bytes and first: the page whose response holds the payload (itself for responses)."""
    html = _payload()
    sums = written(pages.select("page_id", "url", base32_sha1(html).alias("sha1"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("bigint").alias("payload_bytes")), "warc-digests")
    first = written(sums.groupBy("sha256", "payload_bytes").agg(F.min("page_id").alias("smallest"), F.count("*").alias("seen")), "warc-first")
    both = join_many(sums, first, ["sha256", "payload_bytes"], "seen", sums.count())
    return both.withColumn("first", F.when(F.col("payload_bytes") >= min_bytes, F.col("smallest")).otherwise(F.col("page_id"))).drop("smallest")


def headers(plan: DataFrame, date: str) -> DataFrame:
    """plan's page_id, sha256 and payload_bytes with the exact header and http blocks."""
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("page_id").isNull() & F.col("first").isNotNull())
    line = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x], F.lit(BREAK))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = F.concat(line(http + "Content-Length: ", F.col("payload_bytes").cast("string")), F.lit(BREAK))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", "")
    header = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Target-URI: ", url),
        line("WARC-Date: ", date),
        line("WARC-Record-ID: ", _record_id("record", F.col("page_id"), F.col("sha1"))),
        F.coalesce(line("X-Page-ID: ", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest: sha1:", F.col("sha1")),
        F.when(revisit, F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To: ", _record_id("record", F.col("first"), F.col("sha1"))), line("X-Refers-To-Page-ID: ", F.col("first").cast("string")))).otherwise(F.lit("")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", (F.octet_length(block) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string")),
        F.lit(BREAK),
    )
    return plan.select("page_id", "sha256", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.cast("binary").alias("header"), block.cast("binary").alias("http"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """pages (page_id, url, html) as an archive in the folder path; a record for every row."""
    html = _payload()
    # copies within a task go before the shuffle, so a payload that most pages share is no hot group
    stored = pages.select(F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("bigint").alias("payload_bytes"), html.alias("payload")).groupBy("sha256", "payload_bytes").agg(F.any_value("payload").alias("payload"))
    with releasing(pages.sparkSession):
        headers(planned(pages, min_bytes), date).write.parquet(f"{path}/records", compression="zstd")
        stored.write.parquet(f"{path}/payloads", compression="zstd")


def stores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) of an archive; payloads whose bytes don't have the digest they are stored by raise an error."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("sha256"))).cast("binary"))
    return spark.read.parquet(f"{path}/records"), payloads.withColumn("payload", checked)


def originals(spark: SparkSession, path: str, revisits: bool = False) -> DataFrame:
    """The records column and record: the exact original bytes, rebuilt by a join on the digest. Of revisits, which hold no payload, record is the headers; with revisits=True it is followed by the payload they refer to."""
    records, payloads = stores(spark, path)
    whole = records if revisits else records.where("record_type = 'response'")
    joined = whole.join(payloads, ["sha256", "payload_bytes"]).withColumn("record", F.concat("header", "http", "payload")).drop("payload")
    return joined if revisits else joined.unionByName(records.where("record_type = 'revisit'").withColumn("record", F.concat("header", "http")))


def parsed(records: DataFrame, *kept: str) -> DataFrame:
    """records (record: bytes) -> kept, and page_id, record_type, digest, refers_to as the bytes say, and payload_bytes (null for revisits). A wrong Content-Length or payload digest raises an error."""
    content = F.col("record").cast("string")
    head = F.substring_index(content, BREAK * 2, 1)
    two = F.octet_length(F.substring_index(content, BREAK * 2, 2)) + 4
    sizes = records.select(*kept, "record", F.concat(F.lit(BREAK), head, F.lit(BREAK)).alias("head"), two.alias("two"), (F.octet_length("record") - F.octet_length(head) - 4).alias("body"))

    def field(name: str) -> F.Column:
        found = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(found != "", found)

    payload = F.substring(F.col("record"), F.col("two") + 1, F.octet_length("record"))
    response = field("WARC-Type") == "response"
    right = (field("Content-Length").cast("bigint") == F.col("body")) & (~response | (F.concat(F.lit("sha1:"), base32_sha1(payload)) == field("WARC-Payload-Digest")))
    kind = F.when(right, field("WARC-Type")).otherwise(F.raise_error(F.concat(F.lit("record is not whole: "), field("WARC-Record-ID"))).cast("string"))
    size = F.when(response, (F.octet_length("record") - F.col("two")).cast("bigint"))
    return sizes.select(*kept, field("X-Page-ID").alias("page_id"), kind.alias("record_type"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("digest"), field("X-Refers-To-Page-ID").alias("refers_to"), size.alias("payload_bytes"))


def export(spark: SparkSession, path: str, folder: str) -> None:
    """The archive's records as WARC/1.1 files, each record followed by two line breaks; revisits hold no payload."""
    records = originals(spark, path)
    least = -1
    for most, number in (*FILE_CLASSES, (None, 1)):
        size = F.octet_length("record")
        part = records.where((size > least) & (size <= most if most else F.lit(True)))
        with releasing(spark):
            part.select(F.col("record").cast("string").alias("value")).write.mode("append").option("lineSep", BREAK * 2).option("maxRecordsPerFile", number).text(folder)
        least = most


def _records(content: bytes):
    """(header block, http block, payload) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        header = content[at:end]
        size = int(header[header.rindex(b"Content-Length: ") + 16 :].split(b"\r\n", 1)[0])
        body = content[end : end + size]
        if len(body) != size or content[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        split = body.index(b"\r\n\r\n") + 4
        yield header, body[:split], body[split:]
        at = end + size + 4


def _field(header: bytes, name: bytes) -> str | None:
    at = header.find(b"\r\n" + name + b": ")
    return None if at < 0 else header[at + len(name) + 4 : header.index(b"\r\n", at + 2)].decode()


def _of_files(batches):
    for b in batches:
        for content in b.column("content"):
            for header, block, payload in _records(content.as_py()):
                kind, digest = _field(header, b"WARC-Type"), _field(header, b"WARC-Payload-Digest").removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload and digest differ: {_field(header, b'WARC-Record-ID')}")
                row = [_field(header, b"X-Page-ID"), kind, _field(header, b"WARC-Target-URI"), digest, _field(header, b"X-Refers-To-Page-ID")]
                yield pa.record_batch([*[pa.array([c], pa.string()) for c in row], *[pa.array([c], pa.binary()) for c in (header, block, payload if kind == "response" else None)]], ["page_id", "record_type", "url", "digest", "refers_to", "header", "http", "payload"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of WARC files: page_id, record_type, url, digest, refers_to (strings), header, http, payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_of_files, "page_id string, record_type string, url string, digest string, refers_to string, header binary, http binary, payload binary")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to an archive in the shared folder, rebuilds the records and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes of revisits are those of the payload that their digest names.
    """
    spark = pages.sparkSession
    path = archive_folder(spark)
    write(pages, path, min_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = written(parsed(originals(spark, path), "sha256"), "warc-records")
    sizes = written(rows.groupBy("sha256").agg(F.max("payload_bytes").alias("stored"), F.count("*").alias("seen")), "warc-sizes")
    found = join_many(rows, sizes, ["sha256"], "seen", rows.count())
    return found.select(F.col("page_id").cast(kind).alias("page_id"), F.col("stored").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
