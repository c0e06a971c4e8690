"""WARC archive addressed by content.

An archive is two Parquet tables. ``payloads`` holds each distinct payload once under its SHA-256
digest. ``headers`` holds, for every record, the exact bytes that come before the payload: the WARC
header and the HTTP header. A record is header + payload + CRLF CRLF, put together by a join on the
digest, and the digest is recomputed on every read.

Defined cases: a null body is an empty payload; rows that repeat a page are records of their own, of
which the first stays a response and the others revisit it; a null page_id sorts after all others, so
it is a response only if no row with the same payload has an id; a null url becomes ``about:blank``;
line ends and blanks in a url are percent-encoded; an empty table gives an empty archive; columns
other than the three named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.llm.shared import join_hot, salt

CRLF = "\r\n"
#: Payloads below this many bytes are stored as responses even if they repeat.
MIN_REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    path: str

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"


def _record_id(page: Column, url: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64(url)), F.lit(":"), copy.cast("string"), F.lit(">"))


def _header_text(date: str) -> Column:
    """The bytes before the payload, as text; all inputs are ASCII or percent-encoded."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("uri"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), F.col("refers_to_id"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"),
        F.lit(CRLF * 2), http,
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes one record for each row of pages.

    Copies are counted by (page, url, digest) without their bodies. The first record of a digest is found among
    its parts' first records, and is joined part by part, so a payload that a third of all rows share is
    spread over tasks. The bodies are shuffled once, to keep one of each digest, and combined on the map side.
    """
    archive = Archive(path)
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    base = pages.select(F.col(id_col).alias("page"), uri.alias("uri"), F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))

    counted = base.groupBy("page", "uri", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("part", salt("page", "uri"))
    firsts = counted.groupBy("digest", "part").agg(F.min(F.struct(F.col("page").isNull().alias("no_id"), F.col("page"), F.col("uri"))).alias("first"))
    firsts = firsts.withColumn("first", F.min("first").over(Window.partitionBy("digest")))  # one row a part
    records = (
        counted.join(firsts, ["digest", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("is_first", F.col("page").eqNullSafe(F.col("first.page")) & (F.col("uri") == F.col("first.uri")) & (F.col("copy") == 1))
        .withColumn("record_type", F.when((F.col("payload_bytes") < min_revisit) | F.col("is_first"), "response").otherwise("revisit"))
        .withColumn("record_id", _record_id(F.col("page"), F.col("uri"), F.col("copy")))
        .withColumn("refers_to_id", _record_id(F.col("first.page"), F.col("first.uri"), F.lit(1)))
    )
    records.select("digest", F.encode(_header_text(date), "UTF-8").alias("header")).write.mode("overwrite").parquet(archive.headers)
    base.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(archive.payloads)
    return archive


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """digest, payload, payload_bytes; the job fails on a payload that doesn't have its digest."""
    stored = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest"))).cast("long"))
    return stored.select("digest", "payload", checked.alias("payload_bytes"))


def _page_of(record_id: Column) -> Column:
    return F.try_to_number(F.regexp_extract(record_id, r"<urn:page:(-?\d+):", 1), F.lit("S9999999999999999999")).cast("long")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records' headers parsed and joined with the checked payloads' digests and sizes."""
    text = F.decode("header", "UTF-8")
    parsed = spark.read.schema("digest string, header binary").parquet(archive.headers).select(
        F.regexp_extract(text, r"WARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("payload_digest"),
        F.regexp_extract(text, r"WARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.regexp_extract(text, r"WARC-Record-ID: (<[^>]*>)\r\n", 1).alias("record_id"),
        F.nullif(F.regexp_extract(text, r"WARC-Refers-To: (<[^>]*>)\r\n", 1), F.lit("")).alias("refers_to_id"),
        F.regexp_extract(text, r"WARC-Target-URI: ([^\r]*)\r\n", 1).alias("url"),
    )
    sizes = read_payloads(spark, archive).select(F.col("digest").alias("payload_digest"), "payload_bytes")
    return (
        join_hot(parsed, sizes, "payload_digest", ["record_id"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no payload has digest "), F.col("payload_digest"))).cast("long")))
        .withColumn("page_id", _page_of(F.col("record_id")))
        .withColumn("refers_to", _page_of(F.col("refers_to_id")))
    )


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record's original bytes: record_id, record binary."""
    headers = spark.read.schema("digest string, header binary").parquet(archive.headers)
    text = F.decode("header", "UTF-8")
    end = F.lit(bytearray(b"\r\n\r\n"))
    body = F.when(text.contains("WARC-Type: revisit\r\n"), F.lit(bytearray())).otherwise(F.col("payload"))
    return join_hot(headers, read_payloads(spark, archive), "digest", ["header"]).select(F.regexp_extract(text, r"WARC-Record-ID: (<[^>]*>)\r\n", 1).alias("record_id"), F.concat("header", body, end).alias("record"))
