"""Content-addressed web archive: each payload once under its SHA-256, exact record headers beside it, records rebuilt by joins.

Defined cases: a null html is an empty payload; a null url gives an empty target; rows with the same page_id are records of
their own; a null page_id is written as an empty id and is never the response of others unless all are null; extra columns are
ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

#: Digits of conv() in base 32 and those of RFC 4648.
_CONV_DIGITS, _BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %s\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column. 160 bits are four times 40 bits, each eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32_DIGITS)


def record_id(page_id: Column) -> Column:
    """A URN that follows from page_id alone, so that a lost task writes the same record again."""
    digest = F.sha1(F.concat(F.lit("record "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in cuts)), F.lit(">"))


@dataclass(frozen=True)
class Archive:
    """payloads(sha256, payload) and headers(page_id, url, sha256, header)."""

    payloads: DataFrame
    headers: DataFrame


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0) -> Archive:
    """Writes the payloads and the record headers of pages(page_id, url, html) under path.

    Of records whose payloads are equal and have at least `revisit_from` bytes, that with the smallest page_id is a response and
    the others are revisits of it; smaller payloads are all responses. Only the digest groups are shuffled with their payload, one
    copy from each input partition at most.
    """
    spark = pages.sparkSession
    records = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    records = records.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    stored = records.groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")
    payloads = spark.read.schema("sha256 binary, payload binary").parquet(f"{path}/payloads")
    known = records.select("page_id", "url", "sha256", F.length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    first = known.groupBy("sha256").agg(F.min("page_id").alias("response_id"))
    told = known.join(first, "sha256").withColumn(
        "revisits", (F.col("size") >= revisit_from) & F.coalesce(F.col("page_id") != F.col("response_id"), F.col("page_id").isNull() & F.col("response_id").isNotNull())
    )
    http = F.format_string(_HTTP, F.col("size"))
    size = F.octet_length(http) + F.when(F.col("revisits"), 0).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisits"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisits"), F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("response_id")))),
        F.when(F.col("revisits"), F.concat(F.lit("WARC-Refers-To-Page: "), F.col("response_id").cast("string"))),
        F.when(F.col("revisits"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)
    told.select("page_id", "url", "sha256", header.alias("header")).write.parquet(f"{path}/headers")
    headers = spark.read.schema("page_id long, url string, sha256 binary, header string").parquet(f"{path}/headers")
    return Archive(payloads, headers)


def records_of(archive: Archive) -> DataFrame:
    """The original records: page_id, record (bytes as they stand in a WARC file), payload (of the response for a revisit).

    A payload that no longer has the digest it is stored under stops the job.
    """
    checked = archive.payloads.select(
        "sha256", F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its SHA-256")).cast("binary")).alias("payload")
    )
    whole = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), whole, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return archive.headers.join(checked, "sha256").select("page_id", "header", record.alias("record"), "payload")


def read_back(archive: Archive) -> DataFrame:
    """Parses each rebuilt record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    records = records_of(archive)
    field = lambda name: F.regexp_extract(F.split("header", "\r\n\r\n", 2)[0], rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    block = field("Content-Length").cast("long")
    head = F.octet_length(F.concat(F.split("header", "\r\n\r\n", 2)[0], F.lit("\r\n\r\n")))
    whole = F.octet_length("record") == head + block + 4
    digest = base32_sha1(F.col("payload"))
    told = field("WARC-Payload-Digest")
    refers = field("WARC-Refers-To-Page")
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(whole & (told == F.concat(F.lit("sha1:"), digest)), digest).otherwise(F.raise_error(F.lit("a record does not match its headers")).cast("string")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
    )


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages into an archive in the shared folder and reads it back."""
    return read_back(write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))


def export_files(archive: Archive, path: str) -> None:
    """The records as text-safe base64 lines, one file for each partition, for tools outside Spark."""
    records_of(archive).select(F.base64("record").alias("value")).write.text(path, compression="gzip")
