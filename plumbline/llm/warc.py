"""Content-addressed WARC archives.

An archive is two tables in a folder: ``payloads`` holds every distinct payload once under its
SHA-256, ``records`` the exact header bytes of every record and the key of its payload. Joining
the two gives the original records back. A payload is kept under a digest only after its bytes
were hashed, and reading hashes them again: a mismatch raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Copies of shorter payloads are responses of their own; a revisit record would save nothing.
REVISIT_BYTES = 1000
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def _record_id(page_id: Column, url: Column) -> Column:
    """The same for the same page_id, url and payload, another one for any other record."""
    named = F.to_json(F.struct(page_id.alias("page_id"), url.alias("url"), "digest"))
    uuid = F.regexp_replace(F.md5(named), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES
) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` into the folder ``path``.

    The payload is the html in UTF-8, null being empty. Of records with equal payloads of at
    least ``revisit_bytes`` that with the largest page_id is the response and the others revisit
    it. Rows that repeat a page_id and its payload are of the same type; if they repeat the url too,
    they are one record written as often as it occurs, under one record id.
    Rows with a null page_id are never the response that others refer to, unless all have none.

    Payloads go through one shuffle, where copies that share a task are already one row.
    """
    spark = pages.sparkSession
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("owned"),
        F.first("payload").alias("payload"),
    ).withColumn("sha1", F.sha1("payload")).withColumn("length", F.octet_length("payload")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")
    kept = spark.read.parquet(f"{path}/payloads").select(
        "digest", F.col("owned.page_id").alias("owner"), F.col("owned.url").alias("owner_url"), "sha1", "length"
    )
    record = rows.select("page_id", "url", "digest").join(kept, "digest")
    revisit = (F.col("length") >= revisit_bytes) & (F.col("page_id") != F.col("owner"))
    revisit = F.coalesce(revisit, F.col("page_id").isNull() & F.col("owner").isNotNull())
    line = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%20")
    length = F.lit(len(HTTP_HEADER)) + F.when(revisit, 0).otherwise(F.col("length"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url")),
        F.lit("\r\nWARC-Target-URI: "), line,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("owner"), F.col("owner_url")),
            F.lit("\r\nX-Refers-To-Page: "), F.col("owner").cast("string"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"), F.lit(f"\r\n\r\n{HTTP_HEADER}"),
    ).cast("binary")
    record.select("page_id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(
        f"{path}/records"
    )


def _verified(spark: SparkSession, path: str, payloads: DataFrame) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.col("digest")))
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary"))
    return payloads.withColumn("payload", checked)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, type and the exact bytes of every record of an archive.

    A join of headers with payloads; revisit records have no payload of their own.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = _verified(spark, path, spark.read.parquet(f"{path}/payloads").select("digest", "payload"))
    kind = F.regexp_extract(F.col("header").cast("string"), r"\r\nWARC-Type: (\w+)\r\n", 1)
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.join(payloads, "digest").select(
        "page_id", kind.alias("record_type"), F.concat("header", body, F.lit(END).cast("binary")).alias("record")
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    Lengths and digests are computed from the stored payload bytes, once per payload, before
    they are joined to the records; types and references are parsed from the stored headers.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = _verified(spark, path, spark.read.parquet(f"{path}/payloads").select("digest", "payload"))
    measured = payloads.select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    text = F.col("header").cast("string")
    refers = F.regexp_extract(text, r"\r\nX-Refers-To-Page: (-?\d+)\r\n", 1)
    parsed = records.select(
        "page_id",
        "digest",
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.when(refers != "", refers.try_cast("long")).alias("refers_to"),
    )
    return parsed.join(measured, "digest").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
