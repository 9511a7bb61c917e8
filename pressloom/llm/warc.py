"""A content-addressed WARC archive as two tables.

``payloads`` keeps the bytes of each distinct payload once under their SHA-256;
``headers`` keeps every record's exact header bytes, which end where the payload
begins. Joining both on the digest gives the original records back, and the
digest of the bytes read is compared with the key before they are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

#: Smaller payloads are always stored as responses.
LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: What some reader takes for the end of a line, and how it is written.
LINE_ENDS = {"\r": "%0D", "\n": "%0A", "\v": "%0B", "\f": "%0C", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}


def _line(name: str, value: Column) -> Column:
    """A header line; left out for null. Line ends in a value are percent-encoded."""
    for end, code in LINE_ENDS.items():
        value = F.replace(value, F.lit(end), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _field(header: Column, name: str, pattern: str) -> Column:
    """What ``pattern`` finds in a header field; lines end in CR LF only, and the first field of the name counts."""
    return F.regexp_extract(header, rf"(?<=\r\n){name}: {pattern}\r\n", 1)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def archive_records(pages: DataFrame, least_shared: int = LEAST_SHARED, date: str = DATE) -> DataFrame:
    """``page_id, digest, record_type, header``: one WARC record per page row.

    Of records with equal payloads of at least ``least_shared`` bytes that with
    the smallest page id is a response and the others revisit it; repeated rows
    of that id are responses too. Null html is an empty payload, a null url
    leaves its line out, a null page id can't be revisited.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    first = facts.where(F.col("bytes") >= least_shared).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # written apart from the join, so that a digest of very many pages can be split in it
    facts = facts.join(checkpointed(first), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("first_id"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return facts.select("page_id", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.cast("binary").alias("header"))


def write_archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED) -> None:
    """Write both tables below ``path``, which must be new.

    Copies of a payload meet after partial aggregation, so that a digest of very
    many pages brings one row from each task.
    """
    archive_records(pages, least_shared).select("digest", "header").write.parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    stored = pages.select(payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """``digest, header, record, payload``: the exact bytes of every record, revisits without their payload, and the payload they stand for.

    A record whose payload is missing has null bytes.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    whole = spark.read.parquet(f"{path}/headers").join(stored, "digest", "left")
    revisit = _field(F.col("header").cast("string"), "WARC-Type", r"(\w+)") == "revisit"
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return whole.select("digest", "header", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"), "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, refers_to, payload_bytes, payload_digest, record`` of every record as it was written.

    All is read off the reconstructed record bytes: the header's fields, and the
    block of Content-Length bytes, whose payload is a response's; a revisit's
    is the stored one of its digest. A record whose payload is missing, or whose
    digest differs from its header's or the store's, stops the read.
    """
    records = original_records(spark, path)
    # a header ends in the only empty line before the block, and the block's own header in the next
    text = F.col("header").cast("string")
    block = F.octet_length("header") - F.octet_length(F.substring_index(text, "\r\n\r\n", 1)) - 4
    length = _field(text, "Content-Length", "([0-9]+)").cast("int") - block
    kind = _field(text, "WARC-Type", r"(\w+)")
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(F.substring("record", F.octet_length("header") + 1, length))
    found = records.select(
        _field(text, "WARC-Record-ID", "<urn:page:([^>]*)>").try_cast("long").alias("page_id"),
        kind.alias("record_type"),
        _field(text, "WARC-Refers-To", "<urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
        _field(text, "WARC-Payload-Digest", r"sha256:(\w+)").alias("claimed"),
        "digest",
        "record",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("actual"),
    )
    intact = (F.col("actual") == F.col("digest")) & (F.col("actual") == F.col("claimed"))
    checked = F.when(intact, F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string"))
    return found.select("page_id", "record_type", "refers_to", "payload_bytes", checked.alias("payload_digest"), "record")


def archive_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` below ``path`` and return what the archive's reconstructed records hold for each."""
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
