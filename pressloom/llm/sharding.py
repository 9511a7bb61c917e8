"""Sharding by a Feistel permutation with cycle walking over global row numbers.

The number of a row in the order of its key is permuted under a key; the
permuted place p gives shard ``p % shards`` and slot ``p // shards``. Anyone who
knows the number of rows and the key can compute where a row is, without a
lookup, and shard sizes differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.permutation import numbered, permuted

KEY = "shuffle-1"


def shard_rows(rows: DataFrame, shards: int, order: list[Column] | None = None, key: str = KEY) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in every shard).

    ``order`` defines the row numbers, by default ``doc_id`` and then a hash of
    all columns but maps; rows equal in it are interchangeable. Null keys come first. An
    empty table gives an empty one. Existing columns named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = rows.drop("shard", "slot")
    placed, n = numbered(rows, order or [F.col("doc_id"), F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])])
    place = placed.select("row", permuted(F.col("number"), n, key).alias("place"))
    return place.select("row.*", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16, key: str = KEY) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Law ``rows``: shard counts are one apart at most. A null text has size 1 and
    the checksum of no bytes.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = documents.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shard_rows(facts, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], key)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), facts AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, steps
), counted AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i, count(*) OVER () AS n,
    greatest(1, ceil(sqrt(count(*) OVER ()))::BIGINT) AS half FROM facts
), walk AS (
  SELECT i, n, half, i // half AS l, i % half AS r, 0 AS k FROM counted
  UNION ALL
  SELECT i, n, half, r, (l + ('0x' || substr(md5('shuffle-1:' || (k % 4 + 1) || ':' || r), 1, 8))::BIGINT) % half, k + 1
  FROM walk WHERE NOT (k > 0 AND k % 4 = 0 AND l * half + r < n)
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((l * w.half + r) % 16)::INT AS shard,
  ((l * w.half + r) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM walk w JOIN counted USING (i) WHERE k > 0 AND k % 4 = 0 AND l * w.half + r < w.n
"""
