"""URL filters by a temporal list join.

Dated list entries on hosts, parent domains and path prefixes become validity
intervals: an entry holds until the next one on its key. An as-of join evaluates
every capture against the entries that were active when it was fetched; the most
specific one decides.

Intervals are cut at borders of ``bucket_days`` and the join is on key and
bucket, so that a key with a long history, or with a great share of all captures,
is spread over many buckets, and large ones are split by adaptive execution. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_ADDRESS = r"^(?:[0-9.]*|\[.*)$"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
REMOVE = "remove"


def url_host(url: Column) -> Column:
    """Lower-case host; empty for null and for what is no URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def url_keys(url: Column) -> Column:
    """``array<struct<rank, key>>`` that entries may name: parent domains from two labels on (their number of labels), host (100), host and first path segment (101).

    Hosts that are addresses, dotted numbers or in brackets, have no parent domains.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.struct(k.alias("rank"), F.concat(F.lit("."), F.array_join(F.slice(labels, n - k + 1, k), ".")).alias("key")))
    parents = F.when((n > 2) & ~host.rlike(_ADDRESS), parents).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))
    segment = F.coalesce(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))
    own = F.when(host != "", F.array(F.struct(F.lit(100).alias("rank"), host.alias("key")))).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))
    prefix = F.when((host != "") & (segment != ""), F.array(F.struct(F.lit(101).alias("rank"), F.concat(host, F.lit("/"), segment).alias("key"))))
    return F.concat(parents, own, F.coalesce(prefix, F.array().cast("array<struct<rank:int,key:string>>")))


def validity(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` from ``entries(key, action, listed_at)`` in seconds.

    An entry ends where the next of its key begins, the last never. ``remove``
    ends the one before and is dropped. Of entries of one key and second the
    last action in alphabetical order holds. Rows with a null are ignored.
    """
    known = entries.where("key is not null and action is not null and listed_at is not null")
    latest = known.groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    return latest.withColumn("until", until).where(F.col("action") != REMOVE).select("key", "action", F.col("listed_at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, bucket_days: int = 30) -> DataFrame:
    """Captures ``(page_id, url, fetched_at)`` with ``verdict, matched_key, listed_at``.

    Times are whole seconds. The verdict is the action of the most specific
    active entry, ``none`` without one or without a fetch time. An entry is
    active from its own second on, up to but not including the next's. Repeated
    captures are judged one by one; empty tables give empty or unlisted results.
    Other columns are ignored, whatever their names. Captures and their row
    numbers are kept in the shared folder, so that both sides of the join see the same.
    """
    width = bucket_days * 86400
    spans = validity(entries)
    asked = checkpointed(captures.select("page_id", "url", "fetched_at").withColumn("row", F.monotonically_increasing_id()))
    first, last = asked.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    keyed = asked.withColumn("k", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"))), url_keys(F.col("url")))))
    if last is None:
        spans, first, last = spans.limit(0), 0, 0
    low, high = F.lit(first), F.lit(last)
    spans = spans.where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    begin, end = F.floor(F.greatest("since", low) / width), F.floor(F.least(F.coalesce(F.col("until") - 1, high), high) / width)
    spans = spans.withColumn("bucket", F.explode(F.sequence(begin, end)))
    looked = keyed.where("k.key is not null and fetched_at is not null").select("row", "page_id", "url", "fetched_at", "k.rank", "k.key", F.floor(F.col("fetched_at") / width).alias("bucket"))
    active = (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    met = looked.join(spans, ["key", "bucket"]).where(active).select("row", "page_id", "url", "fetched_at", "rank", "key", "action", F.col("since").alias("listed_at"))
    none = asked.select("row", "page_id", "url", "fetched_at", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"), F.lit("none").alias("action"), F.lit(None).cast("long").alias("listed_at"))
    best = met.unionByName(none).groupBy("row", "page_id", "url", "fetched_at").agg(F.max(F.struct("rank", "key", "action", "listed_at")).alias("m"))
    return best.select("page_id", "url", "fetched_at", F.col("m.action").alias("verdict"), F.col("m.key").alias("matched_key"), F.col("m.listed_at").alias("listed_at"))


YEAR = 31_536_000
START = 1_704_067_200


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture at a time of 2024 that follows from its id."""
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR))).alias("fetched_at"))


def page_list(pages: DataFrame, versions: int = 3) -> DataFrame:
    """A dated list over all keys of all pages: each key has ``versions`` entries whose dates and actions follow from its hash."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("k")).select("k.key").distinct()
    drawn = keys.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    digest = F.md5(F.concat("key", F.lit("#"), F.col("v").cast("string")).cast("binary"))
    part = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    action = F.element_at(F.array(F.lit("allow"), F.lit("block"), F.lit("block"), F.lit(REMOVE)), (part(9) % 4 + 1).cast("int"))
    return drawn.select("key", action.alias("action"), (F.lit(START) + part(1) % YEAR).alias("listed_at"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 31536000 AS fetched_at, row_number() OVER () AS row,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages
), keys AS (
  SELECT row, 100 AS rank, host AS key FROM p WHERE host <> ''
  UNION ALL SELECT row, 101, host || '/' || segment FROM p WHERE host <> '' AND segment <> ''
  UNION ALL SELECT row, k, '.' || array_to_string(l[len(l) - k + 1:], '.') FROM (SELECT row, string_split(host, '.') AS l, unnest(range(2, len(string_split(host, '.')))) AS k FROM p WHERE NOT regexp_matches(host, '^([0-9.]*|\[.*)$'))
), drawn AS (
  SELECT key, md5(key || '#' || v) AS d FROM (SELECT DISTINCT key FROM keys), range(1, 4) r(v)
), entries AS (
  SELECT key, 1704067200 + ('0x' || substr(d, 1, 8))::BIGINT % 31536000 AS listed_at, max(['allow', 'block', 'block', 'remove'][('0x' || substr(d, 9, 8))::BIGINT % 4 + 1]) AS action FROM drawn GROUP BY ALL
), spans AS (
  SELECT key, action, listed_at, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS until FROM entries
), best AS (
  SELECT row, arg_max(struct_pack(a := action, k := key, l := listed_at), rank) AS m
  FROM p JOIN keys USING (row) JOIN spans USING (key) WHERE action <> 'remove' AND listed_at <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY row
)
SELECT page_id, url, fetched_at, coalesce(m.a, 'none') AS verdict, m.k AS matched_key, m.l AS listed_at FROM p LEFT JOIN best USING (row)
"""
