"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A document that holds a window holds all of its shingles of three words, so one
necessary token finds every occurrence: the window's rarest shingle over all
documents. Windows of fewer words are one shingle. Documents meet that token's
windows, the token's place bounds where the window would start and end, and the
words of just that range are compared. Windows are equal in all documents, so
the comparison is exact containment; tokens are 64-bit hashes, so that two
shingles of one hash cost a comparison and nothing else.

Only DataFrame functions are used. The windows are broadcast while the bytes of
their words and item ids are within a bound; beyond it, positions and windows meet in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

#: Bytes of windows, with the ids of their items, that may be broadcast.
BROADCAST_BYTES = 32 << 20
SHINGLE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contest_words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and non-ASCII characters, A-Z in lower case; null has none."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    words = F.split(plain, _BETWEEN)
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """``window_id, words, n, items``: the distinct windows of all items and the ids of their items as strings."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), contest_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0)) + 1
    cut = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("i")).select("item_id", F.slice("w", F.col("i"), width).alias("words"))
    distinct = cut.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    return checkpointed(distinct.select(F.monotonically_increasing_id().alias("window_id"), "words", F.size("words").alias("n"), "items"))


def _bytes(windows: DataFrame) -> int:
    """What ``windows`` hold in rows: their strings, 16 bytes around each, 64 around each row."""
    size = lambda strings: F.aggregate(strings, F.lit(0).cast("long"), lambda total, x: total + F.octet_length(x) + 16)
    return windows.agg(F.sum(size("words") + size("items") + 64)).first()[0] or 0


def _token(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from index ``at`` on."""
    return F.xxhash64(F.slice(words, at + 1, F.lit(size)))


def decontaminate(
    documents: DataFrame,
    items: DataFrame,
    width: int = 13,
    share: int = 20,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document row.

    A word is hit if an occurrence of any item's window covers it. Contaminated:
    some word is hit and ``share * n_hit >= n_words``. Null and empty texts have
    no words and are clean; items without words have no windows; null item ids
    count as no item but their windows hit. Repeated rows give repeated results;
    a table without rows gives none. Other columns are ignored.
    """
    windows = benchmark_windows(items, width)
    small = _bytes(windows) <= broadcast_bytes
    hint = F.broadcast if small else (lambda frame: frame)
    texts = documents.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), contest_words(F.col("text")).alias("w"))
    if not small:
        texts = checkpointed(texts)  # row numbers must be the same in both scans

    # an empty first word stands for the row itself, so that every row leaves one line at least
    marked = texts.select("doc_id", "row", F.concat(F.array(F.lit("")), F.col("w")).alias("w"))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect())

    def placed(rows: DataFrame) -> DataFrame:
        """``at, token`` of every shingle of ``w``, whose first word is no word; token 0 at 0."""
        at, room = F.col("at"), F.size("w")
        rows = rows.select("*", F.posexplode("w").alias("at", "_word")).drop("_word")
        own = [F.when(at == 0, F.lit(0).cast("long")).when(at + k <= room, _token(F.col("w"), at, k)) for k in sizes or [SHINGLE]]
        return rows.withColumn("token", own[0] if len(own) == 1 else F.explode(F.array_distinct(F.array(*own))))

    tokens = windows.select("window_id", "words", "n", F.posexplode("words").alias("place", "_word"))
    size = F.least("n", F.lit(SHINGLE))
    own = F.coalesce(*[F.when(size == k, _token(F.col("words"), F.col("place"), k)) for k in sizes or [SHINGLE]])
    tokens = checkpointed(tokens.where(F.col("place") + size <= F.col("n")).select("window_id", "n", "place", own.alias("token")))
    vocabulary = tokens.select("token").distinct()
    seen = placed(marked.select("w")).select("token").join(hint(vocabulary), "token").groupBy("token").agg(F.count("*").alias("times"))
    rarest = F.min(F.struct("times", "place", "token")).alias("t")
    complete = F.count("*") == F.max(F.col("n") - size + 1)  # a shingle that no document has rules its windows out
    anchors = tokens.join(seen, "token").groupBy("window_id").agg(rarest, complete.alias("complete")).where("complete")
    anchors = checkpointed(anchors.join(windows, "window_id").select("window_id", "words", "n", "items", F.col("t.place").alias("place"), F.col("t.token").alias("token")))

    start = F.col("at") - F.col("place")
    fits = (start >= 1) & (start + F.col("n") <= F.size("w"))
    equal = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest("n", F.lit(1))) == F.col("words")
    if small:
        marker = anchors.sparkSession.createDataFrame([(0, 0)], "token long, n int")
        anchors = anchors.unionByName(marker, allowMissingColumns=True)
        met = placed(marked).join(F.broadcast(anchors), "token").where((F.col("n") == 0) | (fits & equal))
    else:
        keys = placed(marked.select("row", "w")).select("row", "at", "token").join(anchors, "token")
        keys = keys.where(start >= 1).select("row", "at", "place", "n", "words", "items")
        met = keys.join(marked, "row").where(fits & equal)
        met = met.unionByName(marked.withColumn("n", F.lit(0)).withColumn("place", F.lit(0)).withColumn("at", F.lit(0)), allowMissingColumns=True)
    met = met.select("row", "doc_id", (F.size("w") - 1).cast("long").alias("n_words"), "n", start.alias("start"), "items")

    span = F.when(F.col("n") > 0, F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end")))
    rows = met.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("hit"), F.greatest(a["end"], s["end"]).alias("end")),
    )
    counted = rows.select("doc_id", "n_words", covered["hit"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT rid, i, p.n, item_id FROM places p JOIN windows USING (n, gram)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
