"""Audit of how document filters interact: what each removes alone, after others, and on average over all orders.

Every document fails a set of filters, which is a mask of bits. Four filters
judge the text by itself; the fifth, copies of a smaller id's text, is read off
compressed tries (`radix_trie`). All that an order of filters removes follows
from the number of documents per part and mask, so the documents are reduced
to these once and the orders are worked out from the small table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.radix_trie import MOST_RANGES, READ_BYTES, TASK_BYTES, least_ids

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: few words, few distinct words, many capitals, symbols of markup or code."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    few = F.size(words) < LEAST_WORDS
    same = 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long")
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long")
    symbols = text.rlike(r"[#$%&*|]")
    return few.cast("int") + 2 * same.cast("int") + 4 * capitals.cast("int") + 8 * symbols.cast("int")


def failure_masks(documents: DataFrame, labels: DataFrame, task_bytes: int = TASK_BYTES, most_ranges: int = MOST_RANGES, read_bytes: int = READ_BYTES) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and labelled ones among them, by part and set of failed filters.

    A part is a language, null and empty being one. Null texts are empty. A
    text is a copy if a smaller id has the same, null ids being larger than
    all others; rows that share id and text are not copies of each other. A
    document has a label if any row of its id in ``labels`` has; null ids have
    none. Empty in, empty out; other columns play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    rows = documents.select(id_.alias("id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    facts = rows.select("id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_hash"), text_mask(F.col("text")).alias("mask"))
    facts = facts.groupBy("id", "part", "text_hash", "mask").agg(F.count("*").alias("n"))
    first = least_ids(rows.select(F.col("text").cast("binary").alias("text"), "id"), task_bytes, most_ranges, read_bytes)
    # a null id is no key of a join: -1 beside a mark stands for it
    key = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(-1)).alias("id"))
    first = first.groupBy(key(F.col("first_id")).alias("key"), "text_hash").agg(F.count("*").alias("firsts"))
    marks = labels.where("doc_id is not null").groupBy(key(F.col("doc_id").cast("long")).alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    judged = facts.withColumn("key", key(F.col("id"))).join(marks, "key", "left").join(first, ["key", "text_hash"], "left")
    mask = F.col("mask") + F.when(F.col("firsts").isNull(), 16).otherwise(0)
    return judged.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("is_good") == 1, F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("is_toxic") == 1, F.col("n"))), F.lit(0)).alias("toxic"))


def order_report(masks: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what is kept, removed, redundant, uniquely failed and lost, and the Shapley sum."""
    each = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # 32 at most
    orders = ["".join(p) for p in permutations(FILTERS)]
    ordered = each.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    own = bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    letters = F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1)
    before = F.aggregate(letters, F.lit(0), lambda s, x: s + bit(x))
    steps = steps.withColumns({"own": own, "before": before})
    fails = lambda x: x["mask"].bitwiseAND(F.col("own")) != 0
    earlier = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0

    def total(name: str, keep) -> Column:
        return F.aggregate(F.filter("sets", keep), F.lit(0).cast("long"), lambda s, x: s + x[name])

    removed = lambda x: fails(x) & ~earlier(x)
    # a filter removes a document in that share of all orders in which it comes first of those that the document fails
    shapley = F.aggregate(F.filter("sets", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.floor(F.lit(len(orders)) / F.bit_count(x["mask"])))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda x: ~fails(x) & ~earlier(x)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & earlier(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.cast("long").alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The report on five filters over whole ``documents``, see `failure_masks` and `order_report`."""
    return order_report(failure_masks(documents, labels))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), facts AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, first_id IS NOT NULL)::INT AS mask
  FROM w
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), sets AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM facts LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || letter FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(letter) WHERE NOT contains(filter_order, letter)
), steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS earlier
  FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5
), joined AS (
  SELECT part, filter_order, step, n, good, toxic, mask, own, mask & own <> 0 AS fails, mask & coalesce(earlier, 0)::BIGINT <> 0 AS gone FROM steps, sets
)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (WHERE fails), 0)::BIGINT AS shapley
FROM joined GROUP BY ALL
"""
