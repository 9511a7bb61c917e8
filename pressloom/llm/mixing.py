"""Mixing sources to target weights along a curriculum that varies over time.

Every source has a weight and a schedule, the rate at which training draws from
it over time 0 to 1. The weights give each source's target words by filling up
to a cap; the schedule, integrated and scaled to the target, is the source's
cumulative demand. A source's documents lie in a fixed shuffled order along
its words; a document's middle word, once per pass over the source, is met at
the time when demand reaches it, which is its training position. Passes whose
middle lies beyond the target are not taken.

A position is a time between 0, the begin of training, and 1, its end. All
sources share this time: at time t each is drawn at its target times its rate at
t over its whole, so that their shares at t follow from these. The sum over the
sources need not be constant; equal spans of time hold about equal words only if it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

#: Words of a source are summed in hash ranges; while one has more rows than this, all are cut finer, up to ``MOST_DIGITS``.
RANGE_ROWS, MOST_DIGITS = 200_000, 6
#: (time, rate) knots of linear schedules, dealt to the sources in turn like the weights: fading, steady, growing.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def demand_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a piecewise linear schedule has drawn ``share`` (0 to 1) of its whole."""
    areas = [0.0]
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (a + b) / 2)
    drawn = share * areas[-1]
    out = None
    for (t0, a), (t1, b), before, after in zip(knots, knots[1:], areas, areas[1:], strict=False):
        slope, rest = (b - a) / (t1 - t0), drawn - before
        time = t0 + (F.sqrt(F.greatest(F.lit(a * a) + rest * (2 * slope), F.lit(0.0))) - a) / slope if slope else t0 + rest / a
        out = F.when(drawn <= after, time) if out is None else out.when(drawn <= after, time)
    return F.least(F.greatest(out.otherwise(F.lit(knots[-1][0])), F.lit(0.0)), F.lit(1.0))


def source_targets(sized: DataFrame, weights: Sequence[int], budget: float, max_repeat: int) -> DataFrame:
    """One row per source: its size, weight and target words.

    ``budget`` times all words are shared by weight; a target stops at
    ``max_repeat`` times the source's size and its excess goes to the others by
    weight until none is above. Sources go by code point, null last. One row
    per source passes the window, never a document.
    """
    sizes = sized.groupBy("null", "source").agg(F.sum("size").alias("source_size"))
    first = F.row_number().over(Window.orderBy("null", "source")) - 1
    turns = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("turn", first % len(weights)).withColumn("weight", turns[F.col("turn")]).withColumn("cap", F.col("source_size") * max_repeat)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "null", "source")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levelled = ranked.withColumn("level", left / open_weight).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    levelled = levelled.withColumn("at", F.row_number().over(fill))
    level = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return levelled.select("null", "source", "turn", "source_size", target.alias("target"))


def shuffle_key(seed: str, row_id: Column, text: Column) -> Column:
    """A hash that orders rows by id and text; rows that share an id, or have none, are spread by their texts."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))


def mix_sources(
    rows: DataFrame,
    size: Column,
    source: Column,
    order: Column,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    budget: float = 1.5,
    max_repeat: int = 2,
) -> DataFrame:
    """``row, size, source_size, target, copies, positions``; ``row`` is a struct of all columns of a row.

    ``copies`` (0 to ``max_repeat``) is how often the mix takes the row and
    ``positions`` the training time of each copy. Rows of a source lie in the
    order of ``order``, a hexadecimal hash such as `shuffle_key`, ties by their
    size and a hash of the row; rows equal in all are interchangeable. A source
    is cut into ranges of that hash, whose sums give each range its start, so
    no source is ever in one task. Null source is a source of its own; null or
    empty texts have size 0. Columns of ``rows`` may have any names, as they
    stay within ``row``. Empty in, empty out.
    """
    keyed = rows.select(F.struct("*").alias("row"), size.alias("size"), source.isNull().alias("null"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), order.alias("order"))
    digits = 3
    while True:
        ranged = keyed.withColumn("range", F.substring("order", 1, digits))
        facts = checkpointed(ranged.groupBy("null", "source", "range").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
        if digits == MOST_DIGITS or (facts.agg(F.max("rows")).first()[0] or 0) <= RANGE_ROWS:
            break
        digits += 1
    targets = source_targets(facts, weights, budget, max_repeat)
    before = Window.partitionBy("null", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = facts.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size", "rows").join(targets, ["null", "source"])
    key = ["null", "source", "range"]
    within = Window.partitionBy(*key).orderBy("order", "size", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(starts, key).withColumn("middle", F.col("start") + F.sum("size").over(within) - F.col("size") / 2)
    middles = F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda k: k * F.col("source_size") + F.col("middle"))
    placed = placed.withColumn("taken", F.filter(middles, lambda m: m < F.col("target")))

    def position(m: Column) -> Column:
        share, out = m / F.col("target"), None
        for turn in range(len(weights)):
            time = demand_time(share, schedules[turn % len(schedules)])
            out = F.when(F.col("turn") == turn, time) if out is None else out.when(F.col("turn") == turn, time)
        return out

    return placed.select("row", "size", "source_size", "target", F.size("taken").alias("copies"), F.transform("taken", position).alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """``row, position`` of every taken copy, range-sorted by position; ties by a hash of the row."""
    copies = mixed.select("row", F.explode("positions").alias("position"))
    tie = F.xxhash64("row")
    return copies.repartitionByRange(F.col("position"), tie).sortWithinPartitions(F.col("position"), tie)


def mix_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_position`` of every row, by first position."""
    text = F.col("text")
    sized = checkpointed(documents.select("doc_id", "source", word_count(text).alias("words"), shuffle_key("mix-1", F.col("doc_id"), text).alias("order")))
    mixed = mix_sources(sized, F.col("words"), F.col("source"), F.col("order"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    out = mixed.select("row.doc_id", "size", "source_size", "target", taken, F.round(F.get("positions", F.lit(0)), 9).alias("first_position"))
    return out.orderBy("first_position", "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2 * source_size AS cap, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS turn FROM sizes
), weighed AS (
  SELECT *, [3, 1, 2][turn + 1] AS weight FROM ranked
), levelled AS (
  SELECT *, row_number() OVER f AS rk,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / weight, source IS NULL, source)
), targets AS (
  SELECT *, CASE WHEN level * weight >= cap THEN cap::DOUBLE ELSE (SELECT arg_min(level, rk) FROM levelled WHERE level * weight < cap) * weight END AS target FROM levelled
), placed AS (
  SELECT doc_id, size, source_size, target, turn, sum(size) OVER (PARTITION BY s.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shared AS (
  SELECT *, CASE WHEN middle < target THEN middle / target END AS u FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * ((middle < target)::INT + (source_size + middle < target)::INT))::BIGINT AS taken,
  CASE WHEN u IS NOT NULL THEN round(least(greatest(CASE turn WHEN 0 THEN (sqrt(greatest(2.25 - 2 * u, 0)) - 1.5) / -1 WHEN 1 THEN u
    ELSE CASE WHEN u <= 0.375 THEN sqrt(0.25 + 2 * u) - 0.5 ELSE 0.5 + sqrt(1 + 2 * (u - 0.375)) - 1 END END, 0), 1), 9) END AS first_position
FROM shared
"""
