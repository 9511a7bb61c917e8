"""Stream forms of the append-only jobs. Each has a batch form of the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressloom.functions import rules
from pressloom.operators.centroids import CentroidStore
from pressloom.operators.curation import append_clicks
from pressloom.operators.stories import assign_once
from pressloom.operators.storage import kept

CLICKS = "raw_id string, session_id string, occurred_at timestamp"
ARTICLES = "article_id long, title string, fetched_at timestamp"


def click_stream(spark: SparkSession, path: str) -> DataFrame:
    """Valid clicks from files that arrive below ``path``; the batch form is `append_clicks`."""
    return append_clicks(spark.readStream.schema(CLICKS).parquet(path))


#: Titles are dealt to so many groups, whose state is one value each. A stream that goes on from a checkpoint needs the number that it began with.
TITLE_GROUPS = 1_024
_TITLES = pa.schema([("title", pa.string()), ("t", pa.int64()), ("article_id", pa.int64()), ("kept", pa.bool_())])


def _first_titles(span: int):
    """Rows of a group's titles in order of time, each once no earlier one can come.

    State is one table: the rows that wait, and as ``kept`` the time of the last row of each title that stayed.
    """

    def stored(rows: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _TITLES, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(rows)
        return sink.getvalue().to_pybytes()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        for rows in batches:
            rows = rows[rows["title_lc"].notna()]
            parts.append(pa.table([pa.array(rows["title_lc"], pa.string()), pa.array(rows["t"], pa.int64()), pa.array(rows["article_id"], pa.int64()), pa.array([False] * len(rows), pa.bool_())], schema=_TITLES))
        rows, now = pa.concat_tables(parts) if parts else _TITLES.empty_table(), state.getCurrentWatermarkMs()
        due = rows.filter(pc.less_equal(rows["t"], now * 1000)).sort_by([("title", "ascending"), ("t", "ascending"), ("article_id", "ascending")])
        title, last, times, staying = None, 0, {}, []
        for own, t, article, kept in zip(*(c.to_pylist() for c in due.columns), strict=True):
            if kept or own != title or t - last > span:
                title, last = own, t
                times[own] = t
                if not kept:
                    staying.append(article)
        times = {own: t for own, t in times.items() if t + span > now * 1000}
        waiting = rows.filter(pc.greater(rows["t"], now * 1000))
        if len(waiting) or times:
            known = pa.table([pa.array(times, pa.string()), pa.array(times.values(), pa.int64()), pa.nulls(len(times), pa.int64()), pa.array([True] * len(times), pa.bool_())], schema=_TITLES)
            state.update((stored(pa.concat_tables([known, waiting])),))
            # the next row that becomes due, or the end of the time in which the last ones count
            state.setTimeoutTimestamp(max(now + 1, (pc.min(waiting["t"]).as_py() if len(waiting) else max(times.values()) + span) // 1000))
        elif state.exists:
            state.remove()
        if staying:
            yield pd.DataFrame({"article_id": pd.Series(staying, dtype="int64")})

    return run


def recent_title_stream(articles: DataFrame, days: int = 7, late: str = "1 hour", groups: int = TITLE_GROUPS) -> DataFrame:
    """``article_id`` of the rows that `recent_title_batch` keeps, whatever the order in which they arrive within ``late``.

    A row is decided when the watermark has passed its time, as no earlier one
    of its title can come then. State is one time for each title of the last
    ``days``, and the rows of the last ``late``. Rows behind the watermark are
    left out. Rows with a null title move the watermark and are dropped.
    Python is called for each of the ``groups`` of titles and batch, not for each title.
    """
    title = F.lower("title")
    article = F.when(F.col("title").isNull(), 0).otherwise(F.col("article_id"))  # no nulls, which would make doubles of a group's ids
    rows = articles.withWatermark("fetched_at", late).select(title.alias("title_lc"), F.unix_micros("fetched_at").alias("t"), article.alias("article_id"), F.pmod(F.xxhash64(title), F.lit(groups)).alias("g"), "fetched_at")
    return rows.groupBy("g").applyInPandasWithState(_first_titles(days * 86_400_000_000), "article_id long", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def recent_title_batch(articles: DataFrame, days: int = 7) -> DataFrame:
    """The first article of each run of equal titles that are at most ``days`` from the one kept before them.

    Titles that come again are kept again once the kept one has expired, in
    order of fetch. Rows stream through their task in that order with the kept
    time as their only state, so that a title of very many rows takes no memory.
    """
    span = days * 86_400_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        title, last = None, 0
        for batch in batches:
            kept = []
            for own, at, article in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != title or at - last > span:
                    title, last = own, at
                    kept.append(article)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["article_id"])

    rows = articles.select(F.lower("title").alias("title_lc"), F.unix_micros("fetched_at").alias("t"), "article_id").where("title_lc is not null")
    return rows.repartition("title_lc").sortWithinPartitions("title_lc", "t", "article_id").mapInArrow(run, "article_id long")


class AssignmentJob:
    """Assigns arriving articles to clusters, batch by batch, with all it knows in tables below ``path``.

    ``members`` holds memberships by batch and `CentroidStore` the centroids. A
    batch reads what earlier batches have left and nothing of its own, and
    replaces its own rows, so a batch that is repeated after a failure gives the
    same tables. ``read_articles`` gives the rows of all articles, with vectors.
    """

    MEMBERS = "article_id long, cluster_id long, similarity double, batch long"

    def __init__(self, spark: SparkSession, path: str, read_articles: Callable[[], DataFrame], as_of: Column, similarity: float = rules.JOIN_SIMILARITY, most: int = rules.MAX_CLUSTER) -> None:
        self.spark, self.path, self.read_articles, self.as_of, self.similarity, self.most = spark, path.rstrip("/"), read_articles, as_of, similarity, most
        spark.createDataFrame([], self.MEMBERS).write.mode("append").partitionBy("batch").parquet(f"{self.path}/members")
        self.store = CentroidStore(spark, f"{self.path}/centroids")

    def members(self, before: int | None = None) -> DataFrame:
        """``article_id, cluster_id, similarity, batch``, of batches below ``before``."""
        rows = self.spark.read.schema(self.MEMBERS).parquet(f"{self.path}/members")
        return rows if before is None else rows.where(F.col("batch") < before)

    def begin(self, members: DataFrame) -> None:
        """Take over known memberships ``article_id, cluster_id`` as what was before the first batch."""
        self._commit(-1, members.select("article_id", "cluster_id", F.lit(None).cast("double").alias("similarity")))

    def _commit(self, number: int, fresh: DataFrame) -> None:
        rows = fresh.withColumn("batch", F.lit(number).cast("long")).select("article_id", "cluster_id", "similarity", "batch")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/members")
        added = self.members().where(F.col("batch") == number).select("article_id", "cluster_id")
        none = self.spark.createDataFrame([], "article_id long, cluster_id long")
        self.store.write(number, added, none, self.members(number + 1).select("article_id", "cluster_id"), self.read_articles())

    def run(self, batch: DataFrame, number: int) -> None:
        """Assign the articles of micro-batch ``number``; ids that have a cluster already, or come twice, are left."""
        known = self.members(number)
        ids = batch.select("article_id").distinct().join(known.select("article_id"), "article_id", "left_anti")
        fresh = kept(self.read_articles().join(ids, "article_id", "left_semi"))
        centroids = kept(self.store.centroids(number))
        found = assign_once(fresh, centroids, self.as_of, self.similarity, self.most)
        self._commit(number, kept(found.select("article_id", "cluster_id", "similarity")))


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table; the checkpoint makes each file count once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_assignment(stream: DataFrame, job: AssignmentJob, checkpoint: str) -> StreamingQuery:
    """Assign the articles of a stream as they arrive, batch by batch."""
    return stream.writeStream.foreachBatch(job.run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
