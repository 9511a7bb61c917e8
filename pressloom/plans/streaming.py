"""Batch forms of the stream jobs, and the streams run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.operators.storage import kept, new_path
from pressloom.plans.registry import query
from pressloom.sources.model import as_of, hours_before
from pressloom.streaming import jobs


def _folder(m, name: str) -> str:
    return new_path(m.spark, name)


@query("stream_click_ingest", "SELECT event_id AS article_id, user_id::VARCHAR AS session_id, ts AS occurred_at FROM events WHERE event_type = 'click' AND event_id % 7 <> 0", model=False)
def stream_click_ingest(m):
    """Clicks written as arriving files, read as a stream, validated and appended to a table."""
    root = _folder(m, "clicks")
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    m.raw("events").where("event_type = 'click'").select(raw.alias("raw_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("occurred_at")).write.parquet(f"{root}/in")
    jobs.start_append(jobs.click_stream(m.spark, f"{root}/in"), f"{root}/out", f"{root}/state").awaitTermination()
    return m.spark.read.parquet(f"{root}/out").select("article_id", "session_id", "occurred_at")


_REPEATED = """, repeated AS (
  SELECT article_id * 4 + n AS article_id, lower(title) AS title_lc, fetched_at + to_days([0, 8, 13, 16][n + 1]::INT) AS fetched_at FROM articles, unnest(range(0, 4)) r(n) WHERE title IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY title_lc ORDER BY fetched_at, article_id) AS place FROM repeated
), walk AS (
  SELECT title_lc, place, article_id, fetched_at AS kept_at, true AS stays FROM ranked WHERE place = 1
  UNION ALL
  SELECT r.title_lc, r.place, r.article_id, CASE WHEN r.fetched_at > kept_at + INTERVAL 168 HOUR THEN r.fetched_at ELSE kept_at END, r.fetched_at > kept_at + INTERVAL 168 HOUR
  FROM walk w JOIN ranked r ON r.title_lc = w.title_lc AND r.place = w.place + 1
) SELECT article_id FROM walk WHERE stays"""


def repeated(m):
    """Articles that come again after 8, 13 and 16 days."""
    again = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("days")) for n, d in enumerate((0, 8, 13, 16))]))
    rows = m.articles().where("title is not null").select("article_id", "title", "fetched_at", again.alias("r"))
    return rows.select((F.col("article_id") * 4 + F.col("r.n")).alias("article_id"), "title", hours_after(F.col("fetched_at"), F.col("r.days") * 24).alias("fetched_at"))


def hours_after(time, hours):
    return F.timestamp_micros(F.unix_micros(time) + hours.cast("long") * 3_600_000_000)


#: Rows of a file that arrives.
FILE_ROWS = 1_000_000


@query("stream_recent_dedupe", _REPEATED)
def stream_recent_dedupe(m):
    """Articles that come again over a month arrive as files, each disordered within; one of a title stays in a week."""
    root = _folder(m, "titles")
    rows = kept(repeated(m))  # short rows, written once, as every file below reads them
    day = F.floor(F.unix_seconds("fetched_at") / 86_400)
    first, last = rows.agg(F.min(day), F.max("fetched_at")).first()
    span = F.least(F.floor((day - (first or 0)) / 8), F.lit(3))
    sizes = dict(rows.groupBy(span.alias("n")).count().collect())
    for n in range(4):  # files of eight days, in order of time; then a row that moves the watermark behind all others
        disordered = F.xxhash64("article_id")
        rows.where(span == n).repartition(1 + sizes.get(n, 0) // FILE_ROWS, disordered).sortWithinPartitions(disordered).write.mode("append").parquet(f"{root}/in")
    end = m.spark.createDataFrame([(None, None, last)], jobs.ARTICLES).select("article_id", "title", hours_after(F.col("fetched_at"), F.lit(24 * 60)).alias("fetched_at"))
    end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    arriving = m.spark.readStream.schema(jobs.ARTICLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.start_append(jobs.recent_title_stream(arriving, 7, "9 days"), f"{root}/out", f"{root}/state").awaitTermination()
    return m.spark.read.schema("article_id long").parquet(f"{root}/out")


@query("recent_dedupe_batch", _REPEATED)
def recent_dedupe_batch(m):
    """The batch form over the same rows."""
    return jobs.recent_title_batch(repeated(m), 7)


@query("stream_assign")
def stream_assign(m):
    """The articles of the last two days arrive as three files and are assigned by the stream, each batch against what the ones before have left."""
    root = _folder(m, "assigned")
    old = m.articles().where(F.col("fetched_at") < hours_before(as_of(), 48)).select("article_id")
    members = kept(m.article_clusters().join(old, "article_id", "left_semi"))
    arriving = kept(m.articles().join(members, "article_id", "left_anti").select("article_id", "title", "fetched_at"))
    for n in range(3):
        arriving.where(F.pmod(F.floor(F.unix_seconds("fetched_at") / 3600), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{root}/in")
    articles = kept(m.articles().select("article_id", "embedding", "fetched_at", "language_code"))
    job = jobs.AssignmentJob(m.spark, f"{root}/out", lambda: articles, as_of(), similarity=0.25)
    job.begin(members)
    stream = m.spark.readStream.schema(jobs.ARTICLES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.start_assignment(stream, job, f"{root}/state").awaitTermination()
    return job.members().where("batch >= 0").select("article_id", "cluster_id")
