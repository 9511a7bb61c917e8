"""Appends to run, attempt and search logs, feed items, and the file forms of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions import texts, urls
from pressloom.operators.storage import new_path


def append_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """The run log with rows for runs ``(run_id, job_name, ended_at, duration_ms, status)``, which began their duration earlier."""
    began = F.timestamp_millis(F.unix_millis("ended_at") - F.col("duration_ms"))
    return runs.unionByName(ended.select("run_id", "job_name", began.alias("started_at"), "duration_ms", "status"))


def append_attempts(attempts: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The attempt log with new attempts, stamped ``at``; columns that these lack are null."""
    return attempts.unionByName(new.withColumn("created_at", at), allowMissingColumns=True)


def append_searches(searches: DataFrame, new: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The search log with the new searches, and their results ``(search_id, place, url)`` as candidates with ranks from 1."""
    rank = F.row_number().over(Window.partitionBy("search_id").orderBy("place", "url")).cast("long")
    return searches.unionByName(new), results.withColumn("rank", rank).drop("place")


ITEM = "guid long, title string, link string, creator string, author string, isoDate string, pubDate string, contentSnippet string, content string, summary string"


def project_feed_items(items: DataFrame, query_feed: bool = False) -> DataFrame:
    """``guid, title, dek, author, published_at, publisher_name, publisher_homepage, canonical_url`` of feed items, one JSON object in ``item`` each.

    Items of a query feed name their publisher at the end of the title, which is
    cut off. Items without title or link stay out.
    """
    r = items.select(F.from_json("item", ITEM).alias("r")).select("r.*")
    title = texts.decoded_entities(F.trim("title"))
    publisher = texts.title_publisher(title)
    author = F.coalesce("creator", "author")
    mail = F.regexp_replace(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)\s*$", " +0000")
    date = F.coalesce(F.try_to_timestamp("isoDate"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    named = publisher["name"].isNotNull() if query_feed else F.lit(False)
    out = r.select(
        "guid",
        F.when(named, texts.clean_feed_title(title)).otherwise(title).alias("title"),
        texts.best_dek(F.col("contentSnippet"), F.col("summary"), F.col("content")).alias("dek"),
        texts.decoded_entities(F.trim(author)).alias("author"),
        date.alias("published_at"),
        F.when(named, publisher["name"]).alias("publisher_name"),
        F.when(named, publisher["homepage"]).alias("publisher_homepage"),
        urls.canonical_url(F.trim("link")).alias("canonical_url"),
    )
    return out.where("title <> '' and canonical_url <> ''")


def round_trip_json(rows: DataFrame) -> DataFrame:
    """``rows`` written as JSON lines and read again by their schema."""
    path = new_path(rows.sparkSession, "lines")
    rows.write.json(path, ignoreNullFields=False)
    return rows.sparkSession.read.schema(rows.schema).json(path)


CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": ""}


def round_trip_csv(rows: DataFrame) -> DataFrame:
    """``rows`` of plain columns written as quoted CSV and read again; quotes are doubled, line ends stay within quotes, ``\\N`` is null."""
    path = new_path(rows.sparkSession, "csv")
    rows.write.options(**CSV, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    read = rows.sparkSession.read.options(**CSV, multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)
    return read.schema(rows.schema).csv(path)


SNAPSHOT = "entries array<struct<place: long, cluster_id: long, score: double>>"


def write_snapshot(ranked: DataFrame) -> str:
    """A short ranked list (a limited one, as feeds are) written as one JSON document; its path."""
    path = new_path(ranked.sparkSession, "snapshot")
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "cluster_id")).cast("long").alias("place")
    listed = ranked.select(place, "cluster_id", "score")
    listed.agg(F.sort_array(F.collect_list(F.struct("place", "cluster_id", "score"))).alias("entries")).coalesce(1).write.json(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path).select(F.explode("entries").alias("e")).select("e.*")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``cluster_id, before, after``: places in both lists, null where a list lacks the cluster."""
    a, b = before.select("cluster_id", F.col("place").alias("before")), after.select("cluster_id", F.col("place").alias("after"))
    return a.join(b, "cluster_id", "full")
