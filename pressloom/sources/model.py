"""The curation model and adapters that derive it from the driver's tables.

Each function returns one table of the model as a lazy DataFrame; times are
offsets from fixed instants, so that every run and the SQL oracles agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF_SECONDS = 1_706_659_200  # 2024-01-31
DISCOVERY_AS_OF_SECONDS = 1_004_918_400  # 2001-11-05

SCHEMAS = {
    "sources": "source_id long, name string, homepage_url string, feed_url string, weight int, slug string, last_fetched_at timestamp, last_fetch_status string, last_fetch_count int",
    "clusters": "cluster_id long, centroid array<double>, member_count long, last_member_at timestamp",
    "article_clusters": "article_id long, cluster_id long",
    "article_events": "article_id long, event string, session_id string, occurred_at timestamp",
    "pipeline_runs": "run_id long, job_name string, started_at timestamp, duration_ms long, status string",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF_SECONDS))


def discovery_as_of() -> Column:
    return F.timestamp_seconds(F.lit(DISCOVERY_AS_OF_SECONDS))


def hours_before(now: Column, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - int(hours * 3_600_000_000))


@dataclass(frozen=True)
class Model:
    """Tables of the model below ``sf_dir``."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sources(self) -> DataFrame:
        k = F.col("s_suppkey")
        text = k.cast("string")
        feed = (
            F.when(k % 4 == 0, F.concat(F.lit("http://feeds.outlet"), text, F.lit(".example.com/rss")))
            .when(k % 4 == 1, F.concat(F.lit("web://outlet"), text, F.lit(".example.com")))
            .when(k % 4 == 2, F.concat(F.lit("discover://outlet"), text, F.lit(".example.com")))
            .otherwise(F.concat(F.lit("disabled://http://outlet"), text, F.lit(".example.com/rss")))
        )
        fetched = F.when(k % 5 != 0, F.timestamp_seconds(F.lit(AS_OF_SECONDS) - (k % 40) * 3600))
        return self.raw("supplier").select(
            k.alias("source_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("https://www.outlet"), (k % 40).cast("string"), F.lit(".example.com/")).alias("homepage_url"),
            feed.alias("feed_url"),
            F.when(k % 17 != 0, (1 + k % 10).cast("int")).alias("weight"),
            F.when(k % 23 == 0, "web-discovery").otherwise(F.concat(F.lit("outlet-"), text)).alias("slug"),
            fetched.alias("last_fetched_at"),
            F.when(k % 7 == 0, "error").when(k % 5 != 0, "ok").alias("last_fetch_status"),
            (k % 9).cast("int").alias("last_fetch_count"),
        )

    def articles(self) -> DataFrame:
        """Documents as articles, with their vectors.

        Columns are made where a document is read, before vectors are joined, so
        that only those that are asked for are shuffled: a title, not its whole text.
        """
        k, text = F.col("doc_id"), F.col("text")
        number = k.cast("string")
        base = F.lit(AS_OF_SECONDS) - ((k * 37) % 14400) * 60
        outlet = F.concat(F.lit("outlet"), (k % 40).cast("string"), F.lit(".example.com"))
        url = (
            F.when(k % 31 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), number))
            .when(k % 31 == 1, F.concat(F.lit("https://www.fool.com/x/"), number))
            .when(k % 31 == 2, F.concat(F.lit("https://www.nature.com/articles/s41558-"), number))
            .when(k % 31 == 3, F.concat(F.lit("https://www.nytimes.com/a/"), number))
            .otherwise(F.concat(F.lit("https://www."), outlet, F.lit("/story/"), number))
        )
        title = F.trim(F.substring(text, 1, 60))
        status = F.when(k % 8 == 0, None).when(k % 8 <= 4, "success").when(k % 8 == 5, "error").when(k % 8 == 6, "blocked").otherwise("paywall")
        fetched = F.timestamp_seconds(base + k % 180)
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
        rows = self.raw("documents").select(
            k.alias("article_id"),
            (k % 13).alias("source_id"),
            title.alias("title"),
            url.alias("canonical_url"),
            F.when(k % 29 != 0, F.timestamp_seconds(base)).alias("published_at"),
            fetched.alias("fetched_at"),
            F.substring(text, F.lit(61), ((k % 3) * 80).cast("int")).alias("dek"),
            F.when(k % 5 == 0, None).when(k % 7 == 0, "").otherwise(F.concat(F.lit("Author "), (k % 20).cast("string"))).alias("author"),
            F.when(k % 6 == 0, None).when(k % 11 == 0, "").otherwise(F.concat(F.lit("Outlet "), (k % 40).cast("string"))).alias("publisher_name"),
            F.when(k % 2 == 0, None).when(k % 9 == 0, "").otherwise(F.concat(F.lit("https://www."), outlet)).alias("publisher_homepage"),
            status.alias("content_status"),
            F.when(status == "success", F.col("n_chars").cast("int") / 6).cast("int").alias("content_word_count"),
            text.alias("content_text"),
            F.when(status.isNotNull(), F.timestamp_seconds(base + 3600)).alias("content_fetched_at"),
            F.when((status == "success") & (k % 3 == 1), F.concat(F.lit("https://img.example.com/"), number, F.lit(".jpg"))).alias("content_image"),
            F.when(k % 11 != 0, F.col("lang")).alias("language_code"),
            F.when(k % 3 == 0, F.concat(F.lit("Re: "), title)).alias("rewritten_title"),
            F.when(k % 10 < 6, F.when(k % 10 < 3, "error").when(k % 10 < 5, "no_category").otherwise("done")).alias("categorise_status"),
            F.when(k % 10 < 6, (k % 5).cast("int")).alias("categorise_attempts"),
            F.when(k % 10 < 6, F.timestamp_seconds(base + (k % 4) * 1800)).alias("categorised_at"),
        )
        return rows.join(vectors, "article_id", "left")

    def article_clusters(self) -> DataFrame:
        rows = self.raw("embeddings").join(self.raw("documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        cluster = F.col("label") * 8 + F.col("vec_id") % 8
        own = rows.select(F.col("vec_id").alias("article_id"), cluster.cast("long").alias("cluster_id"))
        again = rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("article_id"), ((cluster + 1) % 80).cast("long").alias("cluster_id"))
        return own.unionByName(again)

    def categories(self) -> DataFrame:
        slugs = ["government", "justice", "business", "impacts", "tech", "research"]
        return self.spark.createDataFrame(list(enumerate(slugs)), "category_id long, slug string")

    def article_categories(self) -> DataFrame:
        k = F.col("doc_id")
        rows = self.raw("documents").where("doc_id % 4 <> 3").select(k.alias("article_id"), F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("n"))
        a = F.col("article_id")
        return rows.select(
            "article_id",
            ((a + F.col("n")) % 6).alias("category_id"),
            (F.lit(0.2) + ((a * 7 + F.col("n") * 3) % 17) / 20.0).alias("confidence"),
            (F.col("n") == 0).alias("is_primary"),
            F.when(a % 5 != 0, (a % 4) / 4.0).alias("rule_confidence"),
        )

    def article_events(self) -> DataFrame:
        n = self.raw("documents").count()
        return self.raw("events").select(
            (F.col("event_id") % n).alias("article_id"),
            F.col("event_type").alias("event"),
            F.col("user_id").cast("string").alias("session_id"),
            F.col("ts").alias("occurred_at"),
        )

    def discovery_searches(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("search_id"),
            F.concat(F.lit("run-"), F.floor(k / 7).cast("string")).alias("run_id"),
            F.element_at(F.array(F.lit("exa"), F.lit("openai_web_search"), F.lit("gn_site")), (k % 3 + 1).cast("int")).alias("provider"),
            F.when(k % 5 != 0, F.concat(F.lit("model-"), (k % 2).cast("string"))).alias("model"),
            F.concat(F.lit("segment-"), (k % 6).cast("string")).alias("segment"),
            (k % 4).cast("int").alias("tool_calls"),
            F.round(F.col("o_totalprice") / 1_000_000, 6).alias("cost_usd"),
            (k % 900 + 100).cast("long").alias("latency_ms"),
            F.when(k % 9 == 0, "error").otherwise("success").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    def discovery_candidates(self) -> DataFrame:
        k, line = F.col("l_orderkey"), F.col("l_linenumber")
        mark = (k * 3 + line) % 8
        reason = F.element_at(F.array(*[F.lit(x) for x in ("stale", "duplicate_url", "missing_date", "unreachable", "non_climate")]), (mark - 2).cast("int"))
        return self.raw("lineitem").select(
            k.alias("search_id"),
            line.cast("int").alias("rank"),
            F.element_at(F.array(F.lit("exa"), F.lit("openai_web_search"), F.lit("gn_site")), (k % 3 + 1).cast("int")).alias("provider"),
            F.concat(F.lit("host"), (F.col("l_partkey") % 60).cast("string"), F.lit(".example.com")).alias("host"),
            F.concat(F.lit("https://host"), (F.col("l_partkey") % 60).cast("string"), F.lit(".example.com/p/"), (F.col("l_suppkey") % 50).cast("string")).alias("url"),
            F.when(mark < 2, True).when(mark > 2, False).alias("accepted"),
            F.when(mark > 2, reason).alias("reason"),
            F.when(mark == 4, F.col("l_partkey")).alias("duplicate_article_id"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    def rewrite_attempts(self) -> DataFrame:
        k = F.col("l_orderkey")
        return self.raw("lineitem").select(
            (k % 500).alias("article_id"),
            F.col("l_linenumber").cast("int").alias("attempt_idx"),
            F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"),
            (F.col("l_returnflag") == "A").alias("accepted"),
            F.when(F.col("l_returnflag") == "R", F.when(k % 4 == 0, "llm_error").otherwise("length")).when(F.col("l_returnflag") == "N", "unchanged").alias("reason"),
            F.col("l_quantity").cast("long").alias("input_tokens"),
            (k % 50).alias("output_tokens"),
            (k % 4000).alias("latency_ms"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    def pipeline_runs(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("run_id"),
            F.element_at(F.array(F.lit("refresh"), F.lit("full"), F.lit("rewrite"), F.lit("cleanup")), (k % 4 + 1).cast("int")).alias("job_name"),
            F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400).alias("started_at"),
            (k % 60000).alias("duration_ms"),
            F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"),
        )
