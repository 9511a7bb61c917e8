"""Centroids of clusters that are kept up to date from changes of memberships.

A table of changes holds, per batch and touched cluster, how many members and
vectors came or went and the sum of their vectors; the latest fetch of a touched
cluster is read anew from its remaining members. Sums over the batches give all
centroids without reading members again. A batch that is written again replaces
itself, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import scores
from pressloom.operators.storage import kept

CHANGES = "cluster_id long, members long, vectors long, sums array<double>, last_member_at timestamp, batch long"


def _sums(column: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


class CentroidStore:
    """Changes below ``path``, which all executors share; batches are numbered in order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], CHANGES).write.mode("append").partitionBy("batch").parquet(self.path)

    def changes(self, before: int | None = None) -> DataFrame:
        """All changes, or those of batches below ``before``."""
        rows = self.spark.read.schema(CHANGES).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, batch: int, added: DataFrame, removed: DataFrame, members: DataFrame, articles: DataFrame) -> None:
        """Record that ``added`` and ``removed``, rows of ``article_id, cluster_id``, led to ``members``.

        A move is a removal and an addition. ``articles(article_id, embedding,
        fetched_at, language_code)`` must hold all that came, went or stayed in touched clusters.
        Null vectors and those in other languages count as members only.
        """
        facts = articles.select("article_id", "embedding", "fetched_at", "language_code")
        signed = added.select("article_id", "cluster_id", F.lit(1).alias("sign")).unionByName(removed.select("article_id", "cluster_id", F.lit(-1).alias("sign")))
        # a pair that goes and comes back is no change
        signed = signed.groupBy("article_id", "cluster_id").agg(F.sum("sign").alias("sign")).where("sign <> 0").join(facts, "article_id")
        usable = F.col("embedding").isNotNull() & scores.visible_language(F.col("language_code"))
        signed = kept(signed.select("cluster_id", "sign", F.when(usable, F.transform("embedding", lambda x: x.cast("double") * F.col("sign"))).alias("v")))
        counts = signed.groupBy("cluster_id").agg(F.sum("sign").alias("members"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("sign"))), F.lit(0)).alias("vectors"))
        sums = signed.where("v is not null").groupBy("cluster_id").agg(_sums("v").alias("sums"))
        newest = members.join(counts.select("cluster_id"), "cluster_id", "left_semi").join(facts, "article_id").groupBy("cluster_id").agg(F.max("fetched_at").alias("last_member_at"))
        rows = counts.join(sums, "cluster_id", "left").join(newest, "cluster_id", "left")
        rows.select("cluster_id", F.col("members").cast("long"), F.col("vectors").cast("long"), "sums", "last_member_at", F.lit(batch).cast("long").alias("batch")).coalesce(1 if batch else 8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def centroids(self, before: int | None = None) -> DataFrame:
        """``cluster_id, member_count, last_member_at, centroid`` of all clusters with members, from batches below ``before``."""
        rows = self.changes(before)
        counts = rows.groupBy("cluster_id").agg(F.sum("members").alias("member_count"), F.sum("vectors").alias("vectors"), F.max_by("last_member_at", F.col("batch")).alias("last_member_at"))
        sums = rows.where("sums is not null").groupBy("cluster_id").agg(_sums("sums").alias("sums"))
        whole = counts.where("member_count > 0").join(sums, "cluster_id", "left")
        centroid = F.when(F.col("vectors") > 0, F.transform("sums", lambda x: x / F.col("vectors")))
        return whole.select("cluster_id", "member_count", "last_member_at", centroid.alias("centroid"))

    def touched(self, since: int) -> DataFrame:
        """Clusters that changed in batches from ``since`` on."""
        return self.changes().where(F.col("batch") >= since).select("cluster_id").distinct()

    def compact(self, batch: int) -> None:
        """Fold all batches up to ``batch`` into that one; later ones stay. Must not run beside writers or readers."""
        rows = self.changes(batch + 1)
        counts = rows.groupBy("cluster_id").agg(F.sum("members").alias("members"), F.sum("vectors").alias("vectors"), F.max_by("last_member_at", F.col("batch")).alias("last_member_at"))
        sums = rows.where("sums is not null").groupBy("cluster_id").agg(_sums("sums").alias("sums"))
        folded = kept(counts.join(sums, "cluster_id", "left").select("cluster_id", "members", "vectors", "sums", "last_member_at"))
        later = kept(self.changes().where(F.col("batch") > batch))
        whole = folded.withColumn("batch", F.lit(batch).cast("long")).unionByName(later)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(self.path)
