"""Corpus pipeline: documents to a clean, de-duplicated, mixed and sharded training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.decontamination import decontaminate
from pressloom.llm.mixing import mix_sources, shuffle_key, training_order, word_count
from pressloom.llm.ngram_join import ngram_jaccard_join
from pressloom.llm.sharding import shard_rows
from pressloom.llm.storage import checkpointed, looked_up, new_folder
from pressloom.llm.toxicity import learned, without_toxic

SHARDS = 16


def _hashes(*columns) -> list:
    """Two 64-bit hashes of columns, as ``_h1, _h2``."""
    return [F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *columns).alias("_h2")]


def _marked(docs: DataFrame, hashes: list, marks: DataFrame) -> DataFrame:
    """``doc`` structs with their hashes and the ``mark`` that ``marks`` has for these, or null."""
    key = F.struct("_h1", "_h2").alias("_key")
    return looked_up(docs.select(F.struct("*").alias("doc"), F.struct(*hashes).alias("_key")), marks.select(key, "mark"), "_key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not score 0.5 or more.

    Every row is judged by its own whole text: rows that share an id, null ids
    and repeated rows are told apart, null and empty texts have the score of the
    bias alone, a score of exactly 0.5 goes. All columns pass, whatever their
    names. An empty table gives an empty one.
    """
    return without_toxic(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, null ids last, ties by a hash of the row.

    Rows that share an id or have none are told apart by hashes of all their
    columns but maps; of rows equal in all one stays. Null, empty and wordless
    texts are no copies of each other, so all of them stay, but for repeated
    rows. All columns pass, whatever their names. Empty in, empty out.
    """
    hashes = _hashes(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.col("doc_id"), F.col("text"), *hashes)
    same = ngram_jaccard_join(rows, carry=["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    # rows to drop are marked 0, rows of which one of several equal ones stays 1
    marks = checkpointed(same.where("not kept or n > 1").select("_h1", "_h2", F.col("kept").cast("int").alias("mark")))
    found = _marked(docs, hashes, marks)
    kept = found.where("mark is null").select("doc.*")
    if not marks.where("mark = 1").count():
        return kept
    return kept.unionByName(found.where("mark = 1").groupBy("_key").agg(F.any_value("doc").alias("doc")).select("doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no notable share of benchmark passages.

    Rows are judged by their whole texts, equal texts alike; ids play no part,
    so repeated and null ids are harmless. Null and empty texts stay. All
    columns pass, whatever their names. Empty in, empty out.
    """
    keyed = docs.select(F.struct(*_hashes("text")).alias("doc_id"), "text")
    judged = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marks = judged.where("contaminated").select("doc_id._h1", "doc_id._h2", F.lit(0).alias("mark")).distinct()
    return _marked(docs, _hashes("text"), marks).where("mark is null").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, in training order.

    Null is a source like others. Rows that share an id or have none lie in the
    order of their texts' hashes; equal rows are interchangeable. Null and empty
    texts have size 0 and are taken where they lie below the target. All
    columns pass, whatever their names. Empty in, empty out.
    """
    text = F.col("text")
    return training_order(mix_sources(docs, word_count(text), F.col("source"), shuffle_key("mix-1", F.col("doc_id"), text))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ``shard`` and ``slot``, which replace columns of these names.

    Rows are numbered by id, null first, then by a hash of all columns; repeated
    rows get numbers of their own. Empty in, empty out.
    """
    return shard_rows(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: The toxicity model and the signature forest are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
