"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a table of ``content_digest, tokenizer, n_tokens``, partitioned by
tokenizer version. Counting joins the documents' digests to it, encodes every
distinct text that misses once, and appends those counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed
from pressloom.llm.words import row_slices, text_buffers

CACHE_SCHEMA = "content_digest binary, n_tokens long, tokenizer string"
#: Part of every version: byte-level vocabularies see each byte, so null becoming empty is all that is normalised.
NORMALISATION = "null-to-empty/1"
_loaded: dict[str, object] = {}


def normalised(text: Column) -> Column:
    """The content that is digested and encoded."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(definition: str) -> str:
    """Digest of a tokenizer's definition, its library's version and the normalisation."""
    import tokenizers

    return hashlib.sha256("\n".join((NORMALISATION, tokenizers.__version__, definition)).encode()).hexdigest()


def _encode(definition, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = _loaded.get(version)
        if tokenizer is None:
            tokenizer = Tokenizer.from_str(definition.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[version] = tokenizer
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for low, high in row_slices(offsets):
                texts = batch.column(1).slice(low, high - low).to_pylist()
                counts = np.fromiter((len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(counts)], names=["content_digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Cached counts of one tokenizer version, a digest twice where an append was repeated; a missing cache is begun."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version).drop("tokenizer")


def count_tokens(documents: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row by its whole text.

    Special strings inside texts count as the library's default does; none are
    added, and nothing is truncated or padded. Null is empty. Copies share one
    entry: partial aggregates keep one text per digest before the shuffle, so a
    large group of copies is not gathered. A run that fails before its append
    has changed nothing; a repeated append is harmless. Empty in, empty out.
    """
    spark = documents.sparkSession
    definition = Path(tokenizer_path).read_text()
    version = tokenizer_version(definition)
    shared = spark.sparkContext.broadcast(definition)
    texts = documents.select("doc_id", normalised(F.col("text")).alias("text"))
    keyed = texts.withColumn("content_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    distinct = keyed.groupBy("content_digest").agg(F.any_value("text").alias("text"))
    missing = distinct.join(read_cache(spark, cache_path, version), "content_digest", "left_anti")
    counted = missing.select("content_digest", "text").mapInArrow(_encode(shared, version), "content_digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    facts = keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    known = read_cache(spark, cache_path, version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    # written apart from the join, so that a digest of very many documents can be split in it
    done = facts.join(checkpointed(known), "content_digest")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
