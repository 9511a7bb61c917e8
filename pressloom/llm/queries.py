"""Driver queries of the training-data operators, over whole tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressloom.llm import decontamination, filter_audit, mixing, sharding, token_counts, token_files, url_filters, warc
from pressloom.llm.alignment import align_tokenizers
from pressloom.llm.fingerprints import fingerprint_edits
from pressloom.llm.ngram_join import ngram_jaccard_join
from pressloom.llm.pii import pseudonymise
from pressloom.llm.storage import new_folder
from pressloom.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=5, threshold=0.8).select("doc_id", "class_id", "n_links")


@query("op2_sharding", sharding.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query("op3_url_filters", url_filters.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(url_filters.page_captures(pages), url_filters.page_list(pages))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a cache that is new for each call, so that every distinct text is encoded once."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-cache"))


@query("op5_warc", warc.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "archive"))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op7_mixing", mixing.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic")


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in the session's ``spark.pseudonyms.key``; without one, and with a warning, under a key that is public, for trials only."""
    key = spark.conf.get("spark.pseudonyms.key", None)
    if not key:
        warnings.warn("spark.pseudonyms.key is not set: pseudonyms under a public key can be undone by anyone", stacklevel=2)
        key = "a public key for trials"
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key.encode())


@query("op10_decontamination", decontamination.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, share=20)


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-files"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_filter_audit", filter_audit.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
