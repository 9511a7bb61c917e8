"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs
with one word between. With ``beginning``, an option that is off, those of the
first bytes of its longer words are features too, by which inflected forms that
the labels lack are known. FTRL keeps a learning rate per coordinate; its L1 term
leaves few weights, at most ``2**bits``, so that the model is a small broadcast.
Shards of the labelled rows learn side by side and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.storage import LOOKUP_ROWS, checkpointed
from pressloom.llm.words import constants, hash_words, mix, positions, row_slices, text_buffers

_U = np.uint64
#: Labelled rows that are fitted at most, up to the spread of a hash; their ids are broadcast, about 1 MB.
MAX_TRAINING_ROWS = 40_000
SHARD_ROWS = 8_000
BITS = 20


def _features(data: np.ndarray, offsets: np.ndarray, bits: int, beginning: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows and the row of each."""
    words, counts = hash_words(data, offsets)
    owner, within = positions(counts)
    left = counts[owner] - within
    c = constants(6, 41)
    shift = _U(64 - bits)
    one = mix(words * c[0]) >> shift
    two = mix(words[:-1] * c[1] + words[1:] * c[2]) >> shift
    skip = mix(words[:-2] * c[3] + words[2:] * c[4]) >> shift
    has_two, has_skip = left[: len(two)] > 1, left[: len(skip)] > 2
    features, owners = [one, two[has_two], skip[has_skip]], [owner, owner[: len(two)][has_two], owner[: len(skip)][has_skip]]
    if beginning is not None:
        begun, _ = hash_words(data, offsets, beginning)
        longer = begun != words
        features.append(mix(begun[longer] * c[5]) >> shift)
        owners.append(owner[longer])
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


def _featurise(bits: int, beginning: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in row_slices(offsets):
                feature, owner = _features(data, offsets[low : high + 1], bits, beginning)
                both = np.unique((owner << bits) | feature)
                ends = np.append(0, np.cumsum(np.bincount(both >> bits, minlength=high - low))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[1:], lists], names=[*batch.schema.names[1:], "features"])

    return run


def _ftrl(bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, positive_weight: float):
    """Weights of one shard by FTRL-proximal; the last coordinate is the bias, which has no L1 term."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id"])
        size = 1 << bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        penalty = np.full(size + 1, l1)
        penalty[size] = 0.0
        examples = [(np.append(np.asarray(f, np.int32), np.int32(size)), float(y)) for f, y in zip(rows["features"], rows["label"], strict=True)]
        for _ in range(epochs):
            for at, y in examples:
                zi, ni, pi = z[at], n[at], penalty[at]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= pi, 0.0, -(zi - np.sign(zi) * pi) / ((beta + root) / alpha + l2))
                g = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (positive_weight if y else 1.0)
                z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
                n[at] = ni + g * g
        kept = np.flatnonzero(np.abs(z) > penalty)
        w = -(z[kept] - np.sign(z[kept]) * penalty[kept]) / ((beta + np.sqrt(n[kept])) / alpha + l2)
        return pd.DataFrame({"feature": kept, "weight": w, "examples": len(examples)})

    return run


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    shard_rows: int = SHARD_ROWS,
    bits: int = BITS,
    epochs: int = 12,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 40.0,
    l2: float = 0.01,
    positive_weight: float = 2.0,
    beginning: int | None = None,
) -> dict[int, float]:
    """Sparse weights from ``documents(doc_id, text)`` and ``labels(doc_id, label)``.

    Rows of a null id or label are left out. About ``max_rows`` labelled ids at
    most, those of the smallest hashes, are fitted, in shards of about ``shard_rows``;
    of rows that share an id, the text of the smallest hash stands for all, and of its
    labels the largest. Without any, the model is empty and every score is 0.5. Rows of label 1,
    which are rare, count ``positive_weight`` times. Memory for the result is bounded by ``2**bits`` weights.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 40))
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    n = known.count()
    chosen = known.withColumn("place", place).where(F.col("place") < int((1 << 40) * min(1.0, max_rows / max(1, n))))
    shards = max(1, -(-min(max_rows, n) // shard_rows))
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen) if max_rows <= LOOKUP_ROWS else chosen, "doc_id")
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = rows.groupBy("doc_id", "label", "place").agg(one).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(shards)))
    rows = rows.select("text", "doc_id", "label", "place", "shard").mapInArrow(_featurise(bits, beginning), "doc_id long, label int, place long, shard long, features array<int>")
    parts = rows.groupBy("shard").applyInPandas(_ftrl(bits, epochs, alpha, beta, l1, l2, positive_weight), "feature long, weight double, examples long")
    parts = checkpointed(parts)
    whole = parts.where(F.col("feature") == 1 << bits).agg(F.sum("examples")).first()[0] or 0
    merged = parts.groupBy("feature").agg((F.sum(F.col("weight") * F.col("examples")) / F.lit(float(max(1, whole)))).alias("weight"))
    return {r["feature"]: r["weight"] for r in merged.orderBy("feature").collect()}


def _scores(model, bits: int, beginning: int | None, text: int | None):
    """A last column with the scores; the texts are in column ``text``, or else in the first, which is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) + 1, np.float32)
        for k, w in model.value.items():
            table[k] = w
        for batch in batches:
            data, offsets = text_buffers(batch.column(text or 0))
            rest = batch if text is not None else batch.select(batch.schema.names[1:])
            for low, high in row_slices(offsets):
                feature, owner = _features(data, offsets[low : high + 1], bits, beginning)
                hit = table[feature] != 0
                both = np.unique((owner[hit] << bits) | feature[hit])
                margin = np.bincount(both >> bits, table[both & ((1 << bits) - 1)].astype(np.float64), minlength=high - low) + table[-1]
                score = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays([*rest.slice(low, high - low).columns, pa.array(score)], names=[*rest.schema.names, "score"])

    return run


def score_toxicity(documents: DataFrame, model: dict[int, float], bits: int = BITS, beginning: int | None = None) -> DataFrame:
    """``doc_id, score, predicted`` of every row by its whole text.

    Null, empty and wordless texts get the score of the bias alone. Rows of
    null ids and repeated rows are scored like others; other columns are
    ignored. An empty table gives an empty one.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("text", "doc_id").mapInArrow(_scores(shared, bits, beginning, None), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, model: dict[int, float], bits: int = BITS, beginning: int | None = None) -> DataFrame:
    """The rows whose score is below 0.5, with all their columns, whatever their names; rows pass through without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    places = [f"c{i}" for i in range(len(documents.columns))]
    kinds = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(places, documents.schema.fields, strict=True))
    scored = documents.toDF(*places).mapInArrow(_scores(shared, bits, beginning, documents.columns.index("text")), f"{kinds}, score double")
    return scored.where("score < 0.5").drop("score").toDF(*documents.columns)


def held_out(id_column: Column) -> Column:
    """Whether labels of this id are kept from learning."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def learned(documents: DataFrame, labels: DataFrame, label_col: str = "toxic") -> dict[int, float]:
    """The model of the labels that are not held out."""
    return fit_toxicity(documents, labels.select("doc_id", F.col(label_col).alias("label")).where(~held_out(F.col("doc_id"))))


def toxicity(documents: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted``: learn from labels that are not held out, score every row."""
    scored = score_toxicity(documents, learned(documents, labels, label_col))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
