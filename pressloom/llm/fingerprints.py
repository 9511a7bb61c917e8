"""Document fingerprints by consistent weighted sampling.

The terms of a text are its word pairs, weighted by how often they occur. For
each of ``samples`` and each term, gamma variates r, c and a uniform b, all
functions of the term, give the level t = floor(ln w / r + b), and the term of
the smallest a = c exp(-r (t - b)) / e^r is drawn with its level. Two texts draw
the same with probability equal to their generalised Jaccard similarity.

The variates of each sample and term come from hashes of 53 bits and more. At
weight 1 the level is 0 and a = c exp(-r (1 - b)) is exponential; it is drawn
first, as the hash itself, whose order is that of a. Terms of larger weight draw
two exponentials more, from which r, c and b follow with their exact joint
distribution and the same a at weight 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed
from pressloom.llm.words import SLICE_BYTES, constants, hash_words, mix, positions, shingles, text_buffers

_U = np.uint64
SAMPLES = 128
BLOCK_ROWS = 500
MOST_BLOCKS = 20_000


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as unsigned 32-bit numbers of the same order, in the upper half of 64 bits."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(_U) << _U(32)


def _exponential(x: np.ndarray) -> np.ndarray:
    """Exponential variates that grow with the 64-bit hashes ``x``."""
    return -np.log1p(-np.minimum((x.astype(np.float64) + 0.5) * 2.0**-64, 1 - 2.0**-53))


def _heavy_keys(x: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Order of ln a in the upper half and name of term and level in the lower, of terms whose weights have ``logs``."""
    one, rest, back = _exponential(x), _exponential(mix(x)), _exponential(mix(~x))
    c, forth = one + rest, np.log1p(rest / one)  # c and the uniform one / c are independent, and forth = r (1 - b)
    r = forth + back
    level = np.floor((logs + back) / r)
    name = x + level.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)
    return _ordered(np.log(c) + back - r * (level + 1)) | (name & _U(0xFFFFFFFF))


def signatures(column: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples of each text, and whether it has any term.

    A text of one word has that word as its term; a text without words has
    none and zeros. Weights are whole numbers, so equal texts sample alike.
    """
    words, counts = hash_words(*text_buffers(column))
    items, sizes = shingles(words, counts, 2)
    out = np.zeros((len(column), samples), np.uint16)
    full = sizes > 0
    if not full.any():
        return out, full
    owner, _ = positions(sizes)
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    fresh = np.ones(len(items), bool)
    fresh[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(items)))
    items, owner = items[first], owner[first]
    light, heavy = weight == 1, weight > 1
    single, several, logs = items[light], items[heavy], np.log(weight[heavy])
    factors, masks = constants(samples, 53), constants(samples, 59)

    def groups(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        return starts, owners[starts]

    (starts, alone), (heavy_starts, repeated) = groups(owner[light]), groups(owner[heavy])
    for k in range(samples):
        key = np.full(len(column), np.iinfo(_U).max, _U)
        if len(single):
            least = np.minimum.reduceat((single ^ masks[k]) * factors[k], starts)
            key[alone] = _ordered(np.log(_exponential(least))) | (least & _U(0xFFFFFFFF))
        if len(several):
            least = np.minimum.reduceat(_heavy_keys((several ^ masks[k]) * factors[k], logs), heavy_starts)
            key[repeated] = np.minimum(key[repeated], least)
        out[full, k] = mix(key[full] & _U(0xFFFFFFFF)) & _U(0xFFFF)
    return out, full


def likeness(a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Share of equal samples; 1 for two texts without terms, 0 if only one has none."""
    return np.where(has_a & has_b, (a == b).mean(1), (has_a == has_b).astype(np.float64))


def fingerprint(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, fingerprint`` of every row; null texts count as empty."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, _ = signatures(batch.column(1), samples)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in drawn])], names=["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(samples: int):
    """Fingerprints of sorted rows and of their edited texts; a row waits for the one after it.

    A row that stands for several equal ones gives another line, in which it follows itself.
    """

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, each with its successor in the list."""
        drawn, has = signatures(pa.array([r[3] for r in rows], pa.large_string()), samples)
        lines = []  # own row, the row after it, and how many rows this stands for
        for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
            if not a[1] and a[0] == b[0]:
                lines.append((i, i + 1, 1))
                if a[4] > 1:
                    lines.append((i, i, a[4] - 1))
        own, after = np.array([x[0] for x in lines], np.int64), np.array([x[1] for x in lines], np.int64)
        edited = []
        for i, j, _ in lines:
            text, following = rows[i][3], rows[j][3]
            k = len(text) // 3
            edited.append(text[: len(text) - k] + following[:k])
        changed, has_changed = signatures(pa.array(edited, pa.large_string()), samples)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], pa.int64()),
                pa.array([len(rows[i][3]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([drawn[i].tobytes().hex() for i in own], pa.string()),
                pa.array([x.tobytes().hex() for x in changed], pa.string()),
                pa.array(likeness(drawn[own], has[own], changed, has_changed), pa.float64()),
                pa.array(likeness(drawn[own], has[own], drawn[after], has[after]), pa.float64()),
                pa.array([x[2] for x in lines], pa.int64()),
            ],
            names=[*_OUT, "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, opening = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "extra", "doc_id", "text", "times")), strict=True):
                if opening is None or opening[0] != row[0]:
                    opening = row
                waiting.append(row)
                size += len(row[3])
                if size >= SLICE_BYTES and len(waiting) > 1:
                    yield work(waiting)
                    waiting, size = waiting[-1:], len(row[3])
        if waiting:
            if not waiting[-1][1]:  # no successor was sent: all rows are here, and the first follows the last
                waiting.append((waiting[-1][0], 1, None, opening[3], 1))
            yield work(waiting)

    return run


def _crowded(texts: DataFrame, most: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``texts`` with equal rows of crowded ids, those of more than ``most`` rows, drawn together; and hashes that cut these ids.

    Rows of crowded ids lie in the order of ``h``, a hash of their text; each of
    them is cut at the largest hashes of equal ranges. At most one id in
    ``most`` rows is crowded, so that all this is small.
    """
    n = F.ceil(F.col("count") / most)
    ids = checkpointed(texts.groupBy("key").count().where(F.col("count") > most).select("key", n.alias("parts")))
    plain = texts.withColumns({"h": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    if not ids.count():
        return plain, {}
    own = texts.join(F.broadcast(ids), "key").withColumn("h", F.xxhash64("text"))
    together = own.groupBy("key", "doc_id", "text", "h", "parts").agg(F.count("*").alias("times"))
    part = F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("parts"))
    cuts: dict[int, list[int]] = {}
    for r in own.groupBy("key", part.alias("part")).agg(F.max("h").alias("h")).select("key", "h").collect():
        cuts.setdefault(r["key"], []).append(r["h"])
    rest = plain.join(F.broadcast(ids.select("key")), "key", "left_anti")
    return rest.unionByName(together.select(*rest.columns)), {k: np.sort(np.array(v, np.int64)) for k, v in cuts.items()}


def fingerprint_edits(documents: DataFrame, samples: int = SAMPLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    A row's edited text ends in the next document's beginning, by descending id,
    null ids last; the first follows the last. Rows that share an id lie in the
    order of their texts, where they are very many in that of their texts'
    hashes; equal rows follow one another. Ids are integers. Blocks of
    neighbouring ids, whose borders are approximate quantiles of at most
    ``MOST_BLOCKS``, are sorted apart, and ids of more rows than a block are cut
    too; only the rows at the borders are sent twice. Null texts are empty.
    Empty in, empty out.
    """
    lowest = -(1 << 63)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    n = texts.count()
    blocks = max(1, min(MOST_BLOCKS, n // block_rows))
    texts, cuts = _crowded(texts, max(block_rows, n // MOST_BLOCKS))
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks + 1)])
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.percentile_approx("doc_id", shares, F.lit(10 * max(1000, blocks)))).first()[0]
    ids, hashes = [], []
    for border in np.unique(np.array([*(found or []), *cuts], np.int64)).tolist():
        own = cuts.get(border, np.zeros(1, np.int64))
        ids.append(np.full(len(own), border, np.int64))
        hashes.append(own)
    borders, tops = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *hashes])
    parts = max(1, len(borders))

    @F.pandas_udf("long")
    def routed(keys: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the block, plus 1 for the row at its border."""
        key, own = keys.to_numpy(), h.to_numpy()
        block, border = np.searchsorted(borders, key), np.isin(key, borders)
        for crowded in cuts:
            at = np.flatnonzero(key == crowded)
            if len(at):
                block[at] += np.searchsorted(cuts[crowded], own[at])
                border[at] = np.isin(own[at], cuts[crowded])
        return pd.Series(2 * block + border)

    block = F.floor(F.col("route") / 2)
    own = F.struct((block % parts).alias("block"), F.lit(0).alias("extra"))
    successor = F.struct(F.pmod(block + 1, F.lit(parts)).alias("block"), F.lit(1).alias("extra"))
    sent = texts.withColumn("route", routed("key", "h")).withColumn("to", F.explode(F.when(F.col("route") % 2 == 1, F.array(own, successor)).otherwise(F.array(own))))
    sent = sent.select("to.block", "to.extra", "doc_id", "text", "h", "times").repartition("block")
    sent = sent.sortWithinPartitions("block", "extra", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text").select("block", "extra", "doc_id", "text", "times")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = sent.mapInArrow(_compare(samples), kinds + ", times long")
    return done.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "time") if cuts else done.drop("times")
