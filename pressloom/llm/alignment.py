"""Alignment of two tokenizers over a corpus, with the document counts of all linked pairs of ids.

Both tokenizers cut the bytes of a text; where both cut, a group ends, and
tokens of both whose bytes overlap are linked. Ids are kept after the first pass:

1. The distinct linked pairs of all documents are gathered and numbered by a
   minimal perfect hash, which is built bucket by bucket.
2. Every task counts the documents of each pair in a dense vector at the pairs'
   numbers, whose keys are verified; the vectors are summed along a tree.
3. The documents are aligned again and look their pairs' counts up in the summed vector.

More than ``MOST_SHARED`` distinct pairs are not broadcast: their counts are
summed and joined as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.perfect_hash import BUCKET_BITS, PerfectHash, bucket_hash, build
from pressloom.llm.pieces import BYTE_LEVEL_CUTS, SPLIT_BYTES, WordEncoder, byte_level
from pressloom.llm.storage import new_folder
from pressloom.llm.words import row_slices, text_buffers

#: Distinct pairs whose keys and counts are broadcast at most, some 70 MB.
MOST_SHARED = 4_000_000
#: Keys of a bucket on average, slots of a vector's piece, vectors that are added at a time, vectors for each core.
BUCKET_KEYS, PIECE, FAN_IN, VECTORS = 32_768, 65_536, 8, 4
#: Tokens that are aligned at a time, distinct pairs that a task holds, and words that an encoder remembers.
SLICE_TOKENS, HELD_PAIRS, KNOWN_WORDS = 1 << 20, 2_000_000, 150_000
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_pairs: dict[bytes, TokenizerPair] = {}


class TokenBytes:
    """The bytes that ids stand for."""

    def __init__(self, table: list[bytes]) -> None:
        self.flat, self.lengths = np.frombuffer(b"".join(table), np.uint8), np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many each has."""
        lengths = self.lengths[ids]
        at = np.repeat((self.starts[ids] - np.cumsum(lengths) + lengths).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], lengths


class TokenizerPair:
    """Byte-level tokenizer A and piece tokenizer B, and the bytes that their ids stand for."""

    def __init__(self, definition: str, model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        vocabulary = Tokenizer.from_str(definition).get_vocab()
        # byte-level entries write bytes that are no visible characters as characters from 256 on
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        self.bytes_b = []
        for i in range(pieces.vocab_size()):
            piece = pieces.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = TokenBytes(self.bytes_a), TokenBytes(self.bytes_b)
        self.length_a, self.length_b = self.bytes_a.lengths, self.bytes_b.lengths
        self.encode_a = byte_level(definition, special=False, leading=True, most=KNOWN_WORDS)
        # words are cut before punctuation where no piece reaches over such a place
        normal = pa.array([pieces.id_to_piece(i) for i in range(pieces.vocab_size()) if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i))])
        cuts = [c for c in BYTE_LEVEL_CUTS if not pc.any(pc.match_substring_regex(normal, c)).as_py() and len(pieces.encode("a")) == 1]
        self.encode_b = WordEncoder(lambda texts: pieces.encode(texts, num_threads=1), adds_space=True, leading=True, cuts=cuts, most=KNOWN_WORDS)
        self.sizes = len(self.length_a), len(self.length_b)
        names = [b"%c%d" % (mark, i) for mark, n in ((59, self.sizes[0]), (44, self.sizes[0]), (124, self.sizes[1]), (44, self.sizes[1])) for i in range(n)]
        self.names = np.array(names, object)


def _pair(definition, model) -> TokenizerPair:
    key = hashlib.sha256(definition.value.encode() + model.value).digest()
    return _pairs.get(key) or _pairs.setdefault(key, TokenizerPair(definition.value, model.value))


def _without(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], np.where(keep, counts, 0)


def _encode(definition, model):
    """Ids of both tokenizers for each text, as little-endian 32-bit numbers; none where their bytes aren't the text's."""

    def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.append(0, np.cumsum(counts)).astype(np.int32) * 4
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(definition, model)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for low, high in row_slices(offsets, SPLIT_BYTES // 4):
                texts = batch.column(1).slice(low, high - low)
                (a, n_a), (b, n_b) = pair.encode_a(texts), pair.encode_b(texts)
                raw = [b" " + (t or b"") for t in texts.cast(pa.binary()).to_pylist()]
                whole = b"".join(raw)
                keep = np.fromiter((len(x) > 1 for x in raw), bool, len(raw))
                for ids, counts, table in ((a, n_a, pair.bytes_a), (b, n_b, pair.bytes_b)):
                    given, sizes = table.of(ids)
                    at = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
                    if given.tobytes() != whole or (np.diff(at) != [len(x) for x in raw]).any():
                        keep &= [given[i:j].tobytes() == x for i, j, x in zip(at[:-1], at[1:], raw, strict=True)]
                a, b = packed(*_without(a, n_a, keep)), packed(*_without(b, n_b, keep))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), a, b], names=["doc_id", "a", "b"])

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of about ``SLICE_TOKENS`` tokens: their first and last row, ids of A and B, and the numbers of both per row."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in "ab"]
    offsets = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) // 4 for c in columns]
    data = [np.frombuffer(c.buffers()[2] or b"", "<u4") for c in columns]
    for low, high in row_slices(offsets[0] + offsets[1], SLICE_TOKENS):
        a, b = (d[o[low] : o[high]].astype(np.int64) for d, o in zip(data, offsets, strict=True))
        yield low, high, a, b, *(np.diff(o[low : high + 1]) for o in offsets)


class Alignment:
    """Links and groups of some documents in a row, whose tokens of A and B cover the same bytes."""

    def __init__(self, pair: TokenizerPair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        self.pair, self.a, self.b, self.n_a, self.n_b = pair, a, b, n_a, n_b
        self.ends_a, self.ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
        size = int(self.ends_a[-1]) if len(a) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[self.ends_a], in_b[self.ends_b] = True, True
        self.groups_to = np.cumsum(in_a & in_b)
        cuts = np.flatnonzero(in_a | in_b)
        doc_ends = np.append(0, self.ends_a)[np.cumsum(n_a)]
        self.n_groups = np.diff(np.append(0, self.groups_to[doc_ends]))
        self.link_ends = np.searchsorted(cuts, doc_ends, side="right")
        self.n_links = np.diff(np.append(0, self.link_ends))
        at_a, at_b = np.cumsum(in_a)[cuts - 1], np.cumsum(in_b)[cuts - 1]
        self.keys = a[at_a] * pair.sizes[1] + b[at_b]

    def distinct(self, values: np.ndarray, most: int) -> np.ndarray:
        """``values`` of the links below ``most``, once for each document."""
        owner = np.repeat(np.arange(len(self.n_links)), self.n_links)
        return np.unique(owner * most + values) % most if len(values) else values

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's links."""
        return np.diff(np.append(0, np.append(0, np.cumsum(values))[self.link_ends]))

    def group_hashes(self) -> list[str]:
        """SHA-256 of each document's groups as text, or nothing where it has no tokens."""
        of_a, of_b = self.groups_to[self.ends_a - 1], self.groups_to[self.ends_b - 1]
        n = int(self.groups_to[-1])
        per_a, per_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        first_a, first_b = np.diff(of_a, prepend=-1) > 0, np.diff(of_b, prepend=-1) > 0
        v_a, v_b = self.pair.sizes
        order[np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[of_a]] = self.a + np.where(first_a, 0, v_a)
        order[np.arange(len(self.b)) + np.cumsum(per_a)[of_b]] = self.b + 2 * v_a + np.where(first_b, 0, v_b)
        names, out, at = self.pair.names[order].tolist(), [], 0
        for end in np.cumsum(self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join(names[at:end])[1:]).hexdigest() if end > at else "")
            at = end
        return out


def _distinct_pairs(definition, model):
    """The distinct pairs of a task and the hash that chooses their bucket."""

    def rows(keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bucket_hash(keys))], names=["key", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(definition, model)
        held, waiting, n = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, *tokens in _slices(batch):
                waiting.append(np.unique(Alignment(pair, *tokens).keys))
                n += len(waiting[-1])
                if n > HELD_PAIRS:
                    held, waiting, n = np.unique(np.concatenate([held, *waiting])), [], 0
                    if len(held) > HELD_PAIRS:
                        yield rows(held)
                        held = np.zeros(0, np.int64)
        yield rows(np.unique(np.concatenate([held, *waiting])))

    return run


def _built(table: pa.Table) -> pa.Table:
    """The perfect hash of one bucket's keys."""
    sizes, words, keys = build(table["key"].to_numpy())
    return pa.table({"bucket": table["bucket"][:1], "sizes": [sizes.tobytes()], "words": [words.tobytes()], "keys": [keys.tobytes()]})


def _vectors(definition, model, shared):
    """Documents of each pair in a task, as pieces of a dense vector at the pairs' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, numbering = _pair(definition, model), shared.value
        counts = np.zeros(len(numbering), np.int64)
        for batch in batches:
            for _, _, *tokens in _slices(batch):
                links = Alignment(pair, *tokens)
                np.add.at(counts, links.distinct(numbering.numbers(links.keys), len(numbering)), 1)
        pieces = [(k, counts[k * PIECE : (k + 1) * PIECE].tobytes()) for k in range(-(-len(counts) // PIECE)) if counts[k * PIECE : (k + 1) * PIECE].any()]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([task] * len(pieces), pa.int32()), pa.array([v for _, v in pieces], pa.binary())], names=["piece", "node", "counts"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_buffer(), np.int64) for v in table["counts"]], 0, np.int64)
    return pa.table({"piece": table["piece"][:1], "node": table["node"][:1], "counts": [total.tobytes()]})


def _tree_sum(vectors: DataFrame, leaves: int) -> DataFrame:
    """One row per piece: its vectors added, ``FAN_IN`` at a time at every level of a tree over ``leaves`` tasks."""
    while True:
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).groupBy("piece", "node").applyInArrow(_added, "piece int, node int, counts binary")
        leaves = -(-leaves // FAN_IN)
        if leaves <= 1:
            return vectors.select("piece", "counts")


def _looked_up(definition, model, shared):
    """The result's rows from pairs' counts at their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, (numbering, counts, best) = _pair(definition, model), shared.value
        for batch in batches:
            for low, high, *tokens in _slices(batch):
                links = Alignment(pair, *tokens)
                at = numbering.numbers(links.keys)
                sums = [links.n_a, links.n_b, links.n_groups, links.n_links, links.totals(best[at].astype(np.int64)), links.totals(counts[at])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, sums), pa.array(links.group_hashes(), pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def _rows_of_pairs(definition, model):
    """Per row, its number and facts, and its distinct pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(definition, model)
        for batch in batches:
            for low, high, *tokens in _slices(batch):
                links = Alignment(pair, *tokens)
                most = pair.sizes[0] * pair.sizes[1]
                owner = np.repeat(np.arange(len(links.n_links)), links.n_links)
                found, times = np.unique(owner * most + links.keys, return_counts=True)
                ends = np.searchsorted(found // most, np.arange(high - low + 1)).astype(np.int32)
                keys, times = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found % most, times))
                facts = [pa.array(x) for x in (links.n_a, links.n_b, links.n_groups, links.n_links)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(3).slice(low, high - low), *facts, pa.array(links.group_hashes(), pa.string()), keys, times], names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return run


def _by_join(ids: DataFrame, definition, model, size_b: int) -> DataFrame:
    """The result from pairs as rows, for any number of distinct pairs."""
    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"
    path = new_folder(ids.sparkSession, "pairs")
    ids.select("doc_id", "a", "b", F.monotonically_increasing_id().alias("row")).mapInArrow(_rows_of_pairs(definition, model), schema).write.parquet(path)
    rows = ids.sparkSession.read.parquet(path)
    pairs = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("pair")).select("row", "pair.keys", "pair.times")
    counted = pairs.groupBy("keys").agg(F.count("*").alias("n")).withColumn("first", F.floor(F.col("keys") / size_b))
    counted = counted.join(counted.groupBy("first").agg(F.max("n").alias("most")), "first").select("keys", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    sums = pairs.join(counted, "keys").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    whole = rows.drop("keys", "times").join(sums, "row", "left")
    return whole.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in (f.split()[0] for f in RESULT.split(", "))])


def align_tokenizers(documents: DataFrame, byte_level_path: str, piece_path: str, most_shared: int = MOST_SHARED) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``documents``.

    A encodes a space and the text, B the text, to which it adds a space, both
    without special tokens. Texts that are null or empty, or that one of them
    does not give back byte by byte, have no tokens: zeros and an empty string.
    Rows that share an id, null ids and repeated rows are documents like others
    in the counts. Texts are read whole. Empty in, empty out; other columns play no part.
    """
    spark = documents.sparkSession
    definition, model = spark.sparkContext.broadcast(Path(byte_level_path).read_text()), spark.sparkContext.broadcast(Path(piece_path).read_bytes())
    path = new_folder(spark, "aligned-ids")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts.mapInArrow(_encode(definition, model), "doc_id long, a binary, b binary").write.option("compression", "zstd").parquet(path)
    ids = spark.read.parquet(path)
    pairs_path = new_folder(spark, "linked-pairs")
    ids.select("a", "b").mapInArrow(_distinct_pairs(definition, model), "key long, hash long").distinct().write.parquet(pairs_path)
    pairs = spark.read.parquet(pairs_path)
    n = pairs.count()
    if n > most_shared:
        return _by_join(ids, definition, model, _pair(definition, model).sizes[1])
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket = F.shiftright(F.col("hash") * buckets, BUCKET_BITS).cast("int").alias("bucket")
    built = pairs.select("key", bucket).groupBy("bucket").applyInArrow(_built, "bucket int, sizes binary, words binary, keys binary")
    found = {r["bucket"]: [np.frombuffer(r[c], np.int64 if c != "words" else np.uint64) for c in ("sizes", "words", "keys")] for r in built.collect()}  # n keys and some bits
    empty = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    numbering = PerfectHash(*zip(*[found.get(k, empty) for k in range(buckets)], strict=True))
    leaves = VECTORS * spark.sparkContext.defaultParallelism
    vectors = ids.select("a", "b").coalesce(leaves).mapInArrow(_vectors(definition, model, spark.sparkContext.broadcast(numbering)), "piece int, node int, counts binary")
    counts = np.zeros(n, np.int64)
    for piece, own in _tree_sum(vectors, leaves).collect():  # n numbers
        counts[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(own, np.int64)
    first = numbering.keys // _pair(definition, model).sizes[1]
    most = np.zeros(int(first.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, first, counts)
    shared = spark.sparkContext.broadcast((numbering, counts, counts == most[first]))
    return ids.mapInArrow(_looked_up(definition, model, shared), RESULT)
