"""Token ids of a corpus as compressed binary segments, and their reader.

Ids are counted over all documents, which gives one canonical Huffman code of
limited length. Documents lie in the order of their ids; each task codes a range
of them into segments of whole documents, in blocks that decode by themselves from
the bit offsets in the segment's head. The files of a path:

* ``code``: every id that occurs with the length of its code; lengths give codes,
* ``segments``: per segment its place (``part``, ``start`` in the part), the ids
  and sizes of its documents, and the coded bytes.

The binary segments are columns of Parquet files, so any store that Spark writes
to will do, and a task that is lost leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.huffman import LONGEST, Codebook, code_lengths
from pressloom.llm.pieces import SPLIT_BYTES, byte_level
from pressloom.llm.storage import new_folder
from pressloom.llm.words import row_slices, text_buffers

#: Ids of a segment, from which on it is closed.
SEGMENT_IDS = 1 << 19
_SEGMENT = "part int, start long, n_ids long, doc_ids array<long>, n_tokens array<long>, coded binary"
_encoders: dict[str, object] = {}


def _encode(definition, end_id: int, kind: np.dtype):
    """The ids of each text and the end id, as little-endian numbers of ``kind``; the first column passes.

    The last row of a task has no text, but ``counts``: how often each id is in the task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(definition.value) or _encoders.setdefault(definition.value, byte_level(definition.value, special=True))
        total = np.zeros(0, np.int64)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for low, high in row_slices(offsets, SPLIT_BYTES):
                rows = batch.slice(low, high - low)
                ids, counts = encode(rows.column(1))
                ends = np.cumsum(counts + 1)
                whole = np.full(ends[-1], end_id, kind)
                keep = np.ones(len(whole), bool)
                keep[ends - 1] = False
                whole[keep] = ids
                own = np.bincount(whole)
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
                binary = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.append(0, ends) * kind.itemsize), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([rows.column(0), binary.cast(pa.binary()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return run


def vocabulary_size(definition: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and how often they are, from dense counts of tasks."""
    for batch in batches:
        for counts in batch.column(0):
            total = np.frombuffer(counts.as_buffer(), np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


def _packed(book, segment_ids: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        codes = Codebook(*book.value)
        doc_ids, arrays, held = [], [], 0

        def closed() -> pa.RecordBatch:
            coded = codes.encode(np.concatenate(arrays))
            values = [[part], [start], [held], [doc_ids], [[len(a) for a in arrays]], [coded]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "start", "n_ids", "doc_ids", "n_tokens", "coded"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                arrays.append(np.frombuffer(ids.as_buffer(), kind).copy())
                held += len(arrays[-1])
                if held >= segment_ids:
                    yield closed()
                    start, doc_ids, arrays, held = start + held, [], [], 0
        if doc_ids:
            yield closed()

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, longest: int = LONGEST, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``doc_id, text`` and write the files below ``path``, which must be new.

    Every text is encoded whole by the library; null is empty, special strings
    inside texts are special tokens, none are added, and ``end_id`` ends each
    document. Documents lie in ascending order of their ids, null ids last, ties
    by a hash of their token ids; rows equal in both are interchangeable. More distinct ids than codes of ``longest``
    bits are refused. An empty table gives files without segments.
    """
    spark = documents.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    # ids wait for their code in two bytes each where the vocabulary allows it
    kind = np.dtype("<u2" if max(vocabulary_size(definition.value) - 1, end_id) < 1 << 16 else "<u4")
    plain = new_folder(spark, "token-ids")
    documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(definition, end_id, kind), "doc_id long, ids binary, counts binary").write.option("compression", "zstd").parquet(plain)
    written = spark.read.parquet(plain)
    ids = written.where("counts is null").select("doc_id", "ids")
    # as many numbers as the vocabulary has at most
    counted = written.where("counts is not null").select("counts").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    used, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64)
    lengths = code_lengths(counts, longest)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(used, lengths, strict=True)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    keyed = ids.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    book = spark.sparkContext.broadcast((used, lengths))
    ranged.mapInArrow(_packed(book, segment_ids, kind), _SEGMENT).write.parquet(f"{path}/segments")


def _segments(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """``doc_ids, n_tokens, coded`` and the global ``start`` of each segment, and the code's ids and lengths."""
    code = spark.read.parquet(f"{path}/code").orderBy("id").collect()
    book = spark.sparkContext.broadcast((np.array([r[0] for r in code], np.int64), np.array([r[1] for r in code], np.int64)))
    segments = spark.read.parquet(f"{path}/segments")
    before, starts = 0, []
    for part, n in sorted(map(tuple, segments.groupBy("part").agg(F.sum("n_ids")).collect())):  # one row for each task that wrote
        starts.append((part, before))
        before += n
    table = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    return segments.join(table, "part").select("doc_ids", "n_tokens", "coded", (F.col("before") + F.col("start")).alias("start")), book


def _documents(book, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(*book.value)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
                ids = codes.decode(batch.column(2)[row].as_buffer().to_pybytes()).astype("<u4")
                ends = np.cumsum(counts)
                if len(ids) != counts.sum():
                    raise ValueError("a segment holds other ids than its documents")
                if digest:
                    facts = pa.array([crc32(ids[a:b]) for a, b in zip(ends - counts, ends, strict=True)], pa.int64())
                else:
                    facts = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                start = pa.array(batch.column(3)[row].as_py() + ends - counts)
                yield pa.RecordBatch.from_arrays([doc_ids, start, pa.array(counts), facts], names=["doc_id", "start", "n_tokens", "facts"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document from the files: ``start`` ids lie before it."""
    segments, book = _segments(spark, path)
    return segments.mapInArrow(_documents(book, False), "doc_id long, start long, n_tokens long, facts array<int>").withColumnRenamed("facts", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As `read_tokens`, with the unsigned CRC-32 of the decoded ids, little-endian 32-bit numbers, as ``ids_crc32``."""
    segments, book = _segments(spark, path)
    return segments.mapInArrow(_documents(book, True), "doc_id long, start long, n_tokens long, facts long").withColumnRenamed("facts", "ids_crc32")


def token_round_trip(documents: DataFrame, tokenizer_path: str, path: str) -> DataFrame:
    """Write ``documents`` as token files below ``path`` and return what the files hold for each."""
    write_token_files(documents, tokenizer_path, path)
    return token_digests(documents.sparkSession, path)
