"""Compressed tries of whole texts, dealt to tasks by ranges of adaptive prefixes.

A trie keeps each text once, cut into labelled edges at the bytes where texts
part, and at each text's terminal the smallest id it was inserted with. Texts
are range-partitioned, so that each task's trie covers an interval of texts:

1. The first ``HEAD`` bytes of all texts are counted by their bytes. A prefix
   whose texts are more than a task should hold is opened: its texts are told
   apart by the next two bytes after all that they have in common, and so on.
2. Consecutive children of an opened prefix are packed into ranges of about a
   task's share. A prefix that is too large and can't be opened further, as its
   texts agree in their whole heads, is one range of several parts, among which
   a hash of the whole text decides.
3. Each reading task inserts its texts into tries of bounded size and passes on
   their terminals, so that copies of one text leave it as one row; the tasks
   of the ranges insert these into the final tries.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

#: Bytes at the begin of a text by which ranges are cut.
HEAD = 64
#: Bytes of texts that one task of a range should hold, and the most ranges that are cut.
TASK_BYTES, MOST_RANGES = 64 << 20, 20_000
#: Bytes of texts in a trie of a reading task before it is emptied.
READ_BYTES = 16 << 20


def common_length(a: bytes, start: int, b: bytes) -> int:
    """Number of equal first bytes of ``a[start:]`` and ``b``."""
    low, high = 0, min(len(a) - start, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[start + low : start + middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """A place in a trie: children as (label, node) by first byte, and the value of a text that ends here."""

    __slots__ = ("children", "ends", "value")

    def __init__(self) -> None:
        self.children: dict[int, tuple[bytes, Node]] = {}
        self.ends, self.value = False, None


class RadixTrie:
    """Texts with the smallest of the values they were inserted with; ``None`` is larger than all others."""

    def __init__(self) -> None:
        self.root, self.n_bytes = Node(), 0

    def insert(self, text: bytes, value: int | None) -> None:
        node, at = self.root, 0
        while at < len(text):
            found = node.children.get(text[at])
            if found is None:
                leaf = Node()
                node.children[text[at]] = (text[at:], leaf)
                self.n_bytes += len(text) - at
                node = leaf
                break
            label, child = found
            if not text.startswith(label, at):
                same = common_length(text, at, label)
                middle = Node()
                middle.children[label[same]] = (label[same:], child)
                node.children[text[at]] = (label[:same], middle)
                label, child = label[:same], middle
            node, at = child, at + len(label)
        if not node.ends:
            node.ends, node.value = True, value
        elif value is not None and (node.value is None or value < node.value):
            node.value = value

    def terminals(self) -> Iterator[tuple[bytes, int | None]]:
        """Every text with its value, in no stated order."""
        waiting = [((), self.root)]
        while waiting:
            path, node = waiting.pop()
            if node.ends:
                labels = []
                up = path
                while up:
                    labels.append(up[1])
                    up = up[0]
                yield b"".join(reversed(labels)), node.value
            waiting += [((path, label), child) for label, child in node.children.values()]

    def values(self) -> Iterator[int | None]:
        """The value of every text."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node.ends:
                yield node.value
            waiting += [child for _, child in node.children.values()]


def prefix_ranges(texts: DataFrame, task_bytes: int = TASK_BYTES, most_ranges: int = MOST_RANGES) -> list[tuple[bytes, int]]:
    """Ranges of the binary column ``text``: the smallest prefix of each, ascending from the empty one, and its number of parts.

    All texts are counted. The list is bounded by ``most_ranges`` and the tasks
    that the session shuffles to, whatever the number of texts.
    """
    spark = texts.sparkSession
    heads = checkpointed(texts.groupBy(F.substring("text", 1, HEAD).alias("head")).agg(F.sum(F.octet_length("text") + F.lit(64)).alias("bytes")))
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most_ranges, -(-total // task_bytes)))
    limit = max(1, total // tasks)
    cuts: dict[bytes, int] = {b"": 1}
    open_rows = heads.select("head", "bytes", F.lit(b"").alias("node"))
    while True:
        # the next two bytes below each open prefix; a text that ends there is a child of its own
        child = F.substring(F.col("head"), F.octet_length("node") + 1, F.lit(2))
        children = open_rows.groupBy("node", child.alias("child")).agg(F.sum("bytes").alias("bytes"), F.min("head").alias("least"), F.max("head").alias("most"))
        running = F.sum("bytes").over(Window.partitionBy("node").orderBy("child").rowsBetween(Window.unboundedPreceding, -1))
        packed = children.withColumn("group", F.floor(F.coalesce(running, F.lit(0)) / limit)).groupBy("node", "group").agg(
            F.min("child").alias("child"), F.sort_array(F.collect_list(F.when(F.col("bytes") > limit, F.struct("child", "bytes", "least", "most")))).alias("large")
        )
        opened = []
        for row in packed.collect():
            cuts.setdefault(bytes(row["node"]) + bytes(row["child"]), 1)
            for x in row["large"]:
                start = bytes(row["node"]) + bytes(x["child"])
                least, most = bytes(x["least"]), bytes(x["most"])
                same = common_length(most, 0, least)
                if least == most:
                    cuts[start] = -(-x["bytes"] // limit)
                else:
                    opened.append((bytes(row["node"]), bytes(x["child"]), most[:same]))
                    cuts.setdefault(start, 1)
                # what follows a large child begins a range of its own
                cuts.setdefault(_after(start), 1)
        if not opened:
            return sorted(cuts.items())
        table = spark.createDataFrame(opened, "node binary, child binary, below binary")
        inner = open_rows.withColumn("child", child).join(F.broadcast(table), ["node", "child"])
        open_rows = checkpointed(inner.select("head", "bytes", F.col("below").alias("node")))


def _after(prefix: bytes) -> bytes:
    """The least string above all that begin with ``prefix``."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else b"\xff" * (HEAD + 1)


def _terminals(batches: Iterator[pa.RecordBatch], read_bytes: int) -> Iterator[tuple[list[bytes], list[int | None]]]:
    """Texts and least ids of tries of about ``read_bytes``."""
    trie = RadixTrie()
    for batch in batches:
        for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            trie.insert(text, value)
            if trie.n_bytes > read_bytes:
                yield tuple(map(list, zip(*trie.terminals(), strict=True)))
                trie = RadixTrie()
    found = list(trie.terminals())
    if found:
        yield tuple(map(list, zip(*found, strict=True)))


def _dealt(ranges: list[tuple[bytes, int]], read_bytes: int):
    """Distinct texts of a reading task's tries with their least id and the part of a range that they belong to."""
    starts, parts = [r[0] for r in ranges], [r[1] for r in ranges]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()

    def part(text: bytes) -> int:
        place = bisect_right(starts, text) - 1
        return first[place] + (crc32(text) % parts[place] if parts[place] > 1 else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids in _terminals(batches, read_bytes):
            for low in range(0, len(texts), 1000):
                own = texts[low : low + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(ids[low : low + 1000], pa.int64()), pa.array([part(t) for t in own], pa.int32())], names=["text", "id", "part"])

    return run


def hash_of(text: bytes) -> bytes:
    """A hash of all bytes, as ``unhex(md5(text))`` gives it."""
    return hashlib.md5(text, usedforsecurity=False).digest()


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id of every text of a part, and a hash of the text."""
    trie = RadixTrie()
    for batch in batches:
        for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            trie.insert(text, value)
    waiting: list[tuple[int | None, bytes]] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in waiting], pa.int64()), pa.array([x[1] for x in waiting], pa.binary())], names=["first_id", "text_hash"])

    for text, value in trie.terminals():
        waiting.append((value, hash_of(text)))
        if len(waiting) == 10_000:
            yield rows()
            waiting = []
    yield rows()


def least_ids(texts: DataFrame, task_bytes: int = TASK_BYTES, most_ranges: int = MOST_RANGES, read_bytes: int = READ_BYTES) -> DataFrame:
    """``first_id, text_hash``: for every distinct text of ``text`` (binary), ``id`` (long) the smallest id it has and its MD5 hash.

    A null id is larger than all others, so that only a text of null ids alone
    has a null ``first_id``. An empty table gives an empty one.
    """
    ranges = prefix_ranges(texts, task_bytes, most_ranges)
    dealt = texts.select("text", "id").mapInArrow(_dealt(ranges, read_bytes), "text binary, id long, part int")
    tasks = sum(n for _, n in ranges)
    return dealt.repartitionById(tasks, "part").mapInArrow(_least, "first_id long, text_hash binary")
