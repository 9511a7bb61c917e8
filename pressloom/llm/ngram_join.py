"""Near-duplicate join on word n-grams: MinHash LSH forest with exact verification.

1. Every text becomes shingles of five words and a signature of ``trees`` x
   ``max_depth`` minimum hashes; each tree's hashes are its label in a prefix
   trie. Texts of the same word sequence form one class.
2. Classes that share a node of a trie at the depth that the threshold needs for
   the target recall (`prefix_depth`) are sorted by their labels. Within the
   node the matched prefix begins with whole labels and is shortened: the
   classes of each run of equal prefixes are compared by their whole signatures,
   and likely pairs join their parts. A run whose classes are all of one part is
   closed, as its pairs can't join anything more; every other one is shortened
   until the target recall is reached, whatever was found elsewhere.
3. Within a component of likely pairs, blocks of classes meet block by block;
   exact Jaccard similarities of the shingle sets decide every pair. Tasks return
   sums and spanning edges, never pairs.

Nodes and components of any size are cut into blocks of bounded size, whose
pairs are dealt to the tasks in turn. A group of G distinct near copies takes
G * G comparisons, as each member's links are counted, and sends each member to
every block of its group: to 16 at most up to 16,384 classes, to G / 1024 beyond.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.components import connected_components
from pressloom.llm.storage import checkpointed, looked_up
from pressloom.llm.words import constants, hash_words, mix, row_slices, shingles, text_buffers

_U = np.uint64
#: Classes of a block, at least and at most, where signatures or shingle sets are compared; a group is cut into ``MODERATE_BLOCKS`` in between.
SIGNATURE_BLOCK, SET_BLOCK, MODERATE_BLOCKS = (512, 2048), (128, 1024), 16
BLOCK_SHINGLES = 1_000_000
SMALL_RUN = 48
LEVEL_BYTES = 2


def prefix_depth(similarity: float, trees: int, max_depth: int, target_recall: float) -> int:
    """Longest prefix at which a pair of ``similarity`` meets in one of ``trees`` with ``target_recall``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target_recall:
        depth -= 1
    return depth


def _signatures(width: int, size: int):
    """Word sequence hashes, number of shingles and label of each text; further columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, masks = constants(size, 31), constants(size, 37)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in row_slices(offsets):
                words, counts = hash_words(data, offsets[low : high + 1])
                items, sizes = shingles(words, counts, width)
                rows = high - low
                signature = np.zeros((rows, size), _U)
                sequence = np.zeros((rows, 2), _U)
                full = np.flatnonzero(sizes)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    for k in range(size):
                        signature[full, k] = np.minimum.reduceat((items ^ masks[k]) * factors[k], starts)
                    filled = counts[full]
                    word_starts = np.cumsum(filled) - filled
                    within = (np.arange(len(words)) - np.repeat(word_starts, filled)).astype(_U)
                    for k, seed in enumerate((101, 211)):
                        sequence[full, k] = np.add.reduceat(words * mix(within + _U(seed << 20)), word_starts)
                label = np.ascontiguousarray((mix(signature) & _U(0xFFFF)).astype(np.uint16))
                ends = np.arange(rows + 1, dtype=np.int32) * (size * LEVEL_BYTES)
                rest = batch.slice(low, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest.columns[1:],
                        pa.array(sequence[:, 0].view(np.int64)),
                        pa.array(sequence[:, 1].view(np.int64)),
                        pa.array(sizes),
                        pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(label)]),
                    ],
                    names=[*batch.schema.names[1:], "h1", "h2", "n_shingles", "label"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where their groups start and end, from rows sorted by ``keys``.

    Only one group at a time waits for its end.
    """
    waiting: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        fresh = np.ones(table.num_rows, bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (table[k].to_numpy() for k in keys)])
        return table.combine_chunks(), np.append(np.flatnonzero(fresh), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if all(waiting[0].column(k)[0].equals(batch.column(k)[batch.num_rows - 1]) for k in keys):
            continue  # still the same group
        table, bounds = cut(pa.Table.from_batches(waiting))
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        waiting = table.slice(bounds[-2]).to_batches()
    if waiting:
        yield cut(pa.Table.from_batches(waiting))


def _propagate(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that is reachable over the pairs."""
    while len(left):
        low = np.minimum(labels[left], labels[right])
        after = labels.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if (after == labels).all():
            break
        labels = after
    return labels


def _pairs_of_small(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in np.unique(sizes):
        if n < 2:
            continue
        i, j = np.triu_indices(int(n), 1)
        own = starts[sizes == n]
        step = max(1, 100_000 // len(i))
        for k in range(0, len(own), step):
            yield (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()


def _labels(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """One row of ``size`` hashes for each label."""
    chunks = [np.frombuffer(c.buffers()[2], np.uint16)[c.offset * size : (c.offset + len(c)) * size] for c in column.chunks if len(c)]
    return np.concatenate([np.zeros(0, np.uint16), *chunks]).reshape(-1, size)


def _united(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``labels``, each the smallest index of its part, after uniting the parts of the pairs."""
    return _propagate(labels, labels[left], labels[right])


def _likely(size: int, max_depth: int, least_depth: int, least: int):
    """Spanning edges of the classes that share a prefix of ``least_depth`` and whose signatures agree in ``least`` places."""
    depths = [*range(max_depth, least_depth, -2), least_depth]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["tree", "prefix", "low", "high"]):
            cid, tree = table["cid"].to_numpy(), table["tree"].to_numpy()
            sketch = _labels(table["label"], size)
            trie = np.take_along_axis(sketch, tree[:, None] * max_depth + np.arange(max_depth), 1)
            labels = np.arange(len(cid))

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return (sketch[i] == sketch[j]).sum(1) >= least  # noqa: B023

            for depth in depths:
                fresh = np.zeros(len(cid), bool)
                fresh[bounds[:-1]] = True
                fresh[1:] |= (trie[1:, :depth] != trie[:-1, :depth]).any(1)
                starts = np.flatnonzero(fresh)
                sizes = np.diff(np.append(starts, len(cid)))
                parted = np.maximum.reduceat(labels, starts) != np.minimum.reduceat(labels, starts)
                small = parted & (sizes <= SMALL_RUN)
                for i, j in _pairs_of_small(starts[small], sizes[small]):
                    apart = labels[i] != labels[j]
                    i, j = i[apart], j[apart]
                    hit = near(i, j)
                    labels = _united(labels, i[hit], j[hit])
                large = parted & (sizes > SMALL_RUN)
                for start, n in zip(starts[large], sizes[large], strict=True):
                    found = labels[start : start + n]
                    _, first, own = np.unique(found, return_index=True, return_inverse=True)
                    found = first[own]
                    at = np.flatnonzero(found[1:] != found[:-1])  # neighbours in the order of labels first
                    hit = near(start + at, start + at + 1)
                    found = _united(found, at[hit], at[hit] + 1)
                    while True:  # then members of different parts, one by one
                        before = found
                        for i in range(0, n, 64):
                            left, right = np.nonzero(found[i : i + 64, None] != found[None, :])
                            for k in range(0, len(left), 100_000):
                                a, b = left[k : k + 100_000] + i, right[k : k + 100_000]
                                hit = near(a + start, b + start)
                                found = _united(found, a[hit], b[hit])
                        if found is before or (found == before).all():
                            break
                    labels = _united(labels, start + np.arange(n), start + found)
            joined = np.flatnonzero(labels != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays([pa.array(cid[joined]), pa.array(cid[labels[joined]])], names=["u", "v"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for low, high in row_slices(offsets):
                words, counts = hash_words(data, offsets[low : high + 1])
                items, sizes = shingles(words, counts, width)
                owner = np.repeat(np.arange(high - low), sizes)
                order = np.lexsort((items, owner))
                items, owner = items[order], owner[order]
                keep = np.ones(len(items), bool)
                keep[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
                ends = np.append(0, np.cumsum(np.bincount(owner[keep], minlength=high - low))) * 8
                sets = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(items[keep]))])
                rest = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], sets.cast(pa.binary())], names=[*batch.schema.names[1:], "shingles"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections, from the shingles that two sets at least share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = rank[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, [low, low + step])
        table = np.zeros((len(sets), step), np.float32)
        table[owner[a:b], place[a:b] - low] = 1
        out += table @ table.T
    return out


def _exact(threshold: float):
    """Links per class and spanning edges of one pair of blocks.

    Blocks that meet another give only edges between their own parts, as a
    block's inner edges come from its meeting with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _groups(batches, ["component", "low", "high"]):
            cid, copies, block = (table[c].to_numpy() for c in ("cid", "copies", "block"))
            crossing = table["low"].to_numpy() != table["high"].to_numpy()
            sets = [np.frombuffer(x, _U) for x in table["shingles"].to_pylist()]
            label, links = np.arange(len(cid)), np.zeros(len(cid), np.int64)
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                if end - start < 2:
                    continue
                common = _intersections(sets[start:end])
                sizes = np.array([len(x) for x in sets[start:end]], np.float64)
                near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                np.fill_diagonal(near, False)
                own = block[start:end, None] == block[None, start:end]
                inner = _propagate(np.arange(end - start), *np.nonzero(np.triu(near & own)))
                if crossing[start]:
                    near &= ~own
                    i, j = np.nonzero(np.triu(near))
                    parts = np.unique(inner)
                    i, j = np.searchsorted(parts, inner[i]), np.searchsorted(parts, inner[j])
                    inner = np.arange(end - start)
                    inner[parts] = parts[_propagate(np.arange(len(parts)), i, j)]
                links[start:end] = near @ copies[start:end]
                label[start:end] = start + inner
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(cid[label]), pa.array(links)], names=["cid", "label", "links"])

    return run


def _parts(classes: Column, block: tuple[int, int]) -> Column:
    """Number of blocks of a group of so many classes."""
    size = F.least(F.greatest(F.ceil(classes / MODERATE_BLOCKS), F.lit(block[0])), F.lit(block[1]))
    return F.ceil(classes / size)


def _meeting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One copy of each row for every block that its own meets, with the blocks' pairs dealt to the tasks in turn."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high, parts = F.col("low"), F.col("high"), F.col("parts").cast("long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    pair = low * parts - F.floor(low * (low - 1) / 2) + high - low
    return rows.repartitionById(tasks, F.pmod(F.xxhash64(*keys) + pair, F.lit(tasks)).cast("int"))


def _trie_nodes(classes: DataFrame, trees: int, max_depth: int, depth: int) -> DataFrame:
    """``tree, prefix, low, high, cid, label`` of the classes that share a node at ``depth``, in the order of their labels."""
    width = LEVEL_BYTES * max_depth
    prefixes = F.array(*[F.xxhash64(F.substring("label", t * width + 1, LEVEL_BYTES * depth)) for t in range(trees)])
    nodes = classes.select("cid", F.posexplode(prefixes).alias("tree", "prefix"))
    shared = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    met = nodes.join(shared, ["tree", "prefix"]).withColumn("parts", _parts(F.col("n"), SIGNATURE_BLOCK)).join(classes.select("cid", "label"), "cid")
    met = _meeting(met, ["tree", "prefix"]).withColumn("trie", F.substring(F.col("label"), F.col("tree") * width + 1, F.lit(width)))
    return met.sortWithinPartitions("tree", "prefix", "low", "high", "trie", "cid").select("tree", "prefix", "low", "high", "cid", "label")


def _likely_edges(classes: DataFrame, threshold: float, trees: int, max_depth: int, target_recall: float) -> DataFrame:
    """``u, v``: spanning edges of the likely pairs, from the forest's prefixes, shortened until a pair at the threshold meets with the target recall."""
    size = trees * max_depth
    spread = (threshold * (1 - threshold) / size) ** 0.5
    least_depth = prefix_depth(threshold, trees, max_depth, target_recall)
    nodes = _trie_nodes(classes, trees, max_depth, least_depth)
    return nodes.mapInArrow(_likely(size, max_depth, least_depth, int(size * max(0.0, threshold - 5 * spread))), "u long, v long")


def ngram_jaccard_join(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    trees: int = 16,
    max_depth: int = 8,
    target_recall: float = 0.999,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Links of every document row: ``doc_id, class_id, n_links, kept`` and the columns in ``carry``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of ``threshold`` or more, equal texts included; ``class_id`` is
    the smallest id that links lead to, the own id without links. A pair right
    at the threshold is found with probability ``target_recall`` at least, one
    above more surely, independently of all other documents. ``kept`` marks
    exactly one row of each class: that of the smallest id, ties by the carried
    columns, which are integers as ids are. Null ids come last; a class of null
    ids alone has a null ``class_id``. Texts are null, empty or without words:
    no shingles, no links, a class of their own. Repeated rows and rows that
    share an id are rows like others. Texts of any length are read whole. An
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    ties = [f"c{i}" for i in range(len(carry))]
    texts = documents.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("long").alias(t) for c, t in zip(carry, ties, strict=True)])
    texts = texts.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "id", "text")})
    own = "id long, " + "".join(f"{t} long, " for t in ties) + "k1 long, k2 long"
    signed = texts.mapInArrow(_signatures(width, trees * max_depth), own + ", h1 long, h2 long, n_shingles long, label binary")
    signed = checkpointed(signed.withColumn("row", F.monotonically_increasing_id()))
    usable = signed.where("n_shingles > 0")
    first = F.struct(F.col("id").isNull().alias("nul"), "id", *ties, "row", "k1", "k2")
    classes = usable.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("label").alias("label"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))

    member = connected_components(_likely_edges(classes, threshold, trees, max_depth, target_recall), roots=True)
    member = checkpointed(member.join(classes.select(F.col("cid").alias("id"), "copies", "n_shingles", "first.k1", "first.k2"), "id").withColumnRenamed("id", "cid"))
    sizes = member.groupBy("component").agg(F.greatest(_parts(F.count("*"), SET_BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts")).where("parts > 1")
    member = looked_up(member, sizes, "component").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    once = [F.any_value(c).alias(c) for c in ("text", "cid", "component", "copies", "parts")]
    sets = texts.select("k1", "k2", "text").join(member, ["k1", "k2"]).groupBy("k1", "k2").agg(*once).select("text", "cid", "component", "copies", "parts")
    sets = sets.mapInArrow(_shingle_sets(width), "cid long, component long, copies long, parts long, shingles binary")
    keys = ["component", "low", "high"]
    exact = _meeting(sets, ["component"]).select(*keys, "block", "cid", "copies", "shingles").sortWithinPartitions(*keys, "cid")
    exact = checkpointed(exact.mapInArrow(_exact(threshold), "cid long, label long, links long"))

    linked = connected_components(exact.select(F.col("cid").alias("u"), F.col("label").alias("v")), roots=True).withColumnRenamed("id", "cid")
    heads = linked.join(classes.select("cid", "first"), "cid").groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select("cid", "head")
    links = exact.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = classes.select("cid", "h1", "h2", "copies", "first").join(links, "cid", "left").join(linked, "cid", "left")
    head = F.coalesce("head", "first")
    per_class = whole.select("h1", "h2", head["id"].alias("class_id"), head["row"].alias("head_row"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = [F.col("id").alias("doc_id"), "class_id", "n_links", (F.col("row") == F.col("head_row")).alias("kept"), *[F.col(t).alias(c) for c, t in zip(carry, ties, strict=True)]]
    rest = signed.where("n_shingles = 0").withColumns({"class_id": F.col("id"), "n_links": F.lit(0).cast("long"), "head_row": F.col("row")})
    return usable.select("id", *ties, "row", "h1", "h2").join(per_class, ["h1", "h2"]).select(*out).unionByName(rest.select(*out))
