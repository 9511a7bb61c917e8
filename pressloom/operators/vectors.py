"""Nearest neighbours and similar pairs of vectors over cells, and an inverted-file index that is stored.

Vectors are compared by cosine, as unit vectors. A bounded number of pivots
splits the space; a vector belongs to the cell of its nearest pivot, and a cell
knows how far its farthest member is from the pivot. Angles obey the triangle
inequality, so a cell whose distance less its radius is above what is looked for
holds nothing: searches are exact and skip such cells, or look into a stated
number of the nearest cells only (``probe``) and miss some.

Asking rows and members meet by cell in a shuffle. A cell of very many members
is cut into parts and one of very many askers into shares, by hash, so no task
holds a whole cell; every part returns its best rows only. Within a task, blocks
of vectors are multiplied by numpy.

Vectors of another length than the pivots', and null ones, are in no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators.storage import kept

#: Rows that pivots are fitted on at most, turns of fitting, most cells.
SAMPLE_ROWS, TURNS, MOST_CELLS = 20_000, 4, 4096
#: Members of a part and askers of a share of a cell, on average; askers that are multiplied at a time.
PART_ROWS, SHARE_ROWS, BLOCK = 20_000, 5_000, 256
#: Cosines are ordered by so many digits, as products differ in the last ones by the order of sums; those that are returned are not rounded.
DIGITS = 12


def unit(vector: Column) -> Column:
    """``vector`` as doubles of length 1; one of length 0 stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def fit_pivots(vectors: DataFrame, cells: int = 0, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit pivots by spherical k-means over a sample of about ``sample_rows`` rows of ``id, v``, chosen by hash.

    ``cells`` is 0 for the square root of the number of rows; ``MOST_CELLS`` at
    most. The sample decides how well cells fit, never what they may hold.
    """
    n, width = vectors.agg(F.count("*"), F.mode(F.size("v"), True)).first()
    if not n:
        return np.zeros((0, 0))
    some = vectors.where(F.size("v") == width).where(F.pmod(F.xxhash64("id"), F.lit(-(-n // sample_rows))) == 0)
    rows = np.array([r[0] for r in some.orderBy(F.xxhash64("id"), "id").select("v").limit(2 * sample_rows).collect()], float).reshape(-1, width)
    k = min(MOST_CELLS, cells or math.isqrt(n), max(1, len(rows)))
    pivots = rows[:k].copy() if len(rows) else np.zeros((1, width))
    for _ in range(TURNS if k > 1 else 0):
        own = np.argmax(rows @ pivots.T, 1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1)
        pivots = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], pivots)
    return pivots


def with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors(id, v, ...)`` with ``cell`` and the angle ``far`` to its pivot; others than of the pivots' length are left out."""
    width = pivots.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = matrix(batch["v"], width) @ shared.value.T
            cell = np.argmax(cos, 1).astype(np.int32)
            far = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    return vectors.where(F.size("v") == width).mapInArrow(run, f"{kinds}, cell int, far double")


@dataclass(frozen=True)
class Cells:
    """Pivots, and members and radius of each cell: a bounded table."""

    pivots: np.ndarray
    members: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(pivots: np.ndarray, facts: DataFrame) -> Cells:
        """From ``facts(cell, n, far)``, of which a cell may have several rows."""
        members, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for cell, n, far in facts.groupBy("cell").agg(F.sum("n"), F.max("far")).collect():
            members[cell], radius[cell] = n, far
        return Cells(pivots, members, radius)

    def nearest_possible(self, rows: np.ndarray) -> np.ndarray:
        """For each row and cell, the smallest angle at which a member can be."""
        angle = np.arccos(np.clip(rows @ self.pivots.T, -1, 1))
        return np.where(self.members > 0, angle - self.radius - 1e-7, np.inf)


def cell_facts(placed: DataFrame) -> DataFrame:
    """``cell, n, far``: members and radius of each cell of ``placed``."""
    return placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))


def _routed(askers: DataFrame, cells: Cells, choose) -> DataFrame:
    """``askers`` once for each ``cell`` that ``choose(cells, rows, batch)``, a table of rows and cells, marks; without ``least``."""
    shared = askers.sparkSession.sparkContext.broadcast(cells)
    names = [c for c in askers.columns if c != "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                row, cell = np.nonzero(choose(shared.value, matrix(part["v"], shared.value.pivots.shape[1]), part))
                found = part.select(names).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

    kinds = dict(askers.dtypes)
    return askers.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", cell int")


def _first_look(cells: Cells, rows: np.ndarray, members: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cells of each row until they hold ``members``, and those among the nearest ``probe``."""
    order = np.argsort(np.where(cells.members > 0, -(rows @ cells.pivots.T), np.inf), axis=1, kind="stable")
    held = np.cumsum(cells.members[order], 1) - cells.members[order]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    there = np.broadcast_to(cells.members > 0, place.shape)
    return there & np.take_along_axis(held < members, place, 1), there & (place < probe) if probe else there


def _met(askers: DataFrame, members: DataFrame, cells: Cells, function, schema: str) -> DataFrame:
    """``function(askers, members)`` over every share of a cell's askers and part of its members."""
    asked = {r[0]: r[1] for r in askers.groupBy("cell").count().collect()}  # a row per cell at most
    table = [(int(k), -(-n // SHARE_ROWS), max(1, -(-int(cells.members[k]) // PART_ROWS))) for k, n in asked.items()]
    cuts = F.broadcast(askers.sparkSession.createDataFrame(table, "cell int, shares int, parts int"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = askers.join(cuts, "cell").withColumn("share", own("shares")).withColumn("part", every("parts")).drop("shares", "parts")
    right = members.join(cuts, "cell").withColumn("part", own("parts")).withColumn("share", every("shares")).drop("shares", "parts")
    keys = ["cell", "share", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: function(a, b), schema)


def _best(k: int, width: int):
    """The ``k`` nearest members of each asker, equal ones by id."""
    schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("member", pa.int64()), ("s", pa.float64())])))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        members, ids = matrix(right["v"], width), right["id"].to_numpy()
        rows, asking, out = matrix(left["v"], width), left["id"].to_numpy(), []
        for low in range(0, len(rows), BLOCK):
            cos = rows[low : low + BLOCK] @ members.T
            best = np.argsort(-np.round(cos, DIGITS), axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(cos, best, 1).ravel()
            near = pa.StructArray.from_arrays([pa.array(-np.round(found, DIGITS)), pa.array(ids[best].ravel()), pa.array(found)], ["d", "member", "s"])
            ends = np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]
            out.append(pa.table([pa.array(asking[low : low + BLOCK]), pa.ListArray.from_arrays(pa.array(ends), near)], schema=schema))
        return pa.concat_tables(out)

    return run


#: Members that the cells of a first look hold together, at least.
FIRST_LOOK = 64


def nearest(askers: DataFrame, members: DataFrame, cells: Cells, k: int, probe: int = 0) -> DataFrame:
    """``id, place, member, similarity``: the ``k`` nearest of ``members(cell, id, v)`` for each of ``askers(id, v)``.

    First the nearest cells of each asker, until they hold enough members; then
    the others that may hold a nearer one than the worst found. Equal members go
    by id. Only cells that some asker needs are read, which prunes partitions
    of a stored index. With ``probe``, only so many cells are looked into. Ids of
    askers are unique; no members give no rows.
    """
    width = cells.pivots.shape[1]
    asked = kept(askers.where(F.size("v") == width).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))

    def looked(routed: DataFrame) -> DataFrame:
        routed = kept(routed)
        wanted = sorted(r[0] for r in routed.select("cell").distinct().collect())  # a row per cell at most
        own = members.where(F.col("cell").isin(wanted)).select("cell", F.col("id").cast("long").alias("id"), "v")
        return _met(routed, own, cells, _best(k, width), "id long, near array<struct<d: double, member: long, s: double>>")

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))

    enough = max(k, FIRST_LOOK)

    def begin(c: Cells, rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return np.logical_and(*_first_look(c, rows, enough, probe))

    def others(c: Cells, rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        seen, allowed = _first_look(c, rows, enough, probe)
        return ~seen & allowed & (c.nearest_possible(rows) <= np.arccos(np.clip(batch["least"].to_numpy(), -1, 1))[:, None])

    first = kept(merged(looked(_routed(asked, cells, begin))))
    least = F.when(F.size("near") >= k, -F.get("near", F.lit(k - 1))["d"]).otherwise(-1.0)
    rest = _routed(asked.join(first.select("id", least.alias("least")), "id"), cells, others)
    found = merged(first.unionByName(looked(rest)))
    return found.select("id", F.posexplode("near").alias("place", "n")).select("id", "place", "n.member", F.col("n.s").alias("similarity"))


def _pairs(similarity: float, most: int, top: int, width: int):
    """The ``top`` most similar pairs ``a < b`` above ``similarity`` and together of ``most`` weight."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("similarity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            (ids, n, v), (ids2, n2, v2) = ((t["id"].to_numpy(), t["n"].to_numpy(), matrix(t["v"], width)) for t in (left, right))
            for low in range(0, len(ids), BLOCK):
                own = slice(low, low + BLOCK)
                cos = v[own] @ v2.T
                i, j = np.nonzero((cos > similarity) & (ids[own, None] != ids2[None, :]) & (n[own, None] + n2[None, :] <= most))
                swap = ids[own][i] > ids2[j]
                found = [np.where(swap, ids2[j], ids[own][i]), np.where(swap, ids[own][i], ids2[j]), np.where(swap, n2[j], n[own][i]), np.where(swap, n[own][i], n2[j]), cos[i, j]]
                best = [np.concatenate(x) for x in zip(best, found, strict=True)]
                order = np.lexsort((best[1], best[0], -np.round(best[4], DIGITS)))
                best = [x[order] for x in best]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (best[0][1:] != best[0][:-1]) | (best[1][1:] != best[1][:-1])
                best = [x[fresh][:top] for x in best]
        return pa.table([pa.array(x) for x in best], schema=schema)

    return run


def similar_pairs(vectors: DataFrame, similarity: float, most: int, top: int, exact_rows: int, probe: int) -> DataFrame:
    """``a, b, n_a, n_b, similarity``: the ``top`` most similar pairs of ``vectors(id, v, n)``, ties by ids.

    Pairs are above ``similarity`` and of ``most`` weight ``n`` together at most.
    Up to ``exact_rows`` vectors, all of the cells that may hold a similar one
    are looked into, which finds every pair. Beyond, each vector looks into its
    ``probe`` nearest such cells, so work grows with the cells' sizes and not with the
    square of the vectors. Each part of a cell returns its ``top`` pairs only.
    """
    rows = kept(vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v", F.col("n").cast("long").alias("n")))
    pivots = fit_pivots(rows)
    if not pivots.size:
        return rows.sparkSession.createDataFrame([], "a long, b long, n_a long, n_b long, similarity double")
    placed = kept(with_cells(rows, pivots))
    cells = Cells.of(pivots, cell_facts(placed))
    within, few = float(np.arccos(min(1.0, max(-1.0, similarity)))), 0 if int(cells.members.sum()) <= exact_rows else probe

    def choose(c: Cells, own: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        return _first_look(c, own, 1, few)[1] & (c.nearest_possible(own) <= within)

    routed = kept(_routed(placed.select("id", "v", "n"), cells, choose))
    met = _met(routed, placed.select("cell", "id", "v", "n"), cells, _pairs(similarity, most, top, pivots.shape[1]), "a long, b long, n_a long, n_b long, similarity double")
    once = met.groupBy("a", "b", "n_a", "n_b").agg(F.max("similarity").alias("similarity"))  # found from both ends, in other orders of sums
    return once.orderBy(F.round("similarity", DIGITS).desc(), "a", "b").limit(top)


class VectorIndex:
    """An inverted-file index of vectors as tables below a path that all executors share.

    ``pivots`` is written once; ``rows`` is partitioned by cell and batch, ``facts``
    by batch. A batch that is appended again replaces itself, so a repeated
    write is harmless; an id is meant to be in one batch only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(vectors: DataFrame, path: str, cells: int = 0, batch: str = "0") -> VectorIndex:
        """Fit pivots to ``vectors(id, v)`` and write these as the first batch."""
        index = VectorIndex(vectors.sparkSession, path)
        pivots = fit_pivots(vectors.where("v is not null"), cells)
        table = [(k, [float(x) for x in row]) for k, row in enumerate(pivots)]
        index.spark.createDataFrame(table, "cell int, v array<double>").coalesce(1).write.parquet(f"{index.path}/pivots")
        if len(pivots):
            index.append(vectors, batch)
        return index

    @staticmethod
    def kept_up(vectors: DataFrame, path: str, there: bool) -> VectorIndex:
        """The index at ``path``, made from ``vectors(id, v)`` or with those appended whose ids it lacks."""
        index = VectorIndex(vectors.sparkSession, path)
        if not there or not len(index.pivots()):
            return VectorIndex.create(kept(vectors), path) if not there else index
        fresh = kept(vectors.join(index.rows().select("id"), "id", "left_anti"))
        if not fresh.isEmpty():
            index.append(fresh, str(index.rows().select("batch").distinct().count()))
        return index

    def pivots(self) -> np.ndarray:
        return np.array([r[0] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("cell").select("v").collect()], float)

    def append(self, vectors: DataFrame, batch: str) -> None:
        """Write ``vectors(id, v)`` into their cells under the name ``batch``; pivots stay."""
        placed = kept(with_cells(vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v"), self.pivots()))
        put = lambda rows, name, *keys: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.path}/{name}")
        put(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))), "rows", "cell", "batch")
        put(cell_facts(placed).coalesce(1), "facts", "batch")

    def rows(self) -> DataFrame:
        """``id, v, far, cell, batch``."""
        return self.spark.read.schema("id long, v array<double>, far double, cell int, batch string").parquet(f"{self.path}/rows")

    def cells(self) -> Cells:
        return Cells.of(self.pivots(), self.spark.read.schema("cell int, n long, far double, batch string").parquet(f"{self.path}/facts"))

    def nearest(self, askers: DataFrame, k: int, probe: int = 0) -> DataFrame:
        """`nearest` over the stored cells."""
        return nearest(askers, self.rows(), self.cells(), k, probe)

    def search(self, vector: list[float], limit: int, least: float = -1.0, probe: int = 0) -> DataFrame:
        """``id, similarity``: the ``limit`` nearest to one unit vector above ``least``, ties by id.

        Reads the nearest cells until they hold ``limit`` rows, then only the
        cells that may hold a nearer one than the worst of these.
        """
        cells, own = self.cells(), np.array(vector, float)[None, :]
        dot = F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, vector))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

        def read(mask: np.ndarray) -> DataFrame:
            some = self.rows().where(F.col("cell").isin([int(c) for c in np.flatnonzero(mask)]))
            return some.select("id", dot.alias("similarity")).where(F.col("similarity") > least)

        begin, allowed = (m[0] for m in _first_look(cells, own, limit, probe))
        possible = cells.nearest_possible(own)[0]
        begin = begin & allowed & (possible <= np.arccos(np.clip(least, -1, 1)))
        order = [F.round("similarity", DIGITS).desc(), "id"]
        first = kept(read(begin).orderBy(*order).limit(limit))
        n, worst = first.agg(F.count("*"), F.min("similarity")).first()
        bound = max(least, worst) if n >= limit else least
        rest = read(~begin & allowed & (possible <= np.arccos(np.clip(bound, -1, 1))))
        return first.unionByName(rest).orderBy(*order).limit(limit)
