"""Nearest neighbours, similar pairs and the stored index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import vectors as ops
from pressloom.operators.vectors import Cells, VectorIndex, cell_facts, fit_pivots, nearest, similar_pairs, unit, with_cells


def made(n, seed, width=16, groups=40, spread=0.35):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    rows = middles[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def best(askers, members, k):
    cos = np.round(askers @ members.T, ops.DIGITS)
    return np.argsort(-cos, axis=1, kind="stable")[:, :k]


def test_unit_vectors(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(unit(F.col("v"))).collect()
    assert [r[0] for r in got] == [[0.6, 0.8], [0.0, 0.0], None]


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_is_exact_and_ties_go_by_id(spark, monkeypatch, hot):
    monkeypatch.setattr(ops, "PART_ROWS", 50)
    monkeypatch.setattr(ops, "SHARE_ROWS", 20)
    members, askers = made(600, 1), made(150, 2)
    if hot:
        members[::3] = members[0]  # a third of the members are one and the same
    known = frame(spark, members)
    placed = with_cells(known, fit_pivots(known, 20))
    cells = Cells.of(fit_pivots(known, 20), cell_facts(placed))
    got = nearest(frame(spark, askers), placed, cells, 5).collect()
    want = best(askers, members, 5)
    assert {(r.id, r.place, r.member) for r in got} == {(i, j, int(m)) for i, row in enumerate(want) for j, m in enumerate(row)}
    few = nearest(frame(spark, askers), placed, cells, 5, probe=2).collect()
    assert len({(r.id, r.member) for r in few} & {(i, int(m)) for i, row in enumerate(want) for m in row}) >= 0.5 * want.size


def test_index_in_batches_equals_brute_force_and_prunes(spark, tmp_path):
    members, askers = made(900, 3), made(40, 4)
    index = VectorIndex.create(frame(spark, members[:500]), f"{tmp_path}/index", cells=30, batch="a")
    index.append(frame(spark, members[500:], 500), "b")
    index.append(frame(spark, members[500:], 500), "b")  # a repeated batch replaces itself
    assert index.rows().count() == 900 and index.cells().members.sum() == 900
    again = VectorIndex(spark, f"{tmp_path}/index")
    got = {(r.id, r.place, r.member) for r in again.nearest(frame(spark, askers), 7).collect()}
    want = best(askers, members, 7)
    assert got == {(i, j, int(m)) for i, row in enumerate(want) for j, m in enumerate(row)}
    for a in range(5):
        found = again.search(list(askers[a]), 10, least=0.2)
        assert [r.id for r in found.collect()] == [int(m) for m in best(askers[a : a + 1], members, 10)[0] if askers[a] @ members[m] > 0.2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    cells = again.cells()
    mask = cells.nearest_possible(askers[:1])[0] <= np.arccos(np.sort(askers[0] @ members.T)[-10])
    assert 0 < mask.sum() < 30  # most cells can't hold any of the nearest


def test_index_of_nothing_and_of_odd_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert VectorIndex.create(empty, f"{tmp_path}/none").pivots().size == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    index = VectorIndex.create(rows, f"{tmp_path}/odd")
    assert [r.id for r in index.search([1.0, 0.0], 5).collect()] == [1, 2, 5]
    got = index.nearest(spark.createDataFrame([(9, [1.0, 0.0]), (8, [1.0])], "id long, v array<double>"), 2).collect()
    assert {(r.id, r.member) for r in got} == {(9, 1), (9, 2)}


def test_pairs_of_five_thousand_by_cells(spark):
    """The exact way finds every pair; the nearest cells alone find 0.95 of the pairs and compare far fewer."""
    rows = made(5000, 5, width=24, groups=400, spread=0.25)
    table = frame(spark, rows).withColumn("n", (F.col("id") % 7 + 1).cast("long"))
    cos = np.round(rows @ rows.T, ops.DIGITS)
    n = np.arange(5000) % 7 + 1
    i, j = np.nonzero(np.triu((cos > 0.8) & (n[:, None] + n[None, :] <= 9), 1))
    order = np.lexsort((j, i, -cos[i, j]))
    want = list(zip(i[order].tolist(), j[order].tolist(), strict=True))
    take = lambda exact, probe, top: [(r.a, r.b) for r in similar_pairs(table, 0.8, 9, top, exact, probe).collect()]
    assert take(5000, 1, 300) == want[:300]
    found = take(0, 6, len(want) + 10)
    assert len(set(found) & set(want)) >= 0.95 * len(want) and set(found) <= set(want) and len(want) > 5000
    pivots = fit_pivots(table)
    placed = with_cells(table, pivots)
    sizes = Cells.of(pivots, cell_facts(placed)).members
    assert sizes.max() * 6 < 0.25 * 5000  # what a vector meets in six cells
    assert similar_pairs(table.limit(0), 0.8, 9, 5, 10, 2).count() == 0


def test_similarities_are_not_rounded_twice(spark, tmp_path):
    """One just below half a millionth stays there: to 12 digits first it would go up."""
    low = 0.18935249999979822
    table = spark.createDataFrame([(1, [low, (1 - low * low) ** 0.5]), (2, [-1.0, 0.0])], "id long, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "id long, v array<double>")
    index = VectorIndex.create(table, f"{tmp_path}/index")
    found = index.nearest(asked, 1).select(F.round("similarity", 6)).first()[0]
    searched = index.search([1.0, 0.0], 1).select(F.round("similarity", 6)).first()[0]
    both = table.unionByName(asked).withColumn("n", F.lit(1).cast("long"))
    paired = similar_pairs(both, 0.1, 9, 1, 100, 1).select(F.round("similarity", 6)).first()[0]
    assert found == searched == paired == 0.189352
