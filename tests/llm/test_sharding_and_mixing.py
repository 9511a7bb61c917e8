import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pressloom.llm.mixing import SCHEDULES, demand_time, mix_documents, mix_sources, shuffle_key, training_order, word_count
from pressloom.llm.permutation import permuted
from pressloom.llm.sharding import shard_documents, shard_rows

DOCS = "doc_id long, text string, source string, shard string, _part int"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 1000])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, "k")).collect()]
    assert sorted(got) == list(range(n))


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = [(i, None if i == 3 else "é" * i, "s", "x", 1) for i in range(100)] + [(None, "", None, None, None), (7, "dup", "s", "x", 1), (7, "dup", "s", "x", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    got = shard_documents(frame).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 5} == {(11, zlib.crc32("ééééé".encode()))}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 3} == {(1, 0)}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shard_documents(frame.repartition(9)).collect()), key=str)
    whole = shard_rows(frame, 4)
    assert whole.columns == ["doc_id", "text", "source", "_part", "slot", "shard"] or whole.columns == ["doc_id", "text", "source", "_part", "shard", "slot"]
    assert whole.count() == 103 and whole.where("_part = 1").count() == 102
    assert shard_rows(frame.limit(0), 4).count() == 0


def test_mix_meets_the_targets(spark):
    rows = [(i, "w " * (1 + i % 37), ["a", "b", None, "c"][min(3, i % 9)], "x", 1) for i in range(900)] + [(1000, None, "a", "x", 1), (1001, "", "d", "x", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mix_documents(frame).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s, t in target.items():
        assert t <= 2 * size[s] + 1e-6 and abs(taken[s] - t) <= 37
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_documents(frame.repartition(5)).collect()), key=str)
    mixed = mix_sources(frame, word_count(F.col("text")), F.col("source"), shuffle_key("mix-1", F.col("doc_id"), F.col("text")))
    copies = training_order(mixed).collect()
    assert sum(len((r.row.text or "").split()) for r in copies) == sum(taken.values())
    assert all(0 <= r.position <= 1 for r in copies)
    assert mix_documents(frame.limit(0)).count() == 0


def test_mix_of_null_and_repeated_ids_and_clashing_columns(spark, monkeypatch):
    from pressloom.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rows = [(None, f"w{i} " * (i % 5), "a", 1.5, 2, 3, "p", "r") for i in range(200)] + [(7, "x y", "b", 1.5, 2, 3, "p", "r")] * 30
    rows += [(8, "long " * 50_000, "b", 1.5, 2, 3, "p", "r"), (9, None, None, 1.5, 2, 3, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size int, copies int, position string, row string")
    mixed = mix_sources(frame, word_count(F.col("text")), F.col("source"), shuffle_key("s", F.col("doc_id"), F.col("text"))).collect()
    assert len(mixed) == len(rows) and {r.row.target for r in mixed} == {1.5} and {r.row.copies for r in mixed} == {3}
    size, taken, target = Counter(), Counter(), {}
    for r in mixed:
        assert r.size == len((r.row.text or "").split()) and r.copies <= 2
        size[r.row.source] += r.size
        taken[r.row.source] += r.size * r.copies
        target[r.row.source] = r.target
    assert all(target[s] <= 2 * size[s] for s in size) and abs(taken["a"] - target["a"]) <= 4
    # a document that is most of its source is taken as often as its middle lies below the target
    assert taken["b"] <= 2 * size["b"] and abs(taken["b"] - target["b"]) <= 25_000
    again = mix_sources(frame.repartition(7), word_count(F.col("text")), F.col("source"), shuffle_key("s", F.col("doc_id"), F.col("text"))).collect()
    assert sorted((str(r.row), r.copies, str(r.positions)) for r in again) == sorted((str(r.row), r.copies, str(r.positions)) for r in mixed)


@pytest.mark.parametrize("knots", SCHEDULES)
def test_demand_is_inverted(spark, knots):
    shares = [i / 20 for i in range(21)]
    frame = spark.createDataFrame([(x,) for x in shares], "x double")
    times = [r[0] for r in frame.select(demand_time(F.col("x"), knots)).collect()]

    def drawn(t, steps=4000):
        total = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            for i in range(steps):
                m = t0 + (i + 0.5) / steps * (t1 - t0)
                if m < t:
                    total += (a + (b - a) * (m - t0) / (t1 - t0)) * (t1 - t0) / steps
        return total

    whole = drawn(2.0)
    assert all(abs(drawn(t) / whole - x) < 2e-3 for x, t in zip(shares, times))
