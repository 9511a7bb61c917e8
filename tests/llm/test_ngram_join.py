import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pressloom.llm.components import connected_components
from pressloom.llm.ngram_join import ngram_jaccard_join, prefix_depth

SCHEMA = "doc_id long, text string, n_links string, rep_id int"


def shingle_set(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            common = len(s & t)
            if common and common >= threshold * (len(s) + len(t) - common):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (find(i), links[i]) for i in parent}


def answer(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(frame).collect()}


def test_depth_shortens_to_the_recall():
    assert prefix_depth(0.8, 16, 8, 0.999) == 4
    assert prefix_depth(0.95, 16, 8, 0.999) > 4
    assert prefix_depth(0.1, 2, 8, 0.999) == 1


def test_copies_near_copies_and_odd_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, "!!! ..."), (1003, "one"), (1004, "ONE!"), (1005, " ".join(word() for _ in range(20_000)))]
    rows.append((1006, rows[-1][1] + " more"))
    assert answer(spark, rows) == brute_force(rows)


def test_one_large_near_group_is_whole(spark):
    """More distinct near copies than a block holds: every pair counts."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(400):
        own = list(base)
        own[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = answer(spark, rows)
    assert got == dict.fromkeys(range(400), (0, 399))


def test_blocks_of_a_group_compare_every_pair_once(spark, monkeypatch):
    from pressloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", (7, 20))
    monkeypatch.setattr(ngram_join, "SET_BLOCK", (7, 20))
    monkeypatch.setattr(ngram_join, "SMALL_RUN", 4)
    rng = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range([5, 40, 90][g]):
            own = list(base)
            for _ in range(rng.choice([1, 2, 3])):
                own[rng.randrange(120)] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(own)))
    assert answer(spark, rows) == brute_force(rows)


def test_recall_just_above_the_threshold(spark):
    """Pairs of similarity 0.81 that share no other text: the prefixes must become short enough for nearly all."""
    rng = random.Random(12)
    rows = []
    for pair in range(300):
        own = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * pair, " ".join(own)))
        own[20], own[70] = "other", "words"
        rows.append((2 * pair + 1, " ".join(own)))
    true, got = brute_force(rows), answer(spark, rows)
    assert all(n == 1 for _, n in true.values())
    assert sum(n for _, n in got.values()) >= 0.99 * len(rows)


def lone_pairs(seeds):
    """Pairs of texts just above the threshold, by seed."""
    out = []
    for seed in seeds:
        rng = random.Random(seed)
        own = [f"s{seed}w{rng.randrange(10**6)}" for _ in range(94)]
        other = list(own)
        other[20], other[70] = "changed", "words"
        out.append((" ".join(own), " ".join(other)))
    return out


def labels_of(texts):
    from pressloom.llm.ngram_join import _signatures

    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "id"])
    return np.array([np.frombuffer(x, np.uint16).reshape(16, 8) for b in _signatures(5, 128)(iter([batch])) for x in b["label"].to_pylist()])


def test_lone_pairs_at_the_threshold_among_near_copies(spark):
    """Recall of the forest over 3,000 seeded pairs, and end to end the pairs that share no whole label."""
    pairs = lone_pairs(range(3000))
    assert all(0.8 <= len(a & b) / len(a | b) < 0.81 for a, b in [tuple(map(shingle_set, p)) for p in pairs[:20]])
    left, right = labels_of([a for a, _ in pairs]), labels_of([b for _, b in pairs])
    equal = left == right
    assert equal[:, :, :4].all(2).any(1).mean() >= 0.999
    hard = [pairs[k] for k in np.flatnonzero(~equal.all(2).any(1))]
    assert len(hard) >= 30
    rng = random.Random(1)
    copies = []
    for g in range(20):
        base = [f"c{g}w{rng.randrange(10**6)}" for _ in range(400)]
        copies += [" ".join(base), " ".join([*base[:-1], "end"])]
    for some in (hard[:1], hard[1:2], hard):
        rows = list(enumerate([*copies, *(t for p in some for t in p)]))
        got = answer(spark, rows)
        assert got == {i: (i - i % 2, 1) for i, _ in rows}


def test_few_jobs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(100)]
    rows += [(1000 + i, t + " more") for i, t in rows]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    got = answer(spark, rows)
    jobs = len(tracker.getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_force(rows)
    assert jobs <= 60, jobs


def test_nulls_repeats_and_empty(spark):
    text, other = "a b c d e f g h", "one text of several words under an id that another has"
    rows = [(None, text), (5, text), (5, text), (7, text), (7, other), (None, other), (None, "alone"), (None, "ALONE!"), (None, None), (5, "")]
    frame = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, row int, class_id string")
    got = ngram_jaccard_join(frame, carry=["row"]).collect()
    found = [(None, 5, 3), (5, 5, 3), (5, 5, 3), (7, 5, 3), (7, 7, 1), (None, 7, 1), (None, None, 1), (None, None, 1), (None, None, 0), (5, 5, 0)]
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(found, key=str)
    assert sorted([(r.doc_id, r.class_id) for r in got if r.kept], key=str) == sorted([(5, 5), (7, 7), (None, None), (None, None), (5, 5)], key=str)
    assert {r.row for r in got} == {3}
    assert ngram_jaccard_join(frame.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 17])
def test_components_of_a_path(spark, length):
    edges = spark.createDataFrame([(i, i + 1) for i in range(length)] + [(100, 100)], "u long, v long")
    assert sorted(tuple(r) for r in connected_components(edges).collect()) == [(i, 0) for i in range(1, length + 1)]
