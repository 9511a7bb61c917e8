"""The streams over several batches against their batch forms and against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators.centroids import CentroidStore
from pressloom.operators.stories import cluster_centroids
from pressloom.streaming import jobs

DAY0 = dt.datetime(2024, 1, 1)
ARTICLES = "article_id long, embedding array<double>, fetched_at timestamp, language_code string"


def at(days):
    return DAY0 + dt.timedelta(days=days)


def through_stream(spark, tmp_path, batches, late="10 days", days=7):
    """The ids that stay when ``batches`` arrive one after the other, and at last a row that moves the watermark."""
    source = str(tmp_path / "in")
    last = max(r[2] for b in batches for r in b)
    for rows in [*batches, [(None, None, last + dt.timedelta(days=60))]]:
        spark.createDataFrame(rows, jobs.ARTICLES).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.recent_title_stream(spark.readStream.schema(jobs.ARTICLES).option("maxFilesPerTrigger", 1).parquet(source), days, late)
    jobs.start_append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return sorted(r[0] for r in spark.read.schema("article_id long").parquet(str(tmp_path / "out")).collect())


def in_batch(spark, batches, days=7):
    rows = [r for b in batches for r in b if r[1] is not None]
    return sorted(r[0] for r in jobs.recent_title_batch(spark.createDataFrame(rows, jobs.ARTICLES), days).collect())


def test_titles_at_days_0_8_13_16(spark, tmp_path):
    batches = [[(1, "T", at(0))], [(2, "t", at(8)), (9, "u", at(8))], [(3, "T", at(13))], [(4, "T", at(16))]]
    assert through_stream(spark, tmp_path, batches, late="1 hour") == in_batch(spark, batches) == [1, 2, 4, 9]


def test_any_order_within_the_watermark(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcdE"), at(rng.random() * 40)) for i in range(200)] + [(900 + i, None, at(i)) for i in range(3)] + [(950, "tie", at(3)), (951, "TIE", at(3))]
    rows.sort(key=lambda r: r[2])
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=rng.random() * 9))  # each at most nine days late
    batches = [order[i : i + 30] for i in range(0, len(order), 30)]
    assert through_stream(spark, tmp_path, batches) == in_batch(spark, batches)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    batches = [[(1, "T", at(10))], [(2, "u", at(30))], [(3, "T", at(1))]]
    assert through_stream(spark, tmp_path, batches, late="1 day") == [1, 2]


def corpus():
    rng = random.Random(5)
    middles = [np.array([rng.gauss(0, 1) for _ in range(6)]) for _ in range(7)]
    vectors = {i: middles[i % 7] + np.array([rng.gauss(0, 0.5) for _ in range(6)]) for i in range(140)}
    return vectors, {i: 500 + i % 5 for i in range(30)}


def frame(spark, vectors, none=()):
    return spark.createDataFrame([(i, None if i in none else [float(x) for x in v], at(i / 100), "de" if i % 17 == 3 else "en") for i, v in vectors.items()], ARTICLES)


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def assigned_by_hand(vectors, known, batches, similarity, most):
    known = dict(known)
    for batch in batches:
        fresh, groups = sorted(set(batch) - set(known)), {}
        for i, c in known.items():
            groups.setdefault(c, []).append(i)
        usable = {c: [vectors[i] for i in own if i % 17 != 3] for c, own in groups.items()}
        centres = {c: np.mean(v, 0) for c, v in usable.items() if v}
        wishes, found = {}, {}
        for i in fresh:
            near = sorted(centres, key=lambda c: (-round(cosine(vectors[i], centres[c]), 12), c))[:8]
            fit = [c for c in near if cosine(vectors[i], centres[c]) > similarity and len(groups[c]) < most]
            if fit:
                wishes.setdefault(fit[0], []).append((-cosine(vectors[i], centres[fit[0]]), i))
        for c, who in wishes.items():
            found |= {i: c for _, i in sorted(who)[: most - len(groups[c])]}
        known |= {i: found.get(i, -i - 1) for i in fresh}
    return known


def test_assignment_over_batches_with_a_repeated_one(spark, tmp_path):
    vectors, members = corpus()
    batches = [list(range(30, 70)), list(range(60, 110)), list(range(110, 140))]
    articles = frame(spark, vectors)
    job = jobs.AssignmentJob(spark, str(tmp_path / "job"), lambda: articles, F.lit(at(2)), similarity=0.7, most=14)
    job.begin(spark.createDataFrame(list(members.items()), "article_id long, cluster_id long"))
    arriving = lambda ids: spark.createDataFrame([(i, "t", at(1)) for i in ids], jobs.ARTICLES)
    seen = None
    for number, ids in enumerate(batches):
        job.run(arriving(ids), number)
        if number == 1:  # as after a failure before the stream's own commit
            seen = sorted((r.article_id, r.cluster_id) for r in job.members().collect())
            job.run(arriving(ids), number)
            assert sorted((r.article_id, r.cluster_id) for r in job.members().collect()) == seen
    want = assigned_by_hand(vectors, members, batches, 0.7, 14)
    got = {r.article_id: r.cluster_id for r in job.members().collect()}
    assert got == want and job.members().count() == len(want)
    assert any(c < 0 for c in want.values()) and any(c >= 500 for i, c in want.items() if i >= 30)
    again = jobs.AssignmentJob(spark, str(tmp_path / "job"), lambda: articles, F.lit(at(2)))
    stored = {r.cluster_id: r for r in again.store.centroids().collect()}
    whole = {r.cluster_id: r for r in cluster_centroids(again.members().select("article_id", "cluster_id"), articles).collect()}
    assert set(stored) == set(whole)
    for c, r in whole.items():
        assert (stored[c].member_count, stored[c].last_member_at) == (r.member_count, r.last_member_at)
        assert (r.centroid is None) == (stored[c].centroid is None) and (r.centroid is None or np.allclose(r.centroid, stored[c].centroid, rtol=0, atol=1e-9))
    assert {r[0] for r in again.store.touched(2).collect()} == {want[i] for i in batches[2]}


def test_assignment_as_a_stream(spark, tmp_path):
    vectors, members = corpus()
    batches = [list(range(30, 80)), list(range(80, 140))]
    for n, ids in enumerate(batches):
        spark.createDataFrame([(i, "t", at(1)) for i in ids], jobs.ARTICLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    articles = frame(spark, vectors)
    job = jobs.AssignmentJob(spark, str(tmp_path / "job"), lambda: articles, F.lit(at(2)), similarity=0.7, most=14)
    job.begin(spark.createDataFrame(list(members.items()), "article_id long, cluster_id long"))
    stream = spark.readStream.schema(jobs.ARTICLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start_assignment(stream, job, str(tmp_path / "state")).awaitTermination()
    want = assigned_by_hand(vectors, members, batches, 0.7, 14)
    assert {r.article_id: r.cluster_id for r in job.members().collect()} == want


@pytest.mark.parametrize("fold", [False, True])
def test_centroids_from_changes_equal_full_means(spark, tmp_path, fold):
    """After inserts, a merge, a move, retention and a repeated batch."""
    vectors, _ = corpus()
    articles = frame(spark, vectors, none={3, 40})
    store = CentroidStore(spark, str(tmp_path / "store"))
    table = lambda pairs: spark.createDataFrame(sorted(pairs), "article_id long, cluster_id long")
    now = {(i, i % 6) for i in range(100)}
    steps = [now]
    steps.append(steps[-1] | {(i, i % 6) for i in range(100, 140)})  # inserts
    steps.append({(i, 0 if c == 5 else c) for i, c in steps[-1]})  # a merge
    steps.append({(i, 2 if i == 7 else c) for i, c in steps[-1]})  # a move
    steps.append({(i, c) for i, c in steps[-1] if i >= 20 and c != 4})  # retention, and a cluster that goes
    before = set()
    for n, after in enumerate(steps):
        for _ in range(2 if n == 2 else 1):
            store.write(n, table(after - before), table(before - after), table(after), articles)
        before = after
    if fold:
        store.compact(3)
        assert {r[0] for r in store.changes().select("batch").distinct().collect()} == {3, 4}
    stored = {r.cluster_id: r for r in store.centroids().collect()}
    whole = {r.cluster_id: r for r in cluster_centroids(table(before), articles).collect()}
    assert set(stored) == set(whole) == {0, 1, 2, 3}
    for c, r in whole.items():
        assert (stored[c].member_count, stored[c].last_member_at) == (r.member_count, r.last_member_at)
        assert np.allclose(r.centroid, stored[c].centroid, rtol=0, atol=1e-9)


def test_title_stream_of_several_files_a_period(spark, monkeypatch):
    """Eight days may be any number of files; the result stays that of the batch form, and rows are written once."""
    from pressloom.plans import streaming
    from pressloom.plans.catalogue import QUERIES

    written, keep = [], streaming.kept
    monkeypatch.setattr(streaming, "FILE_ROWS", 150)
    monkeypatch.setattr(streaming, "kept", lambda rows: written.append(rows.columns) or keep(rows))
    got = [sorted(r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()) for name in ("stream_recent_dedupe", "recent_dedupe_batch")]
    assert got[0] == got[1] and written == [["article_id", "title", "fetched_at"]]


def test_titles_share_states(spark, tmp_path):
    """State and calls are those of the groups, not of the titles; large ids stay exact beside rows without any."""
    rng = random.Random(6)
    rows = [(2**60 + i, rng.choice("tT") + str(rng.randrange(150)), at(rng.random() * 30)) for i in range(400)] + [(None, None, at(d)) for d in range(30)]
    rows.sort(key=lambda r: r[2])
    batches = [rows[:200], rows[200:], [(None, None, at(100))]]
    for part in batches:
        spark.createDataFrame(part, jobs.ARTICLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(jobs.ARTICLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.start_append(jobs.recent_title_stream(arriving, 7, "1 day", groups=5), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = sorted(r[0] for r in spark.read.schema("article_id long").parquet(str(tmp_path / "out")).collect())
    assert got == in_batch(spark, batches) and len(got) > 150
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(sizes) <= 5 and sizes[-1] == 0
