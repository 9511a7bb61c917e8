"""Gates, attribution, merges and logs by examples."""

import datetime

import pytest
from pyspark.sql import functions as F

from pressloom.operators import gates, logs, stories
from pressloom.streaming import jobs

NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)
TIERS = {"strong": "(?i)climate"}
CANDIDATES = "run_id long, place long, candidate_id long, title string, url string, snippet string, published_at timestamp, language_code string, domain string, reachable boolean, stored boolean"
ARTICLES = "article_id long, canonical_url string, title string, fetched_at timestamp"


def hours(n):
    return NOW - datetime.timedelta(hours=n)


def candidate(k, run=1, title=None, url=None, snippet="climate", at=1, lang="en", domain=None, reachable=True, stored=True):
    title = f"A headline of proper length, number {k}" if title is None else title
    return (run, k, k, title, url or f"https://a.example.com/s/{k}", snippet, hours(at) if at is not None else None, lang, domain, reachable, stored)


def test_every_outcome_of_the_discovery_gate(spark):
    known = [(900, "https://a.example.com/s/old", "Something else entirely, long enough", hours(100)), (901, "https://x/1", "A title of the last two days, stored", hours(10))]
    rows = [
        (candidate(0), "inserted"),
        (candidate(1, title="Short"), "invalid_title"),
        (candidate(2, snippet="sports"), "non_climate"),
        (candidate(3, lang="de"), "non_english"),
        (candidate(4, url="https://a.example.com/s/old?utm_source=x"), "duplicate_url"),
        (candidate(5, title="  A TITLE of the last two days, stored "), "duplicate_title"),
        (candidate(6, url="https://A.example.com/s/0"), "duplicate_candidate"),
        (candidate(7, at=None), "missing_date"),
        (candidate(8, at=100), "stale"),
        (candidate(9, at=-5), "invalid_date"),
        (candidate(10, url="https://a.example.com/x-00000"), "fabricated_url"),
        (candidate(11, url="https://news.google.com/rss/articles/1"), "aggregator_url"),
        (candidate(12, url="https://www.fool.com/x"), "low_value_host"),
        (candidate(13, url="https://news.google.com/rss/articles/2", domain="a.example.com"), "unresolved_aggregator"),
        (candidate(14, url="https://b.other.com/x", domain="a.example.com"), "out_of_domain"),
        (candidate(15, reachable=False), "unreachable"),
        (candidate(16, stored=False), "insert_failed"),
        (candidate(17, snippet="sports", url="https://sub.trusted.org/x"), "inserted"),
        (candidate(18, url="https://m.a.example.com/z", title="A headline of proper length, number 0"), "duplicate_title"),
        (candidate(19), "inserted"),
        (candidate(20), "article_cap_reached"),
        (candidate(21, title="Short"), "article_cap_reached"),
        (candidate(22, run=2, url="https://a.example.com/s/0"), "duplicate_url"),
        (candidate(23, run=2, snippet=None, title="The climate in the title suffices here"), "inserted"),
    ]
    frame = spark.createDataFrame([r for r, _ in rows], CANDIDATES)
    articles = spark.createDataFrame(known, ARTICLES)
    trusted = spark.createDataFrame([("trusted.org",)], "host string")
    got = gates.discovery_gate(frame, articles, trusted, TIERS, F.lit(NOW), F.lit(hours(72)), cap=3).collect()
    assert {r.candidate_id: r.outcome for r in got} == {r[2]: o for r, o in rows}
    assert {r.outcome for r in got} == set(gates.OUTCOMES)
    found = {r.candidate_id: r.duplicate_article_id for r in got}
    assert (found[4], found[5], found[18], found[0]) == (900, 901, None, None)
    assert gates.discovery_gate(frame.limit(0), articles, trusted, TIERS, F.lit(NOW), F.lit(hours(72)), cap=3).count() == 0


def test_trust_needs_a_path_a_host_or_a_homepage_without_feed(spark):
    rows = [
        (1, "https://paper.com/climate/rss", None, None, True),
        (2, "https://paper.com/sports/rss", "https://good.org", None, False),
        (3, "https://feeds.good.org/x", None, None, True),
        (4, "web://good.org", None, None, True),
        (5, "web://bad.org", "https://www.good.org/", None, True),
        (6, None, None, "https://a.good.org/1", True),
        (7, None, None, "https://notgood.org/1", False),
        (8, None, None, None, False),
    ]
    frame = spark.createDataFrame([r[:4] for r in rows], "k long, feed string, home string, url string")
    hosts = spark.createDataFrame([("good.org",)], "host string")
    got = gates.with_trust(frame, "k", hosts, [r"paper\.com/climate"], feed=F.col("feed"), homepage=F.col("home"), url=F.col("url")).collect()
    assert {r.k: r.trusted for r in got} == {r[0]: r[4] for r in rows}


def test_articles_go_to_the_heaviest_source_that_fits(spark):
    sources = [(1, "a-example-com", "http://feeds/x", "https://www.example.com/", 3), (2, "s2", "web://b.example.com", "https://c.org", 9), (3, "s3", "http://f", "https://news.paper.co.uk/x", None), (4, "s4", "http://g", "https://news.paper.co.uk/y", None)]
    articles = [
        (1, "https://a.example.com/1", None, None, 1),
        (2, "https://b.example.com/1", None, None, 2),
        (3, "https://paper.co.uk/1", None, None, 3),
        (4, "https://news.google.com/x", "Other", "https://c.org/home", 2),
        (5, "https://news.google.com/x", "other.com", None, 99),
        (6, "https://fresh.site.net/1", " The Site ", None, None),
        (7, "https://fresh.site.net/2", "site.net", None, None),
        (8, None, "Name", None, 99),
    ]
    got = gates.attribute_sources(
        spark.createDataFrame([a[:4] for a in articles], "article_id long, canonical_url string, publisher_name string, publisher_homepage string"),
        spark.createDataFrame(sources, "source_id long, slug string, feed_url string, homepage_url string, weight int"),
        99,
        spark.createDataFrame([("site.net", 7)], "host string, value int"),
    ).collect()
    by = {r.article_id: r for r in got}
    assert {k: r.source_id for k, r in by.items()} == {a[0]: a[4] for a in articles}
    assert (by[5].publisher_name, by[8].publisher_name, by[6].publisher_name, by[7].publisher_name) == (None, "Name", "The Site", "Fresh Site")
    assert tuple(by[6].new_source) == ("fresh-site-net", "web://fresh.site.net", "The Site", 7) and by[1].new_source is None
    assert by[1].publisher_homepage == "https://a.example.com"


def test_merges_drop_known_and_later_wrappers(spark):
    articles = [(1, "https://news.google.com/a", 5, "success"), (2, "https://o.com/x", 6, "success"), (3, "https://news.google.com/b", 5, "error"), (4, "https://news.google.com/c", 5, "error"), (5, "https://news.google.com/d", 5, "error")]
    resolved = [(1, "https://o.com/x#top"), (3, "https://p.com/y"), (4, "https://p.com/y?fbclid=1"), (5, None)]
    sources = spark.createDataFrame([(6, "o-com", "web://o.com", "https://o.com", 2), (7, "p-com", "web://p.com", None, 2)], "source_id long, slug string, feed_url string, homepage_url string, weight int")
    got = gates.merge_resolved(spark.createDataFrame(articles, "article_id long, canonical_url string, source_id long, content_status string"), spark.createDataFrame(resolved, "article_id long, url string"), sources, 0)
    assert sorted((r.article_id, r.canonical_url, r.source_id, r.content_status, r.action) for r in got.collect()) == [
        (2, "https://o.com/x", 6, "success", "keep"),
        (3, "https://p.com/y", 7, None, "rewrite"),
        (5, "https://news.google.com/d", 5, "error", "keep"),
    ]


def test_feeds_are_resolved_listed_once_and_cut(spark):
    link = '<link rel="alternate" type="application/rss+xml" href="{}">'
    html = "".join(link.format(h) for h in ("rss.xml", "/feed", "//cdn.x.org/f", "mailto:a@b", "https://y.org/f")) + '<link rel="alternate" href="/no">'
    pages = spark.createDataFrame([(1, "https://A.com/blog/post?q=1", html), (2, "https://b.com", None), (3, "nonsense", html)], "page_id long, url string, html string")
    got = {}
    for r in gates.feed_candidates(pages).orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.feed_url)
    assert got[1] == ["https://a.com/blog/rss.xml", "https://a.com/feed", "https://cdn.x.org/f", "https://y.org/f", "https://a.com/rss", "https://a.com/atom.xml"]
    assert got[2] == ["https://b.com" + p for p in ("/feed", "/rss", "/atom.xml", "/feed.xml", "/rss.xml", "/index.xml")]


def test_files_keep_quotes_line_ends_and_nulls(spark):
    texts = ['plain', 'a "quoted", comma', "two\nlines\r\nand \\ back\\", "", None, " spaces ", 'ends with "', "\\N?", "é" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for turn in (logs.round_trip_json, logs.round_trip_csv):
        assert sorted(map(tuple, turn(rows).collect())) == list(enumerate(texts))
        assert turn(rows.limit(0)).count() == 0


def test_feed_items_become_rows(spark):
    items = [
        '{"guid": 1, "title": " A &amp; B - The Paper ", "link": " https://X.com/a?utm_source=1 ", "creator": " Ann ", "isoDate": "2024-01-02T03:04:05Z", "contentSnippet": " ", "content": "<p>Short dek</p>"}',
        '{"guid": 2, "title": "No link"}',
        '{"guid": 3, "title": "Plain", "link": "https://y.com/b", "author": "Bob", "pubDate": "Tue, 02 Jan 2024 03:04:05 +0000"}',
        "not json",
    ]
    got = {r.guid: r for r in logs.project_feed_items(spark.createDataFrame([(i,) for i in items], "item string"), query_feed=True).collect()}
    assert set(got) == {1, 3}
    assert (got[1].title, got[1].publisher_name, got[1].canonical_url, got[1].author, got[1].dek) == ("A & B", "The Paper", "https://x.com/a", "Ann", "Short dek")
    assert got[1].published_at == got[3].published_at and got[3].publisher_name is None and got[3].author == "Bob"


def test_a_capped_candidate_blocks_no_later_run(spark):
    rows = [candidate(0), candidate(1), candidate(2, run=2, url="https://a.example.com/s/1"), candidate(3, run=3, url="https://b.example.com/1", title="A headline of proper length, number 1")]
    trusted, articles = spark.createDataFrame([], "host string"), spark.createDataFrame([], ARTICLES)
    got = gates.discovery_gate(spark.createDataFrame(rows, CANDIDATES), articles, trusted, TIERS, F.lit(NOW), F.lit(hours(72)), cap=1).collect()
    assert {r.candidate_id: r.outcome for r in got} == {0: "inserted", 1: "article_cap_reached", 2: "inserted", 3: "inserted"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_discovery_in_order_on_random_chains(spark, seed):
    """One candidate after the other, with few addresses and titles, small caps and ids that come again."""
    import random

    rng = random.Random(seed)
    rows = []
    for run in range(1, 9):
        for place in range(12):
            n = rng.randrange(9)
            url = f"https://a.example.com/s/{rng.randrange(14)}" + rng.choice(["", "?utm_source=x"])
            row = candidate(n, run, f"A headline of proper length, number {rng.randrange(16)}", url, reachable=rng.random() > 0.15, stored=rng.random() > 0.1, lang=rng.choice(["en"] * 9 + ["de"]))
            rows.append((run, place, *row[2:]))
    known = [(900, "https://a.example.com/s/0", "Something else entirely, long enough", hours(100)), (901, "https://x/1", "A headline of proper length, number 1", hours(10))]
    urls, titles, want = {known[0][1]: 900, known[1][1]: 901}, {known[1][2].lower(): 901}, []
    for run in range(1, 9):
        taken, seen = 0, set()
        for _, place, k, title, url, _, _, lang, _, reachable, stored in (r for r in rows if r[0] == run):
            real, fresh = url.split("?")[0], url.lower() not in seen
            seen.add(url.lower())
            if not fresh:
                outcome = "duplicate_candidate"
            elif taken >= 2:
                outcome = "article_cap_reached"
            elif lang != "en":
                outcome = "non_english"
            elif real in urls:
                outcome = "duplicate_url"
            elif title.lower() in titles:
                outcome = "duplicate_title"
            elif not reachable or not stored:
                outcome = "insert_failed" if reachable else "unreachable"
            else:
                outcome, taken = "inserted", taken + 1
                urls[real], titles[title.lower()] = None, None
            found = urls[real] if outcome == "duplicate_url" else titles[title.lower()] if outcome == "duplicate_title" else None
            want.append((run, place, k, outcome, found))
    trusted = spark.createDataFrame([], "host string")
    got = gates.discovery_gate(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(known, ARTICLES), trusted, TIERS, F.lit(NOW), F.lit(hours(72)), cap=2)
    assert sorted((r.run_id, r.place, r.candidate_id, r.outcome, r.duplicate_article_id) for r in got.collect()) == sorted(want, key=lambda r: r[:2])
    assert len({w[3] for w in want}) >= 5


def test_cells_find_most_of_the_nearest(spark):
    """Recall of a few cells against the exact way, which is the same with one cell and with many."""
    import random

    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    vector = lambda: [x + rng.gauss(0, 0.4) for x in rng.choice(middles)]
    centroids = spark.createDataFrame([(i, vector()) for i in range(400)] + [(900, None)], "cluster_id long, centroid array<double>")
    articles = spark.createDataFrame([(i, vector()) for i in range(100)] + [(200, None), (201, [0.0] * 12)], "article_id long, embedding array<double>")
    take = lambda **kw: {(r.article_id, r.cluster_id) for r in stories.nearest_centroids(articles, centroids, **kw).collect()}
    exact = take()
    assert exact == take(cells=1) == take(cells=150) and len(exact) == 101 * 8
    found = take(cells=20, probe=6)
    real = {p for p in exact if p[0] != 201}
    assert len(found & real) / len(real) >= 0.9


def test_titles_come_again_after_their_time(spark):
    rows = [(1, "T", 0), (2, "t", 24), (3, "T", 24 * 6), (4, "T", 24 * 8), (5, "T", 24 * 15), (6, "u", 0), (7, None, 0), (8, "T", 24 * 16)]
    frame = spark.createDataFrame([(i, t, NOW + datetime.timedelta(hours=h)) for i, t, h in rows], "article_id long, title string, fetched_at timestamp")
    assert sorted(r.article_id for r in jobs.recent_title_batch(frame, 7).collect()) == [1, 4, 6, 8]
    assert jobs.recent_title_batch(frame.limit(0), 7).count() == 0


def test_assignment_and_merging_against_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    middles = [np.array([rng.gauss(0, 1) for _ in range(6)]) for _ in range(6)]
    vectors = {i: middles[i % 6] + np.array([rng.gauss(0, 0.5) for _ in range(6)]) for i in range(120)}
    owner = {i: 100 + i % 6 + 6 * (i // 30 % 2) for i in range(60)}
    articles = spark.createDataFrame([(i, [float(x) for x in v], NOW, "en") for i, v in vectors.items()], "article_id long, embedding array<double>, fetched_at timestamp, language_code string")
    members = spark.createDataFrame(list(owner.items()), "article_id long, cluster_id long")
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    unite = lambda known: {c: (np.mean([vectors[i] for i in known if known[i] == c], 0), sum(known[i] == c for i in known)) for c in set(known.values())}

    known, found = dict(owner), {}
    for _ in range(2):
        centres, wishes = unite(known), {}
        for i in sorted(set(vectors) - set(owner) - set(found)):
            order = sorted(centres, key=lambda c: (-cosine(vectors[i], centres[c][0]), c))[:8]
            fit = [c for c in order if cosine(vectors[i], centres[c][0]) > 0.7 and centres[c][1] < 12]
            if fit:
                wishes.setdefault(fit[0], []).append((-cosine(vectors[i], centres[fit[0]][0]), i))
        for c, who in wishes.items():
            for _, i in sorted(who)[: 12 - centres[c][1]]:
                found[i] = known[i] = c
    got = stories.assign_clusters(articles, members, F.lit(NOW), similarity=0.7, most=12).collect()
    assert {r.article_id: r.cluster_id for r in got if not r.is_new} == found and found
    assert {r.article_id for r in got if r.is_new} == set(vectors) - set(owner) - set(found)

    centres = unite(owner)
    pairs = sorted((-cosine(centres[a][0], centres[b][0]), a, b) for a in centres for b in centres if a < b and cosine(centres[a][0], centres[b][0]) > 0.5 and centres[a][1] + centres[b][1] <= 12)[:10]
    table = stories.merge_pairs(stories.cluster_centroids(members, articles), F.lit(NOW), similarity=0.5, most=12)
    assert [(r.c1, r.c2) for r in table.orderBy(F.col("similarity").desc(), "c1", "c2").collect()] == [p[1:] for p in pairs] and pairs
    size, into = {c: n for c, (_, n) in centres.items()}, {}
    for _, a, b in pairs:
        if a in into or b in into or size[a] + size[b] > 12:
            continue
        keep, drop = (a, b) if size[a] >= size[b] else (b, a)
        size[keep] += size[drop]
        into[drop] = keep
    merged = stories.merge_clusters(members, table, 12).collect()
    assert {r.article_id: r.cluster_id for r in merged} == {i: into.get(c, c) for i, c in owner.items()} and into


def test_cited_results_by_lists_that_are_not_broadcast(spark):
    from pressloom.operators.curation import cited_results

    results = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a")], "search_id long, host string")
    cited = spark.createDataFrame([(1, ["b", "x"]), (2, ["x"]), (4, [])], "search_id long, hosts array<string>")
    got = cited_results(results, cited)
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (3, "c"), (4, "a")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def rejections(spark, tmp_path, name):
    """A query over texts of short sentences, of walls, of few words and none, and its SQL's answer."""
    import duckdb

    from pressloom.plans.catalogue import ORACLES, QUERIES

    short = " ".join(f"a{k} b{k}." for k in range(60))
    walled = "Members subscribe for premium. " + " ".join(f"word{k}" for k in range(60))
    rows = [(1, short), (2, walled), (3, "Too few words."), (4, None), (9, "same " * 80), (10, " ".join(f"long{k}" for k in range(50)))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    for table in ("supplier", "events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    expected = con.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), key=str), sorted(expected.fetchall(), key=str)


def test_rejected_texts_are_those_of_the_sql(spark, tmp_path):
    got, want = rejections(spark, tmp_path, "content_snippet")
    assert got == want == [(6, 2)]


def test_headline_notes_are_those_of_the_sql(spark, tmp_path):
    got, want = rejections(spark, tmp_path, "headline_prep")
    assert got == want and len(want) == 6


def test_walls_and_short_sentences_have_no_snippet(spark, tmp_path):
    got, want = rejections(spark, tmp_path, "content_snippet")
    assert got == want == [(6, 4)]


def test_walled_and_short_pages_have_no_content(spark, tmp_path):
    got, want = rejections(spark, tmp_path, "headline_prep")
    assert got == want and {r[0]: r[1:3] for r in got} == {**{k: (":content_rejected", False) for k in (1, 2, 3, 9)}, 4: ("", False), 10: ("", True)}
