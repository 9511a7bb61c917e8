"""Examples of the Column builders and invariants of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressloom.functions import rules, scores, texts, urls
from pressloom.operators import curation, stories, telemetry
from pressloom.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://Example.com/a?utm_source=x&b=1#top", "https://example.com/a?b=1"),
        ("https://example.com/a?fbclid=1", "https://example.com/a"),
        ("https://example.com", "https://example.com/"),
        ("http://example.com:80/x", "http://example.com/x"),
        ("not a url", "not a url"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, urls.canonical_url(F.lit(url).cast("string"))) == expected


@pytest.mark.parametrize("host, root", [("a.b.example.com", "example.com"), ("news.example.co.uk", "example.co.uk"), ("example.com", "example.com")])
def test_root_domain(spark, host, root):
    assert one(spark, urls.root_domain(F.lit(host))) == root


@pytest.mark.parametrize(
    "url, low", [("https://www.fool.com/x", True), ("https://a.fool.com", True), ("https://notfool.com/x", False), ("https://example.com/?via=fool.com", False)]
)
def test_low_value_hosts(spark, url, low):
    assert one(spark, urls.is_low_value_url(F.lit(url))) is low


@pytest.mark.parametrize("path, section", [("/", True), ("/news", True), ("/topics/wind", True), ("/news/wind-farm", False), ("/2024-report", False), ("/a-b-c-d", False), ("/a/b/c", False)])
def test_section_paths(spark, path, section):
    assert one(spark, urls.is_section_path(F.lit(path))) is section


def test_vectors(spark):
    vector = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, scores.cosine(vector(1, 2, 3), vector(4, 5, 6))) == pytest.approx(0.9746, abs=1e-4)
    assert one(spark, scores.cosine(vector(0, 0), vector(1, 1))) == 0
    assert one(spark, scores.cosine(vector(1), vector(1, 1))) == 0


def test_score_parts(spark):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    ago = lambda h: F.timestamp_seconds(F.lit(1_700_000_000 - h * 3600))
    assert sum(rules.SCORE_SHARES.values()) == pytest.approx(1)
    assert one(spark, scores.cluster_freshness(ago(12), now)) == pytest.approx(0.5)
    assert one(spark, scores.cluster_freshness(F.lit(None).cast("timestamp"), now)) == pytest.approx(2**-10)
    assert one(spark, scores.cluster_freshness(ago(-5), now)) == 1
    assert one(spark, scores.age_damping(F.lit(None).cast("timestamp"), now)) == 1
    assert one(spark, scores.age_damping(ago(168 * 9), now)) == pytest.approx(0.7)
    assert one(spark, scores.top_gate(F.lit(None).cast("int"), F.lit(1))) is True
    assert one(spark, scores.top_gate(F.lit(1), F.lit(8))) is True
    assert one(spark, scores.top_gate(F.lit(1), F.lit(7))) is False
    codes = [one(spark, scores.date_validity(x, now)) for x in (F.lit(None).cast("timestamp"), ago(-1), ago(0), ago(24), ago(24 * 40))]
    assert codes == ["missing_date", "future_date", "suspicious_current_time", "valid", "too_old"]


@pytest.mark.parametrize(
    "title, key", [("Élections françaises: résultats", "elections-francaises-resultats"), ("The a of it", ""), (None, ""), ("one two three four five six seven eight nine ten", "one-two-three-four-five-six-seven-eight")]
)
def test_cluster_key(spark, title, key):
    assert one(spark, texts.cluster_key(F.lit(title).cast("string"))) == key


@pytest.mark.parametrize("title, clean", [("A story - Outlet", "A story"), ("A - b — The Post", "A - b"), ("No suffix", "No suffix"), ("Well-known - Co-op News", "Well-known")])
def test_feed_titles(spark, title, clean):
    assert one(spark, texts.clean_feed_title(F.lit(title))) == clean


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$5 million", [(5e6, "$")]),
        ("$5B in 2030", [(5e9, "$"), (2030.0, "")]),
        ("593 GW and 2.6 gigawatts", [(593.0, "gw"), (2.6, "gw")]),
        ("28.7%", [(28.7, "%")]),
        ("no figure", []),
    ],
)
def test_measurements(spark, text, expected):
    assert [tuple(x) for x in one(spark, texts.measurements(F.lit(text)))] == expected


def test_entities_and_language_marks(spark):
    assert one(spark, texts.decoded_entities(F.lit("a &amp;lt; &#66;&#233; &quot;x&quot;"))) == 'a < Bé "x"'
    assert one(spark, texts.sanitized_headline(F.lit(' "A  headline." '))) == "A headline"
    assert one(spark, texts.clean_summary(F.lit("Current conditions: dry"))) is None


@pytest.mark.parametrize(
    "original, draft, source, content, reason",
    [
        ("o", "", "s", True, "empty"),
        ("o", "too short", "s", True, "length"),
        ("Same words here for the whole of this line and a bit more to be long enough", "Same words here for the whole of this line and a bit more to be long enough", "s", False, "unchanged"),
        ("Grid", "Operators say 593 GW of new capacity joined the national grid over the year", "593 million tons were dug", False, "numeric_mismatch"),
        ("Grid", "Operators say 29% of new capacity joined the national grid over the whole year", "a share of 28.7% joined", False, None),
        ("Grid", "You will not believe what this unprecedented change of plan does to the grid", "text of the article", False, "clickbait"),
        ("Grid", "Officials might change the plan for the grid after the vote of the council", "text of the article", False, "weak_hedging"),
    ],
)
def test_headline_checks(spark, original, draft, source, content, reason):
    rows = spark.createDataFrame([(1, original, draft, source, content)], "doc_id long, original string, draft string, source string, has_content boolean")
    assert curation.headline_qa(rows).first()["reason"] == reason


@pytest.mark.parametrize("source, reason", [("the council voted", "hallucinated_political_figure"), ("the council and Macron voted", None), ("Macronesia voted", "hallucinated_political_figure")])
def test_headlines_bring_in_no_political_figure(spark, source, reason):
    draft = "Council backs the new plan for the grid after Macron asked for a second vote"
    rows = spark.createDataFrame([(1, "Grid", draft, source, False)], "doc_id long, original string, draft string, source string, has_content boolean")
    assert curation.headline_qa(rows).first()["reason"] == reason


def test_headline_query_reads_the_whole_source(spark, tmp_path):
    filler = "Wind farms grew along the coast and people may like them in every small town near it. " * 40
    texts_ = {5: filler + "A report came out.", 6: filler, 3: filler + "The share was 40 percent.", 10: filler}
    spark.createDataFrame(list(texts_.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.reason for r in catalogue.QUERIES["headline_qa"](spark, str(tmp_path)).collect()}
    assert (got[5], got[6]) == ("missing_attribution", None)
    assert got[10] == "numeric_missing_in_source" and got[3] not in ("numeric_missing_in_source", "numeric_mismatch")


def test_reserved_hosts(spark):
    hosts = ["127.0.0.1", "10.9.9.9", "8.8.8.8", "169.254.169.254", "255.255.255.255", "localhost", "db.internal", "example.com", "::1", "1.2.3"]
    got = {r.host: r.reserved for r in curation.reserved_hosts(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert [h for h in hosts if got[h] is None] == ["8.8.8.8", "example.com", "1.2.3"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, w int, t string")
    new = spark.createDataFrame([("a", 9, "n"), ("c", 3, "y")], "k string, w int, t string")
    assert sorted(map(tuple, curation.upsert(old, new, "k", keep=["w"]).collect())) == [("a", 1, "n", False), ("b", 2, "x", False), ("c", 3, "y", True)]
    assert sorted(map(tuple, curation.upsert(old, new, "k", fill=True).collect())) == [("a", 1, "n", False), ("b", 2, "x", False), ("c", 3, "y", True)]


def test_split_keeps_members_and_cap(spark):
    rows = [(i, 1, [1.0, 0.0]) for i in range(10)] + [(100 + i, 1, [0.0, 1.0]) for i in range(3)]
    articles = spark.createDataFrame([(i, v) for i, _, v in rows], "article_id long, embedding array<double>")
    members = spark.createDataFrame([(i, c) for i, c, _ in rows], "article_id long, cluster_id long")
    got = stories.split_clusters(members, articles, least=2, similarity=0.9, most=4).collect()
    assert sorted(r.article_id for r in got) == sorted(r[0] for r in rows)
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append(r.article_id)
    assert max(map(len, parts.values())) <= 4 and all(len({i >= 100 for i in p}) == 1 for p in parts.values())


def test_split_returns_members_of_clusters_beyond_one_task(spark):
    axis = lambda k: [1.0 if j == k else 0.0 for j in range(4)]
    rows = [(i, 1, axis(i % 4)) for i in range(1200)] + [(5000 + i, 2, axis(0)) for i in range(700)] + [(9000 + i, 3, axis(i % 2)) for i in range(30)]
    articles = spark.createDataFrame([(i, v) for i, _, v in rows], "article_id long, embedding array<double>")
    members = spark.createDataFrame([(i, c) for i, c, _ in rows], "article_id long, cluster_id long")
    got = stories.split_clusters(members, articles, least=20, similarity=0.9, most=25, most_rows=100).collect()
    assert sorted((r.article_id, r.cluster_id) for r in got) == sorted((i, c) for i, c, _ in rows)
    parts, of = {}, {i: v for i, _, v in rows}
    for r in got:
        parts.setdefault((r.cluster_id, r.part), []).append(r.article_id)
    assert all(len(p) <= 25 and len({tuple(of[i]) for i in p}) == 1 for p in parts.values())
    for cluster in (1, 2, 3):
        sizes = [len(p) for (c, _), p in parts.items() if c == cluster]
        assert len(parts[cluster, "same"]) == max(sizes)


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0)], "article_id long, rank double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "article_id long, similarity double")
    got = {r.article_id: r.score for r in stories.reciprocal_rank_fusion(a, b).collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61) and got[1] == pytest.approx(1 / 61) and got[3] == pytest.approx(1 / 62)


def test_storable_categories(spark):
    rows = [(1, "a", 0.66, 0.0, 0.66), (1, "b", 0.6, 0.5, 0.6), (2, "a", 0.72, 0.0, 0.72), (3, "a", 0.3, 0.3, 0.0), (4, "a", 0.69, 0.0, 0.69)]
    frame = spark.createDataFrame(rows, "article_id long, slug string, confidence double, rule_confidence double, semantic_confidence double")
    assert sorted((r.article_id, r.slug) for r in curation.storable_categories(frame).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_prices_and_caps(spark):
    models = spark.createDataFrame([("gpt-4o-mini-2024-07-18",), ("gpt-4o",), ("gpt-4other",), ("unknown",)], "model string")
    assert {r.model: r.input_per_m for r in telemetry.model_price(models).collect()} == {"gpt-4o-mini-2024-07-18": 0.15, "gpt-4o": 2.5, "gpt-4other": 2.5, "unknown": 2.5}
    rows = spark.createDataFrame([(1, 1, True, None), (1, 2, False, "stale"), (1, 3, True, None), (1, 4, False, "stale")], "search_id long, rank int, accepted boolean, reason string")
    assert [r.outcome for r in telemetry.article_cap(rows, 2).orderBy("rank").collect()] == ["inserted", "stale", "inserted", "article_cap_reached"]


def test_feed_limits(spark):
    with pytest.raises(ValueError):
        stories.river_clusters(None, None, None, None, None, window_h=0)
    with pytest.raises(ValueError):
        stories.river_clusters(None, None, None, None, None, limit=101)


def test_accents_of_all_latin_letters_fold(spark):
    frame = spark.createDataFrame([("Škoda őŭ ăḿ ﬁ ł Ǹé",)], "t string")
    assert frame.select(texts.folded(F.col("t"))).first()[0] == "skoda ou am ﬁ ł ne"
    assert frame.select(texts.slug(F.col("t"))).first()[0] == "skoda-ou-am-ne"


def test_a_hot_title_makes_no_pairs(spark):
    now = dt.datetime(2024, 1, 31)
    articles = spark.range(3000).selectExpr("id AS article_id", "concat('https://x/', id) AS canonical_url", "'Hot Title' AS title").withColumn("fetched_at", F.lit(now))
    candidates = spark.range(3000).selectExpr("id AS candidate_id", "'hot title' AS title", "concat('https://x/', 2 * id) AS url")
    found = curation.recent_duplicates(candidates, articles, F.lit(now))
    assert {(r.candidate_id, r.article_id) for r in found.collect()} == {(i, 0) for i in range(3000)}
    assert curation.recent_duplicates(candidates.limit(0), articles, F.lit(now)).count() == 0


def test_rules_need_no_join(spark):
    articles = spark.createDataFrame([(1, "A storm and a flood"), (2, "calm"), (3, None)], "article_id long, text string")
    words = spark.createDataFrame([("weather", "keyword", "storm", r"(?i)\bstorm\b"), ("weather", "pattern", "flood", "flood"), ("calm", "keyword", "calm", "^calm$")], "slug string, kind string, rule string, pattern string")
    out = curation.rule_categorise(articles, words)
    assert {(r.article_id, r.slug, round(r.confidence, 6), tuple(r.reasons)) for r in out.collect()} == {(1, "weather", 0.7, ("keyword: storm", "pattern: flood")), (2, "calm", 0.3, ("keyword: calm",))}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert curation.rule_categorise(articles, words.limit(0)).count() == 0


def test_headline_checks_shuffle_no_text(spark):
    pairs = spark.range(1).selectExpr("id AS doc_id", "'Grid' AS original", "concat(id, ' GW') AS draft", "concat('a', id) AS source", "true AS has_content")
    assert "Join" not in curation.headline_qa(pairs)._jdf.queryExecution().optimizedPlan().toString()


def test_deks_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Blank texts, white space and line ends that engines see differently, and a long text without any sentence."""
    import duckdb

    odd = [None, "", "  ", "\n", "<b> </b>", *[a + c + b for c in "\x0b\x85\u2028\xa0\u3000\x1f" for a, b in (("", ""), ("x" * 50, "y" * 50 + ". z"), ("", "x" * 50 + ". b"), ("x" * 50 + ".", "b"), ("x" * 298, "y" * 9))], "no end " * 9_000]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES["best_dek"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.ORACLES["best_dek"]).fetchall())
