"""Queries over stories: scoring, feeds, clustering, categories, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import scores, texts
from pressloom.functions.stems import stem_oracle
from pressloom.operators import stories as ops
from pressloom.operators.storage import kept, new_path
from pressloom.operators.textindex import TextIndex
from pressloom.operators.vectors import DIGITS, VectorIndex, unit
from pressloom.plans.registry import query
from pressloom.sources.model import Model, as_of, hours_before


def base(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    return m.article_clusters(), m.articles(), m.sources()


def scored_articles(m: Model) -> DataFrame:
    return ops.scored_articles(ops.one_cluster_per_article(ops.article_star(*base(m))), as_of())


def cluster_scores(m: Model) -> DataFrame:
    return ops.rescore(*base(m), as_of())


@query("load_tables", "SELECT 'sources' AS name, count(*) AS n FROM sources UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'article_clusters', count(*) FROM article_clusters")
def load_tables(m):
    names = ("sources", "articles", "article_clusters")
    parts = [getattr(m, n)().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("active_feeds", "SELECT source_id, name, feed_url, coalesce(weight, -1) AS weight FROM sources WHERE feed_url LIKE 'http%'")
def active_feeds(m):
    live = m.sources().where(F.col("feed_url").startswith("http"))
    return live.select("source_id", "name", "feed_url", F.coalesce("weight", F.lit(-1)).alias("weight")).orderBy(F.col("weight").desc(), "name")


@query("article_star", "SELECT article_id, cluster_id, source_name, host, weight FROM art")
def article_star(m):
    return scored_articles(m).select("article_id", "cluster_id", "source_name", "host", "weight")


@query("one_cluster_per_article", "SELECT article_id, min(cluster_id) AS cluster_id FROM art GROUP BY article_id")
def one_cluster_per_article(m):
    return ops.one_cluster_per_article(ops.article_star(*base(m))).select("article_id", "cluster_id")


@query("visible_language", "SELECT coalesce(language_code, 'unknown') AS code, count(*) AS n FROM articles WHERE language_code = 'en' OR language_code IS NULL GROUP BY 1")
def visible_language(m):
    return m.articles().where(scores.visible_language(F.col("language_code"))).groupBy(F.coalesce("language_code", F.lit("unknown")).alias("code")).agg(F.count("*").alias("n"))


@query("lead_ineligible", "SELECT article_id, eligible = 0 AS ineligible FROM scored")
def lead_ineligible(m):
    a = scored_articles(m)
    return a.select("article_id", scores.lead_ineligible(F.col("canonical_url"), F.col("published_at"), F.col("fetched_at")).alias("ineligible"))


@query("editorial_quality", "SELECT article_id, round(quality, 6) AS quality FROM scored")
def editorial_quality(m):
    return scored_articles(m).select("article_id", "quality")


@query("article_freshness", "SELECT article_id, round(fresh, 6) AS fresh FROM scored")
def article_freshness(m):
    return scored_articles(m).select("article_id", "fresh")


@query("article_and_lead_score", "SELECT article_id, round(0.4::DOUBLE * quality + 0.6::DOUBLE * fresh, 6) AS article_score, round(0.8::DOUBLE * quality + 0.2::DOUBLE * fresh, 6) AS lead_score FROM scored")
def article_and_lead_score(m):
    return scored_articles(m).select("article_id", "article_score", "lead_score")


@query("effective_weight", "SELECT article_id, weight FROM scored")
def effective_weight(m):
    return scored_articles(m).select("article_id", "weight")


@query(
    "cluster_rollup",
    "SELECT cluster_id, size, distinct_sources, latest_pub, first_pub, sum_w::BIGINT AS sum_w, round(avg_w, 6) AS avg_w, max_w, strong_sources, v4, round(pool, 6) AS pool, lead_article_id FROM rollup_",
)
def cluster_rollup(m):
    return ops.cluster_rollup(scored_articles(m), as_of())


@query("rescore_lead", "SELECT cluster_id, lead_article_id FROM rollup_")
def rescore_lead(m):
    return ops.cluster_rollup(scored_articles(m), as_of()).select("cluster_id", "lead_article_id")


@query("strong_source_count", "SELECT cluster_id, strong_sources FROM rollup_")
def strong_source_count(m):
    return ops.cluster_rollup(scored_articles(m), as_of()).select("cluster_id", "strong_sources")


@query("weighted_velocity", "SELECT cluster_id, round(vw, 6) AS vw FROM velocity")
def weighted_velocity(m):
    return ops.weighted_velocity(scored_articles(m), as_of())


@query("cluster_freshness", "SELECT cluster_id, round(cluster_fresh, 6) AS cluster_fresh FROM base")
def cluster_freshness(m):
    return cluster_scores(m).select("cluster_id", "cluster_fresh")


@query("age_damping", "SELECT cluster_id, round(damping, 6) AS damping FROM base")
def age_damping(m):
    return cluster_scores(m).select("cluster_id", "damping")


_RESCORE = "SELECT cluster_id, size, round(score, 6) AS score, round(base_score, 6) AS base_score, latest_pub, first_pub, strong_sources, lead_article_id FROM cluster_scores"


@query("rescore", _RESCORE)
def rescore(m):
    return cluster_scores(m).select("cluster_id", "size", "score", "base_score", "latest_pub", "first_pub", "strong_sources", "lead_article_id")


@query(
    "why_struct",
    "SELECT cluster_id, round(velocity_norm, 4) AS velocity_norm, round(coverage_norm, 4) AS coverage_norm, round(authority_norm, 4) AS authority_norm, round(pool_norm, 4) AS pool_norm, 0.0::DOUBLE AS novelty_norm, round(damping, 4) AS age_damping, distinct_sources, strong_sources, max_w, v4, round(vw, 3) AS vel_w, 24 AS vel_window_h FROM cluster_scores",
)
def why_struct(m):
    return ops.why(cluster_scores(m)).select("cluster_id", "why.*")


_SERVED = """, served AS (
  SELECT c.cluster_id, c.size, c.lead_article_id, c.strong_sources, coalesce(latest_pub, published_at) AS activity_at, published_at, a.canonical_url, s.weight AS sw,
    CASE WHEN regexp_matches(a.canonical_url, 'nature\\.com/articles/s415(58|60)-') THEN least(coalesce(s.weight, 2), 6) ELSE coalesce(s.weight, 2) END AS lead_weight,
    CASE WHEN latest_pub IS NOT NULL THEN base_score + 0.30::DOUBLE * cluster_fresh ELSE score END * damping * CASE WHEN strong_sources < 2 THEN 0.85::DOUBLE ELSE 1 END AS served
  FROM cluster_scores c JOIN articles a ON a.article_id = c.lead_article_id LEFT JOIN sources s USING (source_id)
)
"""


@query("serve_score", _SERVED + "SELECT cluster_id, round(served, 6) AS served FROM served")
def serve_score(m):
    c = cluster_scores(m)
    served = scores.serve_score(F.col("base_score"), F.col("latest_pub"), F.col("score"), as_of()) * scores.age_damping(F.col("first_pub"), as_of()) * scores.singleton_discount(F.col("strong_sources"))
    return c.select("cluster_id", served.alias("served"))


@query("top_gate", _SERVED + "SELECT cluster_id, strong_sources >= 2 OR lead_weight >= 8 AS passes FROM served")
def top_gate(m):
    c = cluster_scores(m).join(scored_articles(m).select(F.col("article_id").alias("lead_article_id"), "weight"), "lead_article_id")
    return c.select("cluster_id", scores.top_gate(F.col("strong_sources"), F.col("weight")).alias("passes"))


@query("singleton_discount", "SELECT cluster_id, CASE WHEN strong_sources < 2 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS discount FROM rollup_")
def singleton_discount(m):
    return cluster_scores(m).select("cluster_id", scores.singleton_discount(F.col("strong_sources")).alias("discount"))


_RIVER = """, ranked AS (
  SELECT row_number() OVER (ORDER BY {order} DESC, activity_at DESC, cluster_id) AS rank, * FROM served, now
  WHERE activity_at >= t - INTERVAL {hours} HOUR AND NOT regexp_matches(canonical_url, 'news\\.google\\.|^https?://([a-z0-9-]+\\.)*(fool\\.com)(/|$)') AND {gate}
), member AS (
  SELECT r.rank, r.cluster_id, r.lead_article_id, a.*, coalesce(a.publisher_name, s.name) AS pub,
    lower(regexp_replace(split_part(split_part(split_part(coalesce(a.publisher_homepage, a.canonical_url), '://', 2), '/', 1), ':', 1), '^(www|m|mobile|amp|amp-cdn|edition|news|beta)\\.', '')) AS hn
  FROM (SELECT * FROM ranked ORDER BY rank LIMIT {limit}) r JOIN article_clusters USING (cluster_id) JOIN articles a USING (article_id) LEFT JOIN sources s USING (source_id) WHERE language_code = 'en' OR language_code IS NULL
), subs AS (
  SELECT cluster_id, count(DISTINCT source_id) FILTER (WHERE source_id IN (SELECT source_id FROM sources)) AS sources_count,
    count(*) FILTER (WHERE article_id <> lead_article_id AND canonical_url NOT LIKE 'https://news.google.com%' AND hn NOT IN ('news.google.com', 'news.yahoo.com', 'msn.com')) AS subs_total,
    coalesce(string_agg(article_id, ',' ORDER BY published_at DESC NULLS FIRST, article_id) FILTER (WHERE article_id <> lead_article_id AND canonical_url NOT LIKE 'https://news.google.com%' AND hn NOT IN ('news.google.com', 'news.yahoo.com', 'msn.com')), '') AS subs,
    count(DISTINCT pub) FILTER (WHERE canonical_url NOT LIKE 'https://news.google.com%' AND hn NOT IN ('news.google.com', 'news.yahoo.com', 'msn.com')) AS publishers
  FROM member GROUP BY cluster_id
)
SELECT r.rank, cluster_id, size, round(served, 6) AS score, sources_count, lead_article_id, coalesce(rewritten_title, title) AS lead_title, rewritten_title IS NOT NULL AS lead_was_rewritten, a.canonical_url AS lead_url,
  coalesce(publisher_name, s.name) AS lead_source, a.published_at, subs_total, subs, publishers, content_status AS lead_content_status, content_word_count AS lead_content_word_count, content_image AS lead_image
FROM ranked r JOIN subs USING (cluster_id) JOIN articles a ON a.article_id = r.lead_article_id LEFT JOIN sources s USING (source_id) WHERE r.rank <= {limit}
"""


def _river(m, **kind):
    c = cluster_scores(m)
    out = ops.river_clusters(c, *base(m), as_of(), article_categories=m.article_categories(), categories=m.categories(), **kind)
    flat = F.array_join(F.transform("subs", lambda s: s["article_id"].cast("string")), ",")
    return out.select("rank", "cluster_id", "size", "score", "sources_count", "lead_article_id", "lead_title", "lead_was_rewritten", "lead_url", "lead_source", "published_at", "subs_total", flat.alias("subs"), F.size(F.coalesce(F.map_keys("all_articles_by_source"), F.array().cast("array<string>"))).cast("long").alias("publishers"), "lead_content_status", "lead_content_word_count", "lead_image")


_GATE = "(strong_sources >= 2 OR lead_weight >= 8)"
_IN_CATEGORY = """(lead_article_id IN (SELECT article_id FROM article_categories JOIN categories USING (category_id) WHERE slug = 'impacts' AND is_primary AND confidence >= 0.35 AND (coalesce(rule_confidence, 0) > 0 OR confidence >= 0.65))
  OR cluster_id IN (SELECT cluster_id FROM matches WHERE slug = 'impacts' AND ((primary_matches >= 2 AND category_score >= 1.2) OR max_confidence >= 0.75)))"""
_MATCHES = """, matches AS (
  SELECT cluster_id, slug, sum(CASE WHEN is_primary THEN confidence ELSE confidence * 0.35::DOUBLE END) AS category_score, count(*) FILTER (WHERE is_primary) AS primary_matches, max(confidence) AS max_confidence, max(coalesce(rule_confidence, 0)) AS max_rule_confidence
  FROM article_clusters JOIN articles USING (article_id) JOIN article_categories USING (article_id) JOIN categories USING (category_id)
  WHERE (language_code = 'en' OR language_code IS NULL) AND confidence >= 0.35 AND (coalesce(rule_confidence, 0) > 0 OR confidence >= 0.65) GROUP BY ALL
)
"""


@query("river_clusters", _SERVED + _RIVER.format(order="served", hours=168, limit=10, gate=_GATE))
def river_clusters(m):
    return _river(m, window_h=168, limit=10)


@query("river_latest", _SERVED + _RIVER.format(order="activity_at", hours=48, limit=20, gate="true"))
def river_latest(m):
    return _river(m, latest=True, window_h=48, limit=20)


@query("river_category", _SERVED + _MATCHES + _RIVER.format(order="served", hours=168, limit=15, gate=_IN_CATEGORY))
def river_category(m):
    return _river(m, window_h=168, limit=15, category="impacts")


@query("river_rank", _SERVED + "SELECT row_number() OVER (ORDER BY served DESC, activity_at DESC, cluster_id) AS rank, cluster_id FROM served, now WHERE activity_at >= t - INTERVAL 168 HOUR AND NOT regexp_matches(canonical_url, 'news\\.google\\.|^https?://([a-z0-9-]+\\.)*(fool\\.com)(/|$)') AND (strong_sources >= 2 OR lead_weight >= 8) QUALIFY rank <= 10")
def river_rank(m):
    return ops.river_clusters(cluster_scores(m), *base(m), as_of()).select("rank", "cluster_id")


@query("category_rollup", _MATCHES + "SELECT cluster_id, slug, round(category_score, 6) AS category_score, primary_matches, round(max_confidence, 6) AS max_confidence, round(max_rule_confidence, 6) AS max_rule_confidence FROM matches")
def category_rollup(m):
    return ops.category_rollup(m.article_clusters(), m.articles(), m.article_categories(), m.categories())


@query("category_exists_lead", _MATCHES + f"SELECT cluster_id FROM cluster_scores WHERE {_IN_CATEGORY}")
def category_exists_lead(m):
    rows = ops.clusters_in_category(cluster_scores(m), m.article_clusters(), m.articles(), m.article_categories(), m.categories(), "impacts")
    return rows.join(cluster_scores(m), "cluster_id", "left_semi")


@query("sources_count", "SELECT cluster_id, count(DISTINCT s.source_id) AS sources_count FROM article_clusters JOIN articles a USING (article_id) LEFT JOIN sources s USING (source_id) WHERE language_code = 'en' OR language_code IS NULL GROUP BY 1")
def sources_count(m):
    members, articles, sources = base(m)
    rows = members.join(articles.where(scores.visible_language(F.col("language_code"))), "article_id").join(sources.select("source_id", F.lit(1).alias("known")), "source_id", "left")
    return rows.groupBy("cluster_id").agg(F.count_distinct(F.when(F.col("known") == 1, F.col("source_id"))).alias("sources_count"))


@query(
    "normalize_subs",
    r""", rows AS (SELECT cluster_id, article_id, canonical_url AS url, published_at, coalesce(publisher_name, s.name) AS pub FROM article_clusters JOIN articles USING (article_id) LEFT JOIN sources s USING (source_id) WHERE (language_code = 'en' OR language_code IS NULL)
    ), idx AS (
      SELECT cluster_id, lower(trim(pub)) AS nk, max(pub) AS source, count(*) AS n FROM rows WHERE trim(coalesce(pub, '')) <> '' AND article_id % 5 <> 0 GROUP BY 1, 2
    ), subs AS (
      SELECT cluster_id, article_id, published_at, CASE article_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' WWW.' || upper(pub) WHEN 2 THEN pub || ' Daily' ELSE pub END AS source, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS host FROM rows
    ), keyed AS (
      SELECT *, regexp_replace(lower(trim(coalesce(source, ''))), '^www\.', '') AS a FROM subs
    ), found AS (
      SELECT k.*, e.source AS s1, e.n AS n1, CASE WHEN a <> '' THEN (SELECT arg_min(struct_pack(s := f.source, n := f.n), f.nk) FROM idx f WHERE f.cluster_id = k.cluster_id AND (contains(f.nk, k.a) OR contains(k.a, f.nk))) END AS fa,
        CASE WHEN host <> '' THEN (SELECT arg_min(struct_pack(s := f.source, n := f.n), f.nk) FROM idx f WHERE f.cluster_id = k.cluster_id AND (contains(f.nk, k.host) OR contains(k.host, f.nk))) END AS fb
      FROM keyed k LEFT JOIN idx e ON e.cluster_id = k.cluster_id AND e.nk = k.a
    ), named AS (
      SELECT *, trim(coalesce(s1, fa.s, fb.s, nullif(trim(source), ''), nullif(host, ''), '')) AS named, coalesce(n1, fa.n, fb.n) AS n FROM found
    ), final AS (
      SELECT *, CASE WHEN regexp_replace(lower(named), '^www\.', '') <> '' THEN regexp_replace(lower(named), '^www\.', '') ELSE article_id::VARCHAR END AS source_key FROM named
    )
    SELECT cluster_id, source_key, arg_max(named, struct_pack(p := coalesce(published_at, TIMESTAMP '1970-01-01'), i := article_id)) AS source, arg_max(article_id, struct_pack(p := coalesce(published_at, TIMESTAMP '1970-01-01'), i := article_id)) AS article_id, coalesce(max(n), count(*)) AS article_count FROM final GROUP BY 1, 2""",
)
def normalize_subs(m):
    """Sub-links under varied names against the numbers of articles by source."""
    k = F.col("article_id")
    rows = ops.article_star(*base(m)).select("cluster_id", "article_id", F.col("canonical_url").alias("url"), "published_at", F.coalesce("publisher_name", "source_name").alias("pub"))
    by_source = rows.where((F.trim(F.coalesce("pub", F.lit(""))) != "") & (k % 5 != 0)).groupBy("cluster_id", F.col("pub").alias("source")).agg(F.count("*").alias("n"))
    source = F.when(k % 6 == 0, None).when(k % 6 == 1, F.concat(F.lit(" WWW."), F.upper("pub"))).when(k % 6 == 2, F.concat("pub", F.lit(" Daily"))).otherwise(F.col("pub"))
    return ops.normalize_subs(rows.select("cluster_id", "article_id", source.alias("source"), "url", "published_at"), by_source)


@query("source_name_fuzzy", """, p AS (SELECT DISTINCT cluster_id, lower(trim(coalesce(publisher_name, s.name))) AS pub FROM article_clusters JOIN articles USING (article_id) LEFT JOIN sources s USING (source_id) WHERE (language_code = 'en' OR language_code IS NULL) AND coalesce(publisher_name, s.name) <> '')
    SELECT a.cluster_id, a.pub, min(b.pub) AS matched FROM p a JOIN p b ON a.cluster_id = b.cluster_id AND a.pub <> b.pub AND (contains(a.pub, b.pub) OR contains(b.pub, a.pub)) GROUP BY ALL""")
def source_name_fuzzy(m):
    p = ops.article_star(*base(m)).select("cluster_id", F.lower(F.trim(F.coalesce("publisher_name", "source_name"))).alias("pub")).where("pub <> ''").distinct()
    q = p.withColumnRenamed("pub", "other")
    fuzzy = (F.col("pub") != F.col("other")) & (F.contains("pub", "other") | F.contains("other", "pub"))
    return p.join(q, "cluster_id").where(fuzzy).groupBy("cluster_id", "pub").agg(F.min("other").alias("matched"))


@query(
    "cluster_detail",
    """, shown AS (SELECT cluster_id, article_id, source_id, coalesce(rewritten_title, title) AS title, published_at FROM article_clusters JOIN articles USING (article_id)
      WHERE (language_code = 'en' OR language_code IS NULL) AND NOT regexp_matches(canonical_url, 'news\\.google\\.|news\\.yahoo\\.com|www\\.msn\\.com'))
    SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC NULLS LAST, article_id) AS place, article_id, title, published_at, article_id = lead_article_id AS is_lead, sources_count
    FROM shown JOIN (SELECT cluster_id, count(DISTINCT source_id) AS sources_count FROM shown GROUP BY 1) USING (cluster_id) LEFT JOIN (SELECT cluster_id, lead_article_id FROM cluster_scores) USING (cluster_id)""",
)
def cluster_detail(m):
    return ops.cluster_details(*base(m), cluster_scores(m))


_LEADERS = """, eff AS (
  SELECT a.article_id, a.published_at, c.cluster_id, cs.size AS cluster_size, cs.lead_article_id = a.article_id AS is_lead, coalesce(nullif(publisher_name, ''), s.name) AS pn, coalesce(nullif(publisher_homepage, ''), nullif(s.homepage_url, '')) AS ph,
    regexp_replace(lower(regexp_replace(regexp_replace(coalesce(nullif(publisher_homepage, ''), nullif(s.homepage_url, ''), canonical_url), '^https?://', ''), '[:/].*$', '')), '^(www\\.|m\\.|mobile\\.|amp\\.|amp-cdn\\.)', '') AS h
  FROM articles a LEFT JOIN sources s USING (source_id) JOIN article_clusters c USING (article_id) JOIN cluster_scores cs USING (cluster_id), now
  WHERE a.published_at > t - INTERVAL {a} HOUR AND a.published_at <= t - INTERVAL {b} HOUR AND (language_code = 'en' OR language_code IS NULL)
    AND NOT (coalesce(s.slug, '') = 'web-discovery' AND nullif(publisher_name, '') IS NULL AND nullif(publisher_homepage, '') IS NULL)
), board{n} AS (
  SELECT CASE WHEN h <> '' THEN 'host:' || h ELSE 'name:' || lower(coalesce(pn, 'unknown')) END AS rank_key,
    coalesce(arg_max(pn, struct_pack(p := published_at, i := article_id)) FILTER (WHERE pn <> ''), max(h)) AS name, coalesce(arg_max(ph, struct_pack(p := published_at, i := article_id)) FILTER (WHERE ph <> ''), CASE WHEN max(h) <> '' THEN 'https://' || max(h) ELSE '' END) AS homepage,
    sum(CASE WHEN is_lead THEN cluster_size ELSE 0 END)::BIGINT AS leads, count(DISTINCT cluster_id) AS articles
  FROM eff WHERE h NOT IN ('news.google.com', 'news.yahoo.com', 'msn.com') GROUP BY 1 HAVING bool_or(is_lead)
)
"""


@query("leaderboard_stats", _LEADERS.format(a=168, b=0, n="") + "SELECT * FROM board")
def leaderboard_stats(m):
    return ops.leaderboard(cluster_scores(m), *base(m), as_of())


_BOARDS = _LEADERS.format(a=120, b=0, n="") + _LEADERS.format(a=240, b=120, n="2").replace("eff", "eff2")
_CHANGE = "SELECT row_number() OVER (ORDER BY leads DESC, articles DESC, rank_key) AS rank, * FROM board QUALIFY rank <= 10"


@query(
    "publication_leaderboard",
    _BOARDS + f"SELECT c.rank, c.rank_key, name, homepage, leads, articles, before - c.rank AS change FROM ({_CHANGE}) c LEFT JOIN (SELECT rank_key, row_number() OVER (ORDER BY leads DESC, articles DESC, rank_key) AS before FROM board2) p USING (rank_key)",
)
def publication_leaderboard(m):
    c = cluster_scores(m)
    return ops.rank_changes(ops.leaderboard(c, *base(m), as_of(), 120, 0), ops.leaderboard(c, *base(m), as_of(), 240, 120))


@query("rank_change", _BOARDS + f"SELECT c.rank_key, before - c.rank AS change FROM ({_CHANGE}) c LEFT JOIN (SELECT rank_key, row_number() OVER (ORDER BY leads DESC, articles DESC, rank_key) AS before FROM board2) p USING (rank_key)")
def rank_change(m):
    return publication_leaderboard(m).select("rank_key", "change")


_CENTROIDS = """, centroids AS (
  SELECT cluster_id, member_count, last_member_at, centroid FROM (SELECT cluster_id, count(*) AS member_count, max(fetched_at) AS last_member_at FROM article_clusters JOIN articles USING (article_id) GROUP BY 1)
  LEFT JOIN (SELECT cluster_id, list(m ORDER BY i) AS centroid FROM (SELECT cluster_id, i, avg(x::DOUBLE) AS m FROM (SELECT cluster_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM article_clusters JOIN articles USING (article_id)
    WHERE embedding IS NOT NULL AND (language_code = 'en' OR language_code IS NULL)) GROUP BY ALL) GROUP BY 1) USING (cluster_id)
)
"""


def centroids(m):
    return ops.cluster_centroids(m.article_clusters(), m.articles())


@query("cluster_centroid", _CENTROIDS + "SELECT cluster_id, member_count, last_member_at, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last, len(centroid) AS n FROM centroids")
def cluster_centroid(m):
    return centroids(m).select("cluster_id", "member_count", "last_member_at", F.get("centroid", F.lit(0)).alias("first"), F.get("centroid", F.lit(63)).alias("last"), F.when(F.col("centroid").isNotNull(), F.size("centroid")).cast("long").alias("n"))


@query("stale_centroids", _CENTROIDS + "SELECT cluster_id, member_count, round(centroid[1], 6) AS first FROM centroids, now WHERE last_member_at >= t - INTERVAL 120 HOUR AND (cluster_id % 5 = 0 OR t - to_hours((90 + cluster_id % 3 * 10)::INT) < last_member_at)")
def stale_centroids(m):
    """Centroids were stored at different times, a fifth never; those that lag behind are made anew."""
    k = F.col("cluster_id")
    stored = m.article_clusters().select("cluster_id").distinct().where(k % 5 != 0)
    stored = stored.select("cluster_id", F.timestamp_micros(F.unix_micros(as_of()) - (90 + k % 3 * 10) * 3_600_000_000).alias("updated_at"))
    return ops.refreshed_centroids(stored, m.article_clusters(), m.articles(), as_of()).select("cluster_id", "member_count", F.get("centroid", F.lit(0)).alias("first"))


_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query("cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", model=False)
def cosine(m):
    e = m.raw("embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "a")
    return pairs.select("a", "b", F.round(scores.cosine(F.col("va"), F.col("vb")), 5).alias("c"))


_KNN = _CENTROIDS + f""", near AS (
  SELECT article_id, cluster_id, {_COS.format(a="embedding::DOUBLE[]", b="centroid")} AS similarity, member_count, last_member_at FROM articles, centroids WHERE embedding IS NOT NULL AND centroid IS NOT NULL
), top AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY similarity DESC, cluster_id) - 1 AS place FROM near QUALIFY place < 8)
"""


@query("nearest_centroid_knn", _KNN + "SELECT article_id, place, cluster_id, round(similarity, 6) AS similarity FROM top")
def nearest_centroid_knn(m):
    """Centroids are stored as an index; new ones are appended, and the articles searched in it."""
    known = centroids(m).where("centroid is not null").select(F.col("cluster_id").alias("id"), unit(F.col("centroid")).alias("v"))
    index = VectorIndex.kept_up(known, *stored(m, "centroid-index"))
    asked = m.articles().where("embedding is not null").select(F.col("article_id").alias("id"), unit(F.col("embedding")).alias("v"))
    return index.nearest(asked, 8).select(F.col("id").alias("article_id"), F.col("place").cast("long").alias("place"), F.col("member").alias("cluster_id"), "similarity")


@query("best_cluster", _KNN + "SELECT article_id, arg_min(cluster_id, place) AS cluster_id FROM top, now WHERE similarity > 0.25 AND member_count < 25 AND last_member_at >= t - INTERVAL 120 HOUR GROUP BY 1")
def best_cluster(m):
    c = centroids(m)
    return ops.best_cluster(ops.nearest_centroids(m.articles(), c), c, as_of(), similarity=0.25).select("article_id", "cluster_id")


_PAIRS = _CENTROIDS + f""", pairs AS (
  SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.member_count AS n1, b.member_count AS n2, {_COS.format(a="a.centroid", b="b.centroid")} AS similarity FROM centroids a JOIN centroids b ON a.cluster_id < b.cluster_id, now
  WHERE a.centroid IS NOT NULL AND b.centroid IS NOT NULL AND a.member_count >= 2 AND b.member_count >= 2 AND a.member_count + b.member_count <= 25 AND a.last_member_at >= t - INTERVAL 120 HOUR AND b.last_member_at >= t - INTERVAL 120 HOUR)
"""


@query("merge_pairs_theta", _PAIRS + "SELECT c1, c2, n1, n2, round(similarity, 6) AS similarity FROM pairs WHERE similarity > 0.1 ORDER BY pairs.similarity DESC, c1, c2 LIMIT 10")
def merge_pairs_theta(m):
    return ops.merge_pairs(centroids(m), as_of(), similarity=0.1)


@query("merge_clusters")
def merge_clusters(m):
    return ops.merge_clusters(m.article_clusters(), ops.merge_pairs(centroids(m), as_of(), similarity=0.1))


@query("novelty_min_distance", _CENTROIDS + f""", top20 AS (SELECT centroid AS tc FROM cluster_scores JOIN centroids USING (cluster_id), now WHERE centroid IS NOT NULL AND latest_pub >= t - INTERVAL 72 HOUR ORDER BY score DESC, cluster_id LIMIT 20)
    SELECT cluster_id, abs(round(min(1 - {_COS.format(a="centroid", b="tc")}), 6)) AS distance FROM centroids, top20 WHERE centroid IS NOT NULL GROUP BY 1""")
def novelty_min_distance(m):
    return ops.novelty(centroids(m), cluster_scores(m), as_of()).select("cluster_id", F.abs("distance").alias("distance"))


@query("assign_clusters")
def assign_clusters(m):
    """Memberships are known up to two days ago; the articles fetched since are to be assigned."""
    old = m.articles().where(F.col("fetched_at") < hours_before(as_of(), 48)).select("article_id")
    return ops.assign_clusters(m.articles(), m.article_clusters().join(old, "article_id", "left_semi"), as_of(), similarity=0.25)


@query("split_clusters")
def split_clusters(m):
    members = m.article_clusters().select("article_id", F.floor(F.col("cluster_id") / 8).alias("cluster_id"))
    return ops.split_clusters(members, m.articles(), least=4, similarity=0.25, most=25)


@query("cluster_key", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(translate(lower(coalesce(trim(text), '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'to', 'of', 'in', 'on', 'for', 'with', 'by', 'from', 'at', 'is', 'are', 'was', 'were', 'be', 'as'))[1:8], '-') AS key FROM documents", model=False)
def cluster_key(m):
    return m.raw("documents").select("doc_id", texts.cluster_key(F.trim("text")).alias("key"))


@query("lead_and_size", "SELECT cluster_id, article_id AS lead_article_id, size FROM (SELECT cluster_id, article_id, count(*) OVER (PARTITION BY cluster_id) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN regexp_matches(canonical_url, 'news\\.google\\.|news\\.yahoo\\.com|www\\.msn\\.com|^https?://([a-z0-9-]+\\.)*(fool\\.com)(/|$)') OR published_at IS NULL OR abs(epoch(published_at) - epoch(fetched_at)) <= 60 THEN 0 ELSE 1 END DESC, coalesce(s.weight, 2) DESC, published_at DESC NULLS FIRST, article_id DESC) AS rn FROM article_clusters JOIN articles USING (article_id) LEFT JOIN sources s USING (source_id) WHERE language_code = 'en' OR language_code IS NULL) WHERE rn = 1")
def lead_and_size(m):
    rows = ops.article_star(*base(m))
    bad = scores.lead_ineligible(F.col("canonical_url"), F.col("published_at"), F.col("fetched_at"))
    key = F.struct(~bad, F.coalesce("raw_weight", F.lit(2)), F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp")), "article_id")
    return rows.groupBy("cluster_id").agg(F.max_by("article_id", key).alias("lead_article_id"), F.count("*").alias("size"))


@query("cluster_metadata", "SELECT cluster_id, arg_max(article_id, struct_pack(e := eligible, w := coalesce(raw_weight, 2), p := coalesce(published_at, TIMESTAMP '9999-01-01'), i := article_id)) AS lead_article_id, count(*) AS size FROM (SELECT c.cluster_id, s.* EXCLUDE (cluster_id) FROM article_clusters c JOIN scored s USING (article_id)), now WHERE fetched_at >= t - INTERVAL 120 HOUR GROUP BY 1")
def cluster_metadata(m):
    rows = ops.article_star(*base(m)).where(F.col("fetched_at") >= hours_before(as_of(), 120))
    bad = scores.lead_ineligible(F.col("canonical_url"), F.col("published_at"), F.col("fetched_at"))
    key = F.struct(~bad, F.coalesce("raw_weight", F.lit(2)), F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp")), "article_id")
    return rows.groupBy("cluster_id").agg(F.max_by("article_id", key).alias("lead_article_id"), F.count("*").alias("size"))


@query("cluster_health_view", "SELECT cluster_id, count(*) AS size, min(published_at)::DATE::VARCHAR AS oldest, max(published_at)::DATE::VARCHAR AS newest, count(embedding) AS embedded, count(DISTINCT source_id) AS distinct_sources FROM article_clusters JOIN articles USING (article_id) GROUP BY 1")
def cluster_health_view(m):
    rows = m.article_clusters().join(m.articles(), "article_id")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("published_at").cast("date").cast("string").alias("oldest"), F.max("published_at").cast("date").cast("string").alias("newest"), F.count("embedding").alias("embedded"), F.count_distinct("source_id").alias("distinct_sources")).orderBy(F.col("size").desc(), "cluster_id")


@query("cluster_size_buckets", ", s AS (SELECT cluster_id, count(*) AS size FROM article_clusters JOIN articles USING (article_id), now WHERE fetched_at >= t - INTERVAL 168 HOUR AND (language_code = 'en' OR language_code IS NULL) GROUP BY 1) SELECT count(*) AS total_clusters, count(*) FILTER (WHERE size = 1) AS singletons, count(*) FILTER (WHERE size BETWEEN 2 AND 5) AS small, count(*) FILTER (WHERE size BETWEEN 6 AND 15) AS medium, count(*) FILTER (WHERE size BETWEEN 16 AND 25) AS large, count(*) FILTER (WHERE size > 25) AS oversized, coalesce(max(size), 0) AS max_size, (SELECT round(100.0 * count(embedding) / greatest(count(*), 1), 1) FROM articles, now WHERE fetched_at >= t - INTERVAL 168 HOUR AND (language_code = 'en' OR language_code IS NULL)) AS embedded_pct FROM s")
def cluster_size_buckets(m):
    recent = m.articles().where((F.col("fetched_at") >= hours_before(as_of(), 168)) & scores.visible_language(F.col("language_code")))
    size = F.col("size")
    sizes = m.article_clusters().join(recent, "article_id").groupBy("cluster_id").agg(F.count("*").alias("size"))
    one = sizes.agg(
        F.count("*").alias("total_clusters"),
        *[F.count_if(c).alias(n) for n, c in (("singletons", size == 1), ("small", size.between(2, 5)), ("medium", size.between(6, 15)), ("large", size.between(16, 25)), ("oversized", size > 25))],
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
    )
    return one.join(recent.agg(F.round(100.0 * F.count("embedding") / F.greatest(F.count("*"), F.lit(1)), 1).alias("embedded_pct")))


@query("latest_lead_time", "SELECT max(published_at) AS latest FROM cluster_scores c JOIN articles a ON a.article_id = c.lead_article_id, now WHERE published_at >= t - INTERVAL 168 HOUR")
def latest_lead_time(m):
    leads = cluster_scores(m).select("lead_article_id")
    a = m.articles().where(F.col("published_at") >= hours_before(as_of(), 168))
    return a.join(leads, F.col("article_id") == F.col("lead_article_id"), "left_semi").agg(F.max("published_at").alias("latest"))


@query("orphan_scores_anti", "SELECT cluster_id FROM (SELECT DISTINCT cluster_id FROM article_clusters) WHERE cluster_id NOT IN (SELECT cluster_id FROM art)")
def orphan_scores_anti(m):
    visible = ops.one_cluster_per_article(ops.article_star(*base(m))).select("cluster_id")
    return m.article_clusters().select("cluster_id").distinct().join(visible, "cluster_id", "left_anti")


@query("river_snapshot", _SERVED + "SELECT t.cluster_id, top_rank, latest_rank FROM (SELECT row_number() OVER (ORDER BY served DESC, activity_at DESC, cluster_id) AS top_rank, cluster_id FROM served, now WHERE activity_at >= t - INTERVAL 72 HOUR AND NOT regexp_matches(canonical_url, 'news\\.google\\.|fool\\.com') AND (strong_sources >= 2 OR lead_weight >= 8) QUALIFY top_rank <= 10) t FULL JOIN (SELECT row_number() OVER (ORDER BY activity_at DESC, cluster_id) AS latest_rank, cluster_id FROM served, now WHERE activity_at >= t - INTERVAL 168 HOUR AND NOT regexp_matches(canonical_url, 'news\\.google\\.|fool\\.com') QUALIFY latest_rank <= 20) l USING (cluster_id)".replace("SELECT t.cluster_id", "SELECT cluster_id"))
def river_snapshot(m):
    c = cluster_scores(m)
    top = ops.river_clusters(c, *base(m), as_of(), window_h=72).select("cluster_id", F.col("rank").alias("top_rank"))
    latest = ops.river_clusters(c, *base(m), as_of(), latest=True, window_h=168, limit=20).select("cluster_id", F.col("rank").alias("latest_rank"))
    return top.join(latest, "cluster_id", "full")


_TERMS = r""", fields AS (
  SELECT article_id, 1 AS k, 'A' AS field, 1.0::DOUBLE AS weight, concat_ws(' ', title, rewritten_title) AS x FROM articles UNION ALL SELECT article_id, 2, 'B', 0.4, concat_ws(' ', dek, publisher_name, author) FROM articles UNION ALL SELECT article_id, 3, 'C', 0.1, coalesce(content_text, '') FROM articles
), cut AS (
  SELECT *, list_filter(regexp_split_to_array(translate(lower(x), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM fields
), placed AS (
  SELECT article_id, field, weight, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) + before AS pos FROM (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY article_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cut)
), known AS (
  SELECT * FROM placed WHERE length(term) >= 2 AND term NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'to', 'of', 'in', 'on', 'for', 'with', 'by', 'from', 'at', 'is', 'are', 'was', 'were', 'be', 'as')
), terms AS (
  SELECT article_id, term, field, weight, count(*) AS hits FROM known GROUP BY ALL
), stems AS (
  """ + stem_oracle("(SELECT DISTINCT term FROM known)", "term") + r"""
), hit AS (
  SELECT article_id, stem, pos, sum(1 / weight) OVER o AS heavy, count(*) OVER o AS n, 1 / weight AS own FROM known JOIN stems USING (term) WHERE stem IN ('that', 'thi') WINDOW o AS (PARTITION BY article_id ORDER BY pos)
), lasts AS (
  SELECT *, max(pos) FILTER (WHERE stem = 'that') OVER o AS a, max(pos) FILTER (WHERE stem = 'thi') OVER o AS b FROM hit WINDOW o AS (PARTITION BY article_id ORDER BY pos)
), ends AS (
  SELECT article_id, least(a, b) AS p, min(pos) AS q FROM lasts WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL
), covers AS (
  SELECT e.article_id, e.q - e.p AS span, q.n - p.n + 1 AS n, q.heavy - p.heavy + p.own AS heavy FROM ends e JOIN hit p ON p.article_id = e.article_id AND p.pos = e.p JOIN hit q ON q.article_id = e.article_id AND q.pos = e.q
), kw AS (
  SELECT article_id, round(sum(n / heavy / (1 + span - (n - 1))), 9) AS rank FROM covers GROUP BY 1
), kwtop AS (SELECT article_id, rank, row_number() OVER (ORDER BY rank DESC, article_id) - 1 AS r FROM kw QUALIFY r < 40)
, sem AS (SELECT article_id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS similarity FROM articles, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) WHERE embedding IS NOT NULL)
, semtop AS (SELECT article_id, similarity, row_number() OVER (ORDER BY similarity DESC, article_id) - 1 AS r FROM sem WHERE similarity > 0.1 QUALIFY r < 40)
"""


@query("weighted_terms", _TERMS + "SELECT article_id, term, field, weight, hits FROM terms")
def weighted_terms(m):
    return ops.weighted_terms(m.articles())


@query("build_text_index", _TERMS + "SELECT article_id, term, field, hits FROM terms WHERE article_id NOT IN (SELECT article_id FROM articles WHERE rewritten_title IS NOT NULL)")
def build_text_index(m):
    """Articles with a rewritten title are indexed first; the update over all adds the rows of the others, which are the second batch."""
    index = TextIndex(m.spark, new_path(m.spark, "text-index"))
    index.update(m.articles().where("rewritten_title is not null"), 0)
    index.update(m.articles(), 1)
    return index.rows().where("batch = 1").select("article_id", "term", "field", "hits")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(m: Model, name: str) -> tuple[str, bool]:
    """Where the session keeps an index over the tables, and whether it is there already."""
    key = (m.spark.sparkContext.applicationId, m.sf_dir, name)
    there = key in _STORED
    return _STORED.setdefault(key, new_path(m.spark, name)), there


def keyword(m):
    """The session's index is brought up to date with articles that it lacks, then searched."""
    index = TextIndex(m.spark, stored(m, "text-index")[0])
    index.update(m.articles(), index.next_batch())
    return index.search("that this", 40)


def semantic(m):
    """The articles' vectors are stored as an index, whose cells the search prunes; new ones are appended."""
    vectors = m.articles().where("embedding is not null").select(F.col("article_id").alias("id"), unit(F.col("embedding")).alias("v"))
    index = VectorIndex.kept_up(vectors, *stored(m, "article-index"))
    asked = m.raw("embeddings").where("vec_id = 7").select(unit(F.col("embedding"))).first()[0]
    return index.search(asked, 40, least=0.1).withColumnRenamed("id", "article_id")


@query("topk_keyword", _TERMS + "SELECT article_id, round(rank, 6) AS rank FROM kwtop")
def topk_keyword(m):
    return keyword(m)


@query("topk_semantic", _TERMS + "SELECT article_id, round(similarity, 6) AS similarity FROM semtop")
def topk_semantic(m):
    return semantic(m)


@query("rrf_rank", _TERMS + "SELECT article_id, k.r AS keyword_rank, s.r AS semantic_rank FROM kwtop k FULL JOIN semtop s USING (article_id)")
def rrf_rank(m):
    from pyspark.sql import Window

    k = keyword(m).select("article_id", (F.row_number().over(Window.orderBy(F.col("rank").desc(), "article_id")) - 1).alias("keyword_rank"))
    s = semantic(m).select("article_id", (F.row_number().over(Window.orderBy(F.round("similarity", DIGITS).desc(), "article_id")) - 1).alias("semantic_rank"))
    return k.join(s, "article_id", "full")


@query("hybrid_search", _TERMS + "SELECT article_id, round(coalesce(1.0::DOUBLE / (60 + k.r + 1), 0) + coalesce(1.0::DOUBLE / (60 + s.r + 1), 0), 6) AS score FROM kwtop k FULL JOIN semtop s USING (article_id) ORDER BY coalesce(1.0::DOUBLE / (60 + k.r + 1), 0) + coalesce(1.0::DOUBLE / (60 + s.r + 1), 0) DESC, article_id LIMIT 20")
def hybrid_search(m):
    return ops.reciprocal_rank_fusion(keyword(m), semantic(m))


@query("search_card", "SELECT article_id AS cluster_id, coalesce(rewritten_title, title) AS lead_title, canonical_url AS lead_url, 1 AS size, 0 AS subs_total, published_at FROM articles")
def search_card(m):
    return m.articles().select(F.col("article_id").alias("cluster_id"), F.coalesce("rewritten_title", "title").alias("lead_title"), F.col("canonical_url").alias("lead_url"), F.lit(1).alias("size"), F.lit(0).alias("subs_total"), "published_at")


@query("river_param_check", "SELECT event_id, CASE WHEN NOT event_id % 800 BETWEEN 1 AND 720 THEN 'window' WHEN NOT user_id BETWEEN 1 AND 100 THEN 'limit' WHEN event_type NOT IN ('view', 'click') THEN 'view' END AS problem FROM events", model=False)
def river_param_check(m):
    """Requests for feeds as events: window and limit from ids, the view from the type."""
    problem = ops.feed_parameter_problem(F.col("event_id") % 800, F.col("user_id"), F.col("event_type"), F.lit(None).cast("string"), views=("view", "click"))
    return m.raw("events").select("event_id", problem.alias("problem"))
