"""SQL of the model tables, as the common head of every oracle query."""

PRELUDE = r"""
WITH RECURSIVE now AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t, TIMESTAMP '2001-11-05 00:00:00' AS d), sources AS (
  SELECT s_suppkey AS source_id, s_name AS name, 'https://www.outlet' || (s_suppkey % 40) || '.example.com/' AS homepage_url,
    CASE s_suppkey % 4 WHEN 0 THEN 'http://feeds.outlet' || s_suppkey || '.example.com/rss' WHEN 1 THEN 'web://outlet' || s_suppkey || '.example.com'
      WHEN 2 THEN 'discover://outlet' || s_suppkey || '.example.com' ELSE 'disabled://http://outlet' || s_suppkey || '.example.com/rss' END AS feed_url,
    CASE WHEN s_suppkey % 17 <> 0 THEN 1 + s_suppkey % 10 END AS weight,
    CASE WHEN s_suppkey % 23 = 0 THEN 'web-discovery' ELSE 'outlet-' || s_suppkey END AS slug,
    CASE WHEN s_suppkey % 5 <> 0 THEN make_timestamp((1706659200 - (s_suppkey % 40) * 3600) * 1000000) END AS last_fetched_at,
    CASE WHEN s_suppkey % 7 = 0 THEN 'error' WHEN s_suppkey % 5 <> 0 THEN 'ok' END AS last_fetch_status, s_suppkey % 9 AS last_fetch_count
  FROM supplier
), articles AS (
  SELECT k AS article_id, k % 13 AS source_id, trim(substr(text, 1, 60)) AS title,
    CASE k % 31 WHEN 0 THEN 'https://news.google.com/rss/articles/' || k WHEN 1 THEN 'https://www.fool.com/x/' || k WHEN 2 THEN 'https://www.nature.com/articles/s41558-' || k
      WHEN 3 THEN 'https://www.nytimes.com/a/' || k ELSE 'https://www.outlet' || (k % 40) || '.example.com/story/' || k END AS canonical_url,
    CASE WHEN k % 29 <> 0 THEN make_timestamp(b * 1000000) END AS published_at, make_timestamp((b + k % 180) * 1000000) AS fetched_at,
    substr(text, 61, (k % 3) * 80) AS dek, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '' ELSE 'Author ' || (k % 20) END AS author,
    CASE WHEN k % 6 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE 'Outlet ' || (k % 40) END AS publisher_name,
    CASE WHEN k % 2 = 0 THEN NULL WHEN k % 9 = 0 THEN '' ELSE 'https://www.outlet' || (k % 40) || '.example.com' END AS publisher_homepage,
    st AS content_status, CASE WHEN st = 'success' THEN n_chars // 6 END AS content_word_count, text AS content_text,
    CASE WHEN st IS NOT NULL THEN make_timestamp((b + 3600) * 1000000) END AS content_fetched_at, CASE WHEN st = 'success' AND k % 3 = 1 THEN 'https://img.example.com/' || k || '.jpg' END AS content_image, CASE WHEN k % 11 <> 0 THEN lang END AS language_code,
    CASE WHEN k % 3 = 0 THEN 'Re: ' || trim(substr(text, 1, 60)) END AS rewritten_title,
    CASE WHEN k % 10 < 3 THEN 'error' WHEN k % 10 < 5 THEN 'no_category' WHEN k % 10 < 6 THEN 'done' END AS categorise_status,
    CASE WHEN k % 10 < 6 THEN k % 5 END AS categorise_attempts, CASE WHEN k % 10 < 6 THEN make_timestamp((b + (k % 4) * 1800) * 1000000) END AS categorised_at, embedding
  FROM (SELECT doc_id AS k, *, 1706659200 - ((doc_id * 37) % 14400) * 60 AS b,
      CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 8 <= 4 THEN 'success' WHEN doc_id % 8 = 5 THEN 'error' WHEN doc_id % 8 = 6 THEN 'blocked' ELSE 'paywall' END AS st
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
), article_clusters AS (
  SELECT vec_id AS article_id, (label * 8 + vec_id % 8)::BIGINT AS cluster_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT vec_id, ((label * 8 + vec_id % 8 + 1) % 80)::BIGINT FROM embeddings WHERE vec_id % 25 = 0 AND vec_id IN (SELECT doc_id FROM documents)
), categories AS (
  SELECT * FROM (VALUES (0, 'government'), (1, 'justice'), (2, 'business'), (3, 'impacts'), (4, 'tech'), (5, 'research')) v(category_id, slug)
), article_categories AS (
  SELECT a AS article_id, (a + n) % 6 AS category_id, 0.2::DOUBLE + ((a * 7 + n * 3) % 17) / 20.0::DOUBLE AS confidence, n = 0 AS is_primary,
    CASE WHEN a % 5 <> 0 THEN (a % 4) / 4.0::DOUBLE END AS rule_confidence
  FROM (SELECT doc_id AS a, unnest(range(0, doc_id % 3 + 1)) AS n FROM documents WHERE doc_id % 4 <> 3)
), article_events AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS article_id, event_type AS event, user_id::VARCHAR AS session_id, ts AS occurred_at FROM events
), discovery_searches AS (
  SELECT o_orderkey AS search_id, 'run-' || (o_orderkey // 7) AS run_id, ['exa', 'openai_web_search', 'gn_site'][o_orderkey % 3 + 1] AS provider,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'model-' || (o_orderkey % 2) END AS model, 'segment-' || (o_orderkey % 6) AS segment, o_orderkey % 4 AS tool_calls,
    round(o_totalprice / 1000000, 6) AS cost_usd, o_orderkey % 900 + 100 AS latency_ms, CASE WHEN o_orderkey % 9 = 0 THEN 'error' ELSE 'success' END AS status,
    o_orderdate::TIMESTAMP AS created_at FROM orders
), discovery_candidates AS (
  SELECT l_orderkey AS search_id, l_linenumber AS rank, ['exa', 'openai_web_search', 'gn_site'][l_orderkey % 3 + 1] AS provider,
    'host' || (l_partkey % 60) || '.example.com' AS host, 'https://host' || (l_partkey % 60) || '.example.com/p/' || (l_suppkey % 50) AS url,
    CASE WHEN m < 2 THEN true WHEN m > 2 THEN false END AS accepted,
    CASE WHEN m > 2 THEN ['stale', 'duplicate_url', 'missing_date', 'unreachable', 'non_climate'][m - 2] END AS reason,
    CASE WHEN m = 4 THEN l_partkey END AS duplicate_article_id, l_shipdate::TIMESTAMP AS created_at
  FROM (SELECT *, (l_orderkey * 3 + l_linenumber) % 8 AS m FROM lineitem)
), rewrite_attempts AS (
  SELECT l_orderkey % 500 AS article_id, l_linenumber AS attempt_idx, 'model-' || (l_orderkey % 3) AS model, l_returnflag = 'A' AS accepted,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_orderkey % 4 = 0 THEN 'llm_error' ELSE 'length' END WHEN l_returnflag = 'N' THEN 'unchanged' END AS reason,
    l_quantity::BIGINT AS input_tokens, l_orderkey % 50 AS output_tokens, l_orderkey % 4000 AS latency_ms, l_shipdate::TIMESTAMP AS created_at FROM lineitem
), pipeline_runs AS (
  SELECT o_orderkey AS run_id, ['refresh', 'full', 'rewrite', 'cleanup'][o_orderkey % 4 + 1] AS job_name, make_timestamp((epoch(o_orderdate::TIMESTAMP)::BIGINT + o_orderkey % 86400) * 1000000) AS started_at,
    o_orderkey % 60000 AS duration_ms, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status FROM orders
), art AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT c.cluster_id, a.*, s.name AS source_name, s.weight AS raw_weight, s.homepage_url,
      lower(regexp_replace(split_part(split_part(split_part(canonical_url, '://', 2), '/', 1), ':', 1), '^(www|m|mobile|amp|amp-cdn|edition|news|beta)\.', '')) AS host,
      CASE WHEN regexp_matches(canonical_url, 'nature\.com/articles/s415(58|60)-') THEN least(coalesce(s.weight, 2), 6) ELSE coalesce(s.weight, 2) END AS weight,
      regexp_matches(canonical_url, 'news\.google\.|news\.yahoo\.com|www\.msn\.com') AS is_aggregator, regexp_matches(canonical_url, '^https?://([a-z0-9-]+\.)*(fool\.com)(/|$)') AS is_low,
      row_number() OVER (PARTITION BY a.article_id ORDER BY c.cluster_id) AS rn
    FROM article_clusters c JOIN articles a USING (article_id) LEFT JOIN sources s USING (source_id) WHERE language_code = 'en' OR language_code IS NULL) WHERE rn = 1
), scored AS (
  SELECT art.*, CASE WHEN NOT (is_aggregator OR is_low OR published_at IS NULL OR abs(epoch(published_at) - epoch(fetched_at)) <= 60) THEN 1 ELSE 0 END AS eligible,
    least(1.0::DOUBLE, greatest(0.0001::DOUBLE, exp(ln(0.5::DOUBLE) * least((epoch(t) - epoch(coalesce(published_at, t))) / 3600.0::DOUBLE / 6, 10)))) AS fresh,
    weight + CASE WHEN trim(coalesce(author, '')) <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN length(coalesce(dek, '')) >= 120 THEN 0.1::DOUBLE ELSE 0 END
      - CASE WHEN is_aggregator THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN is_low THEN 0.6::DOUBLE ELSE 0 END AS quality
  FROM art, now
), rollup_ AS (
  SELECT cluster_id, count(*) AS size, count(DISTINCT source_id) AS distinct_sources, max(published_at) AS latest_pub, min(published_at) AS first_pub, sum(weight) AS sum_w, avg(weight) AS avg_w,
    max(weight) AS max_w, count(DISTINCT host) FILTER (WHERE weight >= 4) AS strong_sources,
    count(DISTINCT source_id) FILTER (WHERE published_at BETWEEN t - INTERVAL 4 HOUR AND t) AS v4, sum(0.4::DOUBLE * quality + 0.6::DOUBLE * fresh) AS pool,
    arg_max(article_id, struct_pack(a := eligible, b := 0.8::DOUBLE * quality + 0.2::DOUBLE * fresh, c := -article_id)) AS lead_article_id
  FROM scored, now GROUP BY cluster_id
), velocity AS (
  SELECT cluster_id, sum(w) / 10.0::DOUBLE AS vw FROM (SELECT cluster_id, host, max(weight) AS w FROM art, now WHERE published_at BETWEEN t - INTERVAL 24 HOUR AND t GROUP BY ALL) GROUP BY cluster_id
), base AS (
  SELECT r.*, coalesce(vw, 0) AS vw,
    ln(1 + least(coalesce(vw, 0), 10)) / ln(11::DOUBLE) AS velocity_norm,
    (ln(1 + least(sum_w, 100)) + 0.8::DOUBLE * ln(1 + least(distinct_sources, 10)) + 0.4::DOUBLE * ln(1 + least(size, 15))) / (ln(101::DOUBLE) + 0.8::DOUBLE * ln(11::DOUBLE) + 0.4::DOUBLE * ln(16::DOUBLE)) AS coverage_norm,
    least(max_w, 10) / 10.0::DOUBLE AS authority_norm, ln(1 + least(pool, 50)) / ln(51::DOUBLE) AS pool_norm,
    least(1.0::DOUBLE, greatest(0.0001::DOUBLE, exp(ln(0.5::DOUBLE) * least((epoch(t) - epoch(latest_pub)) / 3600.0::DOUBLE / 12, 10)))) AS cluster_fresh,
    CASE WHEN first_pub IS NULL THEN 1.0::DOUBLE ELSE greatest(0.7::DOUBLE, least(1.0::DOUBLE, exp(ln(0.5::DOUBLE) * least((epoch(t) - epoch(first_pub)) / 3600.0::DOUBLE / 168, 20)))) END AS damping
  FROM rollup_ r LEFT JOIN velocity USING (cluster_id), now
), cluster_scores AS (
  SELECT *, (base_score + 0.30::DOUBLE * cluster_fresh) * damping AS score
  FROM (SELECT *, 0.35::DOUBLE * velocity_norm + 0.15::DOUBLE * coverage_norm + 0.15::DOUBLE * authority_norm + 0.05::DOUBLE * pool_norm AS base_score FROM base)
)
"""


def oracle(body: str) -> str:
    """``body`` over the model tables."""
    return PRELUDE + body
