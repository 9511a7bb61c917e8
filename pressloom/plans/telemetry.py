"""Queries over telemetry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import scores, urls
from pressloom.operators import telemetry as ops
from pressloom.plans.registry import query
from pressloom.plans.stories import cluster_scores
from pressloom.sources.model import Model, as_of, discovery_as_of, hours_before

WEEKS = 24 * 60  # the test tables are sparse, so windows are widened to 60 days
_D = "now, discovery_candidates c WHERE c.created_at >= d - INTERVAL 1440 HOUR"


def searches(m: Model):
    return ops.since(m.discovery_searches(), discovery_as_of(), 24 * 200)


def candidates(m: Model):
    return ops.since(m.discovery_candidates(), discovery_as_of(), WEEKS)


_S = "(SELECT s.* FROM discovery_searches s, now WHERE created_at >= d - INTERVAL 4800 HOUR)"
_C = "(SELECT c.* FROM discovery_candidates c, now WHERE created_at >= d - INTERVAL 1440 HOUR)"


@query(
    "provider_yield",
    f"""SELECT s.provider, searches, total_cost_usd, coalesce(c, 0) AS candidates, coalesce(i, 0) AS inserted, round(100.0 * coalesce(i, 0) / nullif(coalesce(c, 0), 0), 1) AS accept_pct,
      round(total_cost_usd / nullif(coalesce(i, 0), 0), 6) AS cost_per_insert_usd, avg_latency_ms, total_tool_calls
    FROM (SELECT provider, count(*) AS searches, round(sum(cost_usd), 4) AS total_cost_usd, round(avg(latency_ms)) AS avg_latency_ms, sum(tool_calls)::BIGINT AS total_tool_calls FROM {_S} GROUP BY 1) s
    LEFT JOIN (SELECT provider, count(*) AS c, count(*) FILTER (WHERE accepted) AS i FROM {_C} GROUP BY 1) c USING (provider)""",
)
def provider_yield(m):
    return ops.provider_yield(searches(m), candidates(m))


@query("rejection_distribution", f"SELECT provider, outcome, n, round(100.0 * n / sum(n) OVER (PARTITION BY provider), 1) AS pct_of_provider FROM (SELECT provider, coalesce(reason, 'inserted') AS outcome, count(*) AS n FROM {_C} GROUP BY ALL)")
def rejection_distribution(m):
    return ops.rejection_distribution(candidates(m))


@query("pct_of_group", "SELECT segment, provider, n, round(100.0 * n / sum(n) OVER (PARTITION BY segment), 1) AS pct FROM (SELECT segment, provider, count(*) AS n FROM discovery_searches GROUP BY ALL)")
def pct_of_group(m):
    from pyspark.sql import Window

    n = m.discovery_searches().groupBy("segment", "provider").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("segment")), 1))


@query("cross_provider_dupes", f"SELECT provider, count(*) FILTER (WHERE reason = 'duplicate_url') AS dupes_of_existing_articles, count(duplicate_article_id) AS dupes_with_known_origin, count(*) FILTER (WHERE accepted) AS unique_inserts FROM {_C} GROUP BY 1")
def cross_provider_dupes(m):
    return ops.cross_provider_dupes(candidates(m))


@query("recency_reject_rate", f"SELECT provider, count(*) AS candidates, count(*) FILTER (WHERE reason IN ('stale', 'missing_date', 'invalid_date')) AS rejected_for_recency, round(100.0 * count(*) FILTER (WHERE reason IN ('stale', 'missing_date', 'invalid_date')) / count(*), 1) AS recency_reject_pct FROM {_C} GROUP BY 1")
def recency_reject_rate(m):
    return ops.recency_reject_rate(candidates(m))


@query("top_hosts", f"SELECT host, count(*) FILTER (WHERE accepted) AS inserted, count(*) AS candidates, round(100.0 * count(*) FILTER (WHERE accepted) / count(*), 1) AS accept_pct, string_agg(DISTINCT provider, ', ' ORDER BY provider) AS providers FROM {_C} GROUP BY 1 HAVING count(*) >= 3 ORDER BY inserted DESC, candidates DESC, host LIMIT 30")
def top_hosts(m):
    return ops.top_hosts(candidates(m))


@query("unreachable_hosts", f"SELECT host, count(*) FILTER (WHERE reason = 'unreachable') AS unreachable_count, count(*) AS total_candidates, round(100.0 * count(*) FILTER (WHERE reason = 'unreachable') / count(*), 1) AS unreachable_pct FROM {_C} GROUP BY 1 HAVING unreachable_count > 0 ORDER BY unreachable_count DESC, host LIMIT 25")
def unreachable_hosts(m):
    return ops.unreachable_hosts(candidates(m))


@query("run_rollup", f"SELECT run_id, started_at, searches, coalesce(candidates, 0) AS candidates, coalesce(inserts, 0) AS inserts, cost_usd, providers_used FROM (SELECT run_id, min(created_at) AS started_at, count(*) AS searches, round(sum(cost_usd), 4) AS cost_usd, string_agg(DISTINCT provider, ', ' ORDER BY provider) AS providers_used FROM {_S} GROUP BY 1) LEFT JOIN (SELECT run_id, count(c.search_id) AS candidates, count(*) FILTER (WHERE accepted) AS inserts FROM {_S} s LEFT JOIN discovery_candidates c ON c.search_id = s.search_id GROUP BY 1) USING (run_id) ORDER BY started_at DESC, run_id LIMIT 20")
def run_rollup(m):
    return ops.run_rollup(searches(m), m.discovery_candidates())


_TREND = f", s14 AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS day, * FROM {_S} WHERE provider IN ('exa', 'openai_web_search')) "


@query("daily_model_trend", _TREND + "SELECT s.day, s.provider, s.model, coalesce(c, 0) AS candidates, coalesce(i, 0) AS inserts, round(100.0 * coalesce(st, 0) / nullif(coalesce(c, 0), 0), 1) AS stale_pct, round(cost_usd / nullif(coalesce(i, 0), 0), 6) AS cost_per_insert_usd FROM (SELECT day, provider, model, round(sum(cost_usd), 4) AS cost_usd FROM s14 GROUP BY ALL) s LEFT JOIN (SELECT day, s14.provider, model, count(c.search_id) AS c, count(*) FILTER (WHERE accepted) AS i, count(*) FILTER (WHERE reason = 'stale') AS st FROM s14 LEFT JOIN discovery_candidates c ON c.search_id = s14.search_id GROUP BY ALL) c ON c.day = s.day AND c.provider = s.provider AND c.model IS NOT DISTINCT FROM s.model")
def daily_model_trend(m):
    return ops.daily_model_trend(searches(m), m.discovery_candidates())


@query("null_safe_join", "SELECT a.search_id, b.n FROM discovery_searches a JOIN (SELECT provider, model, count(*) AS n FROM discovery_searches GROUP BY ALL) b ON a.provider = b.provider AND a.model IS NOT DISTINCT FROM b.model WHERE a.status = 'error'")
def null_safe_join(m):
    s = m.discovery_searches()
    n = s.groupBy(F.col("provider").alias("p"), F.col("model").alias("mo")).agg(F.count("*").alias("n"))
    return s.where("status = 'error'").join(n, (F.col("provider") == F.col("p")) & F.col("model").eqNullSafe(F.col("mo"))).select("search_id", "n")


@query("content_status_by_origin", "SELECT CASE WHEN feed_url LIKE 'web://%' OR feed_url LIKE 'web-discovery://%' THEN 'web_discovered' ELSE 'rss' END AS origin, coalesce(content_status, 'never_attempted') AS status, count(*) AS articles FROM articles JOIN sources USING (source_id) GROUP BY ALL")
def content_status_by_origin(m):
    return ops.content_status_by_origin(ops.since(m.articles(), as_of(), 24 * 14, "fetched_at"), m.sources())


@query("content_status_counts", "SELECT coalesce(content_status, 'null') AS status, count(*) AS n FROM articles WHERE article_id IN (SELECT article_id FROM article_events WHERE event = 'click') GROUP BY 1")
def content_status_counts(m):
    clicked = m.article_events().where("event = 'click'").select("article_id")
    return m.articles().join(clicked, "article_id", "left_semi").groupBy(F.coalesce("content_status", F.lit("null")).alias("status")).agg(F.count("*").alias("n"))


def metrics(m):
    return ops.health_metrics(m.articles(), m.pipeline_runs(), m.rewrite_attempts(), m.discovery_searches(), m.discovery_candidates(), cluster_scores(m), as_of(), discovery_as_of(), 24 * 120)


_METRICS = """, metrics AS (
  SELECT *, CASE WHEN rewrite_attempts > 0 THEN llm_errors / rewrite_attempts END AS llm_error_share, CASE WHEN rewrite_attempts > 0 THEN rewrite_accepted / rewrite_attempts END AS rewrite_accept_share, CASE WHEN prefetch_attempted > 0 THEN prefetch_success / prefetch_attempted END AS prefetch_share,
    CASE WHEN searches > 0 THEN search_successes / searches END AS discovery_share, CASE WHEN candidates > 0 THEN accepted / candidates END AS accept_share, CASE WHEN articles_ingested_24h > 0 THEN unresolved_24h / articles_ingested_24h END AS unresolved_share, CASE WHEN leads_72h > 0 THEN hidden_72h / leads_72h END AS hidden_share_72h, CASE WHEN clusters > 0 THEN singles / clusters END AS singleton_share
  FROM (SELECT count(*) FILTER (WHERE fetched_at > t - INTERVAL 24 HOUR) AS articles_ingested_24h, count(*) FILTER (WHERE fetched_at > t - INTERVAL 2880 HOUR AND content_status IS NOT NULL) AS prefetch_attempted, count(*) FILTER (WHERE fetched_at > t - INTERVAL 2880 HOUR AND content_status = 'success') AS prefetch_success, count(*) FILTER (WHERE fetched_at > t - INTERVAL 24 HOUR AND contains(canonical_url, 'news.google.com')) AS unresolved_24h FROM articles, now),
    (SELECT count(*) FILTER (WHERE started_at > d - INTERVAL 24 HOUR AND status = 'error') AS cron_errors_24h FROM pipeline_runs, now),
    (SELECT count(*) AS rewrite_attempts, count(*) FILTER (WHERE reason = 'llm_error') AS llm_errors, count(*) FILTER (WHERE accepted) AS rewrite_accepted FROM rewrite_attempts, now WHERE created_at > d - INTERVAL 2880 HOUR),
    (SELECT count(*) FILTER (WHERE created_at > d - INTERVAL 2880 HOUR) AS searches, count(*) FILTER (WHERE created_at > d - INTERVAL 2880 HOUR AND status = 'success') AS search_successes, round(coalesce(sum(cost_usd) FILTER (WHERE provider = 'exa' AND created_at >= date_trunc('month', d)), 0), 4) AS spend_month_usd FROM discovery_searches, now),
    (SELECT count(*) AS candidates, count(*) FILTER (WHERE accepted) AS accepted FROM discovery_candidates, now WHERE created_at > d - INTERVAL 2880 HOUR),
    (SELECT count(*) FILTER (WHERE rewritten_title IS NULL AND fetched_at > t - INTERVAL 168 HOUR) AS unrewritten_leads_7d, count(*) FILTER (WHERE published_at > t - INTERVAL 72 HOUR) AS leads_72h, count(*) FILTER (WHERE published_at > t - INTERVAL 72 HOUR AND contains(canonical_url, 'news.google.')) AS hidden_72h, count(*) AS clusters, count(*) FILTER (WHERE size = 1) AS singles FROM cluster_scores c JOIN articles a ON a.article_id = c.lead_article_id, now))
"""
_SHARES = ", ".join(f"round({c}, 6) AS {c}" for c in ("llm_error_share", "rewrite_accept_share", "prefetch_share", "discovery_share", "accept_share", "unresolved_share", "hidden_share_72h", "singleton_share"))
_BREACHES = """list_filter([CASE WHEN articles_ingested_24h = 0 THEN 'no_articles_ingested_24h' END, CASE WHEN cron_errors_24h > 0 THEN 'cron_errors_24h' END, CASE WHEN rewrite_attempts >= 20 AND llm_error_share > 0.1 THEN 'rewrite_llm_error_share' END,
  CASE WHEN prefetch_attempted >= 50 AND prefetch_share < 0.3 THEN 'prefetch_success_share' END, CASE WHEN searches >= 10 AND discovery_share < 0.5 THEN 'discovery_success_share' END, CASE WHEN candidates >= 50 AND accept_share < 0.05 THEN 'discovery_accept_share' END,
  CASE WHEN articles_ingested_24h >= 100 AND unresolved_share > 0.25 THEN 'unresolved_share_24h' END, CASE WHEN spend_month_usd >= 8 THEN 'spend_month_usd' END], lambda x: x IS NOT NULL)"""


@query("health_metrics", _METRICS + f"SELECT * REPLACE ({_SHARES}) FROM metrics")
def health_metrics(m):
    return metrics(m)


@query("health_breaches", _METRICS + f"SELECT array_to_string({_BREACHES}, ',') AS breaches FROM metrics")
def health_breaches(m):
    return ops.health_breaches(metrics(m)).select(F.array_join("breaches", ",").alias("breaches"))


@query("pipeline_health", _METRICS + f"SELECT len({_BREACHES}) = 0 AS ok, array_to_string({_BREACHES}, ',') AS breaches, articles_ingested_24h, searches, candidates, clusters FROM metrics")
def pipeline_health(m):
    return ops.health_breaches(metrics(m)).select("ok", F.array_join("breaches", ",").alias("breaches"), "articles_ingested_24h", "searches", "candidates", "clusters")


@query("month_to_date_spend", "SELECT round(coalesce(sum(cost_usd), 0), 4) AS usd FROM discovery_searches, now WHERE provider = 'exa' AND created_at >= date_trunc('month', d - INTERVAL 100 DAY)")
def month_to_date_spend(m):
    start = F.date_trunc("month", hours_before(discovery_as_of(), 2400))
    return m.discovery_searches().where((F.col("provider") == "exa") & (F.col("created_at") >= start)).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("usd"))


@query("feed_health", "SELECT count(*) AS total, count(*) FILTER (WHERE last_fetch_status = 'ok') AS healthy, count(*) FILTER (WHERE last_fetch_status = 'error') AS erroring, count(*) FILTER (WHERE last_fetched_at < t - INTERVAL 24 HOUR OR last_fetched_at IS NULL) AS stale FROM sources, now WHERE NOT regexp_matches(feed_url, '^(discover|web|web-discovery|disabled)://')")
def feed_health(m):
    return ops.feed_health(m.sources(), as_of())


@query("last_n_runs", "SELECT job_name, place, run_id, started_at, status FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY started_at DESC, run_id) AS place FROM pipeline_runs) WHERE place <= 5")
def last_n_runs(m):
    return ops.last_runs(m.pipeline_runs()).select("job_name", "place", "run_id", "started_at", "status")


_JOBS = "SELECT job_name, max(started_at) AS last_run, arg_max(status, struct_pack(s := started_at, k := -run_id)) AS last_status, arg_max(duration_ms, struct_pack(s := started_at, k := -run_id)) AS last_duration_ms, count(*) FILTER (WHERE status = 'error' AND started_at >= d - INTERVAL 24 HOUR) AS recent_errors, round((epoch(d) - epoch(max(started_at))) / 3600, 1) AS hours_since, (epoch(d) - epoch(max(started_at))) / 3600 > CASE job_name WHEN 'full' THEN 2500 WHEN 'cleanup' THEN 2000 ELSE 24 END AS stale FROM pipeline_runs, now GROUP BY job_name, d"


@query("job_health", _JOBS)
def job_health(m):
    return ops.job_health(m.pipeline_runs(), discovery_as_of(), {"full": 2500, "cleanup": 2000})


@query("provider_run_stats", "SELECT run_id, provider, count(*) AS searches, coalesce(sum(c), 0) AS candidates, coalesce(sum(i), 0) AS inserted, coalesce(sum(r), 0) AS rejected, round(sum(cost_usd), 6) AS cost_usd, sum(tool_calls) AS tool_calls, sum(latency_ms) AS latency_ms FROM discovery_searches LEFT JOIN (SELECT search_id, count(*) AS c, count(*) FILTER (WHERE accepted) AS i, count(*) FILTER (WHERE NOT accepted) AS r FROM discovery_candidates GROUP BY 1) USING (search_id) GROUP BY ALL")
def provider_run_stats(m):
    return ops.provider_run_stats(m.discovery_searches(), m.discovery_candidates())


@query(
    "arm_summary",
    """, f AS (SELECT model, string_agg(reason || '=' || n, ',' ORDER BY reason) AS failures FROM (SELECT model, reason, count(*) AS n FROM rewrite_attempts WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1)
    SELECT model, count(*) AS n, count(*) FILTER (WHERE accepted) AS success, count(*) FILTER (WHERE attempt_idx > 1) AS retries, count(*) FILTER (WHERE reason = 'unchanged') AS factual_failures, quantile_disc(latency_ms, 0.5)::BIGINT AS median_latency_ms,
      quantile_disc(latency_ms, 0.95)::BIGINT AS p95_latency_ms, sum(input_tokens)::BIGINT AS input_tokens, round(sum(input_tokens / 1e6 * 2.5::DOUBLE + output_tokens / 1e6 * 10::DOUBLE), 6) AS cost_usd,
      round(sum(input_tokens / 1e6 * 2.5::DOUBLE + output_tokens / 1e6 * 10::DOUBLE) / count(*) FILTER (WHERE accepted) * 1e6, 3) AS cost_per_accept_micro, any_value(failures) AS failures FROM rewrite_attempts JOIN f USING (model) GROUP BY 1""",
)
def arm_summary(m):
    rows = ops.arm_summary(m.rewrite_attempts(), factual=("unchanged",))
    listed = F.array_join(F.transform(F.map_entries("failures"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumn("failures", listed).withColumn("cost_per_accept_micro", F.round(F.col("cost_per_accept") * 1e6, 3)).drop("cost_per_accept")


@query("top_failures", "SELECT model, reason, n, row_number() OVER (PARTITION BY model ORDER BY n DESC, reason) AS place FROM (SELECT model, reason, count(*) AS n FROM rewrite_attempts WHERE reason IS NOT NULL GROUP BY ALL) QUALIFY place <= 5")
def top_failures(m):
    return ops.top_failures(m.rewrite_attempts())


@query("running_budget", "SELECT search_id, round(coalesce(sum(cost_usd) OVER w, 0), 6) AS spent_before, round(coalesce(sum(cost_usd) OVER w, 0), 6) < 5 AS allowed FROM discovery_searches WINDOW w AS (PARTITION BY date_trunc('month', created_at), provider, segment ORDER BY created_at, search_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_budget(m):
    return ops.running_budget(m.discovery_searches(), 5).select("search_id", "spent_before", "allowed")


@query("article_cap", "SELECT search_id, rank, CASE WHEN coalesce(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY search_id ORDER BY rank, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1 THEN 'article_cap_reached' ELSE coalesce(reason, 'inserted') END AS outcome FROM (SELECT search_id, rank, any_value(accepted) AS accepted, any_value(reason) AS reason, min(url) AS url FROM discovery_candidates GROUP BY ALL)")
def article_cap(m):
    one = m.discovery_candidates().groupBy("search_id", "rank").agg(F.any_value("accepted").alias("accepted"), F.any_value("reason").alias("reason"))
    return ops.article_cap(one, 1).select("search_id", "rank", "outcome")


@query("candidate_first_occurrence", "SELECT search_id, rank, url, row_number() OVER (PARTITION BY search_id, lower(url) ORDER BY rank) > 1 AS duplicate FROM discovery_candidates")
def candidate_first_occurrence(m):
    return ops.first_occurrence(m.discovery_candidates()).select("search_id", "rank", "url", "duplicate")


_PRICED = """, models AS (SELECT search_id, tool_calls, latency_ms AS input_tokens, search_id % 700 AS output_tokens, CASE search_id % 4 WHEN 0 THEN 'gpt-4o-mini-2024' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-4.1-mini' ELSE 'other' END AS model FROM discovery_searches), priced AS (
  SELECT m.*, coalesce((SELECT arg_max(i, length(k)) FROM (VALUES ('gpt-4.1-mini', 0.4), ('gpt-4o-mini', 0.15), ('gpt-4o', 2.5)) p(k, i) WHERE m.model = k OR starts_with(m.model, k || '-')), 2.5)::DOUBLE AS input_per_m, coalesce((SELECT arg_max(o, length(k)) FROM (VALUES ('gpt-4.1-mini', 1.6), ('gpt-4o-mini', 0.6), ('gpt-4o', 10)) p(k, o) WHERE m.model = k OR starts_with(m.model, k || '-')), 10)::DOUBLE AS output_per_m FROM models m) """


def priced(m):
    k = F.col("search_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("gpt-4o-mini-2024", "gpt-4o", "gpt-4.1-mini", "other")]), (k % 4 + 1).cast("int"))
    return ops.model_price(m.discovery_searches().select("search_id", "tool_calls", F.col("latency_ms").alias("input_tokens"), (k % 700).alias("output_tokens"), name.alias("model")))


@query("model_pricing_prefix", _PRICED + "SELECT search_id, model, input_per_m, output_per_m FROM priced")
def model_pricing_prefix(m):
    return priced(m).select("search_id", "model", "input_per_m", "output_per_m")


@query("call_cost", _PRICED + "SELECT search_id, round((input_tokens / 1e6 * input_per_m + output_tokens / 1e6 * output_per_m + tool_calls * 0.01::DOUBLE) * 1e6, 4) AS cost_micro_usd FROM priced")
def call_cost(m):
    return ops.call_cost(priced(m)).select("search_id", F.round(F.col("cost") * 1e6, 4).alias("cost_micro_usd"))


_PAIR = ", pairs AS (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'model-0' ELSE 'model-1' END AS candidate_a, CASE WHEN article_id % 2 = 0 THEN 'model-1' ELSE 'model-0' END AS candidate_b FROM (SELECT DISTINCT article_id FROM rewrite_attempts WHERE model = 'model-0') JOIN (SELECT DISTINCT article_id FROM rewrite_attempts WHERE model = 'model-1') USING (article_id)) "


@query("blinded_pairs", _PAIR + "SELECT * FROM pairs")
def blinded_pairs(m):
    return ops.blinded_pairs(m.rewrite_attempts(), "model-0", "model-1")


@query("human_review_summary", _PAIR + ", r AS (SELECT article_id, CASE article_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS winner, CASE WHEN article_id % 7 = 0 THEN 'fail' ELSE 'ok' END AS aa, CASE WHEN article_id % 11 = 0 THEN 'fail' ELSE 'ok' END AS ab FROM pairs) SELECT model, count(*) AS scored, count(*) FILTER (WHERE winner = side) AS wins, count(*) FILTER (WHERE winner = 'tie') AS ties, count(*) FILTER (WHERE acc = 'fail') AS accuracy_fails FROM (SELECT 'a' AS side, candidate_a AS model, winner, aa AS acc FROM pairs JOIN r USING (article_id) UNION ALL SELECT 'b', candidate_b, winner, ab FROM pairs JOIN r USING (article_id)) GROUP BY 1")
def human_review_summary(m):
    key = ops.blinded_pairs(m.rewrite_attempts(), "model-0", "model-1")
    k = F.col("article_id")
    reviews = key.select("article_id", F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("tie").alias("winner"), F.when(k % 7 == 0, "fail").otherwise("ok").alias("accuracy_a"), F.when(k % 11 == 0, "fail").otherwise("ok").alias("accuracy_b"))
    return ops.review_summary(reviews, key)


@query("profile_comparison_pivot", "SELECT article_id, min(o) FILTER (WHERE model = 'model-0') AS \"model-0\", min(o) FILTER (WHERE model = 'model-1') AS \"model-1\", min(o) FILTER (WHERE model = 'model-2') AS \"model-2\" FROM (SELECT article_id, model, coalesce(reason, CASE WHEN accepted THEN 'ok' END) AS o FROM rewrite_attempts) GROUP BY 1")
def profile_comparison_pivot(m):
    return ops.comparison_pivot(m.rewrite_attempts(), ["model-0", "model-1", "model-2"])


@query("permafail_anti", ", w AS (SELECT article_id, max(created_at) AS lf FROM rewrite_attempts WHERE NOT accepted AND reason IS DISTINCT FROM 'llm_error' GROUP BY 1 HAVING count(*) >= 4) SELECT article_id FROM articles LEFT JOIN w USING (article_id) WHERE lf IS NULL OR lf < content_fetched_at - INTERVAL 8125 DAY")
def permafail_anti(m):
    early = m.articles().withColumn("content_fetched_at", hours_before(F.col("content_fetched_at"), 8125 * 24))
    return ops.permafail(early, m.rewrite_attempts()).select("article_id")


_CALLS = """, flagged AS (
  SELECT search_id, regexp_matches(host, '(^|\\.)host[0-9]\\.example\\.com$') AS dom, created_at >= d - INTERVAL 1440 HOUR AS fresh, regexp_matches(url, '/p/[0-4]$') AS fab, search_id % 3 <> 0 AS checked, rank % 2 = 0 AS up FROM discovery_candidates, now
), counted AS (
  SELECT search_id, count(*) AS results, count(*) FILTER (WHERE dom) AS domain_ok, count(*) FILTER (WHERE fresh) AS fresh_ok, count(*) FILTER (WHERE fab) AS fabricated, count(*) FILTER (WHERE dom AND fresh AND NOT fab) AS valid,
    count(*) FILTER (WHERE dom AND fresh AND NOT fab AND checked) AS checked, count(*) FILTER (WHERE dom AND fresh AND NOT fab AND checked AND up) AS reachable FROM flagged GROUP BY 1
), calls AS (
  SELECT s.search_id, provider, tool_calls, latency_ms, cost_usd, results IS NOT NULL AS parsed, coalesce(results, 0) AS results, coalesce(domain_ok, 0) AS domain_ok, coalesce(fresh_ok, 0) AS fresh_ok, coalesce(fabricated, 0) AS fabricated, coalesce(valid, 0) AS valid,
    coalesce(checked, 0) AS checked, coalesce(reachable, 0) AS reachable FROM discovery_searches s LEFT JOIN counted c ON c.search_id = s.search_id
) """


def search_calls(m):
    k, url = F.col("search_id"), F.col("url")
    # addresses that end in /p/0 to /p/4 stand for made-up ones
    made_up = F.when(url.rlike("/p/[0-4]$"), F.concat(url, F.lit("-00000"))).otherwise(url)
    results = m.discovery_candidates().select("search_id", "host", made_up.alias("url"), F.col("created_at").alias("published_at"), F.when(k % 3 != 0, F.col("rank") % 2 == 0).alias("reachable"))
    searches = m.discovery_searches().select("search_id", "provider", "tool_calls", "latency_ms", "cost_usd")
    return ops.search_calls(searches, results, F.col("host").rlike(r"(^|\.)host[0-9]\.example\.com$"), hours_before(discovery_as_of(), 1440))


@query("search_eval_calls", _CALLS + "SELECT search_id, parsed, results, domain_ok, fresh_ok, fabricated, valid, checked, reachable, CASE WHEN valid > 0 THEN round(cost_usd / valid, 6) END AS cost_per_valid FROM calls")
def search_eval_calls(m):
    return search_calls(m).select("search_id", "parsed", "results", "domain_ok", "fresh_ok", "fabricated", "valid", "checked", "reachable", "cost_per_valid")


@query("search_eval_metrics", _CALLS + "SELECT provider, count(*) AS calls, count(*) FILTER (WHERE parsed) AS parsed, sum(results) AS results, sum(domain_ok) AS domain_ok, sum(fresh_ok) AS fresh_ok, sum(fabricated) AS fabricated, sum(valid) AS valid, sum(checked) AS checked, sum(reachable) AS reachable, round(avg(tool_calls), 6) AS tool_calls, quantile_disc(latency_ms, 0.5)::BIGINT AS p50_latency_ms, round(sum(cost_usd), 4) AS cost_usd, round(sum(domain_ok) / sum(results), 6) AS domain_rate, round(sum(fresh_ok) / sum(results), 6) AS fresh_rate, round(sum(cost_usd) / sum(valid), 4) AS cost_per_valid FROM calls GROUP BY 1")
def search_eval_metrics(m):
    return ops.search_profiles(search_calls(m)).withColumn("cost_usd", F.round("cost_usd", 4)).withColumn("cost_per_valid", F.round("cost_per_valid", 4))


@query("recent_segment_guard", "SELECT provider, segment, bool_or(status = 'success' AND created_at >= d - INTERVAL 3000 HOUR) AS recent FROM discovery_searches, now GROUP BY ALL")
def recent_segment_guard(m):
    ok = (F.col("status") == "success") & (F.col("created_at") >= hours_before(discovery_as_of(), 3000))
    return m.discovery_searches().groupBy("provider", "segment").agg(F.bool_or(ok).alias("recent"))


@query("weight_rescale_stats", "SELECT count(*) AS n, min(coalesce(weight, 2)) AS low, max(coalesce(weight, 2)) AS high FROM sources")
def weight_rescale_stats(m):
    w = F.coalesce("weight", F.lit(2))
    return m.sources().agg(F.count("*").alias("n"), F.min(w).alias("low"), F.max(w).alias("high"))


@query("weight_rescale_preview", "SELECT source_id, name, weight, (weight * 2)::INT AS next FROM sources ORDER BY weight DESC NULLS LAST, source_id LIMIT 25")
def weight_rescale_preview(m):
    return ops.weight_preview(m.sources())


@query("rescale_weights", "SELECT source_id, CASE WHEN (SELECT max(weight) FROM sources) > 5 THEN weight ELSE round(weight * 2)::INT END AS weight FROM sources")
def rescale_weights(m):
    s = m.sources()
    most = s.agg(F.max("weight").alias("most"))
    return s.join(F.broadcast(most)).select("source_id", F.when(F.col("most") > 5, F.col("weight")).otherwise(F.round(F.col("weight") * 2).cast("int")).alias("weight"))


@query("language_stats", "SELECT count(*) AS scanned, count(*) FILTER (WHERE language_code IS DISTINCT FROM lang) AS updated, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE lang <> 'en') AS non_english, count(*) FILTER (WHERE language_code IS NULL) AS unknown FROM articles JOIN documents ON doc_id = article_id")
def language_stats(m):
    rows = m.articles().join(m.raw("documents").select(F.col("doc_id").alias("article_id"), "lang"), "article_id")
    return rows.agg(F.count("*").alias("scanned"), F.count_if(~F.col("language_code").eqNullSafe(F.col("lang"))).alias("updated"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("lang") != "en").alias("non_english"), F.count_if(F.col("language_code").isNull()).alias("unknown"))


@query("domain_hits", "SELECT 'host' || k || '.example.com' AS domain, count(host) AS hits FROM range(0, 80) r(k) LEFT JOIN discovery_candidates c ON c.host = 'host' || k || '.example.com' GROUP BY 1")
def domain_hits(m):
    wanted = m.spark.range(80).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".example.com")).alias("domain"), F.col("id").alias("place"))
    asked = m.discovery_candidates().select("host").groupBy("host").agg(F.count("*").alias("n")).withColumn("s", F.explode(urls.host_suffixes(F.col("host"))))
    first = asked.join(wanted, F.col("s.host") == F.col("domain")).groupBy("host", "n").agg(F.min_by("domain", "place").alias("domain"))
    hits = first.groupBy("domain").agg(F.sum("n").alias("hits"))
    return wanted.join(hits, "domain", "left").select("domain", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("reader_available", "SELECT article_id, NOT regexp_matches(canonical_url, '://([^/]*\\.)?(nytimes\\.com)(/|$)') AND NOT coalesce(content_status IN ('paywall', 'blocked', 'timeout', 'error') OR (content_status = 'success' AND content_word_count < 100), false) AS available FROM articles")
def reader_available(m):
    return m.articles().select("article_id", scores.reader_available(F.col("canonical_url"), F.col("content_status"), F.col("content_word_count")).alias("available"))
