"""Reports on discovery, headline attempts, runs and the health of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import rules, urls
from pressloom.functions.urls import is_fabricated_url
from pressloom.sources.model import hours_before

STALE_REASONS = ("stale", "missing_date", "invalid_date")
# Thresholds of the health report.
LIMITS = {"llm_error_share": 0.1, "prefetch_share": 0.3, "discovery_share": 0.5, "accept_share": 0.05, "unresolved_share": 0.25, "spend": 8.0, "stale_minutes": 600}


def since(rows: DataFrame, now: Column, hours: float, column: str = "created_at") -> DataFrame:
    return rows.where(F.col(column) >= hours_before(now, hours))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def provider_yield(searches: DataFrame, candidates: DataFrame) -> DataFrame:
    s = searches.groupBy("provider").agg(
        F.count("*").alias("searches"), F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"), F.sum("tool_calls").alias("total_tool_calls")
    )
    c = candidates.groupBy("provider").agg(F.count("*").alias("c"), F.count_if("accepted").alias("i"))
    candidate, inserted = F.coalesce("c", F.lit(0)), F.coalesce("i", F.lit(0))
    return s.join(c, "provider", "left").select(
        "provider", "searches", "total_cost_usd", candidate.alias("candidates"), inserted.alias("inserted"), percent(inserted, candidate).alias("accept_pct"),
        F.round(F.col("total_cost_usd") / F.nullif(inserted, F.lit(0)), 6).alias("cost_per_insert_usd"), "avg_latency_ms", "total_tool_calls",
    )


def rejection_distribution(candidates: DataFrame) -> DataFrame:
    """Outcomes per provider and their share; unprocessed candidates count as inserted, as their reason is null."""
    n = candidates.groupBy("provider", F.coalesce("reason", F.lit("inserted")).alias("outcome")).agg(F.count("*").alias("n"))
    return n.withColumn("pct_of_provider", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("provider")), 1))


def cross_provider_dupes(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("provider").agg(F.count_if(F.col("reason") == "duplicate_url").alias("dupes_of_existing_articles"), F.count("duplicate_article_id").alias("dupes_with_known_origin"), F.count_if("accepted").alias("unique_inserts"))


def recency_reject_rate(candidates: DataFrame) -> DataFrame:
    old = F.count_if(F.col("reason").isin(*STALE_REASONS))
    return candidates.groupBy("provider").agg(F.count("*").alias("candidates"), old.alias("rejected_for_recency"), percent(old, F.count("*")).alias("recency_reject_pct"))


def top_hosts(candidates: DataFrame, least: int = 3, limit: int = 30) -> DataFrame:
    accepted = F.count_if("accepted")
    rows = candidates.where("host is not null").groupBy("host").agg(
        accepted.alias("inserted"), F.count("*").alias("candidates"), percent(accepted, F.count("*")).alias("accept_pct"), F.concat_ws(", ", F.sort_array(F.collect_set("provider"))).alias("providers")
    )
    return rows.where(F.col("candidates") >= least).orderBy(F.col("inserted").desc(), F.col("candidates").desc(), "host").limit(limit)


def unreachable_hosts(candidates: DataFrame, limit: int = 25) -> DataFrame:
    bad = F.count_if(F.col("reason") == "unreachable")
    rows = candidates.where("host is not null").groupBy("host").agg(bad.alias("unreachable_count"), F.count("*").alias("total_candidates"), percent(bad, F.count("*")).alias("unreachable_pct"))
    return rows.where("unreachable_count > 0").orderBy(F.col("unreachable_count").desc(), "host").limit(limit)


def run_rollup(searches: DataFrame, candidates: DataFrame, limit: int = 20) -> DataFrame:
    s = searches.groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.count("*").alias("searches"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.concat_ws(", ", F.sort_array(F.collect_set("provider"))).alias("providers_used"))
    c = searches.select("run_id", "search_id").join(candidates.select("search_id", "accepted", F.lit(1).alias("one")), "search_id", "left").groupBy("run_id").agg(F.count("one").alias("candidates"), F.count_if("accepted").alias("inserts"))
    rows = s.join(c, "run_id", "left").select("run_id", "started_at", "searches", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("inserts", F.lit(0)).alias("inserts"), "cost_usd", "providers_used")
    return rows.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def daily_model_trend(searches: DataFrame, candidates: DataFrame, providers=("exa", "openai_web_search")) -> DataFrame:
    s = searches.where(F.col("provider").isin(*providers)).withColumn("day", F.date_trunc("day", "created_at"))
    cost = s.groupBy("day", "provider", "model").agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    c = s.select("search_id", "day", "provider", "model").join(candidates.select("search_id", "accepted", "reason", F.lit(1).alias("one")), "search_id", "left")
    c = c.groupBy("day", F.col("provider").alias("p"), F.col("model").alias("mo")).agg(F.count("one").alias("c"), F.count_if("accepted").alias("i"), F.count_if(F.col("reason") == "stale").alias("st")).withColumnRenamed("day", "d")
    rows = cost.join(c, (F.col("day") == F.col("d")) & (F.col("provider") == F.col("p")) & F.col("model").eqNullSafe(F.col("mo")), "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return rows.select("day", "provider", "model", zero("c").alias("candidates"), zero("i").alias("inserts"), percent(zero("st"), zero("c")).alias("stale_pct"), F.round(F.col("cost_usd") / F.nullif(zero("i"), F.lit(0)), 6).alias("cost_per_insert_usd"))


def content_status_by_origin(articles: DataFrame, sources: DataFrame) -> DataFrame:
    web = F.col("feed_url").startswith("web://") | F.col("feed_url").startswith("web-discovery://")
    rows = articles.join(sources.select("source_id", "feed_url"), "source_id")
    return rows.groupBy(F.when(web, "web_discovered").otherwise("rss").alias("origin"), F.coalesce("content_status", F.lit("never_attempted")).alias("status")).agg(F.count("*").alias("articles"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def health_metrics(articles, runs, attempts, searches, candidates, scored, now: Column, discovery_now: Column, hours: int = 48) -> DataFrame:
    """Key figures in one row. Each part is one aggregate over one table."""
    a24, window = hours_before(now, 24), hours_before(now, hours)
    fresh = F.col("fetched_at") > a24
    one = articles.agg(
        F.count_if(fresh).alias("articles_ingested_24h"),
        F.count_if((F.col("fetched_at") > window) & F.col("content_status").isNotNull()).alias("prefetch_attempted"),
        F.count_if((F.col("fetched_at") > window) & (F.col("content_status") == "success")).alias("prefetch_success"),
        F.count_if(fresh & F.col("canonical_url").rlike(r"news\.google\.com")).alias("unresolved_24h"),
    )
    d = hours_before(discovery_now, hours)
    runs = runs.agg(F.count_if((F.col("started_at") > hours_before(discovery_now, 24)) & (F.col("status") == "error")).alias("cron_errors_24h"))
    rewrite = attempts.where(F.col("created_at") > d).agg(F.count("*").alias("rewrite_attempts"), F.count_if(F.col("reason") == "llm_error").alias("llm_errors"), F.count_if("accepted").alias("rewrite_accepted"))
    search = searches.agg(
        F.count_if(F.col("created_at") > d).alias("searches"),
        F.count_if((F.col("created_at") > d) & (F.col("status") == "success")).alias("search_successes"),
        F.round(F.coalesce(F.sum(F.when((F.col("provider") == "exa") & (F.col("created_at") >= F.date_trunc("month", discovery_now)), F.col("cost_usd"))), F.lit(0.0)), 4).alias("spend_month_usd"),
    )
    candidate = candidates.where(F.col("created_at") > d).agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"))
    lead = scored.join(articles.select(F.col("article_id").alias("lead_article_id"), "rewritten_title", "fetched_at", "published_at", "canonical_url"), "lead_article_id")
    shown = F.col("published_at") > hours_before(now, 72)
    leads = lead.agg(
        F.count_if(F.col("rewritten_title").isNull() & (F.col("fetched_at") > hours_before(now, 168))).alias("unrewritten_leads_7d"),
        F.count_if(shown).alias("leads_72h"),
        F.count_if(shown & urls.is_aggregator_url(F.col("canonical_url"))).alias("hidden_72h"),
        F.count("*").alias("clusters"),
        F.count_if(F.col("size") == 1).alias("singles"),
    )
    row = one
    for part in (runs, rewrite, search, candidate, leads):
        row = row.join(part)
    c = F.col
    return row.withColumns(
        {
            "llm_error_share": share(c("llm_errors"), c("rewrite_attempts")),
            "rewrite_accept_share": share(c("rewrite_accepted"), c("rewrite_attempts")),
            "prefetch_share": share(c("prefetch_success"), c("prefetch_attempted")),
            "discovery_share": share(c("search_successes"), c("searches")),
            "accept_share": share(c("accepted"), c("candidates")),
            "unresolved_share": share(c("unresolved_24h"), c("articles_ingested_24h")),
            "hidden_share_72h": share(c("hidden_72h"), c("leads_72h")),
            "singleton_share": share(c("singles"), c("clusters")),
        }
    )


def health_breaches(metrics: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """The metrics row with the list of broken rules; shares count only above a least number of cases."""
    c = F.col
    tests = [
        ("no_articles_ingested_24h", c("articles_ingested_24h") == 0),
        ("cron_errors_24h", c("cron_errors_24h") > 0),
        ("rewrite_llm_error_share", (c("rewrite_attempts") >= 20) & (c("llm_error_share") > limits["llm_error_share"])),
        ("prefetch_success_share", (c("prefetch_attempted") >= 50) & (c("prefetch_share") < limits["prefetch_share"])),
        ("discovery_success_share", (c("searches") >= 10) & (c("discovery_share") < limits["discovery_share"])),
        ("discovery_accept_share", (c("candidates") >= 50) & (c("accept_share") < limits["accept_share"])),
        ("unresolved_share_24h", (c("articles_ingested_24h") >= 100) & (c("unresolved_share") > limits["unresolved_share"])),
        ("spend_month_usd", c("spend_month_usd") >= limits["spend"]),
    ]
    found = F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))
    return metrics.withColumn("breaches", found).withColumn("ok", F.size(found) == 0)


def feed_health(sources: DataFrame, now: Column) -> DataFrame:
    real = ~F.col("feed_url").rlike("^(discover|web|web-discovery|disabled)://")
    stale = F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") < hours_before(now, 24))
    return sources.where(real).agg(F.count("*").alias("total"), F.count_if(F.col("last_fetch_status") == "ok").alias("healthy"), F.count_if(F.col("last_fetch_status") == "error").alias("erroring"), F.count_if(stale).alias("stale"))


def last_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` runs of each job. A job's partition holds its runs; only their ranks are kept."""
    rank = F.row_number().over(Window.partitionBy("job_name").orderBy(F.col("started_at").desc(), "run_id"))
    return runs.withColumn("place", rank).where(F.col("place") <= n)


def job_health(runs: DataFrame, now: Column, thresholds: dict[str, float]) -> DataFrame:
    newest = F.struct("started_at", (-F.col("run_id")).alias("k"))
    limit = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    rows = runs.groupBy("job_name").agg(
        F.max("started_at").alias("last_run"),
        F.max_by("status", newest).alias("last_status"),
        F.max_by("duration_ms", newest).alias("last_duration_ms"),
        F.count_if((F.col("status") == "error") & (F.col("started_at") >= hours_before(now, 24))).alias("recent_errors"),
    )
    hours = (F.unix_micros(now) - F.unix_micros("last_run")) / 3_600_000_000.0
    return rows.withColumn("hours_since", F.round(hours, 1)).withColumn("stale", hours > F.coalesce(F.try_element_at(limit, F.col("job_name")), F.lit(24.0)))


# Reasons that mean that a headline says what its source does not.
FACTUAL = ("invented_number", "hallucinated_entity", "missing_attribution")
# End of fixed values.


def nearest_rank(column: str, share: float) -> Column:
    """The value at the given share by the nearest-rank rule."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})").cast("long")


def arm_summary(attempts: DataFrame, factual: Sequence[str] = FACTUAL) -> DataFrame:
    """Per model: outcomes, nearest-rank latencies, cost, cost per accepted headline and the count of each failure.

    ``attempts`` has tokens; prices are `model_price`'s. Failures are counted
    per reason before they become a map, which has a key for each reason.
    """
    priced = call_cost(model_price(attempts.where("model is not null").withColumn("tool_calls", F.lit(0))))
    rows = priced.groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if("accepted").alias("success"),
        F.count_if(F.col("attempt_idx") > 1).alias("retries"),
        F.count_if(F.col("reason").isin(*factual)).alias("factual_failures"),
        nearest_rank("latency_ms", 0.5).alias("median_latency_ms"),
        nearest_rank("latency_ms", 0.95).alias("p95_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cost").alias("cost_usd"),
    )
    counts = attempts.where("reason is not null").groupBy("model", "reason").agg(F.count("*").alias("c"))
    failures = counts.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "c")))).alias("failures"))
    per = F.when(F.col("success") > 0, F.col("cost_usd") / F.col("success"))
    return rows.withColumn("cost_per_accept", per).join(failures, "model", "left")


def provider_run_stats(searches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per run and provider: searches, candidates, outcomes, cost, tool calls and latency; candidates are counted per search first."""
    found = candidates.groupBy("search_id").agg(F.count("*").alias("c"), F.count_if("accepted").alias("i"), F.count_if(~F.col("accepted")).alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return searches.join(found, "search_id", "left").groupBy("run_id", "provider").agg(
        F.count("*").alias("searches"),
        total("c").alias("candidates"),
        total("i").alias("inserted"),
        total("r").alias("rejected"),
        F.round(total("cost_usd"), 6).alias("cost_usd"),
        total("tool_calls").alias("tool_calls"),
        total("latency_ms").alias("latency_ms"),
    )


def search_calls(searches: DataFrame, results: DataFrame, domains: Column, cutoff: Column) -> DataFrame:
    """Per call: whether it gave results, how many fit the ``domains`` condition, are fresh, made up or all right, and what a right one cost."""
    fine = {"domain_ok": F.coalesce(domains, F.lit(False)), "fresh_ok": F.coalesce(F.col("published_at") >= cutoff, F.lit(False)), "fabricated": is_fabricated_url(F.col("url"))}
    valid = fine["domain_ok"] & fine["fresh_ok"] & ~fine["fabricated"]
    counts = results.groupBy("search_id").agg(F.count("*").alias("results"), *[F.count_if(c).alias(n) for n, c in fine.items()], F.count_if(valid).alias("valid"), F.count_if(valid & F.col("reachable").isNotNull()).alias("checked"), F.count_if(valid & F.col("reachable")).alias("reachable"))
    rows = searches.join(counts, "search_id", "left").withColumn("parsed", F.col("results").isNotNull())
    rows = rows.fillna(0, ["results", *fine, "valid", "checked", "reachable"])
    return rows.withColumn("cost_per_valid", F.when(F.col("valid") > 0, F.col("cost_usd") / F.col("valid")))


def search_profiles(calls: DataFrame) -> DataFrame:
    """Per provider the sums and rates of `search_calls`, the nearest-rank median latency and the cost of a right result."""
    sums = {n: F.sum(n).alias(n) for n in ("results", "domain_ok", "fresh_ok", "fabricated", "valid", "checked", "reachable")}
    rows = calls.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if("parsed").alias("parsed"), *sums.values(), F.avg("tool_calls").alias("tool_calls"), nearest_rank("CASE WHEN latency_ms > 0 THEN latency_ms END", 0.5).alias("p50_latency_ms"), F.sum("cost_usd").alias("cost_usd"))
    rate = lambda n: F.when(F.col("results") > 0, F.col(n) / F.col("results"))
    return rows.withColumns({"domain_rate": rate("domain_ok"), "fresh_rate": rate("fresh_ok"), "cost_per_valid": F.when(F.col("valid") > 0, F.col("cost_usd") / F.col("valid"))})


def top_failures(attempts: DataFrame, n: int = 5) -> DataFrame:
    counts = attempts.where("reason is not null").groupBy("model", "reason").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.col("n").desc(), "reason"))).where(F.col("place") <= n)


def running_budget(searches: DataFrame, cap: float) -> DataFrame:
    """Searches in order within their month and run, and whether spend before them was below the cap."""
    before = F.sum("cost_usd").over(Window.partitionBy(F.date_trunc("month", "created_at"), "provider", "segment").orderBy("created_at", "search_id").rowsBetween(Window.unboundedPreceding, -1))
    return searches.withColumn("spent_before", F.coalesce(before, F.lit(0.0))).withColumn("allowed", F.round(F.col("spent_before"), 6) < cap)


def article_cap(candidates: DataFrame, cap: int) -> DataFrame:
    """Accept in rank order up to the cap of each search; the rest are marked."""
    before = F.sum(F.when(F.col("accepted"), 1).otherwise(0)).over(Window.partitionBy("search_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    over = F.coalesce(before, F.lit(0)) >= cap
    return candidates.withColumn("outcome", F.when(over, "article_cap_reached").otherwise(F.coalesce("reason", F.lit("inserted"))))


def first_occurrence(candidates: DataFrame, url: str = "url", title: str | None = None) -> DataFrame:
    """The first of equal canonical URLs, or titles without one, in each search; later ones are duplicates, rows without a key are dropped.

    A canonical URL is empty or null only where the URL is, so rows are dropped
    by that, and the key is worked out once, for the window.
    """
    key, some = F.lower(urls.canonical_url(F.col(url))), F.col(url) != ""
    if title:
        key = F.coalesce(F.nullif(key, F.lit("")), F.lower(F.trim(F.col(title))))
        some = F.coalesce(some, F.lit(False)) | (F.trim(F.col(title)) != "")
    rank = F.row_number().over(Window.partitionBy("search_id", "_key").orderBy("rank"))
    return candidates.where(some).withColumn("_key", key).withColumn("duplicate", rank > 1).drop("_key")


def model_price(models: DataFrame, prices=rules.MODEL_PRICES, default: str = rules.DEFAULT_MODEL) -> DataFrame:
    """``models`` with the prices of each row's model by name or longest prefix; unknown ones at the default's.

    The price list is fixed and small, so it is an expression of the row: a join
    by model would bring the rows of each of the few models to one task.
    """
    model, fallback = F.col("model"), next(p for p in prices if p[0] == default)

    def price(place: int) -> Column:
        out = F.when(F.lit(False), F.lit(float(fallback[place])))
        for p in sorted(prices, key=lambda p: -len(p[0])):
            out = out.when((model == p[0]) | model.startswith(f"{p[0]}-"), float(p[place]))
        return out.otherwise(float(fallback[place]))

    return models.withColumns({"input_per_m": price(1), "output_per_m": price(2)})


def call_cost(rows: DataFrame, call_price: float = rules.CALL_PRICE) -> DataFrame:
    """Cost of calls with ``input_tokens, output_tokens, tool_calls`` and prices."""
    cost = F.col("input_tokens") / 1e6 * F.col("input_per_m") + F.col("output_tokens") / 1e6 * F.col("output_per_m") + F.col("tool_calls") * call_price
    return rows.withColumn("cost", cost)


def blinded_pairs(attempts: DataFrame, a: str, b: str) -> DataFrame:
    """Articles that both models wrote for; even ids show model ``a`` on the left."""
    one = attempts.where(F.col("model") == a).select("article_id", F.lit(a).alias("x")).distinct()
    two = attempts.where(F.col("model") == b).select("article_id", F.lit(b).alias("y")).distinct()
    even = F.col("article_id") % 2 == 0
    return one.join(two, "article_id").select("article_id", F.when(even, F.col("x")).otherwise(F.col("y")).alias("candidate_a"), F.when(even, F.col("y")).otherwise(F.col("x")).alias("candidate_b"))


def review_summary(reviews: DataFrame, key: DataFrame) -> DataFrame:
    """Wins, ties and accuracy fails of every model through the blind key."""
    rows = reviews.join(key, "article_id").select("winner", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("candidate_a").alias("model"), F.col("accuracy_a").alias("accuracy")), F.struct(F.lit("b").alias("side"), F.col("candidate_b").alias("model"), F.col("accuracy_b").alias("accuracy")))).alias("s"))
    return rows.groupBy("s.model").agg(F.count("*").alias("scored"), F.count_if(F.col("winner") == F.col("s.side")).alias("wins"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("s.accuracy") == "fail").alias("accuracy_fails"))


def comparison_pivot(attempts: DataFrame, models: list[str]) -> DataFrame:
    """One row per article and the models' first outcomes side by side."""
    outcome = F.coalesce("reason", F.when(F.col("accepted"), "ok"))
    return attempts.withColumn("outcome", outcome).groupBy("article_id").pivot("model", models).agg(F.min("outcome"))


def permafail(articles: DataFrame, attempts: DataFrame, least: int = 4) -> DataFrame:
    """Articles whose headline failed too often since their content was fetched."""
    bad = attempts.where("not accepted and not (reason <=> 'llm_error')").groupBy("article_id").agg(F.count("*").alias("fails"), F.max("created_at").alias("last_fail"))
    worn = bad.where(F.col("fails") >= least)
    rows = articles.join(worn, "article_id", "left")
    return rows.where(F.col("fails").isNull() | (F.col("last_fail") < F.col("content_fetched_at"))).select(articles.columns)


def weight_preview(sources: DataFrame, top: int = 25) -> DataFrame:
    """The heaviest sources with their doubled weights, before they are rescaled; null is lightest."""
    order = [F.col("weight").desc_nulls_last(), F.col("source_id")]
    return sources.orderBy(*order).limit(top).select("source_id", "name", "weight", F.round(F.col("weight") * 2).cast("int").alias("next"))
