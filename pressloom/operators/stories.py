"""Story clusters: roll-ups, scores, feeds, leaderboards, search."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import rules, scores, urls
from pressloom.operators.storage import kept
from pressloom.operators.textindex import placed_terms
from pressloom.operators.vectors import DIGITS, Cells, cell_facts, fit_pivots, nearest, similar_pairs, unit, with_cells
from pressloom.sources.model import hours_before

COVERAGE_MOST = log(101) + 0.8 * log(11) + 0.4 * log(16)
VIEWS = {"top": (72, 10), "latest": (48, 20), "category": (168, 15)}


def article_star(members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Memberships with their visible articles and, where known, sources."""
    visible = articles.where(scores.visible_language(F.col("language_code")))
    named = sources.select("source_id", F.col("name").alias("source_name"), "homepage_url", F.col("weight").alias("raw_weight"))
    return members.join(visible, "article_id").join(named, "source_id", "left")


def active_members(members: DataFrame, articles: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """Memberships of clusters with a recent article."""
    recent = articles.where(F.col("fetched_at") >= hours_before(as_of, 24 * days)).select("article_id")
    return members.join(members.join(recent, "article_id", "left_semi").select("cluster_id").distinct(), "cluster_id", "left_semi")


def one_cluster_per_article(star: DataFrame) -> DataFrame:
    """The membership of the smallest cluster of each article."""
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy("cluster_id"))
    return star.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def scored_articles(star: DataFrame, as_of: Column) -> DataFrame:
    """Members with host, weight, eligibility and the two article scores."""
    url = F.col("canonical_url")
    weight = scores.effective_weight(F.col("raw_weight"), url)
    out = star.withColumns(
        {
            "host": urls.publisher_host(url),
            "weight": weight,
            "eligible": F.when(scores.lead_ineligible(url, F.col("published_at"), F.col("fetched_at")), 0).otherwise(1),
            "fresh": scores.article_freshness(F.col("published_at"), as_of),
            "quality": scores.editorial_quality(weight, F.col("author"), F.col("dek"), url),
        }
    )
    return out.withColumn("article_score", scores.article_score(F.col("quality"), F.col("fresh"))).withColumn("lead_score", scores.lead_score(F.col("quality"), F.col("fresh")))


def cluster_rollup(scored: DataFrame, as_of: Column) -> DataFrame:
    """Size, sources, dates, weights, pool and lead of every cluster, in one aggregation."""
    recent = F.col("published_at").between(hours_before(as_of, 4), as_of)
    lead = F.max_by("article_id", F.struct("eligible", "lead_score", -F.col("article_id")))
    return scored.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.count_distinct("source_id").alias("distinct_sources"),
        F.max("published_at").alias("latest_pub"),
        F.min("published_at").alias("first_pub"),
        F.sum("weight").alias("sum_w"),
        F.avg("weight").alias("avg_w"),
        F.max("weight").alias("max_w"),
        F.count_distinct(F.when(F.col("weight") >= rules.STRONG_WEIGHT, F.col("host"))).alias("strong_sources"),
        F.count_distinct(F.when(recent, F.col("source_id"))).alias("v4"),
        F.sum("article_score").alias("pool"),
        lead.alias("lead_article_id"),
    )


def weighted_velocity(scored: DataFrame, as_of: Column) -> DataFrame:
    """Tenths of the best weights of the outlets that published within a day."""
    recent = scored.where(F.col("published_at").between(hours_before(as_of, rules.VELOCITY_WINDOW_H), as_of))
    return recent.groupBy("cluster_id", "host").agg(F.max("weight").alias("w")).groupBy("cluster_id").agg((F.sum("w") / 10.0).alias("vw"))


def novelty(centroids: DataFrame, previous: DataFrame, as_of: Column, most: int = 20) -> DataFrame:
    """Distance of each cluster's centroid to the nearest of the top clusters so far, on a ramp of 0 to 1.

    The reference set has ``most`` rows, so it is broadcast.
    """
    top = previous.where(F.col("latest_pub") >= hours_before(as_of, 72)).join(centroids.where("centroid is not null"), "cluster_id")
    top = top.orderBy(F.col("score").desc(), "cluster_id").limit(most).select(F.col("centroid").alias("top_centroid"))
    near = centroids.where("centroid is not null").join(F.broadcast(top))
    least = near.groupBy("cluster_id").agg(F.min(1 - scores.cosine(F.col("centroid"), F.col("top_centroid"))).alias("distance"))
    ramp = (F.col("distance") - rules.NOVELTY_FLOOR) / (rules.NOVELTY_CEIL - rules.NOVELTY_FLOOR)
    return least.select("cluster_id", "distance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ramp)).alias("novelty_norm"))


def rescore(members, articles, sources, as_of: Column, previous: DataFrame | None = None, centroids: DataFrame | None = None) -> DataFrame:
    """Scores of all active clusters; without previous scores there is no novelty."""
    star = one_cluster_per_article(article_star(active_members(members, articles, as_of), articles, sources))
    scored = scored_articles(star, as_of)
    out = cluster_rollup(scored, as_of).join(weighted_velocity(scored, as_of), "cluster_id", "left")
    if previous is not None:
        out = out.join(novelty(centroids, previous, as_of).drop("distance"), "cluster_id", "left")
    else:
        out = out.withColumn("novelty_norm", F.lit(None).cast("double"))
    vw = F.coalesce("vw", F.lit(0.0))
    logged = lambda c, most: F.log(1 + F.least(c, F.lit(most)))
    out = out.withColumns(
        {
            "vw": vw,
            "velocity_norm": logged(vw, 10.0) / log(11),
            "coverage_norm": (logged(F.col("sum_w"), 100) + 0.8 * logged(F.col("distinct_sources"), 10) + 0.4 * logged(F.col("size"), 15)) / COVERAGE_MOST,
            "authority_norm": F.least("max_w", F.lit(10)) / 10.0,
            "pool_norm": logged(F.col("pool"), 50.0) / log(51),
            "novelty_norm": F.coalesce("novelty_norm", F.lit(0.0)),
            "cluster_fresh": scores.cluster_freshness(F.col("latest_pub"), as_of),
            "damping": scores.age_damping(F.col("first_pub"), as_of),
        }
    )
    share = rules.SCORE_SHARES
    base = sum((share[k] * F.col(f"{k}_norm") for k in ("velocity", "coverage", "authority", "pool")), F.lit(0.0)) + rules.NOVELTY_SHARE * F.col("novelty_norm")
    out = out.withColumn("base_score", base)
    return out.withColumn("score", (F.col("base_score") + share["freshness"] * F.col("cluster_fresh")) * F.col("damping"))


def why(scored: DataFrame) -> DataFrame:
    """The rounded parts of a score as one JSON object."""
    parts = [F.round(c, 4).alias(c) for c in ("velocity_norm", "coverage_norm", "authority_norm", "pool_norm", "novelty_norm")]
    rest = [F.round("damping", 4).alias("age_damping"), "distinct_sources", "strong_sources", "max_w", "v4", F.round("vw", 3).alias("vel_w"), F.lit(rules.VELOCITY_WINDOW_H).alias("vel_window_h")]
    return scored.select("cluster_id", F.struct(*parts, *rest).alias("why"))


def category_rollup(members, articles, article_categories, categories) -> DataFrame:
    """Per cluster and category: weighted score, primary matches and best confidences of the usable rows."""
    visible = articles.where(scores.visible_language(F.col("language_code"))).select("article_id")
    usable = article_categories.where((F.col("confidence") >= 0.35) & ((F.coalesce("rule_confidence", F.lit(0.0)) > 0) | (F.col("confidence") >= 0.65)))
    rows = members.join(visible, "article_id").join(usable, "article_id").join(categories, "category_id")
    return rows.groupBy("cluster_id", "slug").agg(
        F.sum(F.when(F.col("is_primary"), F.col("confidence")).otherwise(F.col("confidence") * 0.35)).alias("category_score"),
        F.count_if("is_primary").alias("primary_matches"),
        F.max("confidence").alias("max_confidence"),
        F.max(F.coalesce("rule_confidence", F.lit(0.0))).alias("max_rule_confidence"),
    )


def clusters_in_category(scored, members, articles, article_categories, categories, slug: str) -> DataFrame:
    """Clusters whose lead or members as a whole belong to a category."""
    primary = article_categories.join(categories.where(F.col("slug") == slug), "category_id", "left_semi")
    primary = primary.where(F.col("is_primary") & (F.col("confidence") >= 0.35) & ((F.coalesce("rule_confidence", F.lit(0.0)) > 0) | (F.col("confidence") >= 0.65)))
    leads = scored.join(primary.select(F.col("article_id").alias("lead_article_id")), "lead_article_id", "left_semi").select("cluster_id")
    rolled = category_rollup(members, articles, article_categories, categories).where(F.col("slug") == slug)
    rolled = rolled.where("(primary_matches >= 2 and category_score >= 1.2) or max_confidence >= 0.75").select("cluster_id")
    return leads.unionByName(rolled).distinct()


def _shown(url: Column, host: Column) -> Column:
    return ~url.rlike(r"^https://(news\.google\.com|news\.yahoo\.com|www\.msn\.com)") & ~host.isin(*rules.AGGREGATOR_HOSTS)


def river_clusters(scored, members, articles, sources, as_of: Column, latest: bool = False, window_h: int = 168, limit: int = 10, category: str | None = None, article_categories=None, categories=None) -> DataFrame:
    """The ranked story feed. The window function after the limit sees ``limit`` rows.

    Scored rows of before a column was there, with a null ``first_pub`` or
    ``strong_sources``, have these from their members: the first date of all,
    and the hosts of strong sources among the visible ones.
    """
    if not 1 <= window_h <= 720:
        raise ValueError("window must be 1 to 720 hours")
    if not 0 <= limit <= 100:
        raise ValueError("limit must be 0 to 100")
    known = sources.withColumn("_known", F.lit(True))
    a = articles.where(scores.visible_language(F.col("language_code"))).join(known, "source_id", "left")
    lead = a.select(
        F.col("article_id").alias("lead_article_id"),
        "published_at",
        F.coalesce("rewritten_title", "title").alias("lead_title"),
        F.col("rewritten_title").isNotNull().alias("lead_was_rewritten"),
        F.col("canonical_url").alias("lead_url"),
        F.col("dek").alias("lead_dek"),
        F.coalesce("publisher_name", "name").alias("lead_source"),
        F.coalesce("publisher_homepage", "homepage_url").alias("lead_homepage"),
        F.col("author").alias("lead_author"),
        F.col("content_status").alias("lead_content_status"),
        F.col("content_word_count").alias("lead_content_word_count"),
        F.col("content_image").alias("lead_image"),
        scores.effective_weight(F.col("weight"), F.col("canonical_url")).alias("lead_weight"),
    )
    rows = scored.select("cluster_id", "size", "score", "base_score", "latest_pub", "first_pub", "strong_sources", "lead_article_id").join(lead, "lead_article_id")
    activity = F.coalesce("latest_pub", "published_at")
    served = scores.serve_score(F.col("base_score"), F.col("latest_pub"), F.col("score"), as_of)
    rows = rows.where((activity >= hours_before(as_of, window_h)) & ~urls.is_aggregator_url(F.col("lead_url")) & ~urls.is_low_value_url(F.col("lead_url")))
    rows = _with_fallbacks(rows, members, articles, sources)
    if not latest and category is None:
        rows = rows.where(scores.top_gate(F.col("strong_sources"), F.col("lead_weight")))
    if category is not None:
        rows = rows.join(clusters_in_category(scored, members, articles, article_categories, categories, category), "cluster_id", "left_semi")
    rows = rows.withColumn("score", served * scores.age_damping(F.col("first_pub"), as_of) * scores.singleton_discount(F.col("strong_sources"))).withColumn("activity_at", activity)
    order = [F.col("activity_at").desc_nulls_first() if latest else F.col("score").desc_nulls_first(), F.col("activity_at").desc_nulls_first(), F.col("cluster_id")]
    ranked = rows.orderBy(*order).limit(limit or 10)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = articles.sparkSession.createDataFrame(ranked.collect(), ranked.schema)  # 100 rows at most, used three times below
    member = members.join(F.broadcast(ranked.select("cluster_id", "lead_article_id")), "cluster_id").join(a, "article_id")
    member = member.withColumns(
        {"shown_title": F.coalesce("rewritten_title", "title"), "source_name": F.coalesce("publisher_name", "name"), "host": urls.publisher_host(F.coalesce("publisher_homepage", "canonical_url"))}
    )
    shown = _shown(F.col("canonical_url"), F.col("host"))
    sub = shown & (F.col("article_id") != F.col("lead_article_id"))
    order_key = -F.coalesce(F.unix_micros("published_at"), F.lit((1 << 63) - 1))
    entry = F.struct(order_key.alias("k"), F.col("article_id"), F.col("shown_title").alias("title"), F.col("canonical_url").alias("url"), F.col("source_name").alias("source"), "author", "published_at")
    rolled = member.groupBy("cluster_id").agg(
        F.count_distinct(F.when(F.col("_known"), F.col("source_id"))).alias("sources_count"),
        F.sort_array(F.collect_list(F.when(sub, entry))).alias("subs"),
        F.count_if(sub).alias("subs_total"),
    )
    by_source = member.where(shown & F.col("source_name").isNotNull()).groupBy("cluster_id", "source_name").agg(F.sort_array(F.collect_list(F.struct(order_key.alias("k"), "article_id", F.col("shown_title").alias("title"), F.col("canonical_url").alias("url"), "author"))).alias("list"))
    by_source = by_source.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("source_name", "list"))).alias("all_articles_by_source"))
    out = ranked.join(rolled, "cluster_id", "left").join(by_source, "cluster_id", "left")
    return out.select(
        "rank", "cluster_id", "size", "score", "sources_count", "lead_article_id", "lead_title", "lead_was_rewritten", "lead_url", "lead_dek", "lead_source", "lead_homepage", "lead_author", "published_at",
        F.transform("subs", lambda s: s.dropFields("k")).alias("subs"), "subs_total", F.transform_values("all_articles_by_source", lambda _, v: F.transform(v, lambda s: s.dropFields("k"))).alias("all_articles_by_source"),
        "lead_content_status", "lead_content_word_count", "lead_image",
    ).orderBy("rank")


def _with_fallbacks(rows: DataFrame, members: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` whose null ``first_pub`` and ``strong_sources`` are worked out from the members of those clusters."""
    lacking = rows.where("first_pub is null or strong_sources is null").select("cluster_id")
    own = members.join(lacking, "cluster_id", "left_semi").join(articles.select("article_id", "source_id", "published_at", "canonical_url", "language_code"), "article_id")
    own = own.join(sources.select("source_id", F.col("weight").alias("_w")), "source_id", "left")
    strong = scores.visible_language(F.col("language_code")) & (scores.effective_weight(F.col("_w"), F.col("canonical_url")) >= rules.STRONG_WEIGHT)
    found = own.groupBy("cluster_id").agg(F.min("published_at").alias("_first"), F.count_distinct(F.when(strong, urls.publisher_host(F.col("canonical_url")))).alias("_strong"))
    rows = rows.join(found, "cluster_id", "left")
    return rows.withColumns({"first_pub": F.coalesce("first_pub", "_first"), "strong_sources": F.coalesce("strong_sources", "_strong")}).drop("_first", "_strong")


def feed_parameter_problem(window_h: Column, limit: Column, view: Column, category: Column, views=tuple(VIEWS), categories=()) -> Column:
    """What is wrong with the parameters of a feed, null if nothing is; for columns what `river_clusters` raises for values."""
    return (
        F.when(~window_h.between(1, 720), "window")
        .when(~limit.between(1, 100), "limit")
        .when(~view.isin(*views), "view")
        .when(category.isNotNull() & ~category.isin(*categories), "category")
    )


def leaderboard(scored, members, articles, sources, as_of: Column, start_h: int = 168, end_h: int = 0) -> DataFrame:
    """Publishers that led a story within the window, with the sizes they led and the clusters they are in."""
    a = articles.where(scores.visible_language(F.col("language_code"))).join(sources, "source_id", "left")
    a = a.where((F.col("published_at") > hours_before(as_of, start_h)) & (F.col("published_at") <= hours_before(as_of, end_h)))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    anonymous = (F.coalesce("slug", F.lit("")) == "web-discovery") & blank("publisher_name").isNull() & blank("publisher_homepage").isNull()
    a = a.where(~anonymous).select(
        "article_id",
        "published_at",
        F.coalesce(blank("publisher_name"), "name").alias("pub_name"),
        F.coalesce(blank("publisher_homepage"), blank("homepage_url")).alias("pub_home"),
        urls.leaderboard_host(F.coalesce(blank("publisher_homepage"), blank("homepage_url"), "canonical_url")).alias("pub_host"),
    )
    rows = members.join(a, "article_id").join(scored.select("cluster_id", F.col("size").alias("cluster_size"), "lead_article_id"), "cluster_id").where(~F.col("pub_host").isin(*rules.AGGREGATOR_HOSTS))
    key = F.when(F.col("pub_host") != "", F.concat(F.lit("host:"), "pub_host")).otherwise(F.concat(F.lit("name:"), F.lower(F.coalesce("pub_name", F.lit("unknown")))))
    leads = F.col("lead_article_id") == F.col("article_id")
    newest = lambda c: F.max_by(c, F.when((F.col(c) != ""), F.struct("published_at", "article_id")))
    top_host = F.max("pub_host")
    out = rows.groupBy(key.alias("rank_key")).agg(
        F.coalesce(newest("pub_name"), top_host).alias("name"),
        F.coalesce(newest("pub_home"), F.when(top_host != "", F.concat(F.lit("https://"), top_host)).otherwise("")).alias("homepage"),
        F.sum(F.when(leads, F.col("cluster_size")).otherwise(0)).alias("leads"),
        F.count_distinct("cluster_id").alias("articles"),
        F.bool_or(leads).alias("_led"),
    )
    return out.where("_led").drop("_led")


def rank_changes(current: DataFrame, previous: DataFrame, limit: int = 10) -> DataFrame:
    """The top publishers and how many places they moved up; null for new ones.

    Only the ``limit`` rows of the report are ranked; their places before are
    counts of the publishers ahead of them, in one aggregation over all.
    """
    keys = [F.col("leads").desc(), F.col("articles").desc(), F.col("rank_key")]
    top = kept(current.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys))))
    then = kept(previous.select("rank_key", "leads", "articles"))
    asked = then.join(F.broadcast(top.select("rank_key")), "rank_key").collect()
    names = [f"n{i}" for i in range(len(asked))]

    def ahead(row) -> Column:
        order = F.struct(-F.col("leads"), -F.col("articles"), F.col("rank_key"))
        own = F.struct(F.lit(-row["leads"]).cast("long"), F.lit(-row["articles"]).cast("long"), F.lit(row["rank_key"]))
        return F.count_if(order < own)

    places = then.agg(*[ahead(r).alias(n) for r, n in zip(asked, names, strict=True)]).first() if asked else []
    before = top.sparkSession.createDataFrame([(r["rank_key"], p + 1) for r, p in zip(asked, places, strict=True)], "rank_key string, before long")
    return top.join(F.broadcast(before), "rank_key", "left").select("rank", "rank_key", "name", "homepage", "leads", "articles", (F.col("before") - F.col("rank")).alias("change")).orderBy("rank")


def source_key(name: Column) -> Column:
    """A source's name or host as it is compared: trimmed, in lower case, without scheme and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "^https?://", ""), r"^www\.", "")


def normalize_subs(subs: DataFrame, by_source: DataFrame) -> DataFrame:
    """``cluster_id, source_key, source, article_id, article_count``: one sub-link for each source of a story, the newest.

    ``subs(cluster_id, article_id, source, url, published_at)`` meet
    ``by_source(cluster_id, source, n)``, the articles of each source of the
    story, by name, then by host, and only then by names that contain one
    another, of which the first in alphabetical order counts. ``article_count``
    is that source's number, or else how often the sub-link's own came. Links
    without any source stay single.
    """
    index = by_source.select("cluster_id", source_key(F.col("source")).alias("nk"), "source", "n").where("nk <> ''").groupBy("cluster_id", "nk").agg(F.max(F.struct("source", "n")).alias("e"))
    host = urls.url_host(F.col("url"))
    rows = subs.withColumns({"_a": source_key(F.col("source")), "_b": source_key(host), "_host": host})
    exact = lambda side: index.select("cluster_id", F.col("nk").alias(side), F.col("e").alias(f"_e{side}"))
    rows = rows.join(exact("_a"), ["cluster_id", "_a"], "left").join(exact("_b"), ["cluster_id", "_b"], "left")
    open_ = rows.where("_e_a is null and _e_b is null").select("cluster_id", F.explode(F.array("_a", "_b")).alias("c")).where("c <> ''").distinct()
    near = open_.join(index, "cluster_id").where(F.contains("nk", F.col("c")) | F.contains("c", F.col("nk"))).groupBy("cluster_id", "c").agg(F.min_by("e", "nk").alias("e"))
    for side in ("_a", "_b"):
        rows = rows.join(near.select("cluster_id", F.col("c").alias(side), F.col("e").alias(f"_f{side}")), ["cluster_id", side], "left")
    entry = F.coalesce("_e_a", "_e_b", "_f_a", "_f_b")
    rows = rows.withColumn("_entry", entry).withColumn("_named", F.trim(F.coalesce(F.col("_entry.source"), F.nullif(F.trim("source"), F.lit("")), "_host", F.lit(""))))
    rows = rows.withColumn("_k", source_key(F.col("_named")))
    key = F.when(F.col("_k") != "", F.col("_k")).otherwise(F.col("article_id").cast("string"))
    newest = F.max_by(F.struct("article_id", F.nullif("_named", F.lit("")).alias("source")), F.struct(F.coalesce(F.unix_micros("published_at"), F.lit(0)), "article_id"))
    out = rows.groupBy("cluster_id", key.alias("source_key")).agg(newest.alias("b"), F.coalesce(F.max("_entry.n"), F.count("*")).alias("article_count"))
    return out.select("cluster_id", "source_key", "b.source", "b.article_id", "article_count")


def cluster_details(members: DataFrame, articles: DataFrame, sources: DataFrame, scored: DataFrame) -> DataFrame:
    """The pages of stories, a row per article: title, lead, number of sources, and the place among the newest.

    All visible members but those at aggregators, newest first, undated ones last.
    """
    rows = article_star(members, articles, sources).where(~urls.is_aggregator_url(F.col("canonical_url")))
    counts = rows.groupBy("cluster_id").agg(F.count_distinct("source_id").alias("sources_count"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("published_at").desc_nulls_last(), "article_id"))
    leads = scored.select("cluster_id", "lead_article_id")
    rows = rows.join(leads, "cluster_id", "left").join(counts, "cluster_id")
    return rows.select("cluster_id", place.alias("place"), "article_id", F.coalesce("rewritten_title", "title").alias("title"), "published_at", (F.col("article_id") == F.col("lead_article_id")).alias("is_lead"), "sources_count")


def cluster_centroids(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Mean vector of the visible embedded members, number of all members and newest fetch."""
    rows = members.join(articles.select("article_id", "embedding", "fetched_at", "language_code"), "article_id")
    counted = rows.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.max("fetched_at").alias("last_member_at"))
    usable = rows.where(F.col("embedding").isNotNull() & scores.visible_language(F.col("language_code")))
    means = usable.groupBy("cluster_id").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    vectors = means.select("cluster_id", vector_to_array("m").alias("centroid"))
    return counted.join(vectors, "cluster_id", "left")


def refreshed_centroids(stored: DataFrame, members: DataFrame, articles: DataFrame, as_of: Column, days: int = rules.LOOKBACK_DAYS) -> DataFrame:
    """Centroids of the clusters with a member of the last ``days`` that came after ``stored(cluster_id, updated_at)``, or that are not stored.

    Dates alone decide which clusters are stale; the members of the others are not read for their vectors.
    """
    recent = articles.where(F.col("fetched_at") >= hours_before(as_of, 24 * days)).select("article_id", "fetched_at")
    newest = members.join(recent, "article_id").groupBy("cluster_id").agg(F.max("fetched_at").alias("_newest"))
    lagging = F.col("updated_at").isNull() | (F.col("updated_at") < F.col("_newest"))
    stale = kept(newest.join(stored.select("cluster_id", "updated_at"), "cluster_id", "left").where(lagging).select("cluster_id"))
    return cluster_centroids(members.join(stale, "cluster_id", "left_semi"), articles)


def nearest_centroids(articles: DataFrame, centroids: DataFrame, k: int = 8, cells: int = 0, probe: int = 0) -> DataFrame:
    """``article_id, place, cluster_id, similarity``: the ``k`` nearest centroids of every embedded article.

    Centroids and articles meet in cells of the centroids (`vectors.nearest`),
    which is exact; ``cells`` is their number, by default the square root of the
    centroids'. With ``probe``, an article looks into so many cells only, and
    recall grows with it.
    """
    known = kept(centroids.where("centroid is not null").select(F.col("cluster_id").alias("id"), unit(F.col("centroid")).alias("v")))
    pivots = fit_pivots(known, cells)
    if not pivots.size:
        return articles.sparkSession.createDataFrame([], "article_id long, place int, cluster_id long, similarity double")
    placed = kept(with_cells(known, pivots))
    asked = articles.where("embedding is not null").select(F.col("article_id").alias("id"), unit(F.col("embedding")).alias("v"))
    found = nearest(asked, placed, Cells.of(pivots, cell_facts(placed)), k, probe)
    return found.select(F.col("id").alias("article_id"), "place", F.col("member").alias("cluster_id"), "similarity")


def best_cluster(nearest: DataFrame, centroids: DataFrame, as_of: Column, similarity: float = rules.JOIN_SIMILARITY, most: int = rules.MAX_CLUSTER, days: int = rules.LOOKBACK_DAYS) -> DataFrame:
    """The first of the nearest clusters that is similar, small and active enough."""
    facts = centroids.select("cluster_id", "member_count", "last_member_at")
    fit = nearest.where(F.col("similarity") > similarity).join(facts, "cluster_id").where((F.col("member_count") < most) & (F.col("last_member_at") >= hours_before(as_of, 24 * days)))
    return fit.groupBy("article_id").agg(F.min_by(F.struct("cluster_id", "similarity"), F.col("place")).alias("b")).select("article_id", "b.cluster_id", "b.similarity")


def merge_pairs(centroids: DataFrame, as_of: Column, similarity: float = rules.MERGE_SIMILARITY, most: int = rules.MAX_CLUSTER, days: int = rules.LOOKBACK_DAYS, top: int = 10, exact_rows: int = 100_000, probe: int = 12) -> DataFrame:
    """Pairs of recent clusters of two members or more that are similar and small enough together, the ``top`` most similar.

    Clusters meet in cells of their centroids (`vectors.similar_pairs`): exact
    up to ``exact_rows`` clusters, beyond in the ``probe`` nearest cells of each.
    """
    recent = centroids.where((F.col("member_count") >= 2) & (F.col("last_member_at") >= hours_before(as_of, 24 * days)) & F.col("centroid").isNotNull())
    rows = recent.select(F.col("cluster_id").alias("id"), unit(F.col("centroid")).alias("v"), F.col("member_count").alias("n"))
    found = similar_pairs(rows, similarity, most, top, exact_rows, probe)
    return found.select(F.col("a").alias("c1"), F.col("b").alias("c2"), F.col("n_a").alias("n1"), F.col("n_b").alias("n2"), "similarity")


def merge_clusters(members: DataFrame, pairs: DataFrame, most: int = rules.MAX_CLUSTER) -> DataFrame:
    """Memberships after merging the pairs in order of similarity, the smaller into the larger.

    The choice runs over the few pairs of `merge_pairs`; a cluster that has
    changed keeps its new size for later pairs, one that is gone is skipped.
    """
    size, gone, moves = {}, set(), []
    for p in pairs.orderBy(F.round("similarity", DIGITS).desc(), "c1", "c2").collect():
        a, b = p["c1"], p["c2"]
        na, nb = size.get(a, p["n1"]), size.get(b, p["n2"])
        if a in gone or b in gone or na + nb > most:
            continue
        keep, drop = (a, b) if na >= nb else (b, a)
        size[keep] = na + nb
        gone.add(drop)
        moves.append((drop, keep))
    moved = members.sparkSession.createDataFrame(moves, "cluster_id long, into long")
    return members.join(F.broadcast(moved), "cluster_id", "left").select("article_id", F.coalesce("into", "cluster_id").alias("cluster_id")).distinct()


def fitting(articles: DataFrame, centroids: DataFrame, as_of: Column, similarity: float, most: int) -> DataFrame:
    """``article_id, cluster_id, similarity``: each article's first fitting cluster; the nearest articles fill a cluster up to its cap."""
    fit = best_cluster(nearest_centroids(articles, centroids), centroids, as_of, similarity, most).join(centroids.select("cluster_id", "member_count"), "cluster_id")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("similarity", DIGITS).desc(), "article_id"))
    return fit.withColumn("rank", rank).where(F.col("member_count") + F.col("rank") <= most).select("article_id", "cluster_id", "similarity")


def _alone(articles: DataFrame) -> DataFrame:
    """Articles as clusters of their own, named by their article below zero."""
    return articles.select("article_id", (-F.col("article_id") - 1).alias("cluster_id"), F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("is_new"))


def assign_once(articles: DataFrame, centroids: DataFrame, as_of: Column, similarity: float = rules.JOIN_SIMILARITY, most: int = rules.MAX_CLUSTER) -> DataFrame:
    """Memberships of ``articles`` against fixed ``centroids``; what fits none becomes a cluster of its own."""
    found = kept(fitting(articles, centroids, as_of, similarity, most))
    return found.withColumn("is_new", F.lit(False)).unionByName(_alone(articles.join(found, "article_id", "left_anti")))


def assign_clusters(articles: DataFrame, members: DataFrame, as_of: Column, rounds: int = 2, similarity: float = rules.JOIN_SIMILARITY, most: int = rules.MAX_CLUSTER) -> DataFrame:
    """New memberships ``article_id, cluster_id, similarity, is_new`` of unclustered articles.

    Every round assigns all against fixed centroids; the nearest articles fill a
    cluster up to its cap, then centroids are refreshed. The rest become
    clusters of their own, named by their article below zero. This batch form
    differs from strict arrival order.
    """
    start, found = members, None
    for _ in range(rounds):
        open_ones = articles.join(members, "article_id", "left_anti")
        centroids = kept(cluster_centroids(members, articles))
        fit = kept(fitting(open_ones, centroids, as_of, similarity, most))
        found = fit if found is None else found.unionByName(fit)
        members = members.unionByName(fit.select("article_id", "cluster_id"))
    rest = articles.join(start, "article_id", "left_anti").join(found, "article_id", "left_anti")
    return found.withColumn("is_new", F.lit(False)).unionByName(_alone(rest))


#: Members of a cluster that one task splits exactly, in memory in proportion to them.
SPLIT_ROWS, SEEDS, SEED_TURNS = 50_000, 16, 4


def fitting_pieces(rows: DataFrame, most_rows: int = SPLIT_ROWS) -> DataFrame:
    """``rows`` with ``piece``: the cluster, or a part of it of about ``most_rows`` members at most.

    Members of larger pieces go to the nearest of a few of their own as seeds, again
    and again; pieces of equal seeds, and those that stay too large, are dealt out by hash.
    """
    rows = rows.withColumn("piece", F.col("cluster_id").cast("string"))
    vector = lambda c: F.transform(c, lambda x: x.cast("double"))
    for turn in range(SEED_TURNS + 1):
        rows = rows.persist()
        large = rows.groupBy("piece").agg(F.count("*").alias("_n")).where(F.col("_n") > most_rows)
        if large.isEmpty():
            break
        mark = F.xxhash64("article_id", F.lit(turn))
        some = rows.join(large, "piece").where(F.pmod(mark, F.ceil(F.col("_n") / (4 * SEEDS))) == 0)
        few = F.slice(F.sort_array(F.collect_list(F.struct(mark.alias("m"), "article_id", vector("embedding").alias("v")))), 1, SEEDS)
        seeds = large.join(some.groupBy("piece").agg(few["v"].alias("_v")), "piece", "left")
        by_hash = F.lit(turn == SEED_TURNS) | (F.size(F.array_distinct("_v")) == 1)
        near = F.array_max(F.transform("_v", lambda v, i: F.struct(scores.cosine(vector("embedding"), v).alias("c"), (-i).alias("i"))))
        placed = rows.join(seeds, "piece", "left").withColumn("_to", F.when(by_hash, F.pmod(mark, F.ceil(F.col("_n") * 1.25 / most_rows))).otherwise(-near["i"]))
        rows = placed.withColumn("piece", F.concat_ws("/", "piece", F.col("_to").cast("string"))).select(*rows.columns)
    return rows


def agglomerated(vectors: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """The first member of each row's group after centroid-linkage agglomeration.

    The most similar two groups of ``most`` members together at most, equal ones
    by first members, become one, while their means' cosine is ``similarity``
    or more. Every group keeps its best partner among the later ones; after a
    merge only the rows that lost theirs are compared anew, so memory grows with
    the rows and never with their pairs.
    """
    n = len(vectors)
    unit_of = lambda v: v / max(np.linalg.norm(v), 1e-300)
    sums, means = vectors.astype(float).copy(), np.array([unit_of(v) for v in vectors.astype(float)]).reshape(vectors.shape)
    sizes, alive, owner = np.ones(n, np.int64), np.ones(n, bool), np.arange(n)
    best, value = np.full(n, -1), np.full(n, -2.0)

    def compare(row: int) -> None:
        later = np.round(means[row + 1 :] @ means[row], 12)
        later[~alive[row + 1 :] | (sizes[row + 1 :] + sizes[row] > most)] = -2
        at = int(later.argmax()) if len(later) else -1
        best[row], value[row] = (row + 1 + at, later[at]) if at >= 0 and later[at] > -2 else (-1, -2)

    for low in range(0, n, 512):  # all rows at first, block by block
        cos = np.round(means[low : low + 512] @ means[low:].T, 12)
        cos[np.tri(*cos.shape, dtype=bool)] = -2
        if most < 2:
            cos[:] = -2
        best[low : low + 512], value[low : low + 512] = low + cos.argmax(1), cos.max(1)
    while n:
        a = int(value.argmax())
        if value[a] < similarity or value[a] <= -2:
            break
        b = int(best[a])
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        means[a] = unit_of(sums[a])
        alive[b], value[b], owner[owner == b] = False, -2, a
        for row in np.flatnonzero(alive & ((best == a) | (best == b))):
            compare(int(row))
        compare(a)
        # earlier groups may have found a better partner in the new one
        near = np.round(means[:a] @ means[a], 12)
        better = alive[:a] & (sizes[:a] + sizes[a] <= most) & ((near > value[:a]) | ((near == value[:a]) & (a < best[:a])))
        best[:a][better], value[:a][better] = a, near[better]
    return owner


def split_clusters(members: DataFrame, articles: DataFrame, least: int = 20, similarity: float = rules.SPLIT_SIMILARITY, most: int = rules.MAX_CLUSTER, most_rows: int = SPLIT_ROWS) -> DataFrame:
    """Memberships of the large clusters after centroid-linkage agglomeration; the largest group keeps the id.

    One task splits a cluster, exactly (`agglomerated`); those of more than
    ``most_rows`` members are cut into pieces first, and no group then reaches
    over two pieces.
    """
    import pandas as pd

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("article_id")
        ids = rows["article_id"].to_numpy()
        owner = agglomerated(np.stack([np.asarray(v, float) for v in rows["embedding"]]), similarity, most)
        n = np.bincount(owner, minlength=len(ids))
        return pd.DataFrame({"article_id": ids, "cluster_id": rows["cluster_id"].to_numpy(), "first": ids[owner], "n": n[owner]})

    rows = members.join(articles.where("embedding is not null").select("article_id", "embedding"), "article_id").select("article_id", "cluster_id", "embedding")
    sizes = rows.groupBy("cluster_id").count().where(F.col("count") >= least).select("cluster_id")
    pieces = fitting_pieces(rows.join(sizes, "cluster_id"), most_rows)
    found = pieces.groupBy("piece").applyInPandas(split, "article_id long, cluster_id long, first long, n long").persist()
    kept = found.groupBy("cluster_id").agg((-F.max(F.struct("n", (-F.col("first")).alias("f")))["f"]).alias("kept"))
    part = F.when(F.col("first") == F.col("kept"), "same").otherwise(F.concat_ws("-", F.lit("split"), "cluster_id", "first"))
    return found.join(kept, "cluster_id").select("article_id", "cluster_id", part.alias("part"))


def weighted_terms(articles: DataFrame) -> DataFrame:
    """Inverted index ``article_id, term, field, weight, hits``: titles A, dek and names B, content C."""
    return placed_terms(articles).select("article_id", "term", "field", "weight", "hits")


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """Both short lists fused by the reciprocal of their ranks."""
    one = keyword.withColumn("r1", F.row_number().over(Window.orderBy(F.col("rank").desc(), "article_id")) - 1).select("article_id", "r1")
    two = semantic.withColumn("r2", F.row_number().over(Window.orderBy(F.round("similarity", DIGITS).desc(), "article_id")) - 1).select("article_id", "r2")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    return one.join(two, "article_id", "full").select("article_id", (part("r1") + part("r2")).alias("score")).orderBy(F.col("score").desc(), "article_id").limit(limit)
