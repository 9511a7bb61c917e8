"""Gates of incoming items: whole ordered chains, attribution to sources, retention, merges of resolved URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import rules, scores, texts, urls
from pressloom.operators.curation import candidate_duplicates, gate, recent_duplicates, relevance
from pressloom.operators.storage import kept
from pressloom.sources.model import hours_before

OUTCOMES = (
    "inserted invalid_title non_climate non_english duplicate_url duplicate_title duplicate_candidate missing_date stale invalid_date "
    "fabricated_url aggregator_url low_value_host unresolved_aggregator out_of_domain unreachable insert_failed article_cap_reached"
).split()


def with_trust(rows: DataFrame, key: str, hosts: DataFrame, patterns: Sequence[str] = (), feed: Column | None = None, homepage: Column | None = None, url: Column | None = None, host: Column | None = None) -> DataFrame:
    """``rows`` with ``trusted``: whether a source skips the topic gate.

    An http feed counts by a path pattern or its host, a pseudo-feed
    (``web://host``) by its host; so do the host and the item's address. The
    homepage counts only where there is no http feed. Hosts count with all
    hosts below them; ``hosts(host)`` meets exploded parents in one join.
    """
    none = F.lit(None).cast("string")
    feed, homepage, url, host = (none if c is None else c for c in (feed, homepage, url, host))
    http = F.coalesce(feed.rlike("(?i)^https?://"), F.lit(False))
    bare = F.regexp_replace(feed, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    named = F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), urls.tier_host(c)) for c in (bare, host, url, F.when(~http, homepage))]))
    below = rows.select(key, F.explode(named).alias("h")).select(key, F.explode(urls.host_suffixes(F.col("h"))).alias("s")).select(key, F.col("s.host").alias("host"))
    found = below.join(hosts.select("host"), "host", "left_semi").select(key, F.lit(True).alias("_by_host")).distinct()
    by_path = http & F.coalesce(feed.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
    marked = rows.join(found, key, "left")
    return marked.withColumn("trusted", F.coalesce("_by_host", F.lit(False)) | by_path).drop("_by_host")


def discovery_gate(
    candidates: DataFrame,
    articles: DataFrame,
    trusted_hosts: DataFrame,
    tiers: dict[str, str],
    as_of: Column,
    cutoff: Column,
    cap: int,
    max_days: int = 7,
    aggregators: Sequence[str] = rules.AGGREGATOR_HOSTS,
) -> DataFrame:
    """``run_id, place, candidate_id, outcome, duplicate_article_id, article_url`` with one of ``OUTCOMES`` for every candidate.

    ``candidates(run_id, place, candidate_id, title, url, snippet, published_at,
    language_code, domain, reachable, stored)`` come one after the other, runs
    in order and by place within a run; ids may repeat. First an address that the run has had, one still at an aggregator or
    outside of the search's ``domain`` (null: any) leaves; then come the cap on
    inserted items of a run, freshness, title, topic or trust, aggregator,
    fabricated address, low-value host, date, language, duplicates, reach and
    storing. Duplicates are stored articles by address or recent title, and
    candidates inserted before, in any run; one that the cap stopped is not
    stored and blocks nothing (`inserted_in_order`). One run's candidates are one window.
    """
    real = urls.canonical_url(urls.unwrapped_redirect(F.col("url")))
    # addresses are worked out once and written, as many steps below ask for them; rows get numbers of their own
    rows = kept(candidates.withColumn("_real", real).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_host": F.lower(urls.url_host(F.col("_real"))), "_at": F.struct("run_id", "place", "candidate_id", "_row")})
    again = F.row_number().over(Window.partitionBy("run_id", F.lower("url")).orderBy("_at")) > 1
    searched = F.col("domain").isNotNull()
    inside = (F.col("_host") == F.lower("domain")) | F.endswith("_host", F.concat(F.lit("."), F.lower("domain")))
    rows = with_trust(rows.withColumn("_again", again), "_row", trusted_hosts, url=F.col("_real"))
    known = candidate_duplicates(rows.select(F.col("_row").alias("candidate_id"), "title", F.col("_real").alias("url")), articles, as_of)
    rows = rows.join(known.select(F.col("candidate_id").alias("_row"), F.col("reason").alias("_known"), F.col("article_id").alias("duplicate_article_id")), "_row")

    told = F.concat_ws(" ", "title", "snippet")
    fresh = scores.candidate_freshness(F.col("published_at"), cutoff)
    date = scores.date_validity(F.col("published_at"), as_of, max_days)
    blocked = F.col("_host").isin(*aggregators)
    before_cap = [("duplicate_candidate", F.col("_again")), ("unresolved_aggregator", searched & blocked), ("out_of_domain", searched & ~F.coalesce(inside, F.lit(False)))]
    steps = [
        ("missing_date", fresh == "missing_date"),
        ("stale", fresh == "stale"),
        ("invalid_title", ~texts.is_headline_title(F.col("title"))),
        ("non_climate", ~F.col("trusted") & ~relevance(told, tiers)),
        ("aggregator_url", blocked),
        ("fabricated_url", urls.is_fabricated_url(F.col("_real"))),
        ("low_value_host", urls.is_low_value_url(F.col("_real"))),
        ("stale", date == "too_old"),
        ("invalid_date", date != "valid"),
        ("non_english", ~scores.visible_language(F.col("language_code"))),
    ]
    storing = [("unreachable", ~F.col("reachable")), ("insert_failed", ~F.col("stored"))]
    for chain, name in ((before_cap, "_early"), (steps, "_judged"), (storing, "_late")):
        rows = gate(rows, chain).withColumnRenamed("reason", name)
    # written once, as the look-ups below read the judged rows again
    rows = kept(rows.select("run_id", "place", "candidate_id", "_at", "_real", F.lower(F.trim("title")).alias("_title"), "_early", "_judged", "_late", "_known", "duplicate_article_id"))
    open_ = rows.where("coalesce(_early, _judged, _known, _late) is null")
    inserted = kept(inserted_in_order(open_, cap))
    # an address or title is inserted once at most, so these joins add no rows
    rows = rows.join(inserted.select("_real", F.col("_at").alias("_first_url")), "_real", "left").join(inserted.select("_title", F.col("_at").alias("_first_title")), "_title", "left")
    rows = rows.join(inserted.select("_at", F.lit(1).alias("_in")), "_at", "left")
    earlier = Window.partitionBy("run_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("_in").over(earlier), F.lit(0)) >= cap
    by_url = (F.col("_known") == "duplicate_url") | (F.col("_first_url") < F.col("_at"))
    by_title = (F.col("_known") == "duplicate_title") | (F.col("_first_title") < F.col("_at"))
    duplicate = F.when(by_url, "duplicate_url").when(by_title, "duplicate_title")
    outcome = F.coalesce(F.col("_early"), F.when(full, "article_cap_reached"), F.col("_judged"), duplicate, F.col("_late"), F.lit("inserted"))
    rows = rows.withColumn("outcome", outcome)
    stored = F.when(F.col("outcome") == F.col("_known"), F.col("duplicate_article_id")).alias("duplicate_article_id")
    return rows.select("run_id", "place", "candidate_id", "outcome", stored, F.col("_real").alias("article_url"))


def inserted_in_order(candidates: DataFrame, cap: int) -> DataFrame:
    """Those of ``candidates(run_id, _at, _real, _title)`` that are inserted when they come in the order of ``_at``.

    One is, if its run has inserted less than ``cap`` before and no inserted one
    before it has its address or title. Rounds decide what earlier decisions
    allow: a candidate is out once one that shares a key is in, or its run is
    full; it is in once all before it that share a key are out and its run would
    not be full even with all undecided ones. The earliest undecided one is
    decided in every round, and most are in the first ones; rounds grow with the
    longest chain of candidates that wait for each other.
    """
    state = kept(candidates.select("run_id", "_at", "_real", "_title", F.lit(None).cast("boolean").alias("_in")))
    earlier = Window.partitionBy("run_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    while state.where("_in is null").limit(1).count():
        rows = state
        for key in ("_real", "_title"):
            facts = state.groupBy(key).agg(F.min("_at").alias(f"{key}_first"), F.min(F.when(F.col("_in"), F.col("_at"))).alias(f"{key}_in"))
            rows = rows.join(facts, key)
        rows = rows.withColumn("_sure", F.coalesce(F.sum(F.col("_in").cast("int")).over(earlier), F.lit(0))).withColumn("_most", F.count("*").over(earlier))
        blocked = F.coalesce(F.col("_real_in") < F.col("_at"), F.lit(False)) | F.coalesce(F.col("_title_in") < F.col("_at"), F.lit(False)) | (F.col("_sure") >= cap)
        first = (F.col("_real_first") == F.col("_at")) & (F.col("_title_first") == F.col("_at")) & (F.col("_most") < cap)
        state = kept(rows.withColumn("_in", F.coalesce("_in", F.when(blocked, False).when(first, True))).where("_in is null or _in").select("run_id", "_at", "_real", "_title", "_in"))
    return state.drop("_in")


def curate_items(items: DataFrame, articles: DataFrame, trusted_hosts: DataFrame, tiers: dict[str, str], as_of: Column, patterns: Sequence[str] = (), max_days: int = 30, query_feed: bool = False) -> DataFrame:
    """``items`` with ``reason`` (null: inserted), ``article_url`` and ``trusted``.

    ``items(item_id, source_id, title, link, dek, published_at, language_code,
    feed_url, homepage_url)``. A feed's items pass title and link, topic or
    trust, language, date and duplicates by address or title of a week; those of
    a query feed also a low-value-host gate before and after unwrapping.
    Earlier items of the batch count as stored, by address or title.
    """
    real = urls.canonical_url(urls.unwrapped_redirect(F.col("link")))
    # addresses are worked out once and written, as many steps below ask for them
    rows = with_trust(kept(items.withColumn("article_url", real)), "item_id", trusted_hosts, patterns, feed=F.col("feed_url"), homepage=F.col("homepage_url"), url=F.col("article_url"))
    known = recent_duplicates(rows.select(F.col("item_id").alias("candidate_id"), "title", F.col("article_url").alias("url")), articles, as_of)
    rows = rows.join(known.select(F.col("candidate_id").alias("item_id"), F.lit(True).alias("_known")), "item_id", "left")
    missing = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    low = [("low_value_host", urls.is_low_value_url(F.col("link")) | urls.is_low_value_url(F.col("article_url")))] if query_feed else []
    steps = [
        ("missing_title_or_link", missing("title") | missing("link")),
        *low,
        ("non_climate", ~F.col("trusted") & ~relevance(F.concat_ws(" ", "title", "dek"), tiers)),
        ("non_english", ~scores.visible_language(F.col("language_code"))),
        ("invalid_date", scores.date_validity(F.col("published_at"), as_of, max_days) != "valid"),
        ("duplicate", F.col("_known")),
    ]
    rows = kept(gate(rows, steps).withColumn("_title", F.lower(F.trim("title"))).select(*items.columns, "article_url", "trusted", "reason", "_title"))
    passing = rows.where("reason is null")
    for key in ("article_url", "_title"):
        first = passing.groupBy(key).agg(F.min("item_id").alias(f"_first_{key}"))
        rows = rows.join(first, key, "left")
    later = F.col("reason").isNull() & ((F.col("_first_article_url") < F.col("item_id")) | (F.col("_first__title") < F.col("item_id")))
    return rows.withColumn("reason", F.when(later, "duplicate").otherwise(F.col("reason"))).select(*items.columns, "article_url", "trusted", "reason")


def feed_totals(curated: DataFrame) -> DataFrame:
    """Scanned and inserted items of each source."""
    return curated.groupBy("source_id").agg(F.count("*").alias("scanned"), F.count_if(F.col("reason").isNull()).alias("inserted"))


def host_slug(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def attribute_sources(articles: DataFrame, sources: DataFrame, fallback: int, tiers: DataFrame | None = None, blocked: Sequence[str] = rules.AGGREGATOR_HOSTS, most_parts: int = 8) -> DataFrame:
    """``article_id, source_id, publisher_name, publisher_homepage, new_source`` of ``articles(article_id, canonical_url, publisher_name, publisher_homepage)``.

    The host is the address's, or the publisher's homepage's if that is at an
    aggregator; without either the article goes to ``fallback``. A source fits
    by its slug, its ``web://`` feed, or a homepage that contains the host; so
    does one that fits the root of the host. The heaviest wins, then the
    smallest id. Where none fits, ``new_source`` has the slug, feed, name and
    weight of a source to add. That a homepage contains a host is one equi-join
    on the runs of labels in the homepage's host, not a comparison of all pairs.
    """
    own, home = urls.url_host(F.col("canonical_url")), urls.url_host(F.col("publisher_homepage"))
    usable = lambda h: h.isNotNull() & ~h.isin(*blocked)
    host = F.when(usable(own), own).when(usable(home), home)
    rows = articles.select("article_id", "publisher_name", "publisher_homepage", host.alias("host")).withColumn("root", urls.root_domain(F.col("host")))
    weight = F.coalesce("weight", F.lit(0))
    labels = F.split(F.regexp_replace(F.lower("homepage_url"), r"^[a-z]+://|[/?#].*$", ""), r"\.")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_parts), F.size(labels) - i + 1)), lambda n: F.concat(F.lit("home:"), F.array_join(F.slice(labels, i, n), ".")))))
    keys = F.concat(F.array(F.concat(F.lit("slug:"), "slug"), F.concat(F.lit("feed:"), "feed_url")), F.coalesce(spans, F.array().cast("array<string>")))
    listed = sources.select("source_id", weight.alias("w"), F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))
    best = listed.groupBy("k").agg(F.max(F.struct("w", (-F.col("source_id")).alias("minus"))).alias("b"))
    hosts = rows.where("host is not null").select("host", "root").distinct()
    asked = F.flatten(F.transform(F.array("host", "root"), lambda h: F.array(F.concat(F.lit("slug:"), host_slug(h)), F.concat(F.lit("feed:web://"), h), F.concat(F.lit("home:"), h))))
    found = hosts.select("host", F.explode(asked).alias("k")).join(best, "k").groupBy("host").agg((-F.max("b")["minus"]).alias("found"))
    named = hosts.select("host")
    if tiers is not None:
        parts = named.select("host", F.explode(urls.host_suffixes(F.col("host"))).alias("s")).select(F.col("host").alias("own"), "s.depth", F.col("s.host").alias("host"))
        named = named.join(parts.join(tiers, "host").groupBy(F.col("own").alias("host")).agg(F.min_by("value", "depth").alias("tier")), "host", "left")
    else:
        named = named.withColumn("tier", F.lit(None).cast("int"))
    whole = rows.join(found, "host", "left").join(named, "host", "left")
    proper = F.trim("publisher_name")
    proper = F.when((proper != "") & ~proper.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"), proper)
    none, fits = F.col("host").isNull(), F.col("found").isNotNull()
    name = F.coalesce(proper, urls.humanized_host(F.col("host")))
    new = F.struct(host_slug(F.col("host")).alias("slug"), F.concat(F.lit("web://"), "host").alias("feed_url"), name.alias("name"), F.coalesce("tier", F.lit(rules.UNKNOWN_WEIGHT)).alias("weight"))
    return whole.select(
        "article_id",
        F.when(none, F.lit(fallback)).otherwise(F.col("found")).cast("long").alias("source_id"),
        F.when(none, proper).when(~fits, name).alias("publisher_name"),
        F.when(none, F.col("publisher_homepage")).otherwise(F.concat(F.lit("https://"), "host")).alias("publisher_homepage"),
        F.when(~none & ~fits, new).alias("new_source"),
    )


def retention(articles: DataFrame, links: dict[str, DataFrame], clusters: dict[str, DataFrame], as_of: Column, days: int = 45) -> dict[str, DataFrame]:
    """What is kept of ``articles``, of the ``links`` on article_id, and of the ``clusters`` tables on cluster_id.

    Old articles go by publication, or else by fetch; rows that link to them
    follow; then scores and clusters without a member in ``article_clusters`` go.
    """
    young = articles.where(F.coalesce("published_at", "fetched_at") >= hours_before(as_of, 24 * days))
    out = {"articles": young} | {n: rows.join(young.select("article_id"), "article_id", "left_semi") for n, rows in links.items()}
    members = out["article_clusters"].select("cluster_id").distinct()
    return out | {n: rows.join(members, "cluster_id", "left_semi") for n, rows in clusters.items()}


def retention_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``name, before, dropped, after`` of each table; a dry run writes nothing else."""
    count = lambda name, rows, sign: rows.select(F.lit(name).alias("name"), F.lit(sign).alias("side"))
    rows = None
    for name in before:
        both = count(name, before[name], 0).unionByName(count(name, after[name], 1))
        rows = both if rows is None else rows.unionByName(both)
    n = rows.groupBy("name").agg(F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after"))
    return n.select("name", "before", (F.col("before") - F.col("after")).alias("dropped"), "after")


def merge_resolved(articles: DataFrame, resolved: DataFrame, sources: DataFrame, fallback: int) -> DataFrame:
    """``articles`` after their wrapped addresses were resolved, with ``action``.

    ``resolved(article_id, url)`` has the publisher's address, null if unknown.
    A wrapper whose address another article has goes, as do later wrappers of
    one address; the rest get the address, are attributed anew and lose their
    content status, so that their pages are fetched again.
    """
    found = resolved.where("url is not null").select("article_id", urls.canonical_url(F.col("url")).alias("_url"))
    taken = articles.select(F.col("canonical_url").alias("_url"), F.col("article_id").alias("_owner"))
    others = found.join(taken, "_url").where("_owner <> article_id").select("article_id").distinct().withColumn("_taken", F.lit(True))
    first = found.groupBy("_url").agg(F.min("article_id").alias("_first"))
    fate = found.join(first, "_url").join(others, "article_id", "left")
    fate = fate.select("article_id", "_url", (F.coalesce("_taken", F.lit(False)) | (F.col("article_id") != F.col("_first"))).alias("_gone"))
    rows = articles.join(fate, "article_id", "left").where(~F.coalesce("_gone", F.lit(False)))
    moved = rows.where("_url is not null")
    blank = F.lit(None).cast("string")
    owner = attribute_sources(moved.select("article_id", F.col("_url").alias("canonical_url"), blank.alias("publisher_name"), blank.alias("publisher_homepage")), sources, fallback)
    rows = rows.join(owner.select("article_id", F.col("source_id").alias("_source"), F.col("new_source")), "article_id", "left")
    hit = F.col("_url").isNotNull()
    changed = {"canonical_url": F.coalesce("_url", "canonical_url"), "source_id": F.when(hit, F.col("_source")).otherwise(F.col("source_id")), "content_status": F.when(~hit, F.col("content_status")), "action": F.when(hit, "rewrite").otherwise("keep")}
    return rows.withColumns(changed).drop("_url", "_gone", "_source")


def feed_candidates(pages: DataFrame, most: int = 6, paths: Sequence[str] = ("/feed", "/rss", "/atom.xml", "/feed.xml", "/rss.xml", "/index.xml")) -> DataFrame:
    """``page_id, place, feed_url``: feeds that pages declare, resolved against their address, then well-known paths; http only, distinct, ``most`` at most."""
    base = F.col("url")
    origin = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1), "[^/]*$", "")

    def resolved(href: Column) -> Column:
        return (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
        )

    declared = F.transform(texts.feed_links(F.col("html")), resolved)
    known = F.array(*[F.concat(origin, F.lit(p)) for p in paths])
    whole = F.filter(F.array_distinct(F.concat(declared, known)), lambda u: u.rlike(r"(?i)^https?://[^/?#\s]+"))
    return pages.select("page_id", F.posexplode(F.slice(whole, 1, most)).alias("place", "feed_url"))
