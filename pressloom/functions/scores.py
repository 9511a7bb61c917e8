"""Score expressions. ``as_of`` is always an argument."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import rules
from pressloom.functions.urls import is_aggregator_url, is_low_value_url


def age_hours(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 3_600_000_000.0


def _decay(at: Column, as_of: Column, half_life: float, most: float) -> Column:
    return F.exp(F.lit(log(0.5)) * F.least(age_hours(at, as_of) / half_life, F.lit(float(most))))


def cluster_freshness(latest: Column, as_of: Column) -> Column:
    """1 now, halved every 12 hours, no further than ten times; null counts as ten."""
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-4), _decay(latest, as_of, rules.CLUSTER_HALF_LIFE_H, 10)))


def article_freshness(published: Column, as_of: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-4), _decay(F.coalesce(published, as_of), as_of, rules.ARTICLE_HALF_LIFE_H, 10)))


def serve_score(base: Column, latest: Column, stored: Column, as_of: Column) -> Column:
    return F.when(latest.isNotNull(), base + rules.SCORE_SHARES["freshness"] * cluster_freshness(latest, as_of)).otherwise(stored)


def age_damping(first: Column, as_of: Column) -> Column:
    damped = F.greatest(F.lit(rules.DAMPING_FLOOR), F.least(F.lit(1.0), _decay(first, as_of, rules.DAMPING_HALF_LIFE_H, 20)))
    return F.when(first.isNull(), 1.0).otherwise(damped)


def top_gate(strong: Column, lead_weight: Column) -> Column:
    enough = F.lit(rules.GATE_SOURCES)
    return (F.coalesce(strong, enough) >= enough) | (F.coalesce(lead_weight, F.lit(0)) >= rules.GATE_LEAD_WEIGHT)


def singleton_discount(strong: Column) -> Column:
    return F.when(F.coalesce(strong, F.lit(rules.GATE_SOURCES)) < rules.GATE_SOURCES, rules.SINGLETON_DISCOUNT).otherwise(1.0)


def effective_weight(weight: Column, url: Column) -> Column:
    known = F.coalesce(weight, F.lit(rules.UNKNOWN_WEIGHT))
    return F.when(url.rlike("(?i)" + rules.JOURNAL_PATTERN), F.least(known, F.lit(rules.JOURNAL_CAP))).otherwise(known)


def editorial_quality(weight: Column, author: Column, dek: Column, url: Column) -> Column:
    named = F.when(F.trim(F.coalesce(author, F.lit(""))) != "", 0.25).otherwise(0.0)
    long = F.when(F.length(F.coalesce(dek, F.lit(""))) >= 120, 0.10).otherwise(0.0)
    return weight + named + long - F.when(is_aggregator_url(url), 0.5).otherwise(0.0) - F.when(is_low_value_url(url), 0.6).otherwise(0.0)


def article_score(quality: Column, fresh: Column) -> Column:
    return 0.4 * quality + 0.6 * fresh


def lead_score(quality: Column, fresh: Column) -> Column:
    return 0.8 * quality + 0.2 * fresh


def visible_language(code: Column) -> Column:
    return code.isNull() | (code == "en")


def lead_ineligible(url: Column, published: Column, fetched: Column) -> Column:
    """Aggregators, low-value hosts and dates that are missing or within a minute of the fetch."""
    gap = F.abs(F.unix_micros(published) - F.unix_micros(fetched)) <= 60_000_000
    return is_aggregator_url(url) | is_low_value_url(url) | published.isNull() | F.coalesce(gap, F.lit(False))


def date_validity(at: Column, as_of: Column, max_days: int = 30) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(at)
    second = 1_000_000
    return (
        F.when(at.isNull(), "missing_date")
        .when(age < -60 * second, "future_date")
        .when(F.abs(age) < 30 * second, "suspicious_current_time")
        .when(age > max_days * 86400 * second, "too_old")
        .otherwise("valid")
    )


def candidate_freshness(at: Column, cutoff: Column) -> Column:
    return F.when(at.isNull(), "missing_date").when(at < cutoff, "stale").otherwise("fresh")


def reader_available(url: Column, status: Column, words: Column) -> Column:
    from pressloom.functions.urls import is_paywall_url

    bad = status.isin("paywall", "blocked", "timeout", "error") | ((status == "success") & (words < 100))
    return ~is_paywall_url(url) & ~F.coalesce(bad, F.lit(False))


def content_cache_state(status: Column, fetched: Column, as_of: Column, days: int = 7) -> Column:
    known = status.isin("success", "paywall", "timeout", "blocked", "not_found", "error")
    young = F.unix_micros(as_of) - F.unix_micros(fetched) < days * 86_400_000_000
    return F.when(status.isNull() | ~F.coalesce(young, F.lit(False)), "refetch").when(known, "cached").otherwise("error")


def categorise_gate(status: Column, attempts: Column, tried: Column, content_fetched: Column) -> Column:
    """Never tried; or few attempts and not known to be without category; or new content since."""
    again = (F.coalesce(attempts, F.lit(0)) < 3) & (F.coalesce(status, F.lit("")) != "no_category")
    newer = F.coalesce(content_fetched > F.coalesce(tried, F.lit(0).cast("timestamp")), F.lit(False))
    return status.isNull() | again | newer


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or of no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(dot(a, b) / norm)
