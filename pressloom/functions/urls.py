"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import rules


def url_host(url: Column) -> Column:
    """Lower-case host without www.; null for what is no http URL."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def url_path(url: Column) -> Column:
    """Path from the first slash after the host; "/" if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def canonical_url(url: Column) -> Column:
    """Without tracking parameters and fragment, host in lower case, path "/" if empty; what is no URL stays."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(rules.TRACKING_PATTERN))
    origin = F.lower(F.regexp_extract(base, r"^([A-Za-z]+://[^/]+)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")
    path = F.regexp_extract(base, r"^[A-Za-z]+://[^/]+(/.*)$", 1)
    whole = F.concat(origin, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url.rlike(r"^[A-Za-z]+://[^/?#\s]+"), whole).otherwise(url)


def publisher_host(url: Column) -> Column:
    """Host for counting outlets: port and common prefixes stripped."""
    host = F.split_part(F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.lower(F.regexp_replace(host, r"^(www|m|mobile|amp|amp-cdn|edition|news|beta)\.", ""))


def leaderboard_host(url: Column) -> Column:
    """Host for the leaderboard, which keeps news. and edition. apart."""
    host = F.lower(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[:/].*$", ""))
    return F.regexp_replace(host, r"^(www\.|m\.|mobile\.|amp\.|amp-cdn\.)", "")


def tier_host(url: Column) -> Column:
    """Host or URL for tier lookup."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://", ""), r"/.*$", ""), r":\d+$", "")
    return F.regexp_replace(host, r"^(?:www|m|amp|edition|beta)\.", "")


def root_domain(host: Column) -> Column:
    """Last two labels, or three below a compound top level."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) <= 2, host).when(two.isin(*rules.COMPOUND_TLDS), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def humanized_host(host: Column) -> Column:
    """Labels that mean something, capitalised; the first one if none does."""
    capital = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000_000))
    labels = F.split(host, r"\.")
    kept = F.filter(labels, lambda s: ~F.lower(s).isin(*rules.PLAIN_LABELS))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, capital), " ")).otherwise(capital(labels[0]))


def host_suffixes(host: Column) -> Column:
    """The host and its parents of two labels or more, nearest first, as ``struct<depth, host>``."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, i + 1, n), ".").alias("host")))


def is_aggregator_url(url: Column) -> Column:
    return url.rlike("(?i)" + rules.AGGREGATOR_PATTERN)


def is_aggregator_host(host: Column) -> Column:
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    return bare.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in rules.AGGREGATOR_HOSTS) + ")$")


def is_low_value_url(url: Column, hosts=rules.LOW_VALUE_HOSTS) -> Column:
    return url.rlike(rules.host_pattern(hosts))


def is_paywall_url(url: Column, hosts=rules.PAYWALL_HOSTS) -> Column:
    return url.rlike(r"://([^/]*\.)?(" + "|".join(h.replace(".", r"\.") for h in hosts) + r")(/|$)")


def is_fabricated_url(url: Column) -> Column:
    """Paths that end in a run of zeros or have a segment of zeros."""
    path = url_path(url)
    return F.coalesce(path.rlike(r"-0{4,}$|/0{5,}(/|$)"), F.lit(False))


def is_section_path(path: Column) -> Column:
    """Listing and landing pages: the root, one short segment without digits, a listing prefix and a short slug."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    short = lambda s: ~s.rlike("[0-9]") & (F.length(s) - F.length(F.replace(s, F.lit("-"))) <= 1)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when(F.size(parts) == 0, True).when(F.size(parts) == 1, short(first)).when(F.size(parts) == 2, F.lower(first).isin(*rules.LISTING_SEGMENTS) & short(second)).otherwise(False)


def query_parameter(url: Column, name: str) -> Column:
    value = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(value != "", F.try_url_decode(value))


def unwrapped_redirect(url: Column) -> Column:
    """The publisher's URL behind an aggregator link: a url, q or u parameter, or a base64 path segment; else the link."""
    plain = F.coalesce(*[F.when(v.startswith("http"), v) for v in (query_parameter(url, p) for p in ("url", "q", "u"))])
    token = F.regexp_extract(url_path(url), r"([A-Za-z0-9+/=_-]{8,})$", 1)
    token = F.regexp_extract(token, r"([^/]*)$", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    inner = F.regexp_extract(decoded, r"(https?://[\x21-\x7e]+)", 1)
    target = F.coalesce(plain, F.when(inner != "", inner))
    return F.when(url_host(url) == "news.google.com", F.coalesce(canonical_url(target), url)).otherwise(url)
