"""Text expressions: titles, summaries, figures, headlines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import rules

#: Lower-case Latin letters whose compatibility decomposition is one plain letter and marks.
_FOLDS = {chr(c): base for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c) == chr(c).lower() and "a" <= (base := unicodedata.normalize("NFKD", chr(c))[0]) <= "z" and all(map(unicodedata.combining, unicodedata.normalize("NFKD", chr(c))[1:]))}
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())
# Wordings that results depend on.
SUMMARY_LEADS = (
    r"(?i)^(?:Nature|Nature Climate),?\s*Published online:\s*\d{1,2}\s+\w+\s+\d{4};\s*doi:\S+\s*",
    r"(?i)^This story is co-published with [^.]+\.\s*",
    r"(?i)^Welcome to [^.]+ briefing\.\s*",
)
CONDITIONS = "(?i)^current conditions:"
WALL_WORDS = ("subscription", "subscribe", "sign in", "member", "premium", "paywall")
EMPTY_RESPONSE = r"(?is)^\[\s*\]$|no qualifying"
# White space that becomes one space, and the spaces that are trimmed: all of Unicode's, and no other characters.
WHITE = r"[ \t\n\f\r]+"
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# End of fixed values.


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def slug(text: Column, most: int | None = None, trim: bool = True) -> Column:
    out = F.regexp_replace(folded(F.trim(text)), r"[^a-z0-9]+", "-")
    out = F.regexp_replace(out, r"^-|-$", "") if trim else out
    return F.substring(out, 1, most) if most else out


def cluster_key(title: Column) -> Column:
    """The first eight telling words, joined by dashes."""
    words = F.split(F.regexp_replace(folded(F.coalesce(title, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*rules.STOP_WORDS))
    return F.array_join(F.slice(kept, 1, 8), "-")


def decoded_entities(text: Column) -> Column:
    """Decimal references and the six named ones, ``&amp;`` first."""
    pieces = F.split(text, r"&#\d+;", -1)
    codes = F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1))
    numeric = F.array_join(F.zip_with(pieces, codes, lambda p, c: F.concat(p, F.coalesce(F.char(c.cast("long")), F.lit("")))), "")
    out = F.when(text.rlike(r"&#\d+;"), numeric).otherwise(text)
    for name, value in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def clean_feed_title(title: Column) -> Column:
    """Without the last `` - Publisher`` or `` — Publisher``."""
    return F.trim(F.regexp_replace(title, r"\s[-—]\s(?:(?!\s[-—]\s).)+$", ""))


def title_publisher(title: Column) -> Column:
    """``struct<name, homepage>`` from the suffix of a title; a name that looks like a domain is a homepage."""
    name = decoded_entities(F.trim(F.regexp_extract(title, r"(?s)\s[-—]\s(.+)$", 1)))
    found = F.when(name != "", name)
    return F.struct(found.alias("name"), F.when(found.rlike(r"(?i)(?<![A-Za-z0-9_])[a-z0-9.-]+\.[a-z]{2,}(?![A-Za-z0-9_])"), F.concat(F.lit("https://"), found)).alias("homepage"))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), WHITE, " "), F.lit(SPACES))


def stripped_html(text: Column) -> Column:
    return _one_line(F.coalesce(text, F.lit("")))


def best_dek(*fields: Column, most: int = 300) -> Column:
    """First field with text, without tags, cut after its first long sentence or at ``most`` characters.

    A sentence is sought from the first character only: any that begins later and ends
    with one of its marks would be the end of a longer one from there.
    """
    plain = _one_line(F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields]))
    cut = F.regexp_extract(plain, r"(?s)^(?:.{40,}?[.!?](?= )|.*)", 0)
    return F.when(F.length(cut) > most, F.concat(F.rtrim(F.substring(cut, 1, most - 1), F.lit(SPACES)), F.lit("…"))).otherwise(cut)


def clean_summary(summary: Column) -> Column:
    """One line without publishers' boilerplate; null if nothing or only conditions remain."""
    line = F.trim(F.regexp_replace(summary, r"\s+", " "))
    out = line
    for pattern in SUMMARY_LEADS:
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(out)
    return F.when(line.rlike(CONDITIONS) | (out == ""), None).otherwise(out)


def numeric_tokens(text: Column) -> Column:
    """Figures of a text, without separators and with % for percent."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:%|percent))?)"), F.lit(1))
    plain = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(F.replace(F.lower(t), F.lit(",")), "percent$", "%"), r"[^0-9.%]", ""))
    return plain


def spelled_numbers(text: Column) -> Column:
    """Numbers from zero to ninety that are written as words."""
    names = "|".join(rules.NUMBER_WORDS)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![a-z0-9_])({names})(?![a-z0-9_])"), F.lit(1))
    values = F.create_map(*[x for w, n in rules.NUMBER_WORDS.items() for x in (F.lit(w), F.lit(str(n)))])
    return F.transform(found, lambda w: values[w])


def measurements(text: Column) -> Column:
    """``array<struct<value, unit>>``: figures times magnitude words, with the unit or $ they carry."""
    pattern = F.lit(r"(?i)([$€£])?\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s*([a-z%]+)?")
    source = F.coalesce(text, F.lit(""))
    part = lambda i: F.regexp_extract_all(source, pattern, F.lit(i))
    lookup = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    rows = F.arrays_zip(part(1).alias("money"), part(2).alias("number"), part(3).alias("suffix"))

    def one(row: Column) -> Column:
        suffix, money = F.lower(row["suffix"]), row["money"] != ""
        value = F.replace(row["number"], F.lit(",")).cast("double")
        scale = F.coalesce(F.try_element_at(lookup(rules.MAGNITUDES), suffix), F.when(money, F.try_element_at(lookup(rules.MONEY_MAGNITUDES), suffix)), F.lit(1.0))
        is_scale = suffix.isin(*rules.MAGNITUDES) | (money & suffix.isin(*rules.MONEY_MAGNITUDES))
        unit = F.coalesce(F.when(~is_scale, F.try_element_at(lookup(rules.UNITS), suffix)), F.when(money, "$"), F.lit(""))
        return F.struct((value * scale).alias("value"), unit.alias("unit"))

    return F.transform(rows, one)


def sanitized_headline(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\"'\\s]+|[\"'\\s]+$", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[-.|•–—]+$", ""))


def _once(value: Column, use) -> Column:
    """``use(value)``, for which ``value`` is worked out once however often it occurs."""
    return F.get(F.transform(F.array(value), use), 0)


def content_snippet(text: Column, most: int = 600) -> Column:
    """Leading sentences of a page's text; null for short, walled, wordless or repetitive ones, and those of less than 50 characters together."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(state: Column, sentence: Column) -> Column:
        over = F.length(state["text"]) + F.length(sentence) > most
        joined = F.concat(state["text"], F.when(state["text"] != "", " ").otherwise(""), sentence, F.lit("."))
        return (
            F.when(state["full"] | (F.length(sentence) < 10), state)
            .when(over, F.struct(state["text"].alias("text"), F.lit(True).alias("full")))
            .otherwise(F.struct(joined.alias("text"), F.lit(False).alias("full")))
        )

    def leading(plain: Column) -> Column:
        sentences = F.transform(F.split(plain, r"[.!?]+" + WHITE), lambda s: F.trim(s, F.lit(SPACES)))
        return F.aggregate(sentences, start, add, lambda s: s["text"])

    def varied(words: Column) -> Column:
        return (F.size(words) >= 30) & (F.size(F.array_distinct(words)) >= F.size(words) * 0.3)

    def open_page(head: Column) -> Column:
        return sum((head.contains(w).cast("int") for w in WALL_WORDS), F.lit(0)) < 2

    def snippet(plain: Column) -> Column:
        words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), F.lower)
        usable = (F.length(plain) >= 100) & _once(F.lower(F.substring(plain, 1, 200)), open_page) & _once(words, varied)
        return F.when(usable, _once(leading(plain), lambda s: F.when(F.length(s) >= 50, s)))

    return _once(stripped_html(text), snippet)


def is_apology(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(rules.APOLOGY), F.lit(False))


def is_headline_title(title: Column) -> Column:
    long = (F.length(F.trim(title)) >= 20) & (F.length(title) <= 300)
    return F.coalesce(long & ~title.rlike(rules.ARTEFACT) & ~is_apology(title), F.lit(False))


def is_empty_response(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(EMPTY_RESPONSE), F.lit(False))


def has_paywall_phrase(text: Column, words: Column) -> Column:
    return F.when(words < 300, text.rlike(rules.PAYWALL_PHRASES)).otherwise(F.substring(text, 1, 500).rlike(rules.PAYWALL_PHRASES))


def has_blocked_phrase(text: Column) -> Column:
    return text.rlike(rules.BLOCKED_PHRASES)


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and navigation."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return stripped_html(bare)


def word_total(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def link_density(html: Column, words: Column) -> Column:
    """Share of the words that lie in links, at most 1."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    linked = F.aggregate(anchors, F.lit(0), lambda n, a: n + word_total(stripped_html(a)))
    return F.when(words <= 0, 0.0).otherwise(F.least(F.lit(1.0), linked / words))


def feed_links(html: Column) -> Column:
    """Addresses of the feeds that a page declares, in order."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1))
    feeds = F.filter(tags, lambda t: t.rlike(r"(?i)\brel=[\"']?alternate") & t.rlike(r"(?i)application/(rss|atom)\+xml"))
    return F.filter(F.transform(feeds, lambda t: F.regexp_extract(t, r"(?i)\bhref=[\"']?([^\"'\s>]+)", 1)), lambda h: h != "")


def clean_result_text(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\*\*|__+|`", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\[(.*?)\]\((.*?)\)", "$1"), r"<[^>]+>", ""))
