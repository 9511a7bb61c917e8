"""Host lists, weights, patterns and thresholds. All are defaults; operators take them as arguments."""

# Fixed values that results must share with the system whose behaviour is matched.
AGGREGATOR_HOSTS = ("news.google.com", "news.yahoo.com", "msn.com")
AGGREGATOR_PATTERN = r"news\.google\.|news\.yahoo\.com|www\.msn\.com"
LOW_VALUE_HOSTS = (
    "thecooldown.com energiesmedia.com autonocion.com goodmenproject.com bgr.com prnewswire.com businesswire.com globenewswire.com newswise.com openpr.com "
    "webwire.com einnews.com prnasia.com accesswire.com stocktitan.net marketbeat.com simplywall.st fool.com indexbox.io tipranks.com "
    "gurufocus.com tradingview.com investing.com marketscreener.com seekingalpha.com benzinga.com zacks.com yahoo.com msn.com facebook.com"
).split()
PAYWALL_HOSTS = "nytimes.com wsj.com ft.com economist.com bloomberg.com washingtonpost.com newyorker.com theathletic.com foreignpolicy.com".split()
JOURNAL_PATTERN = r"nature\.com/articles/s415(58|60)-|nature\.com/articles/s41558|nature\.com/articles/s41560"
JOURNAL_CAP, UNKNOWN_WEIGHT = 6, 2
COMPOUND_TLDS = "co.uk org.uk ac.uk com.au org.au co.nz org.in co.in co.za com.br co.jp".split()
PLAIN_LABELS = "com org net edu gov io co info biz us uk ca au de fr nz ie in pk sg hk za my ph br mx jp kr cn tw th vn id ae sa il eg ng ke gh www".split()
TRACKING_PATTERN = r"(?i)^(utm_.*|fbclid|gclid|mc_.*|ved|usg|oc|si)$"
LISTING_SEGMENTS = "topic topics tag tags category categories section sections author authors hub hubs search page newsletters podcasts videos".split()
STOP_WORDS = "the a an and or but to of in on for with by from at is are was were be as".split()
CLUSTER_HALF_LIFE_H, ARTICLE_HALF_LIFE_H, VELOCITY_WINDOW_H = 12, 6, 24
SCORE_SHARES = {"freshness": 0.30, "velocity": 0.35, "coverage": 0.15, "authority": 0.15, "pool": 0.05}
NOVELTY_SHARE = 0.03
DAMPING_HALF_LIFE_H, DAMPING_FLOOR, SINGLETON_DISCOUNT = 168, 0.7, 0.85
GATE_SOURCES, STRONG_WEIGHT, GATE_LEAD_WEIGHT = 2, 4, 8
NOVELTY_FLOOR, NOVELTY_CEIL = 0.45, 0.75
JOIN_SIMILARITY, MERGE_SIMILARITY, SPLIT_SIMILARITY, MAX_CLUSTER, LOOKBACK_DAYS = 0.68, 0.72, 0.68, 25, 5
PAYWALL_PHRASES = r"(?i)subscribe to read|subscription (?:is )?required|become a subscriber|sign in to continue|this article is for subscribers|register to continue|members only|premium content|create a free account"
BLOCKED_PHRASES = r"(?i)access denied|403 forbidden|cloudflare|unusual traffic"
APOLOGY = (
    r"(?i)i['’]m sorry|\bunable to (?:locate|find|retrieve)|\bi (?:cannot|can't|couldn't|wasn't able to) (?:find|locate)|\bas an ai\b|\bno relevant results\b|"
    r"wasn't able to find|couldn't find any|no articles.*published|i apologize"
)
ARTEFACT = (
    r"(?i)\*\*.*\*\*|\*[^*]+\*|\(domain:\s*[a-z.]+\)|within the (?:past|last) \d+ hours|here are (?:the|some).*(?:stories|articles)|"
    r"most recent.*climate.*stories|i\.e\.\s*since"
)
MODEL_PRICES = (("gpt-4.1-mini", 0.4, 1.6), ("gpt-4o-mini", 0.15, 0.6), ("gpt-4o", 2.5, 10.0))
DEFAULT_MODEL, CALL_PRICE = "gpt-4o", 0.01
NUMBER_WORDS = dict(
    zip(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(),
        range(21),
        strict=True,
    )
) | dict(zip("thirty forty fifty sixty seventy eighty ninety".split(), range(30, 100, 10), strict=True))
MAGNITUDES = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MONEY_MAGNITUDES = {"k": 1e3, "m": 1e6, "bn": 1e9, "b": 1e9, "tn": 1e12}
UNITS = {"%": "%", "percent": "%", "ton": "ton", "tons": "ton", "tonne": "ton", "tonnes": "ton"}
for _short, _long in (("gw", "gigawatt"), ("mw", "megawatt"), ("kw", "kilowatt"), ("tw", "terawatt"), ("kt", "kilotonne"), ("mt", "megatonne"), ("gt", "gigatonne")):
    UNITS |= {_short: _short, _long: _short, _long + "s": _short}
UNITS |= {u: u for u in ("gwh", "mwh", "kwh", "twh")}
RESERVED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
# End of fixed values.


def host_pattern(hosts) -> str:
    """A pattern of URLs whose host is one of ``hosts`` or below it."""
    return r"(?i)^https?://([a-z0-9-]+\.)*(" + "|".join(h.replace(".", r"\.") for h in hosts) + r")(/|$)"
