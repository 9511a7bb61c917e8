"""English stems by Porter's published algorithm (1980), as SQL over a word column.

Each stage is one expression over the stage before, in words that Spark and
ANSI engines share, so that a query and its oracle can be built from the same
text. Words are lower case; others than of three letters or more stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed values of the published algorithm: suffixes and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# End of fixed values.

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Stems of one vowel-consonant pair at least, exactly one, two at least; with a vowel; ending short.
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _matches(text: str, pattern: str) -> str:
    return f"{{matches}}({text}, '{pattern}')"


def _without(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _ends(word: str, suffix: str) -> str:
    return f"right({word}, {len(suffix)}) = '{suffix}'"


def _longest(word: str, rules: dict[str, str], condition) -> str:
    """The rule of the longest suffix that fits; its condition decides whether it applies."""
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        stem = _without(word, len(suffix))
        cases.append(f"WHEN {_ends(word, suffix)} THEN CASE WHEN {condition(stem, suffix)} THEN concat({stem}, '{rules[suffix]}') ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def stages() -> list[str]:
    """Expressions in ``{w}``, the word of the stage before, and ``{matches}``, the engine's function of text and pattern."""
    w = "{w}"
    plural = f"CASE WHEN {_ends(w, 'sses')} OR {_ends(w, 'ies')} THEN {_without(w, 2)} WHEN {_ends(w, 'ss')} THEN {w} WHEN {_ends(w, 's')} THEN {_without(w, 1)} ELSE {w} END"
    # a stem that lost ed or ing is marked, as the next stage mends it
    past = (
        f"CASE WHEN {_ends(w, 'eed')} THEN CASE WHEN {_matches(_without(w, 3), SOME)} THEN {_without(w, 1)} ELSE {w} END "
        f"WHEN {_ends(w, 'ed')} THEN CASE WHEN {_matches(_without(w, 2), VOWEL)} THEN concat({_without(w, 2)}, '+') ELSE {w} END "
        f"WHEN {_ends(w, 'ing')} THEN CASE WHEN {_matches(_without(w, 3), VOWEL)} THEN concat({_without(w, 3)}, '+') ELSE {w} END ELSE {w} END"
    )
    bare = _without(w, 1)
    mended = (
        f"CASE WHEN {_ends(w, '+')} THEN CASE WHEN {_matches(bare, '(at|bl|iz)$')} THEN concat({bare}, 'e') WHEN {_matches(bare, DOUBLE)} THEN {_without(w, 2)} "
        f"WHEN {_matches(bare, SHORT)} THEN concat({bare}, 'e') ELSE {bare} END ELSE {w} END"
    )
    ypsilon = f"CASE WHEN {_ends(w, 'y')} AND {_matches(_without(w, 1), VOWEL)} THEN concat({_without(w, 1)}, 'i') ELSE {w} END"
    some = lambda stem, suffix: _matches(stem, SOME)
    more = lambda stem, suffix: _matches(stem, MORE) + (f" AND {_matches(stem, '[st]$')}" if suffix == "ion" else "")
    last = f"CASE WHEN {_ends(w, 'e')} AND ({_matches(bare, MORE)} OR ({_matches(bare, ONE)} AND NOT {_matches(bare, SHORT)})) THEN {bare} ELSE {w} END"
    doubled = f"CASE WHEN {_ends(w, 'll')} AND {_matches(bare, MORE)} THEN {bare} ELSE {w} END"
    return [plural, past, mended, ypsilon, _longest(w, STEP_2, some), _longest(w, STEP_3, some), _longest(w, dict.fromkeys(STEP_4, ""), more), last, doubled]


def stemmed(words: DataFrame, column: str, name: str = "stem") -> DataFrame:
    """``words`` with the stem of ``column``; meant for distinct words. Null has none, and words of other letters than a to z stay."""
    kept = f"`{column}` IS NULL OR length(`{column}`) < 3 OR NOT rlike(`{column}`, '^[a-z]+$')"
    out = words.selectExpr("*", f"CASE WHEN {kept} THEN NULL ELSE `{column}` END AS `{name}_0`")
    every = stages()
    for k, stage in enumerate(every):
        expression = stage.replace("{w}", f"`{name}_{k}`").replace("{matches}", "rlike")
        out = out.selectExpr("*", f"{expression} AS `{name}_{k + 1}`").drop(f"{name}_{k}")
    return out.selectExpr("*", f"coalesce(`{name}_{len(every)}`, `{column}`) AS `{name}`").drop(f"{name}_{len(every)}")


def stem_oracle(table: str, column: str) -> str:
    """The same in ANSI SQL: a query of ``table`` with a column ``stem``."""
    out = f"SELECT *, CASE WHEN length({column}) < 3 OR NOT regexp_matches({column}, '^[a-z]+$') THEN NULL ELSE {column} END AS w FROM {table}"
    for stage in stages():
        out = f"SELECT * REPLACE ({stage.replace('{w}', 'w').replace('{matches}', 'regexp_matches')} AS w) FROM ({out})"
    return f"SELECT * EXCLUDE (w), coalesce(w, {column}) AS stem FROM ({out})"
