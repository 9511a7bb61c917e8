"""Language detection against brute force."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressloom.operators import curation
from pressloom.plans import catalogue

ENGLISH = "The council of the town said that it would not build another road through the wood this year".split()
GERMAN = "Der Rat der Stadt sagte gestern dass er in diesem Jahr keine weitere Straße durch den schönen Wald bauen würde".split()
GREEK = "Ο δήμος της πόλης είπε ότι δεν θα φτιάξει άλλον δρόμο μέσα από το δάσος ΦΕΤΟΣ".split()


def text(words, seed, n=40):
    pick = random.Random(seed)
    return "".join(pick.choice(words) + pick.choice([" ", "  ", ", ", "-", "7", ".\n"]) for _ in range(n))


def grams(value):
    words = re.findall(r"[^\W\d_]+", (value or "").lower())
    return Counter(f" {w} "[i : i + 3] for w in words for i in range(len(w)))


def taught(rows, most):
    found = {}
    for lang in {x for x, _ in rows if x is not None}:
        n = sum((grams(t) for x, t in rows if x == lang), Counter())
        top = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]
        found[lang] = {g: k / sum(k for _, k in top) for g, k in top}
    return found


def judged(value, profiles):
    own = grams(value)
    size = lambda x: math.sqrt(sum(v * v for v in x.values()))
    dots = {lang: sum(own[g] * share for g, share in p.items()) for lang, p in profiles.items()}
    ranked = sorted((-dot / size(own) / size(profiles[lang]), lang) for lang, dot in dots.items() if dot)
    if not ranked:
        return None, None, None
    return ranked[0][1], -ranked[0][0], -ranked[0][0] + (ranked[1][0] if len(ranked) > 1 else 0)


def code(gram):
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


@pytest.fixture(scope="module")
def labelled():
    return [(lang, text(words, i)) for lang, words in (("en", ENGLISH), ("de", GERMAN), ("el", GREEK)) for i in range(6)] + [(None, "Not of any language"), ("en", None), ("en", "")]


ODD = [None, "", " ", "12 34 %", "a", "A b", "zzz qqq", "İstanbul", "ΟΔΟΣ", "don't", "the town", "x" * 300, "𝐭𝐡𝐞 𐐀𐐁 the", "the THE The"]


def test_trigrams_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in curation.trigrams(rows).collect():
        expected = {code(g): n for g, n in grams(ODD[r.doc_id]).items()}
        assert {g.gram: g.n for g in r.grams} == expected
        assert r.norm == pytest.approx(math.sqrt(sum(n * n for n in expected.values())))


def test_trigrams_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "the town")], "doc_id long, text string")
    assert "Exchange" not in curation.trigrams(rows)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_languages_by_profiles(spark, labelled, threshold):
    """Broadcast profiles, and those that are too large for it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        profiles = curation.trigram_profiles(spark.createDataFrame(labelled, "lang string, text string"), 30)
        expected = taught(labelled, 30)
        got = {(r.lang, r.gram): r.share for r in profiles.collect()}
        assert got == pytest.approx({(lang, code(g)): share for lang, p in expected.items() for g, share in p.items()})
        texts = [*ODD, *(text(words, seed, 8) for words in (ENGLISH, GERMAN, GREEK) for seed in range(90, 95))]
        rows = curation.detect_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        for r in rows:
            language, score, margin = judged(texts[r.doc_id], expected)
            assert r.language == language
            assert (r.score, r.margin) == ((None, None) if language is None else (pytest.approx(score), pytest.approx(margin)))
            assert r.confident == (language is not None and score >= 0.1 and margin >= 0.02)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_backfill_judges_every_row_by_the_other_half(spark, tmp_path, labelled):
    docs = [(i, t, lang) for i, (lang, t) in enumerate(labelled)]
    docs += [(50, text(GERMAN, 70), "en"), (50, text(ENGLISH, 71), "en"), (51, text(GREEK, 72), None), (52, "12 34 %", "de"), (None, text(ENGLISH, 73), "en")]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(str(path))
    half = {i: None if i is None else crc32(str(i).encode()) % 2 for i, _, _ in docs}
    profiles = {h: taught([(lang, t) for i, t, lang in docs if half[i] == 1 - h], 400) for h in (0, 1)}
    expected = []
    for i, t, lang in docs:
        language, score, margin = judged(t, profiles[half[i]]) if i is not None else (None, None, None)
        language = language if language and score >= 0.1 and margin >= 0.02 else None
        expected += [(i, lang, language)] * (language != lang)
    assert (50, "en", "de") in expected and (51, None, "el") in expected and (52, "de", None) in expected
    got = [tuple(r) for r in catalogue.QUERIES["language_backfill"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_letters_are_those_of_spark(spark):
    """But for code points that the JVM's tables do not have yet."""
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    rows = spark.createDataFrame(pa.table({"c": [chr(x) for x in points], "letter": [chr(x).isalpha() for x in points]}))
    assert rows.where(F.col("letter") != F.col("c").rlike(r"^\p{L}$")).where(~F.col("letter") | ~F.col("c").rlike(r"^\p{Cn}$")).count() == 0
