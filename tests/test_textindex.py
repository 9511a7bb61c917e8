"""The positional index against plain Python: stems, places, covers, updates and pruned partitions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressloom.functions import rules
from pressloom.functions.stems import stemmed
from pressloom.operators import textindex
from pressloom.operators.textindex import TextIndex, cover_density, postings, query_stems

COLUMNS = "article_id long, title string, rewritten_title string, dek string, publisher_name string, author string, content_text string"
#: Words with their stems, from the published examples of the algorithm.
EXAMPLES = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
    "tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform "
    "radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous "
    "formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow "
    "inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog "
    "communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil"
).split()


def test_stems_of_the_published_examples(spark):
    pairs = list(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    got = {r.w: r.stem for r in stemmed(spark.createDataFrame([(w,) for w, _ in pairs], "w string"), "w").collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    odd = stemmed(spark.createDataFrame([("is",), ("ünïts",), ("covid19s",), ("Cats",), (None,)], "w string"), "w").collect()
    assert [r.stem for r in odd] == ["is", "ünïts", "covid19s", "Cats", None]


def plain_words(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"[^a-z0-9]+", folded) if w]


def plain_rank(row, wanted, stem_of):
    """Every span of an article's hits is tried; shortest ones that hold all stems count."""
    hits, at = [], 0
    for text, weight in ((" ".join(x for x in row[1:3] if x), 1.0), (" ".join(x for x in row[3:6] if x), 0.4), (row[6], 0.1)):
        for w in plain_words(text):
            at += 1
            if stem_of.get(w) in wanted:
                hits.append((at, stem_of[w], weight))
    spans = []
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if {h[1] for h in hits[i : j + 1]} == set(wanted):
                spans.append((i, j))
                break
    spans = [(i, j) for i, j in spans if not any((k, m) != (i, j) and i <= k and m <= j for k, m in spans)]
    return sum((j - i + 1) / sum(1 / h[2] for h in hits[i : j + 1]) / (1 + hits[j][0] - hits[i][0] - (j - i)) for i, j in spans)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = ["storm", "storms", "stormy", "flood", "flooding", "the", "of", "warming", "warm", "éclair", "x", "2024", "rates"]
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    return [(i, text(6), text(6), text(8), rng.choice([None, "Storm Post", ""]), rng.choice([None, "A. Flood"]), text(40)) for i in range(150)]


@pytest.mark.parametrize("query", ["storms flooding", "warm", "The flood of storm rates", "eclair 2024 storm"])
def test_rank_against_brute_force(spark, corpus, tmp_path, query):
    index = TextIndex(spark, f"{tmp_path}/index")
    frame = spark.createDataFrame(corpus, COLUMNS)
    index.update(frame.where("article_id < 60"), 0)
    index.update(frame, 1)
    index.update(frame, 1)  # a repeated batch
    index.update(frame.where("article_id < 30"), 2)  # nothing new
    assert index.rows().select("batch").distinct().count() == 2 and index.indexed().count() == 150
    assert index.rows().where("batch = 1").agg(F.min("article_id")).first()[0] >= 60
    stem_of = {r.term: r.stem for r in index.rows().select("term", "stem").distinct().collect()}
    wanted = query_stems(spark, query)
    ranks = {r[0]: plain_rank(r, wanted, stem_of) for r in corpus}
    want = sorted(((-round(v, 9), i) for i, v in ranks.items() if v), key=lambda x: x)[:25]
    found = index.search(query, 25)
    assert [(r.article_id, pytest.approx(r.rank, abs=1e-8)) for r in found.collect()] == [(i, pytest.approx(-v, abs=1e-8)) for v, i in want] and want
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", found._jdf.queryExecution().executedPlan().toString())


def test_places_and_odd_articles(spark, tmp_path):
    rows = [(1, "The Storm, a storm", "Storms", None, "Post", None, "x of Storm"), (2, None, None, None, None, None, None), (3, "", "", "", "", "", "the of"), (4, "w " * 30_000 + "storm", None, None, None, None, None)]
    got = {(r.article_id, r.term, r.field): list(r.places) for r in postings(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(1, "storm", "A"): [2, 4], (1, "storms", "A"): [5], (1, "post", "B"): [6], (1, "storm", "C"): [9], (4, "storm", "A"): [30_001]}
    index = TextIndex(spark, f"{tmp_path}/index")
    assert index.search("storm").count() == 0
    index.update(spark.createDataFrame(rows, COLUMNS), 0)
    assert [r.article_id for r in index.search("STORM").collect()] == [1, 4]
    assert index.search("the of").count() == 0 and index.search("").count() == 0 and index.search("storm unknown").count() == 0
    assert cover_density(index.hits(["nothing"]), ["nothing"]).count() == 0
    assert textindex.BUCKETS == 64 and "the" in rules.STOP_WORDS


def test_terms_are_counted_without_a_shuffle(spark):
    from pressloom.operators.textindex import placed_terms

    rows = spark.createDataFrame([(1, "Sun sun of wind", None, None, None, None, "the sun a wind sun"), (2, None, None, "", None, None, None)], "article_id long, title string, rewritten_title string, dek string, publisher_name string, author string, content_text string")
    found = placed_terms(rows)
    assert sorted(map(tuple, found.select("article_id", "term", "field", "hits", "places").collect())) == [(1, "sun", "A", 2, [1, 2]), (1, "sun", "C", 2, [6, 9]), (1, "wind", "A", 1, [4]), (1, "wind", "C", 1, [8])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
