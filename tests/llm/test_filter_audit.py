import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pressloom.llm.filter_audit import failure_masks, filter_audit, text_mask
from pressloom.llm.radix_trie import RadixTrie, common_length, least_ids, prefix_ranges

DOCS = "doc_id long, text string, lang string, part string, mask int, n int, id string, step string"
LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def brute_mask(text):
    words = text.encode().split()
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + 8 * any(c in "#$%&*|" for c in text)


def brute_report(rows, labels):
    good, toxic, first = defaultdict(bool), defaultdict(bool), {}
    for doc_id, q, t in labels:
        good[doc_id] |= q == 1
        toxic[doc_id] |= t == 1
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    facts = []
    for doc_id, text, lang in rows:
        least = first.get(text or "")
        copy = least is not None and (doc_id is None or doc_id > least)
        facts.append((lang or "", brute_mask(text or "") + 16 * copy, doc_id is not None and good[doc_id], doc_id is not None and toxic[doc_id]))
    shapley, out = Counter(), {}
    for order in permutations("ABCDE"):
        gone = set()
        for step, letter in enumerate(order, 1):
            bit = 1 << "ABCDE".index(letter)
            rows_of = defaultdict(lambda: [0] * 6)
            for k, (part, mask, is_good, is_toxic) in enumerate(facts):
                own = rows_of[part]
                if mask & bit:
                    if k in gone:
                        own[2] += 1
                    else:
                        own[1] += 1
                        own[4] += is_good
                        own[5] += is_toxic
                        shapley[part, letter] += 1
                        gone.add(k)
                    own[3] += mask == bit
            for k, (part, *_) in enumerate(facts):
                rows_of[part][0] += k not in gone
            for part, own in rows_of.items():
                out[part, "".join(order), step] = own
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def corpus():
    rng = random.Random(7)
    words = ["a", "Bee", "SEE", "$5", "tea", "x|y", "é", "\x1cq", "\xa0"]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(99)) * rng.randrange(2) for _ in range(rng.randrange(230))) for _ in range(60)] + ["", None, " \n\t", "x" * 50_000, "same " * 120, "AB", "AbCdEfGhIj", "é" * 9 + "A"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(400)]
    rows += [(None, t, "en") for t in texts[:8]] + [(None, "only null ids", "de"), (None, "only null ids", "fr")] + [(3, "twice", "en")] * 2 + [(3, "twice with other text", "en"), (2, "twice with other text", "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, "p", 1, 2, "i", "s") for r in rows], DOCS).repartition(5), spark.createDataFrame([(*r, "p", 1) for r in labels], LABELS)


def test_report_equals_brute_force(spark):
    rows, labels = corpus()
    got = filter_audit(*frames(spark, rows, labels))
    assert sorted(map(tuple, got.collect())) == brute_report(rows, labels)
    documents, marks = frames(spark, rows, labels)
    assert filter_audit(documents.limit(0), marks).count() == 0
    assert sum(r.good_lost + r.toxic_lost for r in filter_audit(documents, marks.limit(0)).collect()) == 0


def test_small_ranges_and_tries_change_nothing(spark):
    rows, labels = corpus()
    documents, marks = frames(spark, rows, labels)
    plain = sorted(map(tuple, failure_masks(documents, marks).collect()))
    assert sorted(map(tuple, failure_masks(documents, marks, task_bytes=500, most_ranges=300, read_bytes=2000).collect())) == plain


def test_masks_read_whole_texts(spark):
    texts = ["w%d " % (i % 81) * 1 for i in range(1)] + [" ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "x " * 99, "A" * 10 + "b" * 90, "A" * 11 + "b" * 90, "ok " * 200_000 + "#", "é" * 90 + "A" * 10, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(text_mask(F.col("text"))).collect()]
    assert got == [brute_mask(t) for t in texts]


def test_trie_holds_the_least_ids():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(9))) for _ in range(3000)]
    trie, want = RadixTrie(), {}
    for i, t in enumerate(texts):
        value = None if i % 5 == 0 else rng.randrange(10_000)
        trie.insert(t, value)
        known = want.get(t)
        want[t] = value if known is None else known if value is None else min(known, value)
    assert dict(trie.terminals()) == want and len(list(trie.terminals())) == len(want)
    assert Counter(trie.values()) == Counter(want.values())
    assert common_length(b"xxabc", 2, b"abd") == 2 and common_length(b"", 0, b"a") == 0


@pytest.mark.parametrize("kind", ["boilerplate", "hot", "plain", "ends"])
def test_ranges_spread_what_can_be_told_apart(spark, kind):
    rng = random.Random(9)
    made = {
        "boilerplate": ["x" * 200 + str(rng.random()) for _ in range(3000)],
        "hot": ["hot" * 9] * 1500 + [str(rng.random()) for _ in range(1500)],
        "plain": [str(rng.random())[2:] for _ in range(3000)],
        "ends": ["ab" * rng.randrange(40) for _ in range(3000)],
    }[kind]
    frame = spark.createDataFrame(list(enumerate(made)), "id long, text string").select("id", F.col("text").cast("binary").alias("text")).repartition(4)
    ranges = prefix_ranges(frame, task_bytes=8000)
    assert [r[0] for r in ranges] == sorted({r[0] for r in ranges}) and ranges[0][0] == b""
    tasks = sum(n for _, n in ranges)
    assert 5 <= tasks <= 20 * (-(-sum(len(t) + 64 for t in made) // 8000) + 4)
    got = {r.first_id for r in least_ids(frame, task_bytes=8000, read_bytes=5000).collect()}
    first = {}
    for i, t in enumerate(made):
        first.setdefault(t, i)
    assert got == set(first.values())
