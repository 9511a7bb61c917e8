import random
from collections import Counter, defaultdict

import pytest
from test_ngram_join import brute_force
from test_texts import contamination

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, benchmark passages, empty and null ones."""
    rng = random.Random(8)
    neutral = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    items = [(i, " ".join(rng.choice(neutral) for _ in range(20))) for i in range(5)]

    def add(text):
        k = len(rows)
        rows.append((k, text, "en", ["a", "b", None, "c"][min(3, k % 6)], len(text or "")))
        return k

    for i in range(500):
        words = [rng.choice(neutral) for _ in range(rng.choice([20, 60, 150]))]
        if i % 7 == 0:
            for bad in ("vile", "nasty", "awful"):
                words.insert(rng.randrange(len(words)), bad)
        k = add(" ".join(words))
        labels.append((k, int(i % 7 == 0)))
        if i % 10 == 1:
            labels.append((add(" ".join(words)), int(i % 7 == 0)))
        if i % 10 == 2 and len(words) > 50:
            words[rng.randrange(len(words))] = f"new{i}"
            labels.append((add(" ".join(words)), int(i % 7 == 0)))
        if i % 25 == 3:
            add(" ".join(words[:15]) + " " + rng.choice(items)[1])
    for text in (None, "", "!!!"):
        add(text)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_take_effect(spark, folder):
    path, rows, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")

    kept = stages["toxicity"](spark, docs, path).persist()
    assert kept.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    left = {r.doc_id for r in kept.collect()}
    bad = {k for k, t in text.items() if t and "vile" in t}
    assert not left & bad and len(set(text) - left - bad) <= 5

    groups = brute_force([(k, text[k]) for k in sorted(left)])
    single = stages["ngram_jaccard_join"](spark, kept, path).persist()
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {c for c, _ in groups.values()}

    clean = stages["benchmark_decontamination"](spark, single, path).persist()
    expected = {c for c, _ in groups.values() if not contamination(text[c], items)[-1]}
    assert {r.doc_id for r in clean.collect()} == expected and len(expected) < single.count()

    mixed = stages["source_mixing"](spark, clean, path).persist()
    assert mixed.columns == docs.columns
    source = {r[0]: r[3] for r in rows}
    size, taken = Counter(), Counter()
    for k in expected:
        size[source[k]] += len((text[k] or "").split())
    for k, n in Counter(r.doc_id for r in mixed.collect()).items():
        assert n <= 2
        taken[source[k]] += n * len((text[k] or "").split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 150 * len(size)

    final = stages["sharding"](spark, mixed, path).collect()
    slots = defaultdict(list)
    for r in final:
        slots[r.shard].append(r.slot)
    assert len(final) == mixed.count() and len(slots) == corpus_pipeline.SHARDS
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_is_the_stages_in_turn(spark, folder):
    path, rows, _ = folder
    first = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, path).collect())
    again = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, path).collect())
    assert first == again and first


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0] if isinstance(s, tuple) else str(s))
def test_empty_tables_pass(spark, folder, stage):
    path, _, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert stage[1](spark, none, path).count() == 0


CLASHING = DOCS + ", size int, target double, position string, row string, _h1 long, _key int, mark int, kept int, score double, slot string"


def test_null_and_repeated_ids_ties_and_clashing_columns(spark, folder):
    """Rows are told apart by what they hold, ids or not, and other columns pass unchanged."""
    path, rows, items = folder
    rng = random.Random(3)
    other = (5, 0.5, "p", "r", 9, 8, 7, 6, 0.25, "z")
    words = [f"n{i}" for i in range(300)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copy, second, third, long = plain(60), plain(60), plain(60), plain(30_000)
    dirty = items[0][1]
    bad = "vile nasty awful " + plain(10)
    texts = [(None, copy), (None, copy), (3, copy), (3, copy), (3, second), (None, second), (None, third), (None, third + "!"), (4, long), (5, long + " end")]
    texts += [(6, dirty), (6, plain(80)), (None, dirty), (7, bad), (7, plain(70)), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "xx", "a", 1, *other) for i, t in texts], CLASHING)
    stages = dict(corpus_pipeline.STAGES)
    pick = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    tail = lambda frame: {tuple(r)[5:] for r in frame.collect()}

    known = spark.createDataFrame([(*r, *other) for r in rows], CLASHING)  # rows to learn from
    kept = stages["toxicity"](spark, docs.unionByName(known), path).where("lang = 'xx'")
    assert pick(kept) == sorted([x for x in texts if x[1] != bad], key=str) and tail(kept) == {other}

    single = stages["ngram_jaccard_join"](spark, docs, path)
    expected = [(3, copy), (3, second), (4, long), (6, dirty), texts[11], (7, bad), texts[14], (None, None), (8, "")]
    got = pick(single)
    assert single.columns == docs.columns and tail(single) == {other}
    assert [x for x in got if x in expected] == sorted(expected, key=str)
    rest = [x for x in got if x not in expected]
    assert len(rest) == 1 and rest[0] in ((None, third), (None, third + "!"))

    clean = stages["benchmark_decontamination"](spark, docs, path)
    assert pick(clean) == sorted([x for x in texts if x[1] != dirty], key=str) and tail(clean) == {other}

    mixed = stages["source_mixing"](spark, docs, path)
    assert mixed.columns == docs.columns and tail(mixed) == {other} and not set(pick(mixed)) - set(texts)

    final = stages["sharding"](spark, docs, path).collect()
    assert len(final) == len(texts) and {(r.size, r.row, r._h1, r.score) for r in final} == {(5, "r", 9, 0.25)}
    assert len({(r.shard, r.slot) for r in final}) == len(texts)
