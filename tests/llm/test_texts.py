import datetime
import hashlib
import hmac
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressloom.llm.permutation import hmac_pads, with_secret
from pressloom.llm import decontamination, fingerprints, pii, token_counts, toxicity, url_filters, warc
from pressloom.llm.storage import new_folder
from pressloom.llm.words import hash_words, text_buffers


KEY = b"a key of the tests"


def words(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def contamination(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        n = min(13, len(v))
        for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    found.discard("None")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(11)
    vocabulary = ["The", "of", "Étude", "été", "x1", "and"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 13, 20]))) for i in range(8)] + [(90, ""), (91, None), (92, "the of"), (93, "The, OF!"), (94, "x1"), (None, text(15))]
    docs = [(i, text(rng.choice([0, 5, 30])) + " " + (rng.choice(items)[1] or "") + "; " + text(9)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1]), (103, text(20_000)), (None, "the of")]
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, n string, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontamination.decontaminate(frame, bench, broadcast_bytes=limit).collect()), key=str)
    assert got == sorted(((i, *contamination(t, items)) for i, t in docs), key=str)
    clean = decontamination.decontaminate(frame, bench.limit(0), broadcast_bytes=limit)
    assert clean.count() == len(docs) and clean.where("contaminated or n_hit > 0").count() == 0
    assert decontamination.decontaminate(frame.limit(0), bench, broadcast_bytes=limit).count() == 0


def test_toxicity_learns_words_and_keeps_held_out_labels(spark):
    rng = random.Random(2)
    neutral = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        text, toxic = [rng.choice(neutral) for _ in range(rng.choice([5, 60, 400]))], i % 8 == 0
        if toxic:
            for bad in rng.sample(["vile", "nasty", "awful", "gross"], 3):
                text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text), "q"))
        labels.append((i, int(toxic if rng.random() > 0.02 else not toxic)))
    truth = {i: int(i % 8 == 0) for i in range(1500)}
    rows += [(9000, None, "q"), (9001, "", "q"), (None, "vile nasty awful", "q")]
    labels += [(None, 1), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.97
    flipped = spark.createDataFrame([(i, (1 - y if y is not None and i is not None and __import__("zlib").crc32(str(i).encode()) % 5 == 0 else y)) for i, y in labels], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.toxicity(docs, flipped).collect()), key=str) == sorted(map(tuple, got), key=str)
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def brute_force_ftrl(texts, labels, epochs, alpha, beta, l1, l2, positive_weight):
    """FTRL-proximal over the named features themselves, number by number."""

    def features(text):
        w = [x.decode() for x in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())]
        return {("1", x) for x in w} | {("2", *p) for p in zip(w, w[1:])} | {("s", *p) for p in zip(w, w[2:])}

    z, n = Counter(), Counter()

    def weight(f):
        if f != "bias" and abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1 if f != "bias" else 0.0, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    rows = [(features(t) | {"bias"}, y) for t, y in zip(texts, labels)]
    for _ in range(epochs):
        for own, y in rows:
            w = {f: weight(f) for f in own}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (positive_weight if y else 1)
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return lambda text: 1 / (1 + math.exp(-sum(weight(f) for f in features(text) | {"bias"})))


def test_learning_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    labels = [int("ax" in t) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, texts[4])]  # repeated rows are learnt once
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    settings = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": 0.4, "l2": 0.1, "positive_weight": 2.0}
    model = toxicity.fit_toxicity(docs, known, bits=24, **settings)
    place = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))).collect()}
    order = sorted(range(60), key=lambda i: (place[i], i))
    expected = brute_force_ftrl([texts[i] for i in order], [labels[i] for i in order], **settings)
    unseen = spark.createDataFrame([(i, t) for i, t in rows] + [(99, "ax by new"), (98, ""), (97, "ax " * 20_000)], "doc_id long, text string")
    for r in toxicity.score_toxicity(unseen, model, 24).join(unseen.dropDuplicates(["doc_id"]), "doc_id").collect():
        assert abs(r.score - expected(r.text)) < 1e-5


def test_beginnings_of_words_join_inflected_forms():
    whole, counts = hash_words(*text_buffers(pa.array(["Nastily nasty nastier", "no", None, "nast"])))
    begun, same = hash_words(*text_buffers(pa.array(["Nastily nasty nastier", "no", None, "nast"])), 5)
    assert counts.tolist() == same.tolist() == [3, 1, 0, 1]
    assert len(set(whole.tolist())) == 5 and begun[0] == begun[2] != begun[1] == whole[1]
    assert begun[3:].tolist() == whole[3:].tolist()


def test_token_cache_is_filled_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, "Hello world"), (2, "Hello world"), (3, None), (4, ""), (5, "<|endoftext|> x"), (6, "né " * 3000), (None, "a")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_tokens string")
    cache = new_folder(spark, "cache")
    expected = sorted(((i, len((t or "").encode()), n, n > 1024) for i, t in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=str)
    for _ in range(2):
        assert sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()), key=str) == expected
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
    assert stored.count() == 5
    planted = stored.withColumn("n_tokens", F.lit(77).cast("long")).select("content_digest", "n_tokens", "tokenizer")
    other = new_folder(spark, "cache")
    planted.write.partitionBy("tokenizer").parquet(other)
    assert {r.n_tokens for r in token_counts.count_tokens(docs, path, other).collect()} == {77}
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def test_archive_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/x", big), (2, "http://a/y\r\nX: 1", big), (9, None, big), (1, "u", "small"), (3, "u", "small"), (4, "u", None), (2, "http://a/y\r\nX: 1", big), (None, "n", big)]
    # line ends of all kinds and look-alike fields within addresses
    rows += [(20 + k, f"http://a/{end}WARC-Refers-To: <urn:page:77>{end}WARC-Payload-Digest: sha256:abc{end}{end}WARC-Type: revisit", f"long payload {k} " * 20) for k, end in enumerate(["\r\n", "\r", "\n", "\u2028", "\u2029", "\x85", "\x0b", "\x0c", ""])]
    pages = spark.createDataFrame([(i, u, h, "e") for i, u, h in rows], "page_id long, url string, html string, digest string")
    path = new_folder(spark, "archive")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages, path).collect()}
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    size = len(big.encode())
    assert got == {(2, size, digest(big), "response", None), (1, 5, digest("small"), "response", None), (3, 5, digest("small"), "response", None), (4, 0, digest(""), "response", None)} | {
        (i, size, digest(big), "revisit", 2) for i in (5, 9, None)
    } | {(i, len(h), digest(h), "response", None) for i, _, h in rows[8:]}
    assert spark.read.parquet(f"{path}/payloads").count() == 12
    read = warc.read_archive(spark, path).collect()
    assert len(read) == len(rows) and [r.page_id for r in read].count(2) == 2
    records = {r.page_id: bytes(r.record) for r in read}
    for page, record in records.items():
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4
        payload = block[:-4].partition(b"\r\n\r\n")[2]
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else dict((i, h or "") for i, _, h in rows)[page].encode())
    empty = new_folder(spark, "archive")
    assert warc.archive_round_trip(pages.limit(0), empty).count() == 0
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"changed")).write.parquet(f"{empty}x/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{empty}x/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{empty}x").select("payload_digest").collect()


def weighted(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    pairs = list(zip(w, w[1:])) if len(w) > 1 else [(x,) for x in w]
    return {p: pairs.count(p) for p in set(pairs)}


def test_fingerprints_estimate_generalised_jaccard():
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        a = [rng.choice("abcd") for _ in range(60)]
        texts.append(" ".join(a))
        texts.append(" ".join(a[: rng.randrange(10, 60)] + [rng.choice("abcdefgh") for _ in range(20)]))
    drawn, has = fingerprints.signatures(pa.array(texts), 512)
    for i in range(0, 80, 2):
        a, b = weighted(texts[i]), weighted(texts[i + 1])
        keys = a.keys() | b.keys()
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        got = fingerprints.likeness(drawn[i : i + 1], has[i : i + 1], drawn[i + 1 : i + 2], has[i + 1 : i + 2])[0]
        assert abs(got - true) < 0.12


def test_fingerprints_of_long_texts_do_not_favour_repeated_pairs():
    """Hundreds of thousands of distinct pairs, of which the repeated ones alone are shared, or half of the others alone."""
    common = " ".join(f"p{i} q{i} " * 10 for i in range(2500))
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    pairs = [(common + own("a", 250_000), common + own("b", 250_000)), (own("s", 150_000) + common, own("s", 150_000) + own("t", 150_000))]
    for texts in pairs:
        a, b = (Counter(zip(w, w[1:])) for w in map(str.split, texts))
        true = (a & b).total() / (a | b).total()
        drawn, has = fingerprints.signatures(pa.array(texts), 512)
        got = fingerprints.likeness(drawn[:1], has[:1], drawn[1:], has[1:])[0]
        assert abs(got - true) < 0.08, (got, true)


@pytest.mark.parametrize("block", [2, 500])
def test_edits_follow_the_next_document(spark, block):
    rows = [(10, "abcdefghi"), (7, "x y z x y z"), (3, None), (2, "héé wörld and so on"), (40, "x y z x y z"), (-5, "q" * 5000), (None, "no id"), (8, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs, block_rows=block).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[40].fingerprint == got[7].fingerprint and got[3].near_edited == 1.0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert all(plain[i] == r.fingerprint for i, r in got.items())
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprint_edits(docs.where("doc_id is null")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_pseudonyms_keep_formats_and_links(spark):
    card = "4111 1111 1111 1111"
    rows = [
        (1, f"card {card} on 2024-02-29, call +1 (988) 555-2485."),
        (2, f"again {card}! and 4111111111111111 at 10.0.0.255; 078-05-1120"),
        (3, "not 4111111111111112, not 2023-02-29, not 256.1.1.1, not 000-12-3456, v1.2.3.4.5"),
        (4, None),
        (5, ""),
        (6, "no digits"),
        (7, ("é " * 50_000) + "2000-01-01"),
    ]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_dates string")
    got = {r.doc_id: r for r in pii.pseudonymise(frame, KEY).collect()}
    old = dict(rows)

    def valid(number):
        d = [int(c) for c in number if c.isdigit()][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    spaced = re.search(r"\d{4}( \d{4}){3}", got[1].text)[0]
    assert spaced != card and valid(spaced) and spaced in got[2].text and spaced.replace(" ", "") in got[2].text
    assert re.fullmatch(r"card .{19} on (19|20)\d\d-\d\d-\d\d, call \+1 \(\d{3}\) \d{3}-\d{4}\.", got[1].text)
    assert "2024-02-29" not in got[1].text and "988) 555-2485" not in got[1].text and "10.0.0.255" not in got[2].text and "078-05-1120" not in got[2].text
    assert (got[1].n_numbers, got[1].n_dates, got[2].n_numbers) == (2, 1, 4)
    for i in (3, 4, 5, 6):
        assert got[i].text == old[i] and got[i].n_numbers == 0
    assert got[7].n_dates == 1 and len(got[7].text) == len(old[7])
    assert pii.pseudonymise(frame.limit(0), KEY).count() == 0


def test_numbers_beside_a_card_do_not_hide_it(spark):
    card, other = "4111 1111 1111 1111", "4012 8888 8888 1881"
    texts = [
        f"{card} 12/27",
        f"{card} 123",
        f"{card.replace(' ', '')} 12 apples",
        f"7 {card.replace(' ', '')}",
        f"no.{card}",
        f"{card.replace(' ', '-')}-123 12-{card}",
        f"{card} {other} 2024-02-29 {card}",
        f"1234 2024-02-29 {card}",
        f"212-555-0123 {card}",
        "call.212-555-0123, 212.555.0124 or 212 555 0125",
        "2024/02/29 29.02.2024 02/29/2024 29/02/2024",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.text, r.n_numbers, r.n_dates) for r in pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()]
    assert [g[1:] for g in got] == [(1, 0)] * 5 + [(2, 0), (3, 1), (1, 1), (2, 0), (3, 0), (0, 4)]
    new = got[0][0].removesuffix(" 12/27")
    plain = new.replace(" ", "")
    assert re.fullmatch(r"\d{4}( \d{4}){3}", new) and new != card
    assert [g[0] for g in got[1:6]] == [f"{new} 123", f"{plain} 12 apples", f"7 {plain}", f"no.{new}", f"{new.replace(' ', '-')}-123 12-{new}"]
    assert got[6][0].startswith(new) and got[6][0].endswith(new) and other not in got[6][0] and got[8][0].endswith(new)
    for (text, _, _), old in zip(got, texts, strict=True):
        assert re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", old)
    for n in ("212-555-0123", "212.555.0124", "212 555 0125"):
        assert n not in got[9][0] and n not in got[8][0]
    iso, dotted, american, late = re.split(" ", got[10][0])
    assert iso.split("/") == dotted.split(".")[::-1] and american.split("/") == [iso.split("/")[i] for i in (1, 2, 0)]
    assert 13 <= int(late[:2]) <= 31 and late != "29/02/2024"


@pytest.mark.parametrize("block", [4, 500])
def test_edits_of_ids_with_very_many_rows(spark, block):
    """Null and repeated ids and equal rows, cut into blocks or not: each row is followed as a chain over all of them tells."""
    rng = random.Random(7)
    rows = [(i, f"text of {i} " * (i % 4 + 1)) for i in range(0, 60, 3)]
    rows += [(None, f"no id {rng.random()}") for _ in range(40)] + [(30, f"same id {rng.random()}") for _ in range(30)] + [(None, "equal rows")] * 25 + [(33, "also equal")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprint_edits(docs, block_rows=block).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in rows)
    beginnings = {}
    for i, t in rows:
        beginnings.setdefault(t[: len(t) // 3], []).append(t)
    # an edited text tells which beginning it took; every row but repeated ones must be followed once by another
    texts = [t for _, t in rows]
    edits = {hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for a in set(texts) for b in set(texts)}
    assert all(r.edited_sha256 in edits for r in got)
    ordered = sorted((r for r in rows if r[0] is not None and r[0] not in (30, 33)), key=lambda r: -r[0])
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id not in (30, 33)}
    for (i, t), (j, following) in zip(ordered, ordered[1:]):
        if i - j == 3:
            k = len(t) // 3
            assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()
    itself = [r for r in got if r.doc_id is None and r.n_chars == 10 and r.near_next == 1.0]
    assert len(itself) >= 24 and len({r.fingerprint for r in itself}) == 1


def drawn(purpose, step, value, digits=8):
    return int(hmac.new(KEY, f"{purpose}:{step}:{value}".encode(), "sha256").hexdigest()[:digits], 16)


def walked(x, square, purpose, accept):
    """The permutation by numbers alone."""
    half = math.isqrt(square - 1) + 1
    while True:
        left, right = divmod(x, half)
        for i in range(1, 5):
            left, right = right, (left + drawn(purpose, i, right)) % half
        x = left * half + right
        if accept(x):
            return x


def below(x, n, purpose):
    return walked(x, (math.isqrt(n - 1) + 1) ** 2, purpose, lambda y: y < n)


def rewritten(text):
    """Brute-force rewriting of texts that hold well-formed values between spaces."""
    first, out = datetime.date(1900, 1, 1), []
    for token in text.split(" "):
        digits = re.sub("[^0-9]", "", token)
        if re.fullmatch(r"\d{4}-\d\d-\d\d", token):
            day = (datetime.date.fromisoformat(token) - first).days
            token = str(first + datetime.timedelta(below(day, 73049, "date")))
        elif re.fullmatch(r"\d+\.\d+\.\d+\.\d+", token):
            old = token.split(".")
            new = below(int.from_bytes(bytes(map(int, old))), 1 << 32, "address").to_bytes(4)
            token = ".".join(str(b).zfill(len(o)) if re.match("0.", o) else str(b) for b, o in zip(new, old))
        elif re.fullmatch(r"\d{3}-\d\d-\d{4}", token):
            area, group, serial = map(int, token.split("-"))
            n = below(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "social")
            area = n // 9999 // 99
            token = f"{area + (2 if area >= 665 else 1):03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
        elif re.fullmatch(r"\d{3}-\d{3}-\d{4}", token):
            valid = lambda x: x >= 2_000_000_000 and x % 10_000_000 >= 2_000_000
            n = str(walked(int(digits), 10**10, "phone", lambda y: y < 10**10 and valid(y) == valid(int(digits)))).zfill(10)
            token = f"{n[:3]}-{n[3:6]}-{n[6:]}"
        elif re.fullmatch(r"\d{16}", token):
            n, a, b = 15, int(digits[:7]), int(digits[7:15])
            for i in range(1, 9):
                if i % 2 == 0:
                    a = (a + drawn("card", 0, f"{n}:{i}:{b}", 14)) % 10**7
                else:
                    b = (b + drawn("card", 1, f"{n}:{i}:{a}", 14)) % 10**8
            body = f"{a:07}{b:08}"
            total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(body)))
            token = body + str(-total % 10)
        out.append(token)
    return " ".join(out)


def test_rewriting_against_brute_force(spark):
    texts = [
        "on 2024-02-29 from 10.0.0.255 and 010.000.000.255 by 4111111111111111",
        "078-05-1120 called 212-555-0123 or 988-555-2485 on 1999-12-31",
        "5500005555555559 4012888888881881 8.8.8.8 899-99-9999 001-01-0001 2099-12-31 1900-01-01",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, rewritten(t)) for i, t in rows), key=str)
    other = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), b"another").collect()
    assert not {r.text for r in other} & {r.text for r in got}


def test_timestamps_hold_dates(spark):
    """The date of a timestamp becomes what the date alone becomes; the time and other letters behind a date change nothing."""
    texts = ["2024-02-29T10:00:00Z", "at 2024-02-29T10, 2024/02/29T23:59", "29.02.2024Z", "2024-02-29Tuesday 2024-02-29T1 2024-02-29Zulu x2024-02-29T10:00 2024-02-30T10:00", "1999-12-31T10:00 +2024-02-29T10:00"]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, _done string")
    got = [r.text for r in pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()]
    new, old = rewritten("2024-02-29"), rewritten("1999-12-31")
    year, month, day = new.split("-")
    assert got == [f"{new}T10:00:00Z", f"at {new}T10, {year}/{month}/{day}T23:59", f"{day}.{month}.{year}Z", texts[3], f"{old}T10:00 +2024-02-29T10:00"]


def test_no_plan_holds_the_key(spark):
    key = b"0123456789 a key of printable characters"
    frame = spark.createDataFrame([(1, "on 2024-02-29 by 4111111111111111")], "doc_id long, text string")
    done = pii.pseudonymise(frame, key)
    done.collect()
    plans = done._jdf.queryExecution().toString() + done._jdf.queryExecution().optimizedPlan().toJSON()
    held = plans.lower().encode()
    assert b"_pads_" in held
    for secret in (key, *hmac_pads(key)):
        assert secret.lower() not in held and secret.hex().encode() not in held and secret[:16].hex().encode() not in held
        assert b", ".join(str(b if b < 128 else b - 256).encode() for b in secret[:8]) not in held


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_digit_permutations_are_one_to_one(spark, digits):
    frame = spark.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("d"))
    got = [r[0] for r in with_secret(frame, KEY, "key").select(pii.permuted_digits(F.col("d"), F.col("key"), "d")).collect()]
    assert sorted(got) == [str(i).zfill(digits) for i in range(10**digits)]


def test_list_ties_addresses_and_clashing_columns(spark):
    entries = [("10.0.0.1", "allow", 5), ("10.0.0.1", "block", 5), (".0.1", "allow", 0), ("[::1]", "block", 0), (".b.com", "allow", 0), (".a.b.com", "block", 9)]
    listed = spark.createDataFrame([(*e, "v") for e in entries], "key string, action string, listed_at long, rank string")
    captures = [("http://10.0.0.1/x", 5, "block"), ("http://10.0.0.1/x", 4, "none"), ("http://[::1]:80/y", 1, "block"), ("http://x.a.b.com", 9, "block"), ("http://x.a.b.com", 8, "allow")]
    pages = spark.createDataFrame([(1, u, t, 7, "w") for u, t, _ in captures], "page_id long, url string, fetched_at long, row int, verdict string")
    got = url_filters.filter_urls(pages.repartition(3, "url"), listed).collect()
    assert sorted((r.url, r.fetched_at, r.verdict) for r in got) == sorted(captures)


def test_list_entries_hold_between_their_dates(spark):
    day = 86400
    entries = [("bad.com", "block", 10 * day), ("bad.com", "remove", 50 * day), ("bad.com", "allow", 400 * day), (".example.org", "block", 0), ("a.example.org/ok", "allow", 5 * day), ("x", None, 1)]
    captures = [
        (1, "http://bad.com/p", 10 * day - 1, "none"),
        (1, "http://bad.com/p", 10 * day, "block"),
        (2, "https://user@BAD.com:8080/p?q", 50 * day - 1, "block"),
        (3, "http://bad.com/", 50 * day, "none"),
        (4, "http://bad.com", 500 * day, "allow"),
        (5, "http://a.example.org/ok/1", 4 * day, "block"),
        (6, "http://a.example.org/ok/1", 6 * day, "allow"),
        (7, "http://a.example.org/no", 6 * day, "block"),
        (8, "nonsense", 6 * day, "none"),
        (9, None, 6 * day, "none"),
        (10, "http://bad.com/p", None, "none"),
    ]
    pages = spark.createDataFrame([(i, u, t) for i, u, t, _ in captures], "page_id long, url string, fetched_at long")
    listed = spark.createDataFrame(entries, "key string, action string, listed_at long")
    got = sorted((tuple(r)[:4] for r in url_filters.filter_urls(pages, listed).collect()), key=str)
    assert got == sorted(captures, key=str)
    assert url_filters.filter_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, listed.limit(0)).collect()} == {"none"}
