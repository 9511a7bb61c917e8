import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pressloom.llm.alignment import align_tokenizers
from pressloom.llm.huffman import BLOCK, Codebook, code_lengths
from pressloom.llm.perfect_hash import PerfectHash, bucket_hash, build
from pressloom.llm.pieces import BYTE_LEVEL_CUTS, WordEncoder, byte_level
from pressloom.llm.token_files import read_tokens, token_round_trip, write_token_files

DOCS = "doc_id long, text string, start string, ids string, row int, key string, n_tokens int, _1 long"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a ", "a  b", "a   b \n c", "\n", "x \n", "it's we'll 'S don't", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>x y", "<s> x</s> <unk> <0x41>",
    "▁a b", "é a é", "x\xa0 y", "a\x1c b \x1cc", "\x85 x \x85y", "ｆｕｌｌ　ｗｉｄｔｈ １２", "²3 x² 4.5", "snake_case a_b", "\U0001f600 \U0001f600x", "a​b ́x", "nul\x00 x", "tab\tx \ty", "end. Next,word;x", "日本語 の テキスト",
]


def corpus(texts):
    rows = [(i, t, "s", "i", 1, "k", 2, 3) for i, t in enumerate(texts)]
    return rows + [(None, "null id", "s", "i", 1, "k", 2, 3), (None, "null id", None, None, None, None, None, None), (5, "same id", "s", "i", 1, "k", 2, 3), (5, "same id", "s", "i", 1, "k", 2, 3)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = ["the", " ", "  ", "\n", "Word", ",", ".", "é", "日", "'s", "12", "_", "\t", "x" * 9, "\xa0", "<|endoftext|>", "-"]
    made = ["".join(rng.choice(alphabet) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    return ODD + made + ["long " * 30_000, "unbroken" * 5000, "the word. " * 700]


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("leading", [True, False])
def test_words_give_the_ids_of_whole_texts(texts, special, leading):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = not special
    encode = byte_level(open(BYTES).read(), special, leading, most=50)
    own = [t or "" for t in texts]
    for low in range(0, len(own), 20):
        ids, counts = encode(pa.array(own[low : low + 20]))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tokenizer.encode(" " * leading + t, add_special_tokens=False).ids for t in own[low : low + 20]]


def test_words_give_the_pieces_of_whole_texts(texts):
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encode = WordEncoder(lambda x: pieces.encode(x, num_threads=1), adds_space=True, leading=True, cuts=BYTE_LEVEL_CUTS[:1], most=50)
    own = [t for t in texts if t and "▁" not in t]
    ids, counts = encode(pa.array(own))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [pieces.encode(t) for t in own]


def test_huffman_codes_are_the_shortest_within_the_limit():
    rng = np.random.default_rng(3)
    for n in (2, 3, 17, 300):
        counts = rng.integers(1, 1000, n) ** 2
        free = code_lengths(counts, 60)
        import heapq

        heap, total = [int(c) for c in counts], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert (free * counts).sum() == total
        limited = code_lengths(counts, 9)
        assert limited.max() <= 9 and (2.0 ** -limited).sum() <= 1 and (limited * counts).sum() >= total
    # the best lengths for Fibonacci-like counts under a limit of 3
    assert sorted(code_lengths(np.array([1, 1, 2, 3, 5, 8]), 3).tolist()) == [2, 2, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, np.int64), 3)


def test_blocks_decode_by_themselves():
    rng = np.random.default_rng(4)
    for used, n in (([7], 1500), ([0, 60_000], 3 * BLOCK), (list(range(0, 3000, 3)), 40_001), ([5, 9], 0)):
        used = np.array(used)
        book = Codebook(used, code_lengths(rng.integers(1, 10_000, len(used)) ** 2))
        ids = rng.choice(used, n)
        coded = book.encode(ids)
        assert (book.decode(coded) == ids).all()
        for k in range(-(-n // BLOCK)):
            assert (book.decode(coded, k, k + 1) == ids[k * BLOCK : (k + 1) * BLOCK]).all()
    with pytest.raises(ValueError):
        book.encode(np.array([4]))
    with pytest.raises(ValueError):
        book.decode(b"other bytes that are no ids of this form")


@pytest.mark.parametrize("segment_ids", [50, 1 << 20])
def test_token_files_equal_the_library(spark, texts, tmp_path, segment_ids):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = corpus(texts)
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    write_token_files(frame, BYTES, f"{tmp_path}/{segment_ids}", segment_ids=segment_ids)
    got = sorted(((r.start, r.doc_id, r.ids) for r in read_tokens(spark, f"{tmp_path}/{segment_ids}").collect()))
    want = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert [d for _, d, _ in got] == [d for d, _ in want]
    assert Counter((d, tuple(i)) for _, d, i in got) == Counter((d, tuple(i)) for d, i in want)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)


def test_digests_of_token_files(spark, texts, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    frame = spark.createDataFrame(corpus(texts)[: len(texts)], DOCS)
    at, want = 0, set()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((i, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in token_round_trip(frame, BYTES, f"{tmp_path}/a").collect()} == want
    assert token_round_trip(frame.limit(0), BYTES, f"{tmp_path}/b").count() == 0


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        buckets = max(1, n // 9000)
        own = bucket_hash(keys) * buckets >> 16
        whole = PerfectHash(*zip(*[build(keys[own == k]) for k in range(buckets)], strict=True))
        assert sorted(whole.numbers(keys)) == list(range(len(keys)))
        assert (whole.keys[whole.numbers(keys)] == keys).all()
        with pytest.raises(ValueError):
            whole.numbers(np.array([1 << 40]))
    assert 64 * len(whole.words) < 4.5 * len(keys)
    with pytest.raises(ValueError):
        build(np.array([3, 3]))


def brute(texts):
    tokenizer, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokenizer.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    code = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out, documents = [], Counter()
    for text in texts:
        a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        of_a = [bytes(code[c] for c in tokenizer.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(pieces.id_to_piece, b))]
        whole = b" " + (text or "").encode()
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            out.append(None)
            continue
        links, groups, i, j, end_a, end_b, own = [], [], 0, 0, len(of_a[0]), len(of_b[0]), ([], [])
        while True:
            links.append((a[i], b[j]))
            if a[i : i + 1] and (not own[0] or own[0][-1][0] != i):
                own[0].append((i, a[i]))
            if not own[1] or own[1][-1][0] != j:
                own[1].append((j, b[j]))
            if end_a == end_b:
                groups.append("|".join(",".join(str(x) for _, x in side) for side in own))
                own = ([], [])
                if end_a == len(whole):
                    break
                i, j = i + 1, j + 1
                end_a, end_b = end_a + len(of_a[i]), end_b + len(of_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(of_a[i])
            else:
                j += 1
                end_b += len(of_b[j])
        out.append((len(a), len(b), links, groups))
        documents.update(set(links))
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = found
        best = sum(documents[x] == most[x[0]] for x in links)
        rows.append((n_a, n_b, len(groups), len(links), best, sum(documents[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("most_shared", [4_000_000, 0])
def test_alignment_equals_brute_force(spark, texts, most_shared):
    rows = corpus(texts)
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    got = align_tokenizers(spark.createDataFrame(rows, DOCS).repartition(3), BYTES, PIECES, most_shared)
    assert Counter(map(tuple, got.collect())) == want
    assert len({r[-1] for r in want}) > 200 and want[(14, 0, 0, 0, 0, 0, 0, "")] == 1
    assert align_tokenizers(spark.createDataFrame([], DOCS), BYTES, PIECES, most_shared).count() == 0
