from __future__ import annotations

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from conftest_llm import ODD
from sparkwarden.llm.bpe import BytePairEncoder, decode_ids, encode_texts, rank_table, round_trip_digests
from sparkwarden.llm.pretokens import PartCache

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "​", "a", "bc", "ing", "é", "É", "'s", "'re", "'", "1", "²", "!", "###", "漢字", "😀", "<|endoftext|>", "́", "ﬁ", "İ"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return rank_table(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return BytePairEncoder(ranks, public_tokenizers.PATTERN)


def test_random_texts(encoder, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_every_code_point(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2000):
        text = " ".join(f"x{c}! {c}'{c}?" for c in points[at : at + 2000 : 3])
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_long_pre_tokens(encoder, library):
    rng = random.Random(2)
    for text in ("a" * 5001, "".join(rng.choice("abcdeth") for _ in range(20000)), "é" * 3000):
        assert encoder.encode(text) == library.encode_ordinary(text)
    piece = "".join(rng.choice("abcdeth") for _ in range(400_000)).encode()
    began = time.perf_counter()
    ids = encoder.merge(piece)
    assert encoder.decode(ids) == piece and time.perf_counter() - began < 30


def test_ranks_in_any_order():
    """Vocabularies whose merges make lower ranks too: the leftmost lowest pair comes first."""
    rng = random.Random(3)
    for _ in range(300):
        tokens = {bytes([b]) for b in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(12)}
        order = list(tokens)
        rng.shuffle(order)
        table = {t: i for i, t in enumerate(order)}
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while piece not in table and len(parts) > 1:
            best = min(((table.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want = (table[piece],) if piece in table else tuple(table[p] for p in parts)
        assert BytePairEncoder(table, ".+").merge(piece) == want


def test_tables(make_docs, library):
    docs = make_docs(ODD)
    encoded = encode_texts(docs, PATH, public_tokenizers.PATTERN)
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == want
    decoded = sorted((str(r["doc_id"]), bytes(r["text"]).decode()) for r in decode_ids(encoded, PATH).collect())
    assert decoded == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    sha = lambda data: hashlib.sha256(data).hexdigest()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect())
    texts = [(str(r["doc_id"]), r["text"] or "") for r in docs.collect()]
    assert got == sorted((i, len(ids := library.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in texts)
    assert round_trip_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_cache_stays_bounded():
    made = []
    cache = PartCache(lambda part: made.append(part) or part.upper(), entries=10)
    for k in range(1000):
        assert cache[f"p{k % 37}"] == f"P{k % 37}"
        assert cache["hot"] == "HOT"
        assert len(cache) <= 10 and len(cache.old) <= 10
    assert made.count("hot") == 1
