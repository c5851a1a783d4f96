from __future__ import annotations

import random

import public_tokenizers
import pytest
from conftest_llm import ODD
from sparkwarden.llm.counts import TextCounter, prefix_tables, prefix_within, token_counts, tokens_in_prefix

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "a", "B", "thing", "ation", "é", "É", "'s", "'RE", "'ll", "'", "1", "²", "!", "###", "漢", "😀", "<|", "́", "\r\n", "​", "İ", "Σ", "ﬁ", "ß", "\u0958", "\u0344"]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return TextCounter(f.read())


def library(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


def test_totals_and_every_prefix(counter):
    rng = random.Random(1)
    for _ in range(2500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
        assert counter.count(text) == library(counter, text)
        table, plain = counter.table(text), counter.normalize(text)
        for k in range(len(plain) + 1):
            assert counter.tokens_at(table, k) == library(counter, plain[:k])
        for budget in range(4):
            within = [k for k in range(len(plain) + 1) if library(counter, plain[:k]) <= budget]
            assert counter.longest_within(table, budget, len(plain)) == max(within)


def test_special_strings(counter):
    for text in ("ab<|endoftext|>cd don't", "x <|endoftext|><|startoftext|> y!", "<|endoftext|>", "!!<|endoftext|>!!"):
        table = counter.table(text)
        assert counter.count(text) == library(counter, text)
        assert [counter.tokens_at(table, k) for k in range(len(text) + 1)] == [library(counter, text[:k]) for k in range(len(text) + 1)]


def test_every_code_point(counter):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 3000):
        text = " ".join(f"x{c}! {c}'{c}?" for c in points[at : at + 3000 : 5])
        assert counter.count(text) == library(counter, text)


def test_long_word(counter):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdeth") for _ in range(4000))
    assert counter.count(word) == library(counter, word)


def test_tables(make_docs, counter):
    docs = make_docs(ODD)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, PATH).collect())
    texts = [(str(r["doc_id"]), r["text"] or "") for r in docs.collect()]
    want = sorted((i, len(t.encode()), library(counter, t), library(counter, t) > 2048) for i, t in texts)
    assert got == want and any(o for *_, o in got)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_questions_are_looked_up(make_docs, counter):
    text = "The same text is here twice, and again it is here."
    tables = prefix_tables(make_docs([(1, text), (2, None)]), PATH)
    rows = {r["doc_id"]: r for r in tables.select("doc_id", tokens_in_prefix(13).alias("t"), prefix_within(5).alias("w")).collect()}
    assert rows[1]["t"] == library(counter, text[:13]) and rows[2]["t"] == 0 and rows[2]["w"] is None
    assert rows[1]["w"] == max(k for k in range(len(text) + 1) if library(counter, text[:k]) <= 5)
