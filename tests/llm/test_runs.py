from __future__ import annotations

import hashlib
import random
import zlib

from conftest_llm import ODD
from sparkwarden.llm.runs import kept_words, run_digests, runs_of, word_runs


def brute(words, least=12):
    """Every period tried at every place."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(
                q % p == 0 and all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)
            ) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(rng, count):
    for _ in range(count):
        words, kinds = [], rng.choice([1, 2, 3, 30])
        while len(words) < rng.randint(0, 90):
            piece = [b"w%d" % rng.randint(1, kinds) for _ in range(rng.randint(1, 9))]
            words += piece * rng.choice([1, 1, 2, 3, 7])
        yield words


def test_runs_equal_brute_force():
    rng = random.Random(2)
    batch = list(texts(rng, 250)) + [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a", b"b"] * 700]
    assert runs_of(batch) == [brute(t) for t in batch]
    for least in (2, 5, 7, 8):
        assert runs_of(batch[:60], least) == [brute(t, least) for t in batch[:60]]


def test_the_same_text_again_is_not_mixed_with_its_neighbour():
    text = [b"w%d" % (i % 7) for i in range(40)]
    assert runs_of([text] * 3) == [brute(text)] * 3


def test_long_periodic_text():
    words = [b"x"] * 60000 + [b"%d" % i for i in range(20000)] * 3
    assert runs_of([words]) == [[(0, 60000, 1), (60000, 60000, 20000)]]
    assert len(kept_words(words, runs_of([words])[0])) == 1 + 20000


def looped(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def digests(doc_id, text):
    words = looped((text or "").encode().split(), doc_id)
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id,
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def test_query_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(i + 300, (" \n".join(w.decode() for w in t))) for i, t in enumerate(texts(rng, 80))]
    rows += [r for r in ODD if not r[1] or len(r[1]) < 1000] + [(None, "a b " * 30), (9, "a b\x1c \x85c " * 20)]
    got = sorted((tuple(r) for r in run_digests(make_docs(rows)).collect()), key=repr)
    assert got == sorted((digests(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_whole_long_texts_and_empty_tables(make_docs):
    assert run_digests(make_docs([])).count() == 0
    rows = {r["id"]: r for r in word_runs(make_docs(ODD)).collect()}
    assert len(rows) == len({r[0] for r in ODD})
    assert rows[5]["words"] == 90000 and rows[1]["collapsed"] == "" and rows[1]["runs"] == []


def test_documents_of_the_table(documents):
    """Whole texts up to 400 words against every period; longer ones must come once each too."""
    got = {r[0]: tuple(r) for r in run_digests(documents).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    short = [r for r in rows if len((r["text"] or "").split()) <= 150]
    assert len(short) > 50 and all(got[r["doc_id"]] == digests(r["doc_id"], r["text"]) for r in short)
