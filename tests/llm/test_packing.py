from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD
from sparkwarden.llm.packing import DocumentEncoder, pack_pieces, packed_documents, plan_sequences
from sparkwarden.llm.ranking import with_ranks

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "\x1c", "a", "bc", "é", "'s", "'", "1", "²", "!", "###", "漢", "😀", "<|endoftext|>", "́", "ing"]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return DocumentEncoder(f.read(), public_tokenizers.PATTERN)


def test_ids_are_the_library_s(encoder):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def check_packing(rows, capacity=1024):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length >= 1
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_documents(make_docs, documents, encoder):
    docs = documents.select("doc_id", "text").unionByName(make_docs(ODD).select("doc_id", "text"))
    rows = packed_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows) <= -(-total // 1024) + 2
    got, want = [], []
    for r in docs.collect():
        ids = [*encoder.library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *([first] if first else [])]
        while cuts[-1] < len(ids):
            cuts.append(cuts[-1] + 1024)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(r["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert packed_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 1024])
    counts = {rng.randint(1, capacity): rng.randint(1, 10 ** rng.randint(0, 5)) for _ in range(rng.randint(1, 60))}
    plan = plan_sequences(counts, capacity)
    used, ranks = defaultdict(int), defaultdict(list)
    for length, first, last, sequence, uses, _ in plan:
        assert (last - first) % uses == 0
        ranks[length].append((first, last))
        used[sequence] += length * uses
    assert all(0 < n <= capacity for n in used.values())
    for length, n in counts.items():
        assert sorted(ranks[length])[0][0] == 0 and sorted(ranks[length])[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(sorted(ranks[length]), sorted(ranks[length])[1:]))


def test_two_replace_one():
    """Greedy leaves 10 = 6 + 3 with a gap of one; the 3 goes for 2 + 2, which fill it."""
    plan = plan_sequences({6: 1, 3: 1, 2: 2}, 10)
    first = sorted((length, uses) for length, _, _, sequence, uses, _ in plan if sequence == 0)
    assert first == [(2, 2), (6, 1)]


def test_one_length_holds_a_third(spark):
    rows = [(i, 0, 0, 300 if i % 3 == 0 else 1 + (i * 7919) % 1024, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long")
    packed = pack_pieces(pieces).collect()
    assert len(packed) == 6000
    # A third have 300 tokens and many are over half a sequence, so the total alone is no reachable bound.
    assert check_packing(packed) <= 1.04 * sum(r[3] for r in rows) / 1024


def test_ranks_are_gapless(spark):
    rows = [("hot" if i % 2 else f"g{i % 9}", i % 700) for i in range(3000)]
    ranked = with_ranks(spark.createDataFrame(rows, "g string, v long"), "g", ["v"], "r", cells=16).collect()
    by = defaultdict(list)
    for r in ranked:
        by[r["g"]].append(r["r"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by["hot"]) == 1500
