from __future__ import annotations

import random
import re

import pytest
import xxhash
from conftest_llm import ODD
from sparkwarden.llm import simhash
from sparkwarden.llm.components import component_roots
from sparkwarden.llm.simhash import fingerprint_of, near_duplicates, near_pairs, one_of_each


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Brute force over (id, fingerprint) rows: the smallest id reachable."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, least.get(find(f))) for i, f in prints]


def by_id(row):
    return (row[0] is None, row)


def test_equals_brute_force(documents):
    got = near_duplicates(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    prints = [(i, plain(t)) for i, t in texts.items()]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in prints}
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(components(prints))


def test_odd_rows(make_docs):
    docs = make_docs([*ODD, (8, "two words"), (9, "ONE"), (10, "the same text is HERE twice, and again it is here.")])
    got = near_duplicates(docs).collect()
    prints = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=by_id) == sorted(components(prints), key=by_id)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert near_duplicates(docs.limit(0)).count() == 0


def _clouds(seed, per_cloud=60):
    """Fingerprints in clouds of few unstable bits, so that halves and quarters are shared by many."""
    rng = random.Random(seed)
    found = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        unstable = rng.sample(range(32), 6) if rng.random() < 0.5 else rng.sample(range(64), 9)
        for _ in range(per_cloud):
            f = centre
            for b in rng.sample(unstable, rng.randint(0, 4)):
                f ^= 1 << b
            found.add(f)
    return found


@pytest.mark.parametrize("crowded", [128, 10, 3, 0])
def test_pairs_are_all_found_once(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    values = sorted(f - (1 << 64) if f >> 63 else f for f in _clouds(crowded))
    got = [(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame([(f,) for f in values], "fp long")).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) > 500


@pytest.mark.parametrize("hot", [40, 5, 0])
def test_pairs_of_hot_halves_are_all_found_once(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    values = sorted(f - (1 << 64) if f >> 63 else f for f in _clouds(hot))
    got = [(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame([(f,) for f in values], "fp long")).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) > 500


def test_signatures_are_shuffled_once(spark, monkeypatch):
    plans, write = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, purpose))
    rng = random.Random(5)
    values = [rng.getrandbits(63) for _ in range(3000)]
    values += [v ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32, 63)) for v in values]
    # The shared signatures are too many to broadcast, as in a large table.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        assert near_pairs(spark.createDataFrame([(f,) for f in set(values)], "fp long")).count() >= 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning(sig#" in line and "piece1#" not in line]
    assert len(dealt) == 1


def test_roots_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 50 + i) for i in range(40)] + [(3, 3), (140, 7), (-5, -9)]
    got = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {*range(100, 141), 7, *range(50, 90), -5, -9}
    assert {got[n] for n in got if n > 0} == {7} and got[-5] == got[-9] == -9
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(make_docs):
    docs = make_docs([*ODD, (8, "something else entirely, it is not like the others at all")])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i)) == [1, 4, 5, 6, 8, None]


def test_shared_and_missing_ids_lose_no_group(make_docs):
    a, b, c = "a text of some words that is there", "quite another one with other words inside it", "and a third, which nobody gave an id"
    kept = one_of_each(make_docs([(7, a), (7, b), (8, a), (9, b), (None, c), (None, c), (None, a)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(7, a), (7, b), (None, c)], key=repr)
    assert one_of_each(make_docs([])).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = fingerprint_of(text)
    monkeypatch.setattr(simhash, "_BLOCK", 100)
    assert fingerprint_of(text) == whole == plain(text)
