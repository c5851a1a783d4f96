from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from conftest_llm import ODD
from pyspark.sql import functions as F
from sparkwarden.llm import ranking
from sparkwarden.llm.sharding import interleaved_shards
from sparkwarden.llm.tables import stored


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_rows_law_slots_and_digests(documents):
    rows = _rows(interleaved_shards(documents, shards=24))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_match_the_mixture(make_docs):
    docs = make_docs([(i, "t", "en", "big" if i % 3 else f"s{i % 7}") for i in range(3000)])
    shares = Counter(r["source"] for r in docs.collect())
    by_id = {r["doc_id"]: r["source"] for r in docs.collect()}
    in_shard = defaultdict(Counter)
    for r in _rows(interleaved_shards(docs, shards=10)):
        in_shard[r["shard"]][by_id[r["doc_id"]]] += 1
    for counts in in_shard.values():
        # A source is off by at most two rows, and the rest of the shard makes up for all others.
        assert all(abs(counts[s] - n / 10) <= (len(shares) if s == "big" else 2) for s, n in shares.items())


def test_seed_changes_order_and_runs_repeat(documents):
    first = {(r["doc_id"], r["shard"], r["slot"]) for r in _rows(interleaved_shards(documents))}
    assert first == {(r["doc_id"], r["shard"], r["slot"]) for r in _rows(interleaved_shards(documents.repartition(5)))}
    assert first != {(r["doc_id"], r["shard"], r["slot"]) for r in _rows(interleaved_shards(documents, seed=8))}


def test_odd_rows_and_empty_table(make_docs):
    docs = make_docs([(*r, "en", None if k % 2 else "s") for k, r in enumerate(ODD)])
    rows = _rows(interleaved_shards(docs, shards=4))
    assert len(rows) == len(ODD)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 1} == {0}
    assert interleaved_shards(docs.limit(0)).count() == 0


def test_many_small_sources_and_rows_without_id(make_docs):
    """Neither keeps its rows in one place: all fractions, or all ids, are the same."""
    docs = make_docs([(None if i % 2 else i, f"t{i}", "en", f"s{i}") for i in range(2000)] + [(None, "same", "en", "hot")] * 2000)
    rows = _rows(interleaved_shards(docs, shards=7))
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 4000 and max(counts.values()) - min(counts.values()) <= 1
    assert sum(r["text_crc32"] == zlib.crc32(b"same") for r in rows) == 2000
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in counts)


def test_a_hot_key_is_sorted_in_many_tasks(spark, monkeypatch):
    """Rows alike in the whole order spread over the ranges."""
    sorted_rows = []
    # Small parts are kept apart, as large ones are.
    monkeypatch.setattr(ranking, "stored", lambda df, purpose: sorted_rows.append(stored(df, purpose)) or sorted_rows[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20000, numPartitions=4).selectExpr("'' AS tree", "1 AS a")
    try:
        assert sorted(r["place"] for r in ranking.placed(rows, ["a"], "hot-test").collect()) == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in sorted_rows[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert max(sizes) < 10000
