from __future__ import annotations

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from conftest_llm import LONG, ODD
from sparkwarden.llm.quality import THRESHOLD, _repeat_places, gram_counts, judge, judged_documents, log_ratios, trusted_ids

BUCKETS = 512


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_counts(text):
    words, text = words_of(text), text or ""
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def of_longs(*values):
    """Spark's hash of several longs: each is hashed with the hash before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def buckets_of(text):
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words_of(text)]
    return [h % BUCKETS for h in hashes] + [of_longs(a, b) % BUCKETS for a, b in zip(hashes, hashes[1:])]


def check(spark, docs, labels):
    rows = docs.collect()
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0} - {None}
    raw, target = Counter(), Counter()
    for r in rows:
        grams = buckets_of(r["text"])
        raw.update(grams)
        if r["doc_id"] in trusted:
            target.update(grams)
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    weight = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in range(BUCKETS)}
    if not target:
        weight = dict.fromkeys(range(BUCKETS), 0.0)
    want = Counter()
    for r in rows:
        counts, grams = plain_counts(r["text"]), buckets_of(r["text"])
        score = sum(weight[b] for b in grams) / len(grams) if grams else 0.0
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[r["doc_id"], counts, failed, not failed and score >= THRESHOLD, round(score, 9)] += 1
    got = Counter(
        (r["row"]["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"], round(r["score"], 9))
        for r in judged_documents(docs, labels, buckets=BUCKETS).collect()
    )
    assert got == want


def test_equals_brute_force(spark, documents):
    check(spark, documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_odd_rows(spark, make_docs):
    text = "one two three four five six\none two three four five six\n\n x y z a b c d"
    docs = make_docs([*ODD, (8, text), (9, "a " * 40), (10, "é " + "über#1 " * 3 + "w v u t s r q p o n")])
    schema = "doc_id long, quality int, toxic int"
    check(spark, docs, spark.createDataFrame([(5, 1, 0), (5, 1, 0), (6, 1, 1), (8, 1, None), (9, None, 0), (None, 1, 0), (10, 1, 0)], schema))
    check(spark, docs, spark.createDataFrame([], schema))
    check(spark, docs.limit(0), spark.createDataFrame([], schema))


def test_all_columns_stay(spark, make_docs):
    docs = make_docs(ODD)
    judged = judge(docs, [0.0] * 8)
    assert judged.select("row.*").columns == docs.columns
    assert judged.where("kept").count() >= 1


def test_good_and_bad_labels_come_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = judged_documents(docs, labels, keep=["doc_id"]).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").toPandas()
    good = kept[(kept.quality == 1) & ~kept.base_failed]
    bad = kept[kept.quality == 0]
    assert good.kept.mean() > 0.99
    assert bad.kept.mean() < 0.2


def test_ratios_without_trust_decide_nothing(spark, make_docs):
    docs = make_docs(ODD)
    none = gram_counts(docs, trusted_ids(spark.createDataFrame([], "doc_id long, quality int, toxic int")), 16)
    assert log_ratios(none, 16) == [0.0] * 16
    with pytest.raises(ValueError):
        judge(docs, [])
    assert len(words_of(LONG)) == 90000


def test_windows_are_told_apart_by_the_whole_hash(spark):
    """Hashes that differ in their last bits only are different windows; true repeats are found."""
    hashes = [k << 20 for k in range(20_000)]
    hashes[5], hashes[9] = hashes[7] | 1, hashes[3]
    hashes[30], hashes[40] = hashes[50], hashes[50]
    frame = spark.createDataFrame([(1, hashes), (2, hashes[:2]), (3, [])], "id int, _w array<long>")
    want = {1: [3, 9, 30, 40, 50], 2: [], 3: []}
    assert {r["id"]: r["_at"] for r in _repeat_places(frame).collect()} == want


def test_counts_of_a_long_text(spark, make_docs):
    text = " ".join(f"w{i * i % 20011}" for i in range(40_000))
    got = judge(make_docs([(1, text)]), [0.0] * BUCKETS).collect()[0]
    assert (got["n_words"], got["n_repeat_words"]) == (plain_counts(text)[0], plain_counts(text)[4])
