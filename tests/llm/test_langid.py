from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F
from sparkwarden.llm import langid
from sparkwarden.llm.langid import (
    WINDOW,
    document_probabilities,
    held_out,
    identified,
    label_documents,
    position_probabilities,
    train,
    training_windows,
)


@pytest.fixture(scope="module")
def network():
    windows = [(("der und die ung " * 9)[k : k + 60].encode(), "de") for k in range(16)]
    windows += [(("the and of ing " * 9)[k : k + 60].encode(), "en") for k in range(15)]
    return train(windows, steps=60, batch=32)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    weights = {name: v.astype(np.float64) for name, v in langid._fresh(["a", "b", "c"], 3, rng).items()}
    x = rng.integers(97, 105, (7, 5)).astype(np.uint8)
    live = np.ones((7, 5), np.float32)
    live[5:, 1] = 0
    live[2:, 3] = 0
    labels = np.array([0, 1, 2, 1, 0])
    _, grads = langid._gradients(weights, x, live, labels)
    for name, g in grads.items():
        flat = weights[name].reshape(-1)
        slopes = g.reshape(-1)
        for k in [int(np.abs(slopes).argmax()), *rng.choice(len(flat), 3)]:
            held, step = flat[k], 1e-2
            flat[k] = held + step
            up = langid._gradients(weights, x, live, labels)[0]
            flat[k] = held - step
            down = langid._gradients(weights, x, live, labels)[0]
            flat[k] = held
            assert (up - down) / (2 * step) == pytest.approx(slopes[k], abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identified(docs, keep=["doc_id", "lang"]).select("row.*", "lang_pred", held_out(F.col("row.doc_id")).alias("out")).toPandas()
    assert (got.out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    out = got[got.out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.97


def test_whole_texts_count_every_position_once(network):
    texts = [b"", b"x", b"the", b"the and of " * 5, ("der und die " * 40).encode(), b"ing " * 16, b"the " * 3000]
    got = document_probabilities(network, texts)
    for text, row in zip(texts, got):
        if not text:
            assert row.tolist() == [0, 0]
            continue
        want, seen = np.zeros(2), 0
        while seen < len(text):
            start = min(seen, max(0, len(text) - WINDOW))
            window = np.frombuffer(text[start : start + WINDOW], np.uint8)[None, :]
            p = position_probabilities(network, window)[:, :, 0]
            want += p[seen - start :].sum(axis=0)
            seen = start + window.shape[1]
        assert row == pytest.approx(want / len(text), abs=1e-5)
        assert row.sum() == pytest.approx(1, abs=1e-5)


def test_blocks_do_not_matter(network, monkeypatch):
    texts = [b"der und " * k for k in range(60)]
    whole = document_probabilities(network, texts)
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert np.allclose(whole, document_probabilities(network, texts), atol=1e-5)


def test_odd_rows(spark, make_docs, network):
    docs = make_docs(ODD)
    got = {r["row"]["doc_id"]: r for r in label_documents(docs, network).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert got[6]["lang_pred"] == got[7]["lang_pred"] in ("de", "en") and 0.5 < got[6]["score"] <= 1
    assert label_documents(docs, network).select("row.*").columns == docs.columns
    assert {r["lang_pred"] for r in label_documents(docs, train([])).collect()} == {"und"}
    assert identified(docs.limit(0)).count() == 0


def test_training_sample_is_bounded_and_keeps_to_its_fold(make_docs):
    docs = make_docs([(i, f"text number {i} of many", "en" if i % 2 else "de", "s") for i in range(400)] + [(900, "none", None, "s")])
    windows = training_windows(docs, docs_per_language=10)
    assert len(windows) == 2 * 10 * langid.WINDOWS_PER_DOC
    out = {f"text number {i} of many" for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not {w.decode() for w, _ in windows} & out


def test_a_sample_shared_by_many_languages(make_docs):
    docs = make_docs([(i, f"text number {i} of many", f"l{i % 700}" if i % 3 else "hot", "s") for i in range(6000)])
    windows = training_windows(docs, docs_per_language=50, sample_docs=1450)
    by_language = {}
    for _, lang in windows:
        by_language[lang] = by_language.get(lang, 0) + 1
    assert set(by_language.values()) <= {langid.WINDOWS_PER_DOC, 2 * langid.WINDOWS_PER_DOC}
    assert by_language["hot"] == 2 * langid.WINDOWS_PER_DOC and len(by_language) > 690


@pytest.mark.parametrize("sample_docs", [9, 60, 6000])
def test_sample_is_that_with_the_lowest_hashes(make_docs, sample_docs):
    """Alike whether few languages are looked up by the tasks or many are met by a shuffle; one language has a third of all rows."""
    rows = [(i, f"text {i}", f"l{i % 40}" if i % 3 else "hot", "s") for i in range(1500)]
    docs = make_docs(rows + rows[:3])
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(langid.SEED)).alias("h")).collect()}
    learned = [r for r in rows + rows[:3] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    languages = {r[2] for r in learned}
    drawn = max(1, min(20, sample_docs // len(languages)))
    want = []
    for lang in languages:
        mine = sorted((hashes[r[0]], r[0], r[1]) for r in learned if r[2] == lang)[:drawn]
        want += [(text, lang) for _, _, text in mine for _ in range(langid.WINDOWS_PER_DOC)]
    got = training_windows(docs, docs_per_language=20, sample_docs=sample_docs)
    assert len(got) == len(want) and all(lang in languages for _, lang in got)
    starts = {}
    for text, lang in want:
        starts[lang] = starts.get(lang, set()) | {text}
    # A window of a short text is a tail of it.
    assert all(any(t.endswith(w.decode()) for t in starts[lang]) for w, lang in got)
    assert sorted(lang for _, lang in got) == sorted(lang for _, lang in want)
