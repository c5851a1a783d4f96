from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sparkwarden.llm import ann
from sparkwarden.llm.ann import CentroidGraph, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, score double, list string"


def brute(rows, queries, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    found = {}
    for q in queries:
        own = next(v for i, v in rows if i == q)
        scores = x @ np.array(own, np.float32).astype(float)
        order = sorted((-s, i) for s, i in zip(scores, ids) if i != q)
        found[q] = [i for _, i in order[:k]]
    return found


def answers(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(found[r["query_id"]]) == r["rank"]
    return found


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    queries = [i for i, _ in rows if i % 20 == 0]
    got = answers(nearest_neighbours(table, F.col("vec_id") % 20 == 0, list_size=16).collect())
    want = brute(rows, queries, 20)
    assert set(got) == set(queries) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in queries]) >= 0.9


def test_lengths_differ(spark):
    """Inner products, not angles: long vectors come first."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(400)]
    table = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    got = answers(nearest_neighbours(table, F.col("vec_id") < 40, 10).collect())
    want = brute(rows, range(40), 10)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in range(40)]) >= 0.9


def test_a_third_of_all_rows_are_one_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 50)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=6).astype(np.float32).tolist()) for i in range(900)]
    table = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    got = answers(nearest_neighbours(table, F.col("vec_id") % 20 == 0, 20).collect())
    want = brute(rows, [i for i in range(0, 900, 20)], 20)
    for q in want:
        assert len(got[q]) == 20
        if q % 3 == 0:
            assert got[q] == want[q]


def test_every_size_has_its_index(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 + i % 3).astype(np.float32).tolist()) for i in range(600)]
    table = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    got = answers(nearest_neighbours(table, F.col("vec_id") % 2 == 0, 10).collect())
    for size in (3, 4, 5):
        alike = [(i, v) for i, v in rows if len(v) == size]
        want = brute(alike, [i for i, _ in alike if i % 2 == 0], 10)
        assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, -1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (1, [2.0, 1.0]), (10, [-1.0, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    got = nearest_neighbours(table, F.lit(True), 20).collect()
    assert answers(got) == {0: [1, 2, 10], 1: [2, 0, 10], 2: [1, 0, 10], 10: [0, 1, 2]}
    assert {r["score"] for r in got if r["query_id"] == 0} == {2.0, -1.0}
    assert set(answers(got)) == {0, 1, 2, 10}
    assert nearest_neighbours(table.limit(0), F.lit(True)).count() == 0
    assert nearest_neighbours(table.where("vec_id = 5"), F.lit(True)).count() == 0
    assert nearest_neighbours(table.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 30, 400])
def test_graph_finds_the_nearest_centroids(count):
    rng = np.random.default_rng(count)
    sample = np.concatenate([rng.normal(size=(3000, 9)), rng.normal(size=(1000, 9)) * 0.001 + 3]).astype(np.float32)
    graph = CentroidGraph.fitted(sample, count, 1.0)
    x = np.concatenate([sample[:100], sample[-100:]])
    nodes, dist = graph.nearest(x, 8)
    exact = np.sort(np.linalg.norm(x[:, None, :] - graph.centroids[None], axis=2), axis=1)[:, :8]
    assert nodes.shape == exact.shape
    assert np.mean(dist <= exact + 1e-2) > 0.95
    assert all(len(set(row)) == len(row) for row in nodes.tolist())


def _isotropic(tmp_path, spark, count, size=64):
    """A table of `count` unit vectors in no groups, and the vectors."""
    x = np.random.default_rng(count).normal(size=(count, size))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(count)), "embedding": values}), str(tmp_path / "vectors.parquet"), row_group_size=20000)
    return spark.read.parquet(str(tmp_path / "vectors.parquet")), x


def _recall(table, x, every, **how):
    got = answers(nearest_neighbours(table, F.col("vec_id") % every == 0, **how).collect())
    asked = np.arange(0, len(x), every)
    scores = x[asked].astype(float) @ x.T.astype(float)
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-scores, 20, axis=1)[:, :20]
    return np.mean([len(set(got[q]) & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist())])


def test_recall_holds_on_many_vectors_without_groups(spark, tmp_path):
    """With the constants of the query, which once read 64 lists at most."""
    table, x = _isotropic(tmp_path, spark, 150_000)
    assert _recall(table, x, 400) >= 0.9


def test_lists_read_follow_the_table(spark, tmp_path):
    table, x = _isotropic(tmp_path, spark, 6000)
    assert _recall(table, x, 20, list_size=8, usual_lists=8) >= 0.9
    assert _recall(table, x, 20, list_size=8, usual_lists=8, list_ratio=1.0) >= 0.9
    assert _recall(table, x, 20, list_size=8, usual_lists=8, recall=0.0) < 0.9


def test_a_vector_and_a_query_are_written_once(spark, tmp_path, monkeypatch):
    """Not once for each list they are in or read."""
    written, plain = {}, ann.stored

    def stored(df, purpose):
        written[purpose] = plain(df, purpose)
        return written[purpose]

    monkeypatch.setattr(ann, "stored", stored)
    table, _ = _isotropic(tmp_path, spark, 3000)
    nearest_neighbours(table, F.col("vec_id") % 20 == 0, list_size=16).count()
    assert written["postings"].count() == 3000
    assert written["asked"].count() == 150


def test_all_lists_read_by_wide_queries_are_met_quickly(monkeypatch):
    """Each centroid is compared with a query once, however many lists it reads."""
    x = np.random.default_rng(3).normal(size=(9000, 16)).astype(np.float32)
    graph = CentroidGraph.fitted(x, 600, 1.0)
    met, plain = [], ann.np.einsum
    monkeypatch.setattr(ann.np, "einsum", lambda how, a, b: met.append(len(a)) or plain(how, a, b))
    queries = x[:64]
    row, lists = graph.lists(queries, 1.6, 8, 64)
    far = np.linalg.norm(queries[:, None] - graph.centroids[None], axis=2)
    within = far <= far.min(axis=1, keepdims=True) * 1.6
    found = np.zeros(within.shape, int)
    np.add.at(found, (row, lists), 1)
    assert found.max() == 1 and found[within].mean() > 0.99
    assert within.sum(axis=1).mean() > 100 and sum(met) < 2 * 64 * 600


@pytest.mark.parametrize("hot", [False, True])
def test_blocks_tiles_and_turns_give_what_brute_force_gives(spark, monkeypatch, hot):
    """All lists read, ties and lengths of many kinds, more vectors in a list than in a block."""
    for name, value in (("CHUNK", 40), ("BLOCKS", 4), ("TILE", 16), ("TURN", 32), ("_ROWS", 64)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (500, 5)) * rng.choice([0.001, 1, 1000], (500, 1))
    if hot:
        x[:300] = [1000, 500, 0, 0, 3] + rng.integers(0, 2, (300, 5)) * 0.01
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist()) if any(v)]
    table = spark.createDataFrame([(i, v, 0.0, "x") for i, v in rows], SCHEMA)
    asked = [i for i, _ in rows if i % 3 == 0]
    got = answers(nearest_neighbours(table, F.col("vec_id") % 3 == 0, 10, list_ratio=1e4).collect())
    ids = np.array([i for i, _ in rows])
    values = np.array([v for _, v in rows], np.float32).astype(float)
    for q, v in ((i, np.array(v, np.float32).astype(float)) for i, v in rows if i in set(asked)):
        score = (v * values).sum(axis=1)
        order = [i for _, i in sorted(zip(-score, ids.tolist())) if i != q][:10]
        assert got[q] == order
