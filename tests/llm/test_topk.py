from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkwarden.llm import topk
from sparkwarden.llm.topk import best_of_cell, exact_top_k

LOW, HIGH = -(1 << 63), (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, id string, mark int"


def brute(rows, k, is_query=lambda i: i % 20 == 0, scale=64):
    """Every pair compared with Python integers."""
    seen = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, tuple(math.floor(scale * x) for x in v))
        if row not in seen:
            seen.append(row)
    out = []
    for i, v in seen:
        if is_query(i):
            scores = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), LOW), HIGH), j) for j, w in seen if j != i and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in exact_top_k(df, F.col("vec_id") % 20 == 0, k, **options).collect())


@pytest.mark.parametrize("cells", [{}, {"lane_rows": 64, "group_queries": 4}])
def test_against_every_pair(spark, cells):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 13)) / 4)]
    assert searched(spark, rows, **cells) == brute(rows, 5)


def test_odd_rows_ties_and_lengths(spark):
    same = [0.5, 0.25, -0.125]
    rows = [(i, same) for i in range(100, 160)]  # ties everywhere
    rows += [(0, [0.0, 0.0, 0.0]), (20, same), (20, same), (20, [1.0, 0.0, 0.0]), (40, [1.0, 2.0]), (41, [2.0, 1.0]), (60, []), (61, [])]
    rows += [(None, same), (1, None), (2, [1.0, None, 0.0]), (3, [math.nan, 0.0, 0.0]), (4, [math.inf, 0.0, 0.0]), (80, [7.0])]
    got = searched(spark, rows)
    want = []
    for query in sorted({r[0] for r in got}):
        want += [r for r in brute(rows, 5) if r[0] == query]
    assert got == sorted(want) and {r[0] for r in got} == {0, 20, 40, 60, 100, 120, 140}
    assert searched(spark, []) == []


@pytest.mark.parametrize("power", [7, 12])
def test_values_beyond_exact_floats(spark, power):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, power) for _ in range(6)]) for i in range(60)]
    assert searched(spark, rows) == brute(rows, 5)
    huge = [(i, [1e17 * (i + 1), 3.0]) for i in range(4)]
    assert {r[3] for r in searched(spark, huge)} == {(1 << 63) - 1}


@pytest.mark.parametrize("power", [0.0, 1.5])
def test_candidates_are_pruned_and_nothing_is_lost(power, monkeypatch):
    """The bounds let most products go unmade, and the result is that of a full product."""
    rng = np.random.default_rng(7)
    spread = np.arange(1, 65) ** -power
    rows = np.floor(64 * rng.normal(size=(64, 5000)) * spread[:, None] / 8).astype(np.int64)
    queries = rows[:, :40]
    ids, q_ids = np.arange(5000), np.arange(40)
    made = []
    monkeypatch.setattr(topk, "SLAB_ROWS", 500)
    whole = topk.Cell.slab

    def counted(self, *args):
        result = whole(self, *args)
        made.append(len(result[0]))
        return result

    monkeypatch.setattr(topk.Cell, "slab", counted)
    at, best, score = best_of_cell(q_ids, queries, ids, rows, 20)
    full = queries.T @ rows
    for q in range(40):
        order = sorted((-int(s), int(j)) for j, s in enumerate(full[q]) if j != q)[:20]
        assert [(-int(s), int(j)) for s, j in zip(score[at == q], best[at == q], strict=True)] == order
    assert sum(made[5:]) < 0.1 * 40 * 2500
