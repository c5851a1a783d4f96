from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F
from sparkwarden.llm import merkle
from sparkwarden.llm.merkle import Frontier, folded, proofs, verified_rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and, for each leaf, the (before, after) siblings level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, place in enumerate(at):
            run, inside = runs[place // 3], place % 3
            paths[k].append(("".join(run[:inside]), "".join(run[inside + 1 :])))
        at, level = [p // 3 for p in at], [h(*run) for run in runs]
    return level[0], paths


def brute(rows):
    """Expected results for rows (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    keys = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(sources[s], key=lambda r: r[:3])]) for s in keys}
    root, tops = tree([trees[s][0] for s in keys])
    out = []
    for s, top in zip(keys, tops, strict=True):
        for (_, _, digest, row), path in zip(sorted(sources[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            steps = path + top
            node = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = leaf((*row[:4], row[4].replace("\n", "") if row[4] is not None else None))
            for before, after in steps:
                node = h(before, node, after)
            out.append((row[0], digest, trees[s][0], root, h(*(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest int, place int"


def checked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).select("place", "text", "doc_id", "lang", "source", "n_chars", "tree", "digest")
    got = sorted((tuple(r) for r in verified_rows(df).collect()), key=repr)
    assert got == (brute(rows) if rows else [])
    return got


def test_frontier_keeps_every_witness_up_to_date():
    for n in range(1, 30):
        leaves = [h(str(i)) for i in range(n)]
        frontier = Frontier()
        for d in leaves:
            frontier.append(d)
        assert (frontier.finished(), frontier.witnesses) == tree(leaves)


def test_partial_witness_grows_with_each_sibling():
    frontier = Frontier()
    a, b = h("a"), h("b")
    frontier.append(a)
    assert frontier.open[0][0][4] == ""
    frontier.append(b)
    assert frontier.open[0][0][4] == b and frontier.open[0][1][3] == a


@pytest.mark.parametrize("height", [1, 2, 6])
def test_any_block_height_gives_the_same_tree(spark, height, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(proofs, "__kwdefaults__", {**proofs.__kwdefaults__, "height": height})
    rows = [(i, rng.choice([None, "", "a", "é", "z", "Z"]), "en", i % 5, f"line {i}\nnext" if i % 3 else f"line {i}") for i in range(90)]
    rows += [(1000 + i, f"single {i}", None, None, None) for i in range(12)]
    rng.shuffle(rows)
    got = checked(spark, rows)
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_odd_rows(spark):
    rows = [(i, "s", "en", 1, t) for i, t in ODD] + [(7, None, None, None, "a\n\nb"), (7, None, None, None, "a\nb"), (None, None, None, None, None)]
    checked(spark, rows + [rows[-1]] * 5)
    checked(spark, [(3, "only", "en", 2, "x\ny")])
    checked(spark, [])


def test_proofs_of_other_tables(spark):
    """The operator's own interface: any fields, proofs that fold to the root."""
    df = spark.range(50).select(F.col("id").alias("key"), F.lit("p").alias("part"), (F.col("id") * 3).alias("value"))
    rows = proofs(df, fields=["key", "value"], id_col="key", source_col="part")
    assert [c for c in rows.columns] == ["key", "part", "place", "leaf", "before", "after", "subroot", "root"]
    ok = rows.where(folded(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")).where("place = key").count()
    assert ok == 50


def test_the_documents(spark, documents):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [tuple(r) for r in documents.select(*names).collect()]
    assert sorted((tuple(r) for r in verified_rows(documents).collect()), key=repr) == brute(rows)
