"""The pipeline against its operators taken row by row, and the registered queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkwarden.llm.catalog import QUERIES
from sparkwarden.llm.oracles import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SF).cache())
    return results


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality rules", "near duplicates", "packing"]
    for result in stages[1:4]:
        assert result.columns == stages[0].columns
        assert ids(result) <= ids(stages[0])


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    good = ids(labels) & ids(stages[0])
    assert len(good & ids(stages[1])) / len(good) > 0.99
    kept = good & ids(stages[1])
    assert len(kept & ids(stages[2])) / len(kept) > 0.9
    bad = ids(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")) & ids(stages[1])
    assert len(bad & ids(stages[2])) / len(bad) < 0.2


def test_one_document_of_each_group_stays(stages):
    from test_simhash import components, plain

    before = [(r["doc_id"], plain(r["text"])) for r in stages[2].collect()]
    assert ids(stages[3]) == {c for _, c in components(before)}


def test_all_that_is_kept_is_packed(spark, stages):
    from test_packing import check_packing

    rows = stages[4].collect()
    assert {r["doc_id"] for r in rows} == ids(stages[3])
    assert check_packing(rows) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1
    ran = corpus_pipeline.run(spark, SF)
    digest = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, ran.select(digest).collect())) == sorted(map(tuple, stages[4].select(digest).collect()))


def test_queries_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
