from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang, source); further columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), 0, "x", 1) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", row string, score int")

    return make
