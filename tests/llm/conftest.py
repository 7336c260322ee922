import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text) pairs, or (doc_id, text, source); lang and n_chars null."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def corpus(sf001):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{sf001}/documents.parquet' ORDER BY doc_id").fetchall()
