"""Every registered query against its DuckDB SQL at sf0.001."""

import pytest

import __spark_entry__ as E
from lumenvec.plans.catalog import QUERIES
from oracle_check import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf001, name):
    rep = compare(spark, sf001, [name], verbose=False)[name]
    if rep[0] == "rows-only":
        assert rep[1] > 0, rep
    else:
        assert rep[0] is True, rep


def test_parity_whole_compares_every_document(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = QUERIES["parity_whole"](spark, sf001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.status for r in rows} == {"both"} and {r.lang for r in docs.select("lang").collect()} >= {"fr", "de"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "dim", "x"]
