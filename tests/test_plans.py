"""Physical plan checks: broadcast where bounded, no shuffle on the ONNX
path, pruned scans, pushed filters, top-k before the shuffle."""

import pytest
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.search import topk_similar
from lumenvec.plans.catalog import WORDS64, fixture_onnx
from lumenvec.plans.pipeline import embed
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return table(spark, sf001, "documents")


def test_onnx_path_has_no_shuffle(docs):
    vocab = corpus_word_vocabulary(docs)
    p = plan(embed(docs.select("doc_id", "text"), vocab, WORDS64, fixture_onnx(vocab)))
    assert "MapInPandas" in p and "Exchange" not in p


def test_static_path_has_no_shuffle_and_prunes(docs):
    vocab = corpus_word_vocabulary(docs)
    for dim in (64, 768):
        df = embed(docs.where(F.col("lang") == "en").select("doc_id", "text"), vocab, WORDS64, fixture_vectors(vocab, dim))
        p = plan(df)
        assert "MapInArrow" in p and "Exchange" not in p and "ObjectHashAggregate" not in p
        assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
        assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_decode_and_reports_read_once_without_a_token_shuffle(spark, sf001):
    from lumenvec.operators.reports import top_unknown_tokens
    from lumenvec.operators.tokens import decode_rows, id_rows, token_ids

    d = table(spark, sf001, "documents")
    vocab = corpus_word_vocabulary(d)
    assert "Exchange" not in plan(decode_rows(id_rows(d, vocab, WORDS64), vocab, WORDS64))
    p = plan(top_unknown_tokens(token_ids(d, vocab, WORDS64, keep=["lang"]), ["lang"]))
    assert p.count("documents.parquet") == 1 and "SortMergeJoin" not in p


def test_topk_limits_before_shuffle(spark, sf001):
    e = table(spark, sf001, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    df = topk_similar(e.withColumnRenamed("doc_id", "query_id"), e, 5)
    df.collect()
    assert "WindowGroupLimit" in plan(df)
