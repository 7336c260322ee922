"""Queries of search and pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.quantized import code_blocks, topk_codes
from lumenvec.operators.search import pair_scores, topk_pruned, topk_similar
from lumenvec.plans.queries.fixtures import TOP_K, documents, static_embeddings
from lumenvec.plans.strategy import spread
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary


def q_topk_benchmark_docs(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item (embedded like the documents) -> its 5 nearest documents."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    base = static_embeddings(spark, d, docs, vocab)
    bench = spread(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id")
    q = static_embeddings(spark, d, bench, vocab)
    return topk_similar(q.withColumnRenamed("doc_id", "query_id"), base, TOP_K)


def q_topk_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector -> its 5 nearest other vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topk_similar(e.withColumnRenamed("doc_id", "query_id"), e, TOP_K, exclude_self=True)


def q_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same rows by blocks of neighbours, pairs of blocks skipped by their bounds."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topk_pruned(e.withColumnRenamed("doc_id", "query_id"), e, TOP_K, exclude_self=True, block=256)


def q_topk_codes(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from int8 codes, what their bounds leave rescored on whole vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return topk_codes(e.withColumnRenamed("doc_id", "query_id"), code_blocks(e), TOP_K, exclude_self=True)


def q_topk_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """Top 5 where a third of the rows has no vector (errors) and a third a NaN one (zero vectors)."""
    kind = F.pmod(F.col("label"), F.lit(3))
    nan = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    vec = F.when(kind == 1, nan).when(kind == 2, F.col("embedding"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), vec.alias("embedding"))
    return topk_similar(e.withColumnRenamed("doc_id", "query_id"), e, TOP_K, exclude_self=True)


def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Score of each vector against the next id (NULL when there is none)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    pairs = e.select(F.col("doc_id").alias("id_a"), (F.col("doc_id") + 1).alias("id_b"))
    return pair_scores(pairs, e)


QUERIES = {
    "topk_benchmark_docs": q_topk_benchmark_docs,
    "topk_embeddings": q_topk_embeddings,
    "topk_pruned": q_topk_pruned,
    "topk_codes": q_topk_codes,
    "topk_with_errors": q_topk_with_errors,
    "pairs": q_pairs,
}
