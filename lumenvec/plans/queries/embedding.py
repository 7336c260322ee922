"""Queries of encoders, pooling and result rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.pooling import embedding_preview, masked_mean_pool
from lumenvec.operators.tokens import token_ids
from lumenvec.plans.pipeline import embed, split_results
from lumenvec.plans.queries.fixtures import FIXTURE_DIM, SUBWORD64, WORDS64, documents, fixture_onnx, fixture_tasks, long_vectors
from lumenvec.plans.strategy import materialize
from lumenvec.profiles import SUBWORD1024, WORDS768
from lumenvec.sources.vocab import corpus_piece_vocabulary, corpus_word_vocabulary


def _head_and_norm(res: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, dim, x, n_dims, norm, checksum): the first values of every embedding, its size, its
    length and the sum of all its values, weighed by their places; made once a row, before a row becomes several."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    weighed = F.transform("embedding", lambda x, i: x * (i % 97 + 1))
    own = res.select("doc_id", F.size("embedding").cast("bigint").alias("n_dims"), F.round(norm, 6).alias("norm"),
                     F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"),
                     F.slice("embedding", 1, n).alias("head"))
    out = own.select("doc_id", "n_dims", "norm", "checksum", F.posexplode_outer("head").alias("dim", "x")).where(F.col("dim").isNotNull())
    return out.select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"), "n_dims", "norm", "checksum")


def q_embed_static(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    res = embed(docs, vocab, WORDS64, fixture_vectors(vocab, FIXTURE_DIM), dtype="double")
    return long_vectors(res, "doc_id", "embedding")


def q_embed_static_768(spark: SparkSession, d: str) -> DataFrame:
    """The words profile at its real size."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    return _head_and_norm(embed(docs, vocab, WORDS768, fixture_vectors(vocab, WORDS768.dim), dtype="double"))


def q_embed_static_1024_task(spark: SparkSession, d: str) -> DataFrame:
    """The subword profile at its real size, with its default task's offset."""
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    enc = fixture_vectors(vocab, SUBWORD1024.dim, task_scale=1 / 8)
    return _head_and_norm(embed(docs, vocab, SUBWORD1024, enc, dtype="double", tasks=fixture_tasks(spark)))


def q_embed_static_1024_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same where nothing may be sent whole: joins for the ids, the vectors in blocks of dimensions."""
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    enc = fixture_vectors(vocab, SUBWORD1024.dim, task_scale=1 / 8)
    return _head_and_norm(embed(docs, vocab, SUBWORD1024, enc, dtype="double", tasks=fixture_tasks(spark), max_shipped=0))


def q_embed_onnx(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    res = embed(docs, vocab, WORDS64, fixture_onnx(vocab), dtype="double")
    return long_vectors(res, "doc_id", "embedding")


def q_embed_onnx_v3(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    res = embed(docs, vocab, SUBWORD64, fixture_onnx(vocab, with_tasks=True), dtype="double", tasks=fixture_tasks(spark))
    return long_vectors(res, "doc_id", "embedding")


def q_masked_pool(spark: SparkSession, d: str) -> DataFrame:
    """O13 alone: mean of the vectors of in-vocabulary words only (markers and
    unknown words carry mask 0; a text of only unknown words pools to zeros)."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    ids = token_ids(docs, vocab, WORDS64)
    attention = (F.col("in_vocab") & (F.col("token_id") > 2)).cast("bigint")
    # A token's vector counts as often as the token does: counted first, one vector for each token of a text is moved.
    per = ids.groupBy("doc_id", "token_id").agg(F.sum(attention).alias("attention"))
    j = per.join(enc.vectors, F.col("token_id") == F.col("id"), "left")
    pooled = masked_mean_pool(j, FIXTURE_DIM, hidden_col="v")
    return long_vectors(pooled, "doc_id", "pooled", digits=None)


def q_preview(spark: SparkSession, d: str) -> DataFrame:
    """Shape and first 10 values of each document's embedding."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    res = embedding_preview(embed(docs, vocab, WORDS64, fixture_vectors(vocab, FIXTURE_DIM), dtype="double"))
    out = res.select("doc_id", F.col("shape").cast("bigint").alias("shape"), F.posexplode_outer("head").alias("dim", "x"))
    return out.where(F.col("dim").isNotNull()).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), "shape", F.round(F.col("x").cast("double"), 6).alias("x")
    )


def q_result_split(spark: SparkSession, d: str) -> DataFrame:
    """Results where words past id 1,500 have no vector, split into good and error rows."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    res = embed(docs, vocab, WORDS64, replace(enc, vectors=enc.vectors.where("id <= 1500")))
    good, bad = split_results(materialize(res, "results"))
    cols = ["doc_id", "dim", "n_tokens", "error"]
    return good.select(F.lit("good").alias("sink"), *cols).unionByName(bad.select(F.lit("error").alias("sink"), *cols)).select(
        "sink", "doc_id", F.col("dim").cast("bigint").alias("dim"), "n_tokens", "error"
    )


QUERIES = {
    "embed_static": q_embed_static,
    "embed_static_768": q_embed_static_768,
    "embed_static_1024_task": q_embed_static_1024_task,
    "embed_static_1024_blocks": q_embed_static_1024_blocks,
    "embed_onnx": q_embed_onnx,
    "embed_onnx_v3": q_embed_onnx_v3,
    "masked_pool": q_masked_pool,
    "preview": q_preview,
    "result_split": q_result_split,
}
