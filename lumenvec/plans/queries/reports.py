"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.reports import latency_report, parity, parity_summary, top_unknown, top_unknown_summarised, unknown_token_report, vocabulary_report
from lumenvec.operators.tokens import token_ids
from lumenvec.plans.pipeline import TIMINGS, embed
from lumenvec.plans.queries.fixtures import FIXTURE_DIM, SUBWORD64, TOP_K, WORDS64, documents, fixture_onnx
from lumenvec.plans.strategy import materialize
from lumenvec.profiles import WORDS768
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_piece_vocabulary, corpus_word_vocabulary


def _parity_rows(spark: SparkSession, d: str, without: tuple[str | None, str | None] = ("fr", "de")) -> DataFrame:
    """``without``: the language that each side leaves out, if any."""
    docs = documents(spark, d, "lang")
    vocab = corpus_word_vocabulary(docs)
    lang = F.coalesce(F.col("lang"), F.lit(""))
    left, right = ((docs.where(lang != x) if x else docs).select("doc_id", "text") for x in without)
    static = embed(left, vocab, WORDS64, fixture_vectors(vocab, FIXTURE_DIM), dtype="double")
    onnx = embed(right, vocab, WORDS64, fixture_onnx(vocab), dtype="float")
    return parity(static, onnx)


def q_parity(spark: SparkSession, d: str) -> DataFrame:
    """Static encoder (double, all but French) against the ONNX encoder (float32
    output, all but German)."""
    return _parity_rows(spark, d)


def q_parity_summary(spark: SparkSession, d: str) -> DataFrame:
    return parity_summary(_parity_rows(spark, d))


def q_parity_whole(spark: SparkSession, d: str) -> DataFrame:
    """Both encoders over every document."""
    return _parity_rows(spark, d, (None, None))


def q_parity_summary_whole(spark: SparkSession, d: str) -> DataFrame:
    return parity_summary(_parity_rows(spark, d, (None, None)))


def _texts_and_vocabulary(spark: SparkSession, d: str, profile):
    docs = documents(spark, d, "lang", "source")
    return docs, corpus_word_vocabulary(docs) if profile is WORDS64 else corpus_piece_vocabulary(docs)


def q_oov_report(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_report(*_texts_and_vocabulary(spark, d, WORDS64), WORDS64, ["lang"])


def q_oov_report_source(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_report(*_texts_and_vocabulary(spark, d, WORDS64), WORDS64, ["lang", "source"])


def q_oov_top(spark: SparkSession, d: str) -> DataFrame:
    return top_unknown(*_texts_and_vocabulary(spark, d, WORDS64), WORDS64, ["lang"], n=TOP_K)


def q_oov_top_summarised(spark: SparkSession, d: str) -> DataFrame:
    """The same by summaries and an exact second count of what they leave."""
    return top_unknown_summarised(*_texts_and_vocabulary(spark, d, WORDS64), WORDS64, ["lang"], n=TOP_K)


def q_oov_report_v3(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_report(*_texts_and_vocabulary(spark, d, SUBWORD64), SUBWORD64, ["lang"])


def q_oov_report_v3_source(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_report(*_texts_and_vocabulary(spark, d, SUBWORD64), SUBWORD64, ["source"])


def q_oov_top_v3(spark: SparkSession, d: str) -> DataFrame:
    """The characters that no piece covers."""
    return top_unknown(*_texts_and_vocabulary(spark, d, SUBWORD64), SUBWORD64, ["lang"], n=TOP_K)


def q_oov_ids(spark: SparkSession, d: str) -> DataFrame:
    """The report over long-form ids that carry the texts' own ``source`` along."""
    docs, vocab = _texts_and_vocabulary(spark, d, SUBWORD64)
    return unknown_token_report(token_ids(docs, vocab, SUBWORD64, keep=["source"]), ["source"])


def q_latency_job(spark: SparkSession, d: str) -> DataFrame:
    """The report over timings that two embedding jobs of this run took, with exact
    quantiles and from sketches; the times differ from run to run, so the result tells
    the rows and what has to hold for any times."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    runs = None
    for profile in (WORDS64, WORDS768):
        res = embed(docs, vocab, profile, fixture_vectors(vocab, profile.dim)).select(F.lit(profile.name).alias("runtime"), *TIMINGS)
        runs = res if runs is None else runs.unionByName(res)
    runs = materialize(runs, "timings")
    exact, sketched = latency_report(runs), latency_report(runs, sketch=True).select("runtime", F.col("p50").alias("s50"), F.col("calls").alias("s_calls"))
    near = runs.groupBy("runtime").agg(
        F.percentile("inference_time", F.lit(0.45)).alias("p45"), F.percentile("inference_time", F.lit(0.55)).alias("p55"),
        F.countDistinct("call_id").alias("n_calls"), F.count("setup_time").alias("n_setups"), F.max("inference_time").alias("most"),
    )
    j = exact.join(sketched, "runtime").join(near, "runtime")
    return j.select(
        "runtime", "rows",
        ((F.col("calls") == F.col("n_calls")) & (F.col("calls") == F.col("s_calls")) & (F.col("n_setups") <= F.col("calls"))).alias("calls_ok"),
        ((F.col("p50") <= F.col("p95") + 1e-6) & (F.col("p95") <= F.col("most") + 1e-6) & (F.col("first_call") > 0)).alias("quantiles_ok"),
        F.col("s50").between(F.col("p45"), F.col("p55")).alias("sketch_ok"),
        (F.abs(F.col("rows_per_sec") * F.col("mean") - 1) < 0.5).alias("rate_ok"),
    )


def q_latency_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over a table of timings made from the documents by a fixed
    rule: languages as runtimes, 16 texts a call, 2**-16 s a character."""
    docs = table(spark, d, "documents")
    res = docs.select(
        F.coalesce("lang", F.lit("none")).alias("runtime"), F.col("doc_id").alias("call_time"),
        F.floor(F.col("doc_id") / 16).alias("call_id"), (F.col("n_chars") / F.lit(65536.0)).alias("inference_time"),
        F.when(F.col("doc_id") % 100 == 0, F.lit(0.5)).alias("setup_time"),
    )
    return latency_report(res)


QUERIES = {
    "parity": q_parity,
    "parity_summary": q_parity_summary,
    "parity_whole": q_parity_whole,
    "parity_summary_whole": q_parity_summary_whole,
    "oov_report": q_oov_report,
    "oov_report_source": q_oov_report_source,
    "oov_report_v3_source": q_oov_report_v3_source,
    "oov_ids": q_oov_ids,
    "oov_top": q_oov_top,
    "oov_top_summarised": q_oov_top_summarised,
    "oov_report_v3": q_oov_report_v3,
    "oov_top_v3": q_oov_top_v3,
    "latency_report": q_latency_report,
    "latency_job": q_latency_job,
}
