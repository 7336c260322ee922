"""Queries of the store, incremental runs and streams."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.store import (
    append,
    as_store_rows,
    compact,
    documents_view,
    embed_incremental,
    pending,
    read_errors,
    read_store,
    store_table,
    text_hash,
)
from lumenvec.plans.pipeline import embed
from lumenvec.plans.queries.fixtures import FIXTURE_DIM, WORDS64, documents, fixture_onnx
from lumenvec.plans.strategy import materialize
from lumenvec.session import work_dir
from lumenvec.sources.vocab import corpus_word_vocabulary
from lumenvec.sources.requests import parse_requests
from lumenvec.streaming.stream import (
    embed_stream,
    errors_table,
    query_id,
    request_stream,
    results_table,
    run_available,
    run_into_store,
    write_batch,
)


def q_anti_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Texts still to encode after a run over the English documents: the
    previous results are the store, new work is every distinct text whose
    hash is not in it."""
    docs = documents(spark, d, "lang")
    vocab = corpus_word_vocabulary(docs)
    en = docs.where(F.col("lang") == "en")
    hashed = en.select("doc_id", "text", text_hash().alias("text_hash"))
    prev = embed(hashed, vocab, WORDS64, fixture_vectors(vocab, FIXTURE_DIM), keep=["text_hash"])
    store = as_store_rows(prev, WORDS64.name, None)
    return pending(docs.select("doc_id", "text"), store, WORDS64.name).select("text_hash", "n_docs", "first_doc_id")


def q_incremental_runs(spark: SparkSession, d: str) -> DataFrame:
    """O22 in full: a run over the English texts, one over all, and one again:
    rows each run stores, and the documents that have an embedding after it."""
    docs = documents(spark, d, "lang")
    vocab = corpus_word_vocabulary(docs)
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    path = work_dir(spark, f"store-{uuid.uuid4().hex}")

    def encode(df: DataFrame) -> DataFrame:
        return embed(df, vocab, WORDS64, enc, keep=["text_hash"])

    runs = []
    for k, texts in enumerate((docs.where(F.col("lang") == "en"), docs, docs)):
        added = embed_incremental(spark, texts.select("doc_id", "text"), path, encode, WORDS64.name)
        view = documents_view(docs, read_store(spark, path), WORDS64.name)
        embedded = view.where(F.col("embedding").isNotNull()).agg(F.count(F.lit(1)).alias("embedded"))
        runs.append(embedded.select(F.lit(k + 1).cast("bigint").alias("run"), F.lit(added).cast("bigint").alias("added"), "embedded"))
        runs[-1] = materialize(runs[-1], "runs")
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def q_store_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two runs appended to a Parquet store: run r1 embeds all documents with
    the static encoder, run r2 the English ones again with the ONNX encoder;
    the latest row per text wins. (doc_id, run_id, dim, x)."""
    docs = documents(spark, d, "lang")
    vocab = corpus_word_vocabulary(docs)
    path = work_dir(spark, f"store-{uuid.uuid4().hex}")

    def run(texts, encoder, run_id):
        once = texts.select("doc_id", "text", text_hash().alias("text_hash")).dropDuplicates(["text_hash"])
        res = embed(once, vocab, WORDS64, encoder, dtype="double", keep=["text_hash"])
        return as_store_rows(res, WORDS64.name, None, run_id)

    append(run(docs, fixture_vectors(vocab, FIXTURE_DIM), "r1"), path)
    append(run(docs.where(F.col("lang") == "en"), fixture_onnx(vocab), "r2"), path)
    view = documents_view(docs, read_store(spark, path, WORDS64.name), WORDS64.name)
    out = view.select("doc_id", "run_id", F.posexplode_outer("embedding").alias("dim", "x")).where(F.col("dim").isNotNull())
    return out.select("doc_id", "run_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


def q_stream_embed(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as request files, three texts to a batch request,
    embedded by a streaming query (one file per micro-batch) with the
    row-local static encoder, read back from the sink."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    root = work_dir(spark, f"stream-{uuid.uuid4().hex}")
    of = docs.groupBy(F.floor(F.col("doc_id") / 3).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    lines = of.select(F.to_json(F.struct("id", F.transform("t", lambda x: x["text"]).alias("inputs"))).alias("value"))
    lines.repartition(4).write.text(f"{root}/in")
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    res = embed_stream(request_stream(spark, f"{root}/in", 1), vocab, WORDS64, enc, dtype="double")
    run_available(res, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out").select("request_id", "idx", F.posexplode_outer("embedding").alias("dim", "x"))
    return out.where(F.col("dim").isNotNull()).select(
        "request_id", F.col("idx").cast("bigint").alias("idx"), F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x")
    )


def q_store_compact(spark: SparkSession, d: str) -> DataFrame:
    """A store after a run of errors only, a run over the English documents, one over all and one
    that is tried again; then compacted: (doc_id, dim, n_tokens, checksum, runs, stored, errors)."""
    docs = documents(spark, d, "lang")
    vocab = corpus_word_vocabulary(docs)
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    path = work_dir(spark, f"store-{uuid.uuid4().hex}")
    none = replace(enc, vectors=enc.vectors.where("id < 0"))

    def run(texts: DataFrame, encoder, run_id: str) -> int:
        once = texts.select("doc_id", "text", text_hash().alias("text_hash")).dropDuplicates(["text_hash"])
        res = embed(once, vocab, WORDS64, encoder, dtype="double", keep=["text_hash"])
        return append(as_store_rows(res, WORDS64.name, None, run_id), path)

    en = docs.where(F.col("lang") == "en")
    for texts, encoder, run_id in ((en, none, "r0"), (en, enc, "r1"), (docs, enc, "r2"), (en, none, "r2")):
        run(texts, encoder, run_id)
    before = len(store_table(spark, path).runs())
    stored = compact(spark, path)
    n_errors = read_errors(spark, path).count()
    view = documents_view(docs, read_store(spark, path), WORDS64.name)
    weighed = F.transform("embedding", lambda x, i: x * (i + 1))
    return view.select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), "n_tokens",
        F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"),
        F.lit(before).cast("bigint").alias("runs"), F.lit(stored).cast("bigint").alias("stored"), F.lit(n_errors).cast("bigint").alias("errors"),
    )


def q_stream_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents as batch requests of three texts, every seventh a command that is not
    served, through a streaming query whose micro-batches write results and errors as
    runs; words past id 1,500 have no vector, so many texts are errors. The first
    batch is then given to the sink once more, as after a failure."""
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    enc = fixture_vectors(vocab, FIXTURE_DIM)
    enc = replace(enc, vectors=enc.vectors.where("id <= 1500"))
    root = work_dir(spark, f"stream-{uuid.uuid4().hex}")
    of = docs.groupBy(F.floor(F.col("doc_id") / 3).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    asked = F.to_json(F.struct("id", F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("inputs")))
    line = F.when(F.col("id") % 7 == 0, F.to_json(F.struct("id", F.lit("ping").alias("command")))).otherwise(asked)
    of.select(line.alias("value")).repartition(2).write.text(f"{root}/in")
    run_into_store(request_stream(spark, f"{root}/in", 1), vocab, WORDS64, enc, f"{root}/out", f"{root}/checkpoint", dtype="double")
    first = f"{query_id(spark, f'{root}/checkpoint')}-0"
    again = parse_requests(spark.read.text(f"{root}/in"))
    write_batch(again, first, vocab, WORDS64, enc, f"{root}/out", dtype="double")
    weighed = F.transform("embedding", lambda x, i: x * (i + 1))
    checksum = F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 6)
    cols = ["request_id", F.col("idx").cast("bigint").alias("idx")]
    good = results_table(spark, f"{root}/out").read().select(
        F.lit("result").alias("sink"), *cols, "n_tokens", checksum.alias("checksum"), F.lit(None).cast("string").alias("error"))
    bad = errors_table(spark, f"{root}/out").read().select(
        F.lit("error").alias("sink"), *cols, F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("double").alias("checksum"), "error")
    return good.unionByName(bad)


QUERIES = {
    "anti_incremental": q_anti_incremental,
    "incremental_runs": q_incremental_runs,
    "store_latest": q_store_latest,
    "store_compact": q_store_compact,
    "stream_embed": q_stream_embed,
    "stream_store": q_stream_store,
}
