"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm import (
    conversation_trie,
    hard_negatives,
    line_dedup,
    mixing,
    packing,
    personal_data,
    quality_rules,
    simhash,
    spotsigs,
    substring,
    token_counts,
    token_files,
    toxicity,
)
from lumenvec.llm.encoding import tokenizer_path
from lumenvec.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of every document, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and the shards its copies go to."""
    shards = F.array_join(F.transform("copies", lambda x: x["shard"].cast("string")), ",").alias("shards")
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shards)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and what is left of its text."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    return spotsigs.compared(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.counted(docs, tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the written files give it back."""
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    g = simhash.grouped(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, the label set apart by a checksum of doc_id."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts and the verdict of the quality rules for every document."""
    q = quality_rules.judge(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost", "base_failed", "kept")
    return q.select("doc_id", *[f"quality.{n}" for n in names])


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations."""
    own = conversation_trie.sequences(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.rebuilt(own)).drop("digest")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, some labels moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.rows_of(table(spark, sf_dir, "embeddings"), label=moved)
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    spans = personal_data.found(docs, personal_data.train(docs))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    digest = F.sha2(personal_data.listed(base), 256).alias("base_sha256")
    return spans.select("doc_id", *counts, digest, personal_data.listed(F.col("spans")).alias("spans"), added)
