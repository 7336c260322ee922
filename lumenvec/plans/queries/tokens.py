"""Queries of vocabularies, tokens and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.operators.subword import segment_table
from lumenvec.operators.tokens import decode_rows, explode_tokens, id_rows, raw_tokens, task_ids, token_ids
from lumenvec.plans.queries.fixtures import SUBWORD64, WORDS64, documents
from lumenvec.plans.strategy import spread
from lumenvec.sources.requests import parse_requests
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import (
    corpus_piece_vocabulary,
    corpus_word_vocabulary,
    tasks_from_json,
    tokenizer_document,
    tokenizer_document_array,
    vocabulary_from_json,
)

LETTERS_ONLY = r"^\p{L}+$"


def q_v2_tokens(spark: SparkSession, d: str) -> DataFrame:
    nested = raw_tokens(documents(spark, d), WORDS64)
    return explode_tokens(nested).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def q_v2_token_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    ids = token_ids(docs, vocab, WORDS64)
    return ids.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token", "token_id", "in_vocab")


def q_v3_pretokens(spark: SparkSession, d: str) -> DataFrame:
    nested = raw_tokens(documents(spark, d), SUBWORD64)
    return explode_tokens(nested).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def q_v3_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    pts = explode_tokens(raw_tokens(docs, SUBWORD64)).select("token").distinct()
    seg = segment_table(pts, vocab, SUBWORD64)
    out = seg.select("token", F.posexplode_outer("pieces").alias("sub", "piece")).where(F.col("sub").isNotNull())
    return out.select("token", F.col("sub").cast("bigint").alias("sub"), "piece")


def q_v3_token_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    ids = token_ids(docs, vocab, SUBWORD64)
    return ids.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("sub").cast("bigint").alias("sub"),
        "token", "token_id", "in_vocab",
    )


def q_v3_token_ids_max(spark: SparkSession, d: str) -> DataFrame:
    """At most 16 tokens a document, markers included."""
    docs = documents(spark, d)
    ids = token_ids(docs, corpus_piece_vocabulary(docs), SUBWORD64.with_(max_tokens=16))
    return ids.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("sub").cast("bigint").alias("sub"), "token", "token_id", "in_vocab"
    )


def q_decode_v3(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_piece_vocabulary(docs)
    return decode_rows(id_rows(docs, vocab, SUBWORD64), vocab, SUBWORD64)


def q_decode_v2(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    vocab = corpus_word_vocabulary(docs)
    return decode_rows(id_rows(docs, vocab, WORDS64), vocab, WORDS64)


def q_vocab_object(spark: SparkSession, d: str) -> DataFrame:
    """Object-shape tokenizer.json written from the corpus vocabulary: words
    of letters only carry ``id + 0.5`` (truncated back to ``id`` on load);
    other words carry their id as a JSON string and are skipped on load."""
    vocab = corpus_word_vocabulary(documents(spark, d))
    value = F.when(
        F.col("token").rlike(LETTERS_ONLY), F.parse_json(F.concat(F.col("id").cast("string"), F.lit(".5")))
    ).otherwise(F.parse_json(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('"'))))
    doc = tokenizer_document(vocab.tokens, vocab.specials, value)
    loaded = vocabulary_from_json(doc)
    return loaded.tokens.select("token", "id")


def q_vocab_array(spark: SparkSession, d: str) -> DataFrame:
    """Array-shape tokenizer.json: position = rank - 1; words with a
    non-letter become one-item entries, which are skipped on load but keep
    their position."""
    vocab = corpus_word_vocabulary(documents(spark, d))
    item = F.when(
        F.col("token").rlike(LETTERS_ONLY),
        F.parse_json(F.to_json(F.array(F.col("token"), (F.col("id") * -0.5).cast("string")))),
    ).otherwise(F.parse_json(F.to_json(F.array(F.col("token")))))
    entries = vocab.tokens.select((F.col("id") - 3).alias("pos"), item.alias("item"))
    loaded = vocabulary_from_json(tokenizer_document_array(entries, vocab.specials))
    return loaded.tokens.select("token", "id")


def q_special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The languages of the corpus as added tokens, numbered in order; every
    second one is listed again with 100 more, and the last entry counts."""
    langs = table(spark, d, "documents").select("lang").where(F.col("lang").isNotNull()).distinct()
    w = Window.orderBy("lang")  # one row a language
    once = langs.select(F.concat(F.lit("<"), "lang", F.lit(">")).alias("content"), F.row_number().over(w).cast("bigint").alias("id"))
    twice = once.unionByName(once.where(F.col("id") % 2 == 0).withColumn("id", F.col("id") + 100))
    vocab = spark.createDataFrame([("a", 0)], "token string, id bigint")
    return vocabulary_from_json(tokenizer_document(vocab, twice)).specials.select("content", "id")


def q_task_ids(spark: SparkSession, d: str) -> DataFrame:
    """Task list = the two most frequent conversation roles (count desc, role
    asc); each turn's role is looked up strictly (v3) and leniently (v2)."""
    conv = spread(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id")
    top = conv.groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("role")).limit(2)
    cfg = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "role"))).alias("l")).select(
        F.to_json(F.struct(F.transform("l", lambda x: x["role"]).alias("lora_adaptations"))).alias("value")
    )
    tasks = tasks_from_json(cfg)
    strict = task_ids(conv, tasks, SUBWORD64, "role")
    lenient = task_ids(conv, tasks, WORDS64, "role").select(
        "conv_id", "turn", F.col("task_id").alias("task_id_lenient")
    )
    return strict.select("conv_id", "turn", "role", "task_id", "task_error").join(lenient, ["conv_id", "turn"])


def q_read_requests(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as request lines: user turns as single requests, a
    conversation's assistant turns as one batch request, system turns as a
    command the job does not serve; of every fifth conversation the first
    turn's line is cut short, of every seventh its text is a number. Lines
    that are no JSON have no id (here -1; it is a hash of the line)."""
    conv = spread(table(spark, d, "conversations"), "conv_id")
    cid = F.col("conv_id")
    first = F.col("turn") == 0
    infer = F.lit("infer").alias("command")
    line = (
        F.when(first & (cid % 5 == 0), F.lit('{"command": "infer", "text": "x"'))
        .when(first & (cid % 7 == 0), F.to_json(F.struct(cid.alias("id"), infer, F.col("turn").alias("text"))))
        .when(F.col("role") == "user", F.to_json(F.struct(cid.alias("id"), infer, F.col("text").alias("text"))))
        .otherwise(F.to_json(F.struct(cid.alias("id"), F.lit("ping").alias("command"))))
    )
    odd = first & ((cid % 5 == 0) | (cid % 7 == 0))
    own = conv.where(odd | (F.col("role") != "assistant") | F.col("role").isNull()).select(line.alias("value"))
    turns = conv.where(~odd & (F.col("role") == "assistant")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")
    )
    batches = turns.select(F.to_json(F.struct(cid.alias("id"), F.transform("t", lambda x: x["text"]).alias("inputs"))).alias("value"))
    rows = parse_requests(own.unionByName(batches))
    rid = F.when(F.col("error") == "invalid JSON", F.lit(-1)).otherwise(F.col("request_id"))
    return rows.select(rid.cast("bigint").alias("request_id"), F.col("idx").cast("bigint").alias("idx"), "text", "error")


QUERIES = {
    "v2_tokens": q_v2_tokens,
    "v2_token_ids": q_v2_token_ids,
    "v3_pretokens": q_v3_pretokens,
    "v3_segments": q_v3_segments,
    "v3_token_ids": q_v3_token_ids,
    "v3_token_ids_max": q_v3_token_ids_max,
    "decode_v3": q_decode_v3,
    "decode_v2": q_decode_v2,
    "vocab_object": q_vocab_object,
    "vocab_array": q_vocab_array,
    "special_tokens": q_special_tokens,
    "task_ids": q_task_ids,
    "read_requests": q_read_requests,
}
