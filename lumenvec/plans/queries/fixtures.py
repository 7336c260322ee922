"""Profiles, vocabularies and encoders that the registered queries share.

No model or tokenizer file ships with this project: vocabularies come from the
tables by fixed rules, vectors from a formula.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.onnx_batch import OnnxEncoder
from lumenvec.plans.pipeline import embed
from lumenvec.plans.strategy import spread
from lumenvec.profiles import SUBWORD1024, WORDS768
from lumenvec.sources.model_fixture import gather_model, static_matrix
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary, tasks_from_json

FIXTURE_DIM = 64
WORDS64 = WORDS768.with_(name="words64", dim=FIXTURE_DIM)
SUBWORD64 = SUBWORD1024.with_(name="subword64", dim=FIXTURE_DIM)
TOP_K = 5

# The task list of the v3 model's config.json.
V3_TASKS = ["retrieval.query", "retrieval.passage", "separation", "classification", "text-matching"]


def documents(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """All documents, spread over the cores when the file is small."""
    return spread(table(spark, d, "documents").select("doc_id", "text", *cols), "doc_id")


def long_vectors(df: DataFrame, id_col: str, vec_col: str, idx: str = "dim", val: str = "x", digits: int | None = 6) -> DataFrame:
    """Array column -> (id, dim BIGINT, x DOUBLE), rounded to ``digits`` places.

    Values computed exactly in both engines (dyadic sums and one division)
    are left unrounded: rounding exact ties differs between engines.
    """
    x = F.col(val).cast("double")
    # explode_outer + filter: a plain explode would make Catalyst evaluate
    # the vector expression twice (inferred size filter).
    out = df.select(id_col, F.posexplode_outer(vec_col).alias(idx, val)).where(F.col(idx).isNotNull())
    return out.select(id_col, F.col(idx).cast("bigint").alias(idx), (F.round(x, digits) if digits is not None else x).alias(val))


def fixture_tasks(spark: SparkSession) -> DataFrame:
    cfg = spark.createDataFrame([(json.dumps({"lora_adaptations": V3_TASKS}),)], "value string")
    return tasks_from_json(cfg)


def fixture_onnx(vocab, dim: int = FIXTURE_DIM, with_tasks: bool = False) -> OnnxEncoder:
    """Gather model over the fixture vectors of every vocabulary id; the v3
    form adds ``(task_id + 1) / 8`` to every dimension."""
    import numpy as np

    n_ids = int(vocab.reverse.agg(F.max("id")).first()[0]) + 1  # one scalar of a bounded table
    mat = static_matrix(n_ids, dim)
    if not with_tasks:
        return OnnxEncoder(model_bytes=gather_model(mat), dim=dim)
    tm = np.repeat(((np.arange(len(V3_TASKS)) + 1) / 8.0)[:, None], dim, axis=1)
    model = gather_model(mat, ("input_ids", "attention_mask", "task_id"), "text_embeds", task_matrix=tm)
    return OnnxEncoder(model_bytes=model, dim=dim)


def static_embeddings(spark: SparkSession, d: str, texts: DataFrame | None = None, vocab=None, dtype="double"):
    docs = documents(spark, d)
    vocab = vocab or corpus_word_vocabulary(docs)
    return embed(texts if texts is not None else docs, vocab, WORDS64, fixture_vectors(vocab, FIXTURE_DIM), dtype=dtype)
