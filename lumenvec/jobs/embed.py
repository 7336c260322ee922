"""Embed a text table with a tokenizer.json, config.json and model.onnx.

    python -m lumenvec.jobs.embed --texts docs.parquet --tokenizer tokenizer.json \\
        --config config.json --model model.onnx --profile words768 --store out/

Reads the texts (Parquet), loads vocabulary, special tokens and task list
from the JSON files (O1-O3), encodes with the ONNX model (O12b) and appends
the results to the embedding store (O23); with ``--incremental`` only texts
the store lacks are encoded (O22). Failed rows go to ``<store>_errors``.
Paths must be readable by every executor (shared storage).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.onnx_batch import OnnxEncoder
from lumenvec.operators.store import append, as_store_rows, embed_incremental, text_hash
from lumenvec.plans.pipeline import embed
from lumenvec.profiles import SUBWORD1024, WORDS768
from lumenvec.sources.vocab import load_tasks, load_vocabulary

PROFILES = {p.name: p for p in (WORDS768, SUBWORD1024)}


def parse_args(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--texts", required=True, help="Parquet table with id and text columns")
    ap.add_argument("--id-col", default="doc_id")
    ap.add_argument("--text-col", default="text")
    ap.add_argument("--tokenizer", required=True, help="tokenizer.json")
    ap.add_argument("--config", help="config.json with lora_adaptations (needed by task models)")
    ap.add_argument("--model", required=True, help="model.onnx")
    ap.add_argument("--profile", default="words768", choices=sorted(PROFILES))
    ap.add_argument("--dim", type=int, help="override the profile's output size")
    ap.add_argument("--task", help="task name for task models (default: the profile's)")
    ap.add_argument("--store", required=True, help="Parquet store folder")
    ap.add_argument("--incremental", action="store_true", help="skip texts already in the store")
    ap.add_argument("--max-batch-tokens", type=int, default=32768)
    return ap.parse_args(argv)


def run(spark: SparkSession, args) -> int:
    """Returns the number of rows written to the store."""
    profile = PROFILES[args.profile]
    if args.dim:
        profile = profile.with_(dim=args.dim)
    if args.task:
        profile = profile.with_(task=args.task)
    vocab = load_vocabulary(spark, args.tokenizer)
    tasks = load_tasks(spark, args.config) if args.config else None
    enc = OnnxEncoder(model_path=args.model, dim=profile.dim, max_batch_tokens=args.max_batch_tokens)
    texts = spark.read.parquet(args.texts).select(
        F.col(args.id_col).cast("bigint").alias("doc_id"), F.col(args.text_col).alias("text")
    )

    def encode(df):
        return embed(df, vocab, profile, enc, tasks=tasks, keep=["text_hash"])

    if args.incremental:
        return embed_incremental(spark, texts, args.store, encode, profile.name, profile.task)
    # The hash goes along with the text; the model runs once, the split reads what it wrote.
    hashed = texts.withColumn("text_hash", text_hash())
    return append(as_store_rows(encode(hashed), profile.name, profile.task), args.store)


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName("lumenvec-embed").getOrCreate()
    n = run(spark, args)
    print(f"store rows for {args.profile}: {n}")


if __name__ == "__main__":
    main()
