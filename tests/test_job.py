"""The command-line job: files in, store out, incremental second run."""

import json

from pyspark.sql import functions as F

from lumenvec.jobs.embed import parse_args, run
from lumenvec.operators.store import read_store
from lumenvec.sources.model_fixture import gather_model, static_matrix
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary


def test_embed_job_from_files(spark, sf001, tmp_path):
    docs = table(spark, sf001, "documents").select("doc_id", "text")
    v = corpus_word_vocabulary(docs)
    words = {r.token: r.id for r in v.tokens.collect()}
    tok = {"model": {"type": "WordPiece", "vocab": {**words, "[CLS]": 1, "[SEP]": 2}},
           "added_tokens": [{"id": 1, "content": "[CLS]", "special": True}, {"id": 2, "content": "[SEP]", "special": True}]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(tok))
    (tmp_path / "model.onnx").write_bytes(gather_model(static_matrix(max(words.values()) + 1, 16)))
    store = str(tmp_path / "store")
    base = ["--texts", f"{sf001}/documents.parquet", "--tokenizer", str(tmp_path / "tokenizer.json"),
            "--model", str(tmp_path / "model.onnx"), "--dim", "16", "--store", store]
    # Every text goes through the encoder once, though good and error rows are split.
    from lumenvec.operators import onnx_batch

    seen = spark.sparkContext.accumulator(0)
    whole = onnx_batch._runner

    def counting(*args):
        inner = whole(*args)

        def run_batches(batches):
            for pdf in inner(batches):
                seen.add(len(pdf))
                yield pdf

        return run_batches

    onnx_batch._runner = counting
    try:
        n = run(spark, parse_args(base))
    finally:
        onnx_batch._runner = whole
    assert n == docs.count() == seen.value
    rows = read_store(spark, store)
    assert rows.where(F.size("embedding") != 16).count() == 0
    assert run(spark, parse_args(base + ["--incremental"])) == 0
