"""The corpus embedding job (O15) and its incremental form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.vectors import l2_normalize
from lumenvec.operators.encode import MAX_SHIPPED_BYTES, StaticEncoder, encode_blocks, encode_rows, vector_bytes, vocabulary_bytes
from lumenvec.profiles import Profile
from lumenvec.sources.vocab import Vocabulary

TIMINGS = ["inference_time", "setup_time", "call_seq", "call_time", "call_id"]
RESULT_COLUMNS = ["doc_id", "embedding", "dim", "n_tokens", *TIMINGS, "error"]


def finish(pooled: DataFrame, dtype: str = "float", unit: bool = False) -> DataFrame:
    """O14 + result row shape (O17): normalised embedding, or an error. ``unit``: the encoder has normalised."""
    emb = F.col("pooled") if unit else l2_normalize("pooled")
    if dtype == "float":
        emb = emb.cast("array<float>")
    return pooled.select(
        "doc_id",
        F.when(F.col("error").isNull(), emb).alias("embedding"),
        F.when(F.col("error").isNull(), F.size("pooled")).cast("int").alias("dim"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        *TIMINGS,
        "error",
        *[F.col(c).alias(c.removeprefix("keep_")) for c in pooled.columns if c.startswith("keep_")],
    )


def embed(
    texts: DataFrame,
    vocab: Vocabulary,
    profile: Profile,
    encoder,
    dtype: str = "float",
    text_col: str = "text",
    id_col: str = "doc_id",
    tasks: DataFrame | None = None,
    keep: list[str] | None = None,
    max_shipped: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """Texts -> RESULT_COLUMNS, one row for each input row.

    ``dtype`` is the element type of ``embedding`` ("float" like the reference, or
    "double"). Columns of ``texts`` named in ``keep`` come through. With a static
    encoder null texts, null and repeated ids and tasks have the same results
    (see ``lumenvec.operators.encode``) whether its tables can be sent to the
    executors (``max_shipped`` bytes) or not. A stream needs tables that can be
    sent; beyond the bound, embed its micro-batches (``streaming.stream.run_into_store``)."""
    if isinstance(encoder, StaticEncoder):
        words = vocabulary_bytes(vocab)
        if words + vector_bytes(encoder) <= max_shipped:
            return finish(encode_rows(texts, vocab, profile, encoder, text_col, id_col, tasks, keep, unit=True), dtype, unit=True)
        if texts.isStreaming:
            raise ValueError(f"the encoder's tables take more than {max_shipped} bytes: embed the stream's micro-batches instead")
        return finish(encode_blocks(texts, vocab, profile, encoder, text_col, id_col, tasks, keep, words <= max_shipped), dtype)
    from lumenvec.operators.onnx_batch import encode_onnx

    return finish(encode_onnx(texts, vocab, profile, encoder, text_col, id_col, tasks, keep), dtype)


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows) for two sinks."""
    return results.where(F.col("error").isNull()), results.where(F.col("error").isNotNull())
