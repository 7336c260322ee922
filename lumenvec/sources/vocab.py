"""Vocabulary, special tokens and task lists as tables (O1, O2, O3).

A tokenizer document is one JSON value; it is parsed with ``parse_json`` and
its ``model.vocab`` is exploded into rows, so only the parse of the single
document is serial. The document size is a model property (a 250k-piece
vocabulary is a few MB), not something that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.functions.text import v2_words
from lumenvec.operators.pretokens import letters_and_digits, prefixed, pretokens, trimmed

NUMERIC_VARIANT = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


@dataclass(frozen=True)
class Vocabulary:
    tokens: DataFrame  # (token STRING, id BIGINT): one id per token
    reverse: DataFrame  # (id BIGINT, token STRING): one token per id
    specials: DataFrame  # (content STRING, id BIGINT): added tokens
    row_bound: int | None = None  # proven upper bound on rows of tokens/reverse, if known


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, column ``value`` holding the whole JSON text."""
    return spark.read.text(path, wholetext=True)


def _variant(doc: DataFrame, col: str) -> DataFrame:
    return doc.select(F.parse_json(F.col(col)).alias("doc"))


def vocabulary_from_json(doc: DataFrame, col: str = "value") -> Vocabulary:
    """Parse ``model.vocab`` in either shape plus ``added_tokens``.

    Object shape ``{"tok": id}``: keep numeric ids, truncated toward zero.
    Array shape ``[[tok, score], ...]``: id is the position; entries that are
    not arrays of at least two items with a string first item are skipped but
    still use up their position; a repeated token keeps its last position.
    """
    parsed = _variant(doc, col).select(
        F.variant_get("doc", "$.model.vocab", "variant").alias("vocab"),
        F.try_variant_get("doc", "$.added_tokens", "array<variant>").alias("added"),
    )

    obj = parsed.select(
        F.explode(F.try_variant_get("vocab", "$", "map<string,variant>")).alias("token", "v")
    ).where(F.schema_of_variant("v").rlike(NUMERIC_VARIANT))
    obj = obj.select(
        "token",
        F.try_variant_get("v", "$", "double").try_cast("bigint").alias("id"),
        F.lit(None).cast("int").alias("pos"),
    ).where(F.col("id").isNotNull())

    arr = parsed.select(
        F.posexplode(F.try_variant_get("vocab", "$", "array<variant>")).alias("pos", "e")
    )
    arr = arr.where(
        (F.size(F.try_variant_get("e", "$", "array<variant>")) >= 2)
        & (F.schema_of_variant(F.variant_get("e", "$[0]", "variant")) == "STRING")
    ).select(
        F.variant_get("e", "$[0]", "string").alias("token"),
        F.col("pos").cast("bigint").alias("id"),
        F.col("pos"),
    )

    entries = obj.unionByName(arr)
    # Array shape: last position wins; object shape has unique keys already.
    tokens = entries.groupBy("token").agg(F.max_by("id", F.coalesce("pos", F.lit(0))).alias("id"))
    # Two tokens on one id (object shape): keep the greatest token.
    reverse = entries.groupBy("id").agg(F.max("token").alias("token"))

    specials = parsed.select(F.posexplode("added").alias("pos", "t")).select(
        "pos",
        F.variant_get("t", "$.content", "string").alias("content"),
        F.try_variant_get("t", "$.id", "double").try_cast("bigint").alias("id"),
    ).where(F.col("content").isNotNull())
    specials = specials.groupBy("content").agg(F.max_by("id", "pos").alias("id"))
    return Vocabulary(tokens=tokens, reverse=reverse, specials=specials)


def load_vocabulary(spark: SparkSession, tokenizer_path: str) -> Vocabulary:
    """O1 + O2: ``tokenizer.json`` -> vocabulary tables."""
    return vocabulary_from_json(read_json_documents(spark, tokenizer_path))


def tasks_from_json(doc: DataFrame, col: str = "value") -> DataFrame:
    """O3: ``lora_adaptations`` -> (task_id BIGINT, task STRING), id = position."""
    return _variant(doc, col).select(
        F.posexplode(F.variant_get("doc", "$.lora_adaptations", "array<string>")).alias("task_id", "task")
    ).select(F.col("task_id").cast("bigint"), "task")


def load_tasks(spark: SparkSession, config_path: str) -> DataFrame:
    return tasks_from_json(read_json_documents(spark, config_path))


def specials_table(spark: SparkSession, entries: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(entries, "content string, id bigint")


# ---------------------------------------------------------------------------
# Vocabularies derived from a corpus (the test fixtures of this project; a real
# job loads the model's tokenizer.json instead).


def _ranked(counts: DataFrame, size: int, first_id: int) -> DataFrame:
    # Top-k without a global sort: TakeOrderedAndProject keeps k per partition.
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("token"))  # over at most ``size`` rows
    return top.select("token", (F.row_number().over(w) + (first_id - 1)).cast("bigint").alias("id"))


def _materialize(df: DataFrame) -> DataFrame:
    """Compute a bounded derived table once into the shared checkpoint
    folder, so every later use (joins, decode, vector table) reads a few rows
    instead of recounting the corpus."""
    from lumenvec.plans.strategy import materialize

    return materialize(df, "vocabulary")


def token_totals(nested: DataFrame) -> DataFrame:
    """(tokens ARRAY<STRING>) -> (token, n): how often each token is there; or (tokens STRING), the trimmed
    texts, of which the pre-tokens are counted. Counted Arrow batch by Arrow batch in the tasks, then added
    up: what is exploded and shuffled is a row for each token of a batch."""
    from lumenvec.session import ship_package

    spark = nested.sparkSession
    ship_package(spark)
    texts = dict(nested.dtypes)["tokens"] == "string"
    letters = spark.sparkContext.broadcast(letters_and_digits(spark) if texts else None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from lumenvec.operators.batches import parts

        for b in batches:
            if texts:
                found = pa.chunked_array([pretokens(part.column(0))[1] for part in parts(b, 0)], pa.string()).value_counts()
                values = pa.array(prefixed(found.field("values").to_numpy(zero_copy_only=False).tolist(), letters.value), pa.string())
            else:
                found = b.column(0).flatten().value_counts()
                values = found.field("values")
            yield pa.RecordBatch.from_arrays([values, found.field("counts")], ["token", "n"])

    found = nested.select("tokens").mapInArrow(run, "token string, n long")
    return found.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))


def corpus_word_vocabulary(texts: DataFrame, size: int = 2000, text_col: str = "text") -> Vocabulary:
    """Words profile fixture: the ``size`` most frequent words (count desc,
    word asc), ids from 3; ``[CLS]`` = 1, ``[SEP]`` = 2, no unknown token."""
    # explode_outer: see operators.tokens.explode_tokens on inferred filters.
    words = texts.select(F.explode_outer(v2_words(text_col)).alias("token")).where(F.col("token").isNotNull())
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tokens = _materialize(_ranked(counts, size, 3))
    spark = texts.sparkSession
    specials = specials_table(spark, [("[CLS]", 1), ("[SEP]", 2)])
    reverse = tokens.select("id", "token").unionByName(specials.select("id", F.col("content").alias("token")))
    return Vocabulary(tokens=tokens, reverse=reverse, specials=specials, row_bound=size + 2)


# The XLM-R style special pieces and their ids.
SUBWORD_SPECIALS = [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3)]
SINGLE_PIECE_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def corpus_piece_vocabulary(texts: DataFrame, size: int = 1000, text_col: str = "text") -> Vocabulary:
    """Subword profile fixture: the ``size`` most frequent pre-tokens (count
    desc, piece asc) with ids from 4, then every ASCII letter and digit alone
    and with the word prefix, so unseen words split into pieces and accented
    letters become unknown."""
    spark = texts.sparkSession
    counts = token_totals(texts.select(trimmed(text_col).alias("tokens")))
    top = _materialize(_ranked(counts, size, 4))
    singles = spark.createDataFrame(
        [(c,) for c in SINGLE_PIECE_CHARS] + [("▁" + c,) for c in SINGLE_PIECE_CHARS], "token string"
    )
    extra = singles.join(top, "token", "left_anti")
    w = Window.orderBy("token")
    extra = extra.select("token", (F.row_number().over(w) + (size + 3)).cast("bigint").alias("id"))
    tokens = _materialize(top.unionByName(extra))
    specials = specials_table(spark, SUBWORD_SPECIALS)
    reverse = tokens.select("id", "token").unionByName(specials.select("id", F.col("content").alias("token")))
    bound = size + 2 * len(SINGLE_PIECE_CHARS) + len(SUBWORD_SPECIALS)
    return Vocabulary(tokens=tokens, reverse=reverse, specials=specials, row_bound=bound)


def tokenizer_document(tokens: DataFrame, specials: DataFrame, value: Column | None = None) -> DataFrame:
    """Write vocabulary tables back as one ``tokenizer.json`` text (object
    shape). ``value`` is the JSON value per entry (default: the id). The
    vocabulary is a model artifact; this gathers it into one row."""
    val = value if value is not None else F.parse_json(F.col("id").cast("string"))
    vocab = tokens.select(F.struct(F.col("token"), val.alias("v")).alias("e")).agg(
        F.map_from_entries(F.collect_list("e")).alias("vocab")
    )
    added = specials.agg(
        F.array_sort(F.collect_list(F.struct("id", "content", F.lit(True).alias("special")))).alias("added_tokens")
    )
    doc = vocab.join(added, how="left")  # both sides are one row
    return doc.select(F.to_json(F.struct(F.struct("vocab").alias("model"), "added_tokens")).alias("value"))


def tokenizer_document_array(entries: DataFrame, specials: DataFrame) -> DataFrame:
    """Array shape: ``entries`` (pos, item VARIANT) -> ``{"model":{"vocab":[...]}}``."""
    by_pos = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    vocab = entries.agg(F.array_sort(F.collect_list(F.struct("pos", "item")), by_pos).alias("l")).select(
        F.transform("l", lambda x: x["item"]).alias("vocab")
    )
    added = specials.agg(
        F.array_sort(F.collect_list(F.struct("id", "content", F.lit(True).alias("special")))).alias("added_tokens")
    )
    doc = vocab.join(added, how="left")
    return doc.select(F.to_json(F.struct(F.struct("vocab").alias("model"), "added_tokens")).alias("value"))
