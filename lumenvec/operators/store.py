"""Embedding store (O23) and incremental runs.

The store is a table of runs (``sources/runs.py``) bucketed by ``text_hash``: rows
keyed by ``(text_hash, profile, task)`` with a ``run_ts``. Error rows go beside it,
into ``<store>_errors``, so a failed run never hides a good embedding. Both are
there for a run once its manifest says so, and a run that is there is not
written again. The latest row per key, and the texts still to encode, are found
bucket by bucket, without shuffling the store. An incremental run anti-joins its
texts against the store, encodes each distinct new text once and writes the
result once before it is split.

Beside the store lies its skip list, a Bloom filter for each run in
``<store>_filter``: the words of a bit array of fixed size, made by one aggregate
and merged by or. Texts it doesn't know are new for sure; of the others only the
digests are compared with the store, so a text that is there is never shuffled. A
run's filter is committed before its rows, so the filter never lacks a row.

Defined results: a store without runs reads as no rows; a null text counts as an
empty one; a null task is a task of its own; repeated texts are encoded once; a run
of error rows only leaves the store as it was; a run without rows is not
committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.sources.runs import RunTable

STORE_COLUMNS = ["text_hash", "profile", "task", "run_id", "run_ts", "embedding", "dim", "n_tokens", "error"]
KEY = ["text_hash", "profile", "task"]
# The skip list: 16 MB of bits for any store. Under 1 % false hits up to about 14 million texts,
# more beyond; they cost time, no result.
FILTER_BITS = 1 << 27
FILTER_HASHES = 4


def text_hash(col: str = "text"):
    return F.sha2(F.coalesce(F.col(col), F.lit("")), 256)


def store_table(spark: SparkSession, path: str, element: str = "float") -> RunTable:
    """The store's rows; ``element``: the type of a new store's embedding values."""
    columns = f"text_hash string, profile string, task string, run_ts timestamp, embedding array<{element}>, dim int, n_tokens bigint, error string"
    return RunTable(spark, path, columns, "text_hash")


def errors_table(spark: SparkSession, path: str, element: str = "float") -> RunTable:
    return store_table(spark, path.rstrip("/") + "_errors", element)


def read_store(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    df = store_table(spark, path).read().select(*STORE_COLUMNS)
    return df if profile is None else df.where(F.col("profile") == profile)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return errors_table(spark, path).read().select(*STORE_COLUMNS)


def latest(store: DataFrame) -> DataFrame:
    """One row per (text_hash, profile, task): error-free rows first, then the
    latest run. Of several equal ones in a run, one stays. One aggregate; over a
    stored table it needs no shuffle."""
    rest = [c for c in store.columns if c not in KEY]
    rank = F.struct(F.col("error").isNull().cast("int"), "run_ts", "run_id")
    best = store.groupBy(*KEY).agg(F.max_by(F.struct(*rest), rank).alias("x"))
    return best.select(*KEY, "x.*").select(*store.columns)


def filter_table(spark: SparkSession, path: str) -> RunTable:
    return RunTable(spark, path.rstrip("/") + "_filter", "word bigint, bits bigint", "word", 8)


def filter_words(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(word, bits): the set 64-bit words of the Bloom filter of rows (text_hash)."""
    h1, h2 = (F.conv(F.substring("text_hash", at, 15), 16, 10).cast("long") for at in (1, 17))
    places = F.array(*[F.pmod(h1 + i * h2, F.lit(bits)) for i in range(FILTER_HASHES)])
    at = hashes.select(F.explode(places).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))


def maybe_stored(spark: SparkSession, path: str, bits: int = FILTER_BITS):
    """A function of a ``text_hash`` column: false where the store has no row with it, or None
    where there is no filter. The words of all runs, at most ``bits`` / 8 bytes, go to the
    executors."""
    import numpy as np
    import pandas as pd

    table = filter_table(spark, path)
    if not table.runs():
        return None
    words = table.read().groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    whole = np.zeros(bits // 64, np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    shipped = spark.sparkContext.broadcast(whole.view(np.uint64))

    @F.pandas_udf("boolean")
    def known(hashes):
        h1, h2 = (np.array([int(x[a : a + 15], 16) for x in hashes], np.int64) for a in (0, 16))
        out = np.ones(len(hashes), bool)
        for i in range(FILTER_HASHES):
            at = (h1 + i * h2) % bits
            out &= (shipped.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    return known


def append(results: DataFrame, path: str) -> int:
    """Writes finished results once and splits them: error-free rows into the
    store, the others into ``<store>_errors``, for each ``run_id`` of theirs.
    Returns the rows stored; runs that are there already are left as they are."""
    spark = results.sparkSession
    done = materialize(results.select(*STORE_COLUMNS), "store-run")
    element = dict(done.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    good, bad = F.col("error").isNull(), F.col("error").isNotNull()
    stored = 0
    # One run, or a few: a run_id is given to a job, not to a row.
    for r in done.groupBy("run_id").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad")).collect():
        own = done.where(F.col("run_id") == r["run_id"])
        if r["bad"]:
            errors_table(spark, path, element).append(own.where(bad), r["run_id"])
        if r["good"]:
            filter_table(spark, path).append(filter_words(own.where(good).select("text_hash")), r["run_id"])
            stored += store_table(spark, path, element).append(own.where(good), r["run_id"])
    return stored


def compact(spark: SparkSession, path: str) -> int:
    """One run with the latest row of each key in place of the runs so far; returns its rows."""
    return store_table(spark, path).compact(latest)


def pending(texts: DataFrame, done: DataFrame | None, profile: str, task: str | None = None,
            text_col: str = "text", id_col: str = "doc_id", maybe=None) -> DataFrame:
    """Distinct texts not yet in ``done`` (a store or its latest view):
    (text_hash, text, n_docs, first_doc_id). ``maybe``: the store's ``maybe_stored``."""
    h = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    facts = [F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id")]
    once = lambda rows: rows.groupBy("text_hash").agg(F.min_by("text", "doc_id").alias("text"), *facts)
    if done is None:
        return once(h)
    d = done.where((F.col("profile") == profile) & F.col("error").isNull())
    d = d.where(F.col("task").isNull() if task is None else F.col("task") == task).select("text_hash")
    if maybe is None:
        return once(h).join(d, "text_hash", "left_anti")
    h = h.withColumn("_maybe", maybe("text_hash"))
    hits = h.where("_maybe")
    # The digests of possible hits meet the store; the few that are not there after all get their texts.
    missed = hits.select("text_hash").distinct().join(d, "text_hash", "left_anti")
    missed = materialize(missed.withColumnRenamed("text_hash", "_h"), "missed-hits")
    again = hits.join(missed, F.col("text_hash") == F.col("_h"), "left_semi")
    return once(h.where("NOT _maybe").unionByName(again))


def as_store_rows(results: DataFrame, profile: str, task: str | None, run_id: str | None = None) -> DataFrame:
    """Result rows that carry ``text_hash`` in the shape of the store, as one run."""
    return results.select(
        "text_hash", F.lit(profile).alias("profile"), F.lit(task).cast("string").alias("task"),
        F.lit(run_id or uuid.uuid4().hex).alias("run_id"),
        F.current_timestamp().alias("run_ts"), "embedding", "dim", "n_tokens", "error",
    )


def embed_incremental(spark: SparkSession, texts: DataFrame, store_path: str, embed_fn, profile: str,
                      task: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> int:
    """Encode only texts the store lacks; append them. Returns rows stored.

    ``embed_fn(df)`` takes (doc_id, text, text_hash) and returns the result
    rows of ``plans.pipeline.embed(..., keep=["text_hash"])``.
    """
    todo = pending(texts, read_store(spark, store_path), profile, task, text_col, id_col, maybe_stored(spark, store_path))
    batch = todo.select(F.col("first_doc_id").alias("doc_id"), "text", "text_hash")
    return append(as_store_rows(embed_fn(batch), profile, task), store_path)


def documents_view(texts: DataFrame, store: DataFrame, profile: str, task: str | None = None,
                   text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document with its stored embedding (join back on text hash)."""
    lt = latest(store.where(F.col("profile") == profile))
    lt = lt.where(F.col("task").isNull() if task is None else F.col("task") == task)
    h = texts.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"))
    return h.join(lt.select("text_hash", "run_id", "embedding", "dim", "n_tokens", "error"), "text_hash", "left")
