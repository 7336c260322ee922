"""Streaming embedding job.

``readStream`` of JSON request lines -> parse (O4) -> JVM tokenise -> encoder
in Arrow batches (O12, pooling inside the batch) -> normalise (O14) ->
``writeStream``. Every row is independent, so the query keeps no
state and needs no watermark. Two sinks: a plain Parquet folder
(``run_available``, exactly once by Spark's checkpoint), or tables of runs for
results, errors and the embedding store (``run_into_store``), each micro-batch
one run of each, known by the query's id and the batch's number: a batch that
is tried again after a failure finds its runs there and changes nothing.

Defined results: a request that failed to parse, and a text that failed to
encode, is one error row; requests without texts give no row; a null text is an
error of its request; repeated requests have a result each; a batch without
requests writes two empty runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators.store import append, as_store_rows, text_hash
from lumenvec.plans.pipeline import embed
from lumenvec.plans.strategy import materialize
from lumenvec.sources.requests import parse_requests
from lumenvec.sources.runs import RunTable


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_requests(reader.load(source_dir))


def embed_stream(requests: DataFrame, vocab, profile, encoder, tasks: DataFrame | None = None, dtype: str = "float") -> DataFrame:
    """Streaming (or batch) requests -> result rows keyed by (request_id, idx),
    so the texts of one ``inputs`` request stay apart and in order. Requests
    that failed to parse are left to the caller's error sink
    (``requests.where(error IS NOT NULL)``). Both encoders work row by row and
    keep no state; a static one whose tables are too large to send to the
    executors is refused on a stream (``run_into_store`` takes any)."""
    ok = requests.where(F.col("error").isNull()).select(F.col("request_id").alias("doc_id"), "idx", "text")
    res = embed(ok, vocab, profile, encoder, dtype, tasks=tasks, keep=["idx"])
    return res.withColumnRenamed("doc_id", "request_id")


def results_table(spark: SparkSession, out: str, element: str = "float") -> RunTable:
    columns = f"request_id bigint, idx int, text_hash string, embedding array<{element}>, dim int, n_tokens bigint"
    return RunTable(spark, f"{out.rstrip('/')}/results", columns, "request_id")


def errors_table(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out.rstrip('/')}/errors", "request_id bigint, idx int, error string", "request_id")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint over restarts."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def write_batch(requests: DataFrame, run_id: str, vocab, profile, encoder, out: str, tasks: DataFrame | None = None,
                dtype: str = "float", store: str | None = None, max_shipped: int | None = None) -> None:
    """One batch of parsed requests as a run of the results and the errors, and of the
    embedding ``store`` if one is given. Runs that are committed already stay as they are."""
    spark = requests.sparkSession
    good, bad = results_table(spark, out, dtype), errors_table(spark, out)
    if run_id in good.runs() and run_id in bad.runs():
        return
    ok = requests.where(F.col("error").isNull())
    ok = ok.select(F.col("request_id").alias("doc_id"), "idx", "text", text_hash().alias("text_hash"))
    bound = {} if max_shipped is None else {"max_shipped": max_shipped}
    done = materialize(embed(ok, vocab, profile, encoder, dtype, tasks=tasks, keep=["idx", "text_hash"], **bound), "stream-batch")
    rows = done.withColumnRenamed("doc_id", "request_id")
    if store:
        once = done.where(F.col("error").isNull()).dropDuplicates(["text_hash"])
        append(as_store_rows(once, profile.name, profile.task, run_id), store)
    good.append(rows.where(F.col("error").isNull()), run_id)
    failed = requests.where(F.col("error").isNotNull()).select("request_id", "idx", "error")
    bad.append(failed.unionByName(rows.where(F.col("error").isNotNull()).select("request_id", "idx", "error")), run_id)


def run_into_store(requests: DataFrame, vocab, profile, encoder, out: str, checkpoint: str, **options) -> None:
    """Processes all requests available now, micro-batch by micro-batch, with ``write_batch`` (its ``options``)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}"
        write_batch(batch, run_id, vocab, profile, encoder, out, **options)

    q = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(results: DataFrame, out_dir: str, checkpoint_dir: str) -> None:
    """Process everything available now into a Parquet sink, then stop."""
    q = (
        results.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
