"""Join strategy helpers: broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A vocabulary of 250k pieces with ids is a few MB; its pieces are short, so
# 2M rows stay well under Spark's broadcast limit.
MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, known_rows: int | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side of short rows that is proven small.

    ``known_rows`` is an upper bound that comes with the table (a model
    artifact's size, a ``limit``). Without one nothing is counted and nothing
    hinted: Spark broadcasts by measured bytes or shuffles."""
    return F.broadcast(df) if known_rows is not None and known_rows <= max_rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a batch input by ``key`` if its files give fewer tasks
    than there are cores.

    A file can hold one row group, which Spark reads in a single task; the
    text work after it would then run on one core. Files that already give a
    task a core, and streams, are returned unchanged: shuffling the text would
    cost more than it saves. Operators give the same rows either way."""
    if df.isStreaming:
        return df
    cores = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df.repartition(2 * cores, key) if scan_tasks(df) < cores else df


def scan_tasks(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table under the shared checkpoint
    folder and read it back: the lineage is cut, every later use reads the
    written rows, and the reader knows the table's size.

    (``DataFrame.checkpoint(eager=True)`` would compute its input twice: once
    to count it and once to write it.)
    """
    import uuid

    from lumenvec.session import work_dir

    path = work_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
