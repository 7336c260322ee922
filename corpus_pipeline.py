"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept;
its result is written as Parquet and read again. All but the last give the
columns of ``documents``, with ``text`` and ``n_chars`` as they are by then:

1. quality rules: lines that fail are taken out, rejected documents go;
2. line dedup: later copies of runs of lines go, with documents that have no
   words left;
3. SimHash near-dedup: one document of each group stays;
4. mixing sources to target weights: a row for each copy the mix takes, so a
   document can come twice; the last one of a source can be cut; the rows
   are written shard after shard, in the random order of their places;
5. best-fit packing: the pieces of all rows with their sequences.

Defined results, stage by stage: a null or blank text fails the base rules of
stage 1 and goes. Rows that repeat each pass stage 1; of rows that agree in doc_id
and text neither is an earlier copy for stage 2, and one stays in stage 3; rows
that share a doc_id with other texts are documents of their own. Rows without a
doc_id come first in stage 2 and all stay in stage 3. A null source is a source of
the mix, last in order. Very long texts pass whole. An empty table gives an empty
result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm import line_dedup, mixing, packing, quality_rules, simhash
from lumenvec.llm.encoding import tokenizer_path
from lumenvec.plans.strategy import materialize
from lumenvec.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, the characters counted anew."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(line_dedup.dedup(docs).where(line_dedup.has_words("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(simhash.dedup(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed(docs)
    shard, place = out.columns[-2:]
    # Ranges, not one task for each shard: the written rows are in the order of the shards and places.
    return as_documents(out.repartitionByRange(shard, place).sortWithinPartitions(shard, place))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# Packing has no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
