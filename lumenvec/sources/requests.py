"""Request rows (O4): JSON lines in the two shapes the reference accepts.

* single request ``{"command": "infer", "text": "..."}``
* batch request ``{"inputs": ["...", "..."]}``

An optional ``"id"`` field names the request; without it the id is a hash
of the line. A bad line yields one error row instead of failing the job.

Defined results: a null or empty line is invalid JSON; an id that is no whole number
counts as none; a text, or an item of ``inputs``, that is null or no string is a
missing text; an empty ``inputs`` gives no row; repeated lines have rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The one command that asks for an embedding.
INFER = "infer"


def string_of(value):
    """The text of a variant that is a JSON string; numbers and the like are no texts."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def parse_requests(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """(value STRING) -> (request_id BIGINT, idx INT, text STRING, error STRING)."""
    v = F.try_parse_json(F.col(value_col))
    cmd = F.try_variant_get(v, "$.command", "string")
    raw = F.try_variant_get(v, "$.text", "variant")
    text = string_of(raw)
    inputs = F.transform(F.try_variant_get(v, "$.inputs", "array<variant>"), string_of)

    def item(i, t, e):
        return F.struct(i.cast("int").alias("idx"), t.cast("string").alias("text"), e.cast("string").alias("error"))

    none = F.lit(None)
    items = (
        F.when(v.isNull(), F.array(item(F.lit(0), none, F.lit("invalid JSON"))))
        .when(inputs.isNotNull(), F.transform(inputs, lambda t, i: item(i, t, F.when(t.isNull(), F.lit("missing text")))))
        .when(cmd == INFER, F.array(item(F.lit(0), text, F.when(text.isNull(), F.lit("missing text")))))
        .otherwise(F.array(item(F.lit(0), none, F.lit("Unknown command"))))
    )
    rid = F.coalesce(F.try_variant_get(v, "$.id", "bigint"), F.xxhash64(F.col(value_col)))
    # explode_outer + filter: a plain explode makes Catalyst evaluate the
    # parse twice (inferred size filter); an empty batch still yields no row.
    out = lines.select(rid.alias("request_id"), F.explode_outer(items).alias("r")).where(F.col("r").isNotNull())
    return out.select("request_id", "r.idx", "r.text", "r.error")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files -> request rows."""
    return parse_requests(spark.read.text(path))


def request_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Single-shape request lines for (id, text) rows: (value STRING)."""
    return rows.select(
        F.to_json(F.struct(F.col(id_col).cast("bigint").alias("id"), F.lit(INFER).alias("command"),
                           F.col(text_col).alias("text"))).alias("value")
    )
