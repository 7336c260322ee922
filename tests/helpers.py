"""Small builders for golden tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenvec.sources.vocab import Vocabulary, specials_table


def make_vocab(spark, tokens: dict[str, int], specials: dict[str, int]) -> Vocabulary:
    t = spark.createDataFrame(list(tokens.items()) or [("", -1)], "token string, id bigint")
    if not tokens:
        t = t.where(F.lit(False))
    s = specials_table(spark, list(specials.items()) or [("", -1)])
    if not specials:
        s = s.where(F.lit(False))
    rev = t.select("id", "token").unionByName(s.select("id", F.col("content").alias("token")))
    return Vocabulary(tokens=t, reverse=rev, specials=s, row_bound=len(tokens) + len(specials))


def texts(spark, values: list[str]):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, text string")
