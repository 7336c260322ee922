"""the row encoder works on whole arrays; its rows are those of the row-by-row expressions."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import make_vocab

from lumenvec.functions.text import v3_pretokens
from lumenvec.functions.vectors import l2_normalize
from lumenvec.operators import encode
from lumenvec.operators.encode import StaticEncoder, encode_blocks, encode_rows, fixture_vectors
from lumenvec.operators.pretokens import letters_and_digits, prefixed, pretokens, trimmed
from lumenvec.plans.catalog import SUBWORD64, WORDS64
from lumenvec.plans.pipeline import embed
from lumenvec.plans.queries.embedding import _head_and_norm
from lumenvec.sources.vocab import token_totals

EVERY = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
HARD = ["".join(EVERY), "x".join(EVERY[:0x3000]), "a", "b_ __ _1", "", None, " \t\n", "　 a b \x0b\x85", "\x0b a_b\x1c9 Kſİ",
        "c", "é", "d", "\U0001f600e \U0001d7d8", "f\x00g"]


def test_pretokens_are_those_of_the_expression(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "id int, t string").coalesce(1)
    bad = spark.sql("SELECT 100 AS id, CAST(X'61ff62c328e282' AS STRING) AS t")  # no UTF-8
    got = df.union(bad).select("id", trimmed("t").alias("t"), v3_pretokens("t").alias("want")).orderBy("id").toPandas()
    column = pa.array(["x", *got["t"], "y"], pa.string()).slice(1, len(got))
    place, found = pretokens(column)
    words = prefixed(found.to_pylist(), letters_and_digits(spark))
    assert [words[lo:hi] for lo, hi in zip(place[:-1], place[1:])] == [list(x) for x in got["want"]]
    assert [len(x) for x in pretokens(pa.array([None, "", None], pa.string()))] == [4, 0] and len(pretokens(column.slice(0, 0))[1]) == 0


def test_totals_of_texts_are_those_of_their_pretokens(spark):
    df = spark.createDataFrame([(t,) for t in [*HARD, *HARD, "a a b_", "a"]], "t string").repartition(3)
    got = {r.token: r.n for r in token_totals(df.select(trimmed("t").alias("tokens"))).collect()}
    assert got == {r.token: r.n for r in token_totals(df.select(v3_pretokens("t").alias("tokens"))).collect()} and got["▁a"] > 3


def test_no_expression_works_token_by_token(spark):
    """Nothing is matched in the JVM for each occurrence, and no vector is summed again for each value that is shown."""
    v = make_vocab(spark, {"▁a": 4, "a": 5, "b": 6}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    docs = spark.createDataFrame([(1, "ab a"), (2, None), (None, "c a")], "doc_id bigint, text string")
    out = _head_and_norm(embed(docs, v, SUBWORD64, fixture_vectors(v, 12), dtype="double"), 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "aggregate(" in plan.split("Generate")[1] and "aggregate(" not in plan.split("Generate")[0]
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r.x)
        assert r.n_dims == 12 and r.norm == 1.0
    assert {k: len(x) for k, x in rows.items()} == {1: 3, 2: 3, None: 3}


@pytest.mark.parametrize("profile", [WORDS64, SUBWORD64, SUBWORD64.with_(max_tokens=5)], ids=["words", "subword", "cut"])
def test_counted_tokens_pool_as_before(spark, monkeypatch, profile):
    """The rows of the blocks: with lacking vectors, an infinite one, equal rows, nulls; ``unit`` is l2_normalize."""
    names = {"▁a": 4, "a": 5, "▁ab": 6, "b": 7, "ab": 8, "c": 9}
    v = make_vocab(spark, names, {"<s>": 0, "</s>": 2, "<unk>": 3, "[CLS]": 1, "[SEP]": 10})
    texts = ["a abb ab", "a abb ab", None, "", "zz", "b " * 50 + "c", "c b", "a " * 3000, " ab　"] * 3
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    for of_c in ([float("inf")] * 4, [0.5, -0.5, 0.25, 1.0], None):
        vecs = [(i, [((i * 31 + d * 17) % 129 - 64) / 64 for d in range(4)]) for i in [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]]
        enc = StaticEncoder(spark.createDataFrame(vecs + [(9, of_c)] * (of_c is not None), "id bigint, v array<double>"), 4)
        key = lambda df, c: sorted(str((r.doc_id, r[c], r.n_tokens, r.error)) for r in df.collect())
        got = encode_rows(docs, v, profile, enc)
        if profile.max_tokens is None:
            assert key(got, "pooled") == key(encode_blocks(docs, v, profile, enc), "pooled")
        want = got.select("doc_id", l2_normalize("pooled").alias("pooled"), "n_tokens", "error")
        assert key(encode_rows(docs, v, profile, enc, unit=True), "pooled") == key(want, "pooled")


@pytest.mark.parametrize("finite", [True, False])
def test_frequent_and_rare_vectors(monkeypatch, finite):
    """What many rows have goes by products, in steps of a bounded number of vectors; the rest vector by vector."""
    monkeypatch.setattr(encode, "PRODUCT_VECTORS", 7)
    rng = np.random.default_rng(1)
    mat = rng.integers(-64, 65, size=(300, 5)) / 64.0
    tokens = [np.concatenate((rng.integers(0, 20, 30), rng.integers(0, 300, 3))) for _ in range(64)]
    tokens[10] = np.zeros(0, np.int64)
    row, at = np.repeat(np.arange(64), [len(x) for x in tokens]), np.concatenate(tokens)
    if not finite:
        mat[at[0]] = np.inf
    with np.errstate(invalid="ignore"):
        want = np.stack([mat[x].sum(axis=0) for x in tokens])
        for share in (0, 16):  # distinct places by sorting, by counting
            monkeypatch.setattr(encode, "DENSE_SHARE", share)
            counted = encode.row_counts(row, at, 64, 300)
            assert np.array_equal(encode.sparse_product(*counted, 64, mat, finite), want)
