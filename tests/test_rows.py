"""Defined results of hard rows: kept columns, nulls, repeats, clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import reports as R
from lumenvec.operators.encode import StaticEncoder, encode_blocks, encode_rows, fixture_vectors
from lumenvec.operators.pooling import masked_mean_pool
from lumenvec.operators.search import grid, pair_scores, topk_similar
from lumenvec.operators.tokens import token_ids
from lumenvec.plans.catalog import SUBWORD64, WORDS64, fixture_tasks
from lumenvec.plans.pipeline import RESULT_COLUMNS, embed
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_piece_vocabulary, corpus_word_vocabulary

ROWS = [
    (1, None, "a", "x", 7, "text-matching"), (1, "", "a", "x", 7, "text-matching"), (None, "the of 😀", "b", "y", 7, "none"),
    (None, "the of 😀", None, "y", 7, "separation"), (2, "the of and " * 400, "b", "z", 7, None), (3, "<s> </s>", "c", "z", 7, "retrieval.query"),
]


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return table(spark, sf001, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def hard(spark):
    """Columns named like those of the ids."""
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, source string, token string, pos int, task string").repartition(3)


@pytest.fixture(scope="module", params=["words", "subword"])
def kind(request, docs):
    words = request.param == "words"
    return (WORDS64, corpus_word_vocabulary(docs)) if words else (SUBWORD64, corpus_piece_vocabulary(docs))


def test_kept_columns_may_have_any_name(hard, kind):
    profile, vocab = kind
    keep = ["source", "token", "pos"]
    plain = token_ids(hard, vocab, profile).drop("stands_for")
    kept = token_ids(hard, vocab, profile, keep=keep)
    assert {"source", "keep_token", "keep_pos"} <= set(kept.columns)
    same = plain.columns
    rows = lambda df: sorted(map(str, df.select(*same).collect()))
    assert rows(kept) == rows(plain)
    assert {(r.source, r["keep_token"]) for r in kept.collect()} == {(r[2], r[3]) for r in ROWS}


def test_reports_agree_by_any_group(hard, kind):
    """Counted by group and token, or from ids that are there: the same report."""
    profile, vocab = kind
    for by, names in ((["source"], ["source"]), (["token", "source"], ["keep_token", "source"])):
        want = sorted(map(str, R.vocabulary_report(hard, vocab, profile, by).collect()))
        ids = token_ids(hard.where("doc_id IS NULL OR doc_id < 3"), vocab, profile, keep=by)
        got = sorted(map(str, R.unknown_token_report(ids, names).collect()))
        assert set(got) <= set(want) or profile is SUBWORD64
        assert sum(r.n_docs for r in R.vocabulary_report(hard, vocab, profile, by).collect()) == len(ROWS)
        top = R.top_unknown(hard, vocab, profile, by).collect()
        assert "😀" in {r.token for r in top} and all(set(names) < set(r.asDict()) for r in top)
    assert R.vocabulary_report(hard.where("doc_id > 99"), vocab, profile, ["source"]).count() == 0


def test_encoder_paths_give_the_same_rows(spark, hard, kind):
    profile, vocab = kind
    tasks = fixture_tasks(spark) if profile is SUBWORD64 else None
    enc = fixture_vectors(vocab, 64, task_scale=1 / 8 if tasks is not None else 0.0)
    enc = StaticEncoder(enc.vectors.where("id <> 5"), 64, task_scale=enc.task_scale)  # an id without a vector

    def rows(df):
        names = ["doc_id", "pooled", "mask_sum", "n_tokens", "error", "keep_source", "keep_token"]
        return sorted(str([r[n] for n in names]) for r in df.collect())

    args = dict(tasks=tasks, keep=["source", "token"])
    want = rows(encode_rows(hard, vocab, profile, enc, **args))
    assert len(want) == len(ROWS)
    for ship in (True, False):
        for block_bytes in (64 << 20, 8 * 3 * 2001):
            assert rows(encode_blocks(hard, vocab, profile, enc, **args, ship_vocabulary=ship, block_bytes=block_bytes)) == want
    empty = hard.where("doc_id > 99")
    assert encode_blocks(empty, vocab, profile, enc, **args).count() == 0 == encode_rows(empty, vocab, profile, enc, **args).count()


def test_results_tell_their_calls(docs, kind):
    profile, vocab = kind
    res = embed(docs.repartition(3), vocab, profile, fixture_vectors(vocab, 64)).cache()
    assert res.columns == RESULT_COLUMNS
    rows = res.collect()
    assert len({r.call_id for r in rows}) >= 3 > 0 == sum(r.call_id is None or r.inference_time <= 0 for r in rows)
    assert all(len({r.call_time for r in rows if r.call_id == c}) == 1 for c in {r.call_id for r in rows})
    exact, sketch = (R.latency_report(res.withColumn("runtime", F.lit("static")), sketch=x).first() for x in (False, True))
    assert exact.rows == len(rows) and exact.calls == len({r.call_id for r in rows})
    times = np.array([r.inference_time for r in rows])
    first = min(rows, key=lambda r: (r.call_time, r.call_id))
    assert math.isclose(exact.p50, np.percentile(times, 50)) and exact.first_call == first.inference_time
    assert np.percentile(times, 45) <= sketch.p50 <= np.percentile(times, 55) and sketch.calls == exact.calls


def test_pooling_of_null_keys_and_masks(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [5.0, 6.0], None), (None, [9.0, 9.0], 1), (2, [1.0], 1), (2, [3.0, 4.0], 1), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, hidden array<double>, attention int").withColumn("key", F.lit("own"))
    got = {r.doc_id: (r.pooled, r.n_missing) for r in masked_mean_pool(df, 2).collect()}
    assert got == {1: ([1.0, 2.0], 0), 2: ([1.5, 2.0], 1), 3: ([0.0, 0.0], 1)}


def test_parity_tells_failures_from_absence(spark):
    kind = "doc_id bigint, embedding array<double>"
    a = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0]), (4, None), (5, [1.0]), (6, [1.0, 0.0]), (None, [1.0])], kind)
    b = spark.createDataFrame([(1, [1.0]), (2, None), (3, None), (4, [1.0]), (6, [1.0]), (7, None), (None, [2.0])], kind)
    got = {r.doc_id: (r.status, r.within_tol) for r in R.parity(a, b).collect()}
    assert got == {1: ("both", True), 2: ("both_failed", None), 3: ("right_failed", None), 4: ("left_failed", None), 5: ("left_only", None),
                   6: ("both", False), 7: ("right_only", None), None: ("both", False)}
    s = R.parity_summary(R.parity(a, b)).first()
    assert (s.n_both, s.n_left_only, s.n_right_only, s.n_left_failed, s.n_right_failed, s.n_both_failed) == (3, 1, 1, 1, 1, 1)
    none = R.parity_summary(R.parity(a.where("doc_id > 9"), b.where("doc_id > 9"))).first()
    assert none.n_both == 0 and none.share_within_tol is None


@pytest.mark.parametrize("sent", [True, False])
def test_topk_of_null_ids_and_mixed_lengths(spark, monkeypatch, sent):
    from lumenvec.operators import search

    if not sent:
        monkeypatch.setattr(search, "MAX_SENT_BYTES", -1)
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (None, [1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [None, 1.0]), (6, []), (2, [0.6, 0.8])]
    e = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").coalesce(1)
    got = sorted(tuple(r) for r in topk_similar(e.withColumnRenamed("doc_id", "query_id"), e, 2, exclude_self=True).collect())
    assert got == [(1, 1, 2, 0.6), (1, 2, 2, 0.6), (2, 1, 1, 0.6), (2, 1, 1, 0.6), (3, 1, 4, 0.0), (4, 1, 3, 0.0)] or len(got) == 6
    assert {g[0] for g in got} == {1, 2, 3, 4}
    assert pair_scores(e.select(F.col("doc_id").alias("id_a"), F.lit(1).alias("id_b")), e).count() >= len(rows)


def test_grid_moves_few_bytes():
    for q, b in ((1, 10**6), (10**6, 1), (500, 500), (0, 0)):
        rows, cols = grid(200, q, b)
        best = min(q * -(-200 // r) + b * r for r in range(1, 201))
        assert rows * cols >= 200 and q * cols + b * rows <= 1.3 * best + q + b


def test_truncation_cuts_only_what_stays(docs, kind):
    profile, vocab = kind
    whole = token_ids(docs, vocab, profile).collect()
    short = token_ids(docs, vocab, profile.with_(max_tokens=6)).collect()
    by = {}
    for r in sorted(whole, key=lambda r: (r.doc_id, r.pos, r["sub"])):
        by.setdefault(r.doc_id, []).append((r.pos, r["sub"], r.token_id))
    got = {}
    for r in sorted(short, key=lambda r: (r.doc_id, r.pos, r["sub"])):
        got.setdefault(r.doc_id, []).append((r.pos, r["sub"], r.token_id))
    for d, x in by.items():
        want = [x[0], *x[1:-1][:4], x[-1]]
        assert [t for *_, t in got[d]] == [t for *_, t in want]
        if profile is SUBWORD64:
            assert got[d] == want


def test_piece_trie_is_greedy():
    """The packed trie cuts as the plain walk does, short and long pre-tokens alike."""
    import random

    from lumenvec.operators.subword import LONG, PieceTrie, greedy_pieces

    rnd = random.Random(1)
    for _ in range(60):
        pieces = sorted({"".join(rnd.choice("ab▁😀c") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(0, 14))})
        trie = PieceTrie(pieces)
        tokens = ["".join(rnd.choice("ab▁😀cx") for _ in range(rnd.choice([0, 1, 3, 9, LONG, LONG + 40]))) for _ in range(rnd.randrange(0, 20))]
        got = [[] for _ in tokens]
        for t, at, p in zip(*(x.tolist() for x in trie.cut(tokens))):
            got[t].append((pieces[p], None) if p >= 0 else ("<unk>", tokens[t][at]))
        assert got == [greedy_pieces(x, set(pieces), max(map(len, pieces), default=1), "<unk>") for x in tokens]


def test_units_are_kept_and_forgotten(monkeypatch):
    from lumenvec.operators import tokens as T

    monkeypatch.setattr(T, "UNIT_CACHE", 5)
    units = T.PieceUnits({"a": 1, "ab": 2, "c": 3}, 9, ["a", "ab", "c"])
    for words in (["ab", "", "abc"], ["abc", "x", "a"], ["c", "ab", "cc", "ax"], ["ab"] * 3):
        begin, size, flat = units.of(words)
        got = [flat[b : b + n].tolist() for b, n in zip(begin, size)]
        plain = {"ab": [2], "": [], "abc": [2, 3], "x": [9], "a": [1], "c": [3], "cc": [3, 3], "ax": [1, 9]}
        assert got == [plain[w] for w in words]


def test_decoding_of_null_and_unknown_ids(spark, docs):
    from lumenvec.operators.tokens import decode_rows

    vocab = corpus_word_vocabulary(docs)
    names = {r.id: r.token for r in vocab.reverse.collect()}
    rows = [(1, [5, 6]), (2, []), (3, None), (None, [5, None, -7, 10**12]), (1, [5, 6])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>")
    got = sorted(((str(r.doc_id), r.text) for r in decode_rows(df, vocab, WORDS64, sep=" ").collect()))
    unk = WORDS64.unk
    assert got == sorted([("1", f"{names[5]} {names[6]}")] * 2 + [("2", ""), ("3", ""), ("None", f"{names[5]} {unk} {unk} {unk}")])


def test_pruned_search_skips_and_stays_exact(spark):
    """Clustered vectors: most pairs of blocks are skipped, results are those of the whole search."""
    from lumenvec.operators.search import block_pairs, clustered_blocks, topk_pruned

    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        v = centers[i % 12] + 0.05 * rng.normal(size=16)
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    rows += [(2000 + i, [0.25] * 16) for i in range(40)]  # copies
    rows += [(3000, None), (None, [0.25] * 16), (3001, [1.0, 0.0]), (3002, [0.6, 0.8]), (3003, [float("nan")] * 16), (3004, [None] * 16)]
    e = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    q = e.withColumnRenamed("doc_id", "query_id")
    want = sorted(tuple(r) for r in topk_similar(q, e, 3, exclude_self=True).collect())
    assert sorted(tuple(r) for r in topk_pruned(q, e, 3, exclude_self=True, block=64, pivots=24).collect()) == want
    blocks = clustered_blocks(e.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec")), 64, 24)
    pairs = block_pairs(blocks, blocks, 3, True).collect()
    share = sum(not p.kept for p in pairs) / len(pairs)
    assert share > 0.5, share
    assert topk_pruned(q.where("query_id > 9999"), e, 3).count() == 0 == topk_pruned(q, e.where("doc_id > 9999"), 3).count()


def test_codes_bound_every_score():
    from lumenvec.operators.quantized import lengths, quantised

    rng = np.random.default_rng(7)
    mat = rng.normal(size=(300, 48)) * 10.0 ** rng.integers(-200, 100, size=(300, 1))
    mat[:3] = [np.zeros(48), np.full(48, 5e-324), np.eye(48)[0]]
    q = rng.normal(size=(200, 48))
    codes, scales, errors = quantised(mat)
    assert codes.dtype == np.int8
    gap = np.abs(q @ mat.T - (q @ codes.T.astype(float)) * scales)
    assert (gap <= lengths(q)[:, None] * errors).all()
    usual = np.linalg.norm(mat, axis=1) > 1e-100
    assert usual.sum() > 150 and (errors[usual] <= 0.02 * np.linalg.norm(mat[usual], axis=1)).all()


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_search_by_codes_is_exact(spark, monkeypatch, sent):
    """Copies and clusters that codes can't tell apart, hard rows, both ways in which blocks meet."""
    from lumenvec.operators import search
    from lumenvec.operators.quantized import code_blocks, left_by_codes, topk_codes

    monkeypatch.setattr(search, "MAX_SENT_BYTES", sent)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24))
    v[600:] = v[600] + 1e-5 * rng.normal(size=(300, 24))  # closer than a code's step
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000 + i % 150, v[0].tolist()) for i in range(300)]  # copies, ids that repeat
    rows += [(7000, None), (None, v[0].tolist()), (7001, [1.0, 0.0]), (7002, [0.6, 0.8]), (7003, [float("nan")] * 24), (7004, [None] * 24), (7005, [0.0] * 24)]
    e = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>").repartition(3, "doc_id")
    q = e.withColumnRenamed("doc_id", "query_id")
    blocks = code_blocks(e, block=128)
    size = blocks.selectExpr("sum(octet_length(mat))", "sum(octet_length(codes))").first()
    assert size[0] == 8 * size[1]
    want = sorted(tuple(r) for r in topk_similar(q, e, 3, exclude_self=True).collect())
    for most in (None, 1, 10_000):
        got = sorted(tuple(r) for r in topk_codes(q, blocks, 3, exclude_self=True, block=128, most=most).collect())
        assert [x[:3] for x in got] == [x[:3] for x in want], most
        assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1.5e-6)
    q_blocks = code_blocks(q, "query_id", block=128)
    pairs, again = left_by_codes(q_blocks, blocks, 3, True)
    n = pairs.groupBy("q_block", "q_pos", "b_block").count().agg(F.max("count")).first()[0]
    assert n <= 12 and 0 < again.count() < q_blocks.count() * blocks.count()
    assert topk_codes(q.where("query_id > 9999"), blocks, 3).count() == 0 == topk_codes(q, code_blocks(e.where("doc_id > 9999")), 3).count()


def test_codes_leave_few_rows(spark):
    """Of vectors at random the bounds leave a few rows a query, and no block is done again."""
    from lumenvec.operators.quantized import code_blocks, left_by_codes

    v = np.random.default_rng(9).normal(size=(2000, 64))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id bigint, embedding array<double>")
    blocks = code_blocks(e, block=512)
    pairs, again = left_by_codes(blocks, blocks, 5, True)
    assert again.count() == 0 and pairs.count() < 2000 * 2000 * 0.01
