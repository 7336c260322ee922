"""Batches are worked on in parts of a bounded size; results don't depend on them."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import make_vocab
from pyspark.sql import functions as F

from lumenvec.operators.batches import PART_ITEMS, PART_ROWS, cuts, parts
from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.onnx_batch import OnnxEncoder
from lumenvec.plans.catalog import WORDS64
from lumenvec.plans.pipeline import embed
from lumenvec.sources.model_fixture import gather_model, static_matrix


def test_parts_are_bounded_and_whole():
    sizes = [3, 0, 50, 1, 1, 1, 9, 0]
    assert list(cuts(sizes, 3, 10)) == [(0, 2), (2, 3), (3, 6), (6, 8)] and list(cuts([], 3, 10)) == []
    lists = pa.array([None if n == 0 else list(range(n)) for n in sizes], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), lists], ["id", "x"])
    got = list(parts(batch, 1, 3, 10))
    assert [p.num_rows for p in got] == [2, 1, 3, 2] and pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
    assert PART_ROWS <= 1024 and PART_ITEMS <= 1 << 18


def test_no_call_takes_a_whole_batch(spark):
    """One partition, one Arrow batch: the encoders still take it in parts, with the results of small batches."""
    v = make_vocab(spark, {"a": 4, "b": 5}, {"[CLS]": 1, "[SEP]": 2})
    n = 2 * PART_ROWS + 10
    text = F.when(F.col("id") % 5 == 0, F.lit("")).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit("a \n b "), F.repeat(F.lit("b "), (F.col("id") % 7).cast("int"))))
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    onnx = OnnxEncoder(model_bytes=gather_model(static_matrix(6, 8)), dim=8)
    want = embed(docs.repartition(40), v, WORDS64, fixture_vectors(v, 8), dtype="double").select("doc_id", "embedding", "n_tokens").collect()
    want = {r.doc_id: r for r in want}
    for enc in (fixture_vectors(v, 8), onnx):
        got = embed(docs, v, WORDS64, enc, dtype="double").collect()
        calls = {}
        for r in got:
            calls[r.call_id] = calls.get(r.call_id, 0) + 1
            assert r.n_tokens == want[r.doc_id].n_tokens and np.allclose(r.embedding, want[r.doc_id].embedding, atol=1e-9)
        assert len(got) == n and max(calls.values()) <= PART_ROWS and len(calls) >= 3


def test_onnx_runner_yields_bounded_parts(spark):
    import pandas as pd

    from lumenvec.operators.onnx_batch import _runner
    from lumenvec.operators.tokens import sent_vocabulary

    v = make_vocab(spark, {"a": 4, "b": 5}, {"[CLS]": 1, "[SEP]": 2})
    enc = OnnxEncoder(model_bytes=gather_model(static_matrix(6, 8)), dim=8)
    sent = spark.sparkContext.broadcast(enc.model_bytes)
    run = _runner(enc, WORDS64, sent_vocabulary(v, WORDS64), sent, ("parts", 1), [])
    whole = pd.DataFrame({"doc_id": range(PART_ROWS + 5), "tokens": ["a\nb"] * (PART_ROWS + 5)})
    assert [len(p) for p in run([whole])] == [PART_ROWS, 5]


def test_best_of_cells_is_exact_and_small():
    """A task's k best over many blocks are those of one sort; it holds and gives k rows a query, whatever it meets."""
    from lumenvec.operators.search import Best

    rng = np.random.default_rng(3)
    q, base = rng.normal(size=(90, 16)), rng.normal(size=(600, 16))
    base[200:300] = q[:10] = base[200]  # copies: smallest ids first
    ids, own = rng.permutation(600), rng.permutation(600)[:90]
    best = Best(16, 4, True)
    for at in range(0, 90, 30):
        best.add(str(at), own[at : at + 30], q[at : at + 30])
    for at in range(0, 600, 70):
        best.meet(ids[at : at + 70], base[at : at + 70], ["0", "60", "30"])
    score = np.round(q @ base.T, 6)
    score[own[:, None] == ids[None, :]] = -np.inf
    want = [ids[np.lexsort((ids, -row))[:4]].tolist() for row in score]
    assert best.found.tolist() == want and sum(b.num_rows for b in best.rows()) == 90 * 4


def test_blocks_are_moved_once_a_cell(spark, monkeypatch):
    """Whatever pairs are kept, a cell gets a block once: the pairs of blocks never become rows with vectors."""
    from lumenvec.operators import search

    e = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(640)], "id bigint, vec array<double>").repartition(4)
    blocks = search.clustered_blocks(e, 16, 8).select(F.col("block_id").alias("block"), "ids", "mat", "dim").cache()
    pairs = blocks.select(F.col("block").alias("q_block")).crossJoin(blocks.select(F.col("block").alias("b_block")))
    n, cells = blocks.count(), search.dealt(blocks, blocks, pairs)
    rows, cols = search.grid(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, 1)
    assert n >= 40 and cells.count() == n * (rows + cols)
    met = cells.where("base").select(F.sum(F.size("wanted"))).first()[0]
    assert met == n * n


def test_bounds_of_earlier_blocks_prune_a_cell():
    """A task gives only rows that the bounds of all its blocks leave, the k best among them; dense blocks are done again."""
    from lumenvec.operators.quantized import Bounds, quantised

    rng = np.random.default_rng(6)
    q, base = rng.normal(size=(60, 32)), rng.normal(size=(4000, 32))
    base[1000:1050] = q[0]  # copies in one block
    held = Bounds(32, 3, False, 12)
    for at in range(0, 60, 20):
        held.add(str(at), np.arange(at, at + 20), q[at : at + 20])
    for at in range(0, 4000, 250):
        held.meet(f"b{at}", np.arange(at, at + 250), *quantised(base[at : at + 250]))
    found = [r for b in held.rows() for r in b.to_pylist()]
    again = {(r["q_block"], r["q_pos"], r["b_block"]) for r in found if r["b_pos"] < 0}
    assert again == {("0", 0, "b1000")}
    left = {}
    for r in found:
        left.setdefault(int(r["q_block"]) + r["q_pos"], set()).add(int(r["b_block"][1:]) + r["b_pos"])
    best = np.argsort(-(q @ base.T), axis=1)[:, :3]
    assert all(set(best[i].tolist()) <= left[i] for i in range(1, 60))
    assert sum(map(len, left.values())) < 60 * 8  # block by block without the others it would be 16 times k at least


def test_pieces_are_cut_row_by_row(spark, monkeypatch):
    """long-form pieces need no shuffle and no join of the pre-tokens; a text longer than a window is whole."""
    from lumenvec.operators import subword
    from lumenvec.operators.tokens import PieceNumbers, raw_tokens, token_ids
    from lumenvec.plans.catalog import SUBWORD64

    v = make_vocab(spark, {"▁a": 4, "a": 5, "▁ab": 6, "b": 7, "<s>": 9}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    texts = ["a abb", None, "", "ab\U0001f600b <s> \xe9", "ab a, " * 40_000, "abba" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    ids = token_ids(df, v, SUBWORD64)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    got = {}
    for r in ids.collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sub, r.token, r.token_id, r.in_vocab, r.stands_for))
    pieces, known = {"▁a", "a", "▁ab", "b", "<s>"}, {"▁a": 4, "a": 5, "▁ab": 6, "b": 7, "<unk>": 3}
    for r in raw_tokens(df, SUBWORD64).collect():
        want = [(0, 0, "<s>", 9, True, None), (len(r.tokens) + 1, 0, "</s>", 2, True, None)]
        for pos, t in enumerate(r.tokens, 1):
            for sub, (p, source) in enumerate(subword.greedy_pieces(t, pieces, 3, "<unk>")):
                want.append((pos, sub, p, known[p], source is None, source))
        assert sorted(got[r.doc_id], key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
    units = PieceNumbers(["a"])
    assert units.of(["ab", ""])[2].tolist() == [0, -1 - ord("b")]


def test_piece_counts_move_no_token(spark):
    """a text's pieces are counted where it is cut, over all of its windows; a number's id is looked up once."""
    from lumenvec.operators.encode import piece_counts_and_vectors
    from lumenvec.plans.catalog import SUBWORD64

    v = make_vocab(spark, {"▁a": 4, "a": 5, "b": 6}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    df = spark.createDataFrame([("a ab? " * 30_000,), ("b",), ("b",), (None,)], "text string")
    counts, vectors = piece_counts_and_vectors(df, v, SUBWORD64, fixture_vectors(v, 2).vectors)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1  # by a text's digest
    names = sorted(["▁a", "a", "b"]) + ["<unk>", "<s>", "</s>"]
    got = sorted(str(sorted((names[i], n) for i, n in zip(r.ids, r.n))) for r in counts.collect())
    ends = {"<s>": 1, "</s>": 1}
    want = [{"▁a": 60_000, "b": 30_000, "<unk>": 30_000} | ends, {"<unk>": 1, "b": 1} | ends, ends]
    assert got == sorted(str(sorted(x.items())) for x in want)
    assert {r.id for r in vectors.collect()} == set(range(6))


@pytest.mark.parametrize("finite", [True, False])
def test_sparse_product_either_way(finite):
    """By one matrix product or vector by vector; an infinite vector spoils no row that lacks it."""
    from lumenvec.operators.encode import sparse_product

    rng = np.random.default_rng(5)
    mat = rng.integers(-64, 65, size=(40, 7)) / 64.0
    counts = rng.integers(0, 3, size=(30, 40))
    counts[3] = 0
    counts[:15, 0] = 0
    row, at = np.nonzero(counts)
    if not finite:
        mat[0] = np.inf
    got = sparse_product(row, at, counts[row, at], 30, mat, finite)
    want = np.stack([(mat[c > 0] * c[c > 0][:, None]).sum(axis=0) for c in counts])
    assert np.array_equal(got, want)


def test_token_totals_and_java_pattern(spark):
    """Java's short pattern finds what the tokenizer's own does; counts over batches are those of all rows."""
    from lumenvec.functions.text import JVM_PRETOKEN_PATTERN, PRETOKEN_PATTERN
    from lumenvec.sources.vocab import token_totals

    every = [chr(c) for c in [*range(1, 0x3000), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)]]
    text = [("".join(every),), ("x".join(every),), ("\x0b a_b\x1c9 \u212a\u017f\u0130",), (None,)]
    df = spark.createDataFrame(text, "t string")
    own, short = (F.regexp_extract_all("t", F.lit(p), 0) for p in (PRETOKEN_PATTERN, JVM_PRETOKEN_PATTERN))
    assert df.where(~own.eqNullSafe(short)).count() == 0
    nested = spark.createDataFrame([(["a", "b", "a"],), (None,), ([],), (["b", None],)] * 3, "tokens array<string>")
    assert {r.token: r.n for r in token_totals(nested).collect()} == {"a": 6, "b": 6}
