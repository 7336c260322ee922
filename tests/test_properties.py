"""Properties: encoders agree, results do not depend on batching or
partitioning, embeddings are unit length, failures stay per row."""

import numpy as np
import pytest
from helpers import make_vocab, texts
from pyspark.sql import functions as F

from lumenvec.operators.encode import fixture_vectors
from lumenvec.operators.onnx_batch import OnnxEncoder
from lumenvec.operators.search import topk_similar
from lumenvec.plans.catalog import WORDS64, fixture_onnx
from lumenvec.plans.pipeline import embed
from lumenvec.sources.model_fixture import gather_model, static_matrix
from lumenvec.sources.requests import parse_requests
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return table(spark, sf001, "documents").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def vocab(docs):
    return corpus_word_vocabulary(docs)


def as_dict(df):
    return {r.doc_id: np.array(r.embedding, dtype=np.float64) for r in df.select("doc_id", "embedding").collect()}


def test_static_equals_onnx_and_unit_norm(docs, vocab):
    a = as_dict(embed(docs, vocab, WORDS64, fixture_vectors(vocab, 64), dtype="double"))
    b = as_dict(embed(docs, vocab, WORDS64, fixture_onnx(vocab), dtype="double"))
    assert a.keys() == b.keys() and len(a) == docs.count()
    for k in a:
        assert np.max(np.abs(a[k] - b[k])) < 1e-9
        assert abs(np.linalg.norm(a[k]) - 1) < 1e-9


def test_onnx_batch_size_invariance(docs, vocab):
    enc = fixture_onnx(vocab)
    one = OnnxEncoder(model_bytes=enc.model_bytes, dim=64, max_batch_rows=1)
    many = OnnxEncoder(model_bytes=enc.model_bytes, dim=64, max_batch_rows=16, max_batch_tokens=4096)
    a = as_dict(embed(docs, vocab, WORDS64, one))
    b = as_dict(embed(docs, vocab, WORDS64, many))
    for k in a:
        assert np.max(np.abs(a[k] - b[k])) < 1e-5


def test_partition_count_invariance(docs, vocab):
    enc = fixture_vectors(vocab, 64)
    a = as_dict(embed(docs.repartition(1), vocab, WORDS64, enc, dtype="double"))
    b = as_dict(embed(docs.repartition(7), vocab, WORDS64, enc, dtype="double"))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_embed_twice_same(docs, vocab):
    enc = fixture_vectors(vocab, 64)
    a = as_dict(embed(docs, vocab, WORDS64, enc))
    b = as_dict(embed(docs, vocab, WORDS64, enc))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_onnx_bad_row_does_not_fail_batch(spark):
    # "bad" maps to id 50, outside the 10-row model matrix: Gather fails.
    v = make_vocab(spark, {"good": 4, "bad": 50}, {"[CLS]": 1, "[SEP]": 2})
    enc = OnnxEncoder(model_bytes=gather_model(static_matrix(10, 8)), dim=8)
    res = {r.doc_id: r for r in embed(texts(spark, ["good", "bad good", "good good"]), v, WORDS64, enc).collect()}
    assert res[1].error and res[1].embedding is None
    assert res[0].error is None and res[2].error is None and len(res[0].embedding) == 8


def test_static_missing_vector_is_error(spark):
    from lumenvec.operators.encode import StaticEncoder

    v = make_vocab(spark, {"a": 4}, {"[CLS]": 1, "[SEP]": 2})
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    res = embed(texts(spark, ["a"]), v, WORDS64, StaticEncoder(vectors=vec, dim=2)).first()
    assert res.embedding is None and "no vector" in res.error


def test_requests_shapes(spark):
    lines = spark.createDataFrame(
        [('{"id": 1, "command": "infer", "text": "hi"}',), ('{"id": 2, "inputs": ["a", "b"]}',),
         ('{"id": 3, "command": "ping"}',), ('{"id": 4, "command": "infer", "text": "x"',)],
        "value string",
    )
    rows = sorted((r.request_id or 0, r.idx, r.text, r.error) for r in parse_requests(lines).collect())
    assert (1, 0, "hi", None) in rows and (2, 0, "a", None) in rows and (2, 1, "b", None) in rows
    assert (3, 0, None, "Unknown command") in rows
    assert any(e == "invalid JSON" for *_, e in rows)


def test_topk_matches_brute_force_and_blocks(spark, sf001):
    e = table(spark, sf001, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    pdf = e.toPandas()
    ids = pdf["doc_id"].to_numpy()
    m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -np.inf)
    want = set()
    for i, q in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:3]
        want |= {(int(q), r + 1, int(ids[j])) for r, j in enumerate(order)}
    for block in (4096, 97):
        got = topk_similar(e.withColumnRenamed("doc_id", "query_id"), e, 3, exclude_self=True, block=block)
        assert {(r.query_id, r.rank, r.doc_id) for r in got.collect()} == want


def test_incremental_second_run_encodes_nothing(spark, docs, vocab, tmp_path):
    from lumenvec.operators.store import embed_incremental

    path = str(tmp_path / "store")
    enc = fixture_vectors(vocab, 64)
    fn = lambda df: embed(df, vocab, WORDS64, enc, keep=["text_hash"])
    first = embed_incremental(spark, docs, path, fn, WORDS64.name)
    assert first == docs.select(F.sha2("text", 256)).distinct().count()
    assert embed_incremental(spark, docs, path, fn, WORDS64.name) == 0


def test_shuffled_and_row_local_encoders_agree(docs, vocab):
    enc = fixture_vectors(vocab, 100)
    a = as_dict(embed(docs, vocab, WORDS64, enc, dtype="double"))
    b = as_dict(embed(docs, vocab, WORDS64, enc, dtype="double", max_shipped=0))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k], equal_nan=True) for k in a)


@pytest.mark.parametrize("dim", [64, 768])
def test_pooling_has_one_rule_for_any_dim(spark, dim):
    from lumenvec.operators.pooling import masked_mean_pool

    rng = np.random.default_rng(7)
    rows = []
    for doc in range(6):
        for pos in range(5):
            mask = 0 if (doc == 5 or pos == 2) else 1
            rows.append((doc, pos, rng.normal(size=dim).tolist(), mask))
    rows.append((6, 0, [float("nan")] * dim, 0))  # NaN under mask 0 stays NaN
    rows.append((6, 1, [1.0] * dim, 1))
    rows.append((7, 0, None, 1))  # no vector at all: zeros
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, hidden array<double>, attention bigint").repartition(5)
    found = {r.doc_id: r for r in masked_mean_pool(df, dim).collect()}
    got = {k: np.array(r.pooled) for k, r in found.items()}
    for doc in range(6):
        h = np.array([r[2] for r in rows if r[0] == doc])
        m = np.array([r[3] for r in rows if r[0] == doc], dtype=float)
        assert np.allclose(got[doc], (h * m[:, None]).sum(0) / max(m.sum(), 1e-9), atol=1e-12)
    assert np.all(got[5] == 0) and np.all(got[7] == 0) and np.isnan(got[6]).all()
    assert found[7].n_missing == 1 and found[6].n_rows == 2


def test_topk_without_vectors_or_queries(spark):
    e = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [float("nan")] * 2), (4, [0.0, 1.0]), (5, [1.0, 0.0])], "doc_id bigint, embedding array<double>"
    )
    q = e.withColumnRenamed("doc_id", "query_id")
    got = {tuple(r) for r in topk_similar(q, e, 2).collect()}
    assert got == {(1, 1, 1, 1.0), (1, 2, 5, 1.0), (4, 1, 4, 1.0), (4, 2, 1, 0.0), (5, 1, 1, 1.0), (5, 2, 5, 1.0)}
    assert topk_similar(q.where("query_id > 9"), e, 2).count() == 0
    assert topk_similar(q, e.where("doc_id > 9"), 2).count() == 0


def test_requests_take_strings_only(spark):
    lines = spark.createDataFrame(
        [('{"id": 1, "inputs": [3, "a", null]}',), ('{"id": 2, "command": "infer", "text": 5}',), ('{"id": 3, "inputs": []}',)], "value string"
    )
    rows = sorted((r.request_id, r.idx, r.text, r.error) for r in parse_requests(lines).collect())
    assert rows == [(1, 0, None, "missing text"), (1, 1, "a", None), (1, 2, None, "missing text"), (2, 0, None, "missing text")]


def test_error_rows_never_hide_a_good_one(spark, tmp_path):
    from lumenvec.operators.store import STORE_COLUMNS, append, latest, read_errors, read_store

    ddl = "text_hash string, profile string, task string, run_id string, run_ts timestamp, embedding array<float>, dim int, n_tokens bigint, error string"
    import datetime as dt

    day = lambda k: dt.datetime(2024, 1, k)
    rows = [("a", "p", None, "r1", day(1), [1.0], 1, 1, None), ("a", "p", None, "r2", day(2), None, None, 1, "bad"),
            ("b", "p", "t", "r1", day(1), [1.0], 1, 1, None), ("b", "p", "t", "r2", day(2), [2.0], 1, 1, None)]
    df = spark.createDataFrame(rows, ddl)
    assert {(r.text_hash, r.run_id) for r in latest(df).collect()} == {("a", "r1"), ("b", "r2")}
    path = str(tmp_path / "s")
    assert append(df.select(*STORE_COLUMNS), path) == 3
    assert read_store(spark, path).count() == 3 and read_errors(spark, path).count() == 1
    assert {(r.text_hash, r.run_id) for r in latest(read_store(spark, path)).collect()} == {("a", "r1"), ("b", "r2")}


def test_stream_equals_batch_for_task_model(spark, docs, tmp_path):
    """O26 with the subword profile and a task model: the streaming result
    equals the batch embedding of the same texts."""
    from lumenvec.plans.catalog import SUBWORD64, fixture_onnx, fixture_tasks
    from lumenvec.sources.requests import request_lines
    from lumenvec.sources.vocab import corpus_piece_vocabulary
    from lumenvec.streaming.stream import embed_stream, request_stream, run_available

    v = corpus_piece_vocabulary(docs)
    enc = fixture_onnx(v, with_tasks=True)
    tasks = fixture_tasks(spark)
    src = str(tmp_path / "in")
    request_lines(docs, "doc_id", "text").repartition(3).write.text(src)
    res = embed_stream(request_stream(spark, src, 1), v, SUBWORD64, enc, tasks=tasks, dtype="double")
    run_available(res, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    streamed = as_dict(spark.read.parquet(str(tmp_path / "out")).withColumnRenamed("request_id", "doc_id"))
    batch = as_dict(embed(docs, v, SUBWORD64, enc, dtype="double", tasks=tasks))
    assert streamed.keys() == batch.keys()
    assert all(np.max(np.abs(streamed[k] - batch[k])) < 1e-12 for k in batch)
