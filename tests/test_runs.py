"""Tables of runs, the store on them, and the streaming sink."""

import json

import pytest
from pyspark.sql import functions as F

from lumenvec.operators import store as S
from lumenvec.operators.encode import fixture_vectors
from lumenvec.plans.catalog import WORDS64
from lumenvec.plans.pipeline import embed
from lumenvec.sources.requests import parse_requests
from lumenvec.sources.runs import RunTable
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_word_vocabulary
from lumenvec.streaming import stream as T


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return table(spark, sf001, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def vocab(docs):
    return corpus_word_vocabulary(docs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, lo, hi):
    return spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v"))


def test_runs_are_whole_and_written_once(spark, tmp_path):
    t = RunTable(spark, str(tmp_path / "t"), "k string, v bigint", "k", 8)
    assert t.read().count() == 0 and t.runs() == {}
    assert t.append(rows_of(spark, 0, 100), "it's r/1") == 100
    assert t.append(rows_of(spark, 0, 7), "it's r/1") == 100  # there already
    assert t.append(rows_of(spark, 90, 120), "r2") == 30 and t.append(rows_of(spark, 0, 0), "r3") == 0
    assert {(r.run_id, r.n) for r in t.read().groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("it's r/1", 100), ("r2", 30)}
    # Files without a commit are not read, neither here nor in another session.
    t._write(rows_of(spark, 500, 600), "lost")
    assert t.read().count() == 130 and RunTable(spark.newSession(), t.path, "k string, v bigint", "k").read().count() == 130
    assert t.append(rows_of(spark, 500, 600), "lost") == 100 and t.read().count() == 230
    assert t.compact(lambda d: d.groupBy("k").agg(F.max("v").alias("v")), "all") == 220
    assert t.runs() == {"all": 220} and t.read().count() == 220


def test_commits_meet(spark, tmp_path):
    """A writer whose manifest number is taken commits on top of the other's."""
    t = RunTable(spark, str(tmp_path / "t"), "k string, v bigint", "k", 4)
    plain, first = t.manifest(), []
    t.append(rows_of(spark, 0, 3), "a")

    def change(runs):
        if not first:  # between reading the manifest and publishing the next one
            first.append(1)
            t.append(rows_of(spark, 0, 5), "b")
        return {"c": {"folder": "none", "rows": 0}} | runs

    t._commit(change)
    assert plain[0] == 0 and set(t.runs()) == {"a", "b", "c"}


def test_store_side_is_not_shuffled(spark, docs, vocab, tmp_path):
    path = str(tmp_path / "s")
    enc = fixture_vectors(vocab, 64)
    fn = lambda df: embed(df, vocab, WORDS64, enc, keep=["text_hash"])
    S.embed_incremental(spark, docs.where("doc_id < 100"), path, fn, WORDS64.name)
    stored = S.read_store(spark, path)
    assert "Exchange" not in plan(S.latest(stored)) and "Bucketed: true" in plan(S.latest(stored))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = plan(S.pending(docs, stored, WORDS64.name))
        right = todo[todo.index("FileScan parquet spark_catalog") - 400 :]
        assert "LeftAnti" in todo and "Exchange" not in right
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_run_of_errors_only_does_not_end_the_store(spark, docs, vocab, tmp_path):
    path = str(tmp_path / "s")
    enc = fixture_vectors(vocab, 64)
    none = lambda df: embed(df, vocab, WORDS64, enc.__class__(enc.vectors.where("id < 0"), 64), keep=["text_hash"])
    some = lambda df: embed(df, vocab, WORDS64, enc, keep=["text_hash"])
    n = docs.select(S.text_hash()).distinct().count()
    assert S.embed_incremental(spark, docs, path, none, WORDS64.name) == 0 and S.read_errors(spark, path).count() == n
    assert S.embed_incremental(spark, docs, path, some, WORDS64.name) == n
    assert S.embed_incremental(spark, docs, path, some, WORDS64.name) == 0
    assert S.compact(spark, path) == n and S.embed_incremental(spark, docs, path, some, WORDS64.name) == 0


def test_skip_list_gives_the_same_texts(spark, docs, vocab, tmp_path):
    """With the filter and without it the same texts are new; texts that are there skip the shuffle."""
    path = str(tmp_path / "s")
    assert S.maybe_stored(spark, path) is None
    enc = fixture_vectors(vocab, 64)
    fn = lambda df: embed(df, vocab, WORDS64, enc, keep=["text_hash"])
    for part in (docs.where("doc_id < 60"), docs.where("doc_id < 120")):
        S.embed_incremental(spark, part, path, fn, WORDS64.name)
    hard = docs.unionByName(docs.where("doc_id > 150")).unionByName(spark.createDataFrame([(900, None), (None, "no id")], docs.schema))
    stored = S.read_store(spark, path)
    rows = lambda df: sorted(map(str, df.collect()))
    known = S.maybe_stored(spark, path)
    for profile, task in ((WORDS64.name, None), ("other", None), (WORDS64.name, "t")):
        plain = rows(S.pending(hard, stored, profile, task))
        assert plain and rows(S.pending(hard, stored, profile, task, maybe=known)) == plain
    there = {r.text_hash for r in stored.collect()}
    told = hard.select(S.text_hash().alias("h")).withColumn("m", known("h")).collect()
    assert all(r.m for r in told if r.h in there) and sum(r.m for r in told if r.h not in there) <= 1


LINES = [
    {"id": 1, "inputs": ["the", "a b", ""]}, {"id": 2, "command": "infer", "text": "of the"}, {"id": 3, "command": "ping"},
    {"id": 4, "inputs": [None, "x"]}, {"id": 5, "inputs": []}, {"id": 2, "command": "infer", "text": "of the"},
]


def sinks(spark, out):
    good = T.results_table(spark, out, "double").read().select("request_id", "idx", "n_tokens", "run_id").collect()
    bad = T.errors_table(spark, out).read().select("request_id", "idx", "error", "run_id").collect()
    return sorted(map(tuple, good)), sorted(map(tuple, bad))


def test_a_batch_tried_again_changes_nothing(spark, vocab, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(json.dumps(x),) for x in LINES] + [("{bad",)], "value string")
    req, out, store = parse_requests(lines), str(tmp_path / "out"), str(tmp_path / "store")
    enc = fixture_vectors(vocab, 64)
    real = RunTable.append

    def failing(self, rows, run_id):  # after the results, before the errors
        if self.path.endswith("/errors"):
            raise OSError("lost")
        return real(self, rows, run_id)

    monkeypatch.setattr(RunTable, "append", failing)
    with pytest.raises(OSError):
        T.write_batch(req, "q-0", vocab, WORDS64, enc, out, dtype="double", store=store)
    monkeypatch.undo()
    assert [len(x) for x in sinks(spark, out)] == [6, 0]
    for _ in range(2):
        T.write_batch(req, "q-0", vocab, WORDS64, enc, out, dtype="double", store=store)
    good, bad = sinks(spark, out)
    assert [x[:3] for x in good] == [(1, 0, 3), (1, 1, 4), (1, 2, 2), (2, 0, 4), (2, 0, 4), (4, 1, 3)]
    assert [x[2] for x in bad if x[0] in (3, 4)] == ["Unknown command", "missing text"] and len(bad) == 3
    assert S.read_store(spark, store).count() == 5  # distinct texts
    T.write_batch(req.where("request_id < 0"), "q-1", vocab, WORDS64, enc, out, dtype="double")
    assert [len(x) for x in sinks(spark, out)] == [6, 3]


def test_stream_resumes_with_its_own_runs(spark, vocab, tmp_path):
    """Two starts of one query; tables beyond the bound are embedded in blocks by the micro-batches."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    enc = fixture_vectors(vocab, 64)

    def go(lines):
        spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.mode("append").text(src)
        T.run_into_store(T.request_stream(spark, src, 1), vocab, WORDS64, enc, out, ck, dtype="double", max_shipped=0)

    go(LINES[:3])
    go(LINES[3:])
    good, bad = sinks(spark, out)
    assert len(good) == 6 and len(bad) == 2 and len({x[-1] for x in good}) == 2
    with pytest.raises(ValueError, match="micro-batches"):
        embed(T.request_stream(spark, src).withColumnRenamed("request_id", "doc_id"), vocab, WORDS64, enc, max_shipped=0)
