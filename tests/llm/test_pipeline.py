"""The queries and the pipeline on the smallest tables."""

import random

import brute
import corpus_pipeline
import pytest
from oracle_check import compare
from test_tokens import check_packing

import __spark_entry__ as E
from lumenvec.llm import mixing
from lumenvec.llm.oracle import SQL
from lumenvec.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf001, name):
    assert compare(spark, sf001, [name], verbose=False)[name][0] is True


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name,columns", [
    ("op1_substring_dedup", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
    ("op2_mixing", ["doc_id", "size", "source_size", "target", "taken", "shards"]),
    ("op4_spotsigs", ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]),
    ("op5_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    ("op7_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    ("op8_simhash", ["doc_id", "fingerprint", "component_id"]),
    ("op9_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op13_personal_data", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]),
])
def test_query_covers_the_table(spark, sf001, corpus, name, columns):
    got = QUERIES[name](spark, sf001)
    assert got.columns == columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in corpus]
    if name == "op1_substring_dedup":
        assert {r.doc_id: tuple(r)[1:] for r in rows} == brute.substring_dedup(corpus)
    if name == "op8_simhash":
        assert {r.doc_id: tuple(r)[1:] for r in rows} == brute.simhash_groups(corpus)


def test_pipeline_stages_against_brute_force(spark, sf001, corpus):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    step = lambda n, d: stages[n](spark, d, sf001)
    quality = step(names[0], docs).cache()
    kept = {r.doc_id: r.text for r in quality.collect()}
    verdict = {r.doc_id: r.kept for r in QUERIES["op10_quality_rules"](spark, sf001).collect()}
    assert set(kept) == {d for d, v in verdict.items() if v}
    whole = dict(corpus)
    assert all(set(t.split("\n")) <= set(whole[d].split("\n")) for d, t in kept.items())

    lines = step(names[1], quality).cache()
    want = {d: t for d, t in brute.line_dedup(list(kept.items())).items() if brute.words(t)}
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == want

    near = step(names[2], lines).cache()
    groups = brute.simhash_groups(list(want.items()))
    want = {d: t for d, t in want.items() if groups[d][1] == d}
    assert {r.doc_id: r.text for r in near.collect()} == want

    mixed = step(names[3], near).cache()
    rows = mixed.collect()
    source = {r.doc_id: r.source for r in near.collect()}
    sizes, taken = {}, {}
    for d, t in want.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(brute.words(t))
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
    goal = brute.targets(sizes, (5, 2, 1))
    assert all(abs(taken.get(s, 0) - goal[s]) < 1 for s in sizes)

    packed = step(names[4], mixed).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in rows], 2048)
    assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in (quality, lines, near, mixed))
    assert all(r.n_chars == len(r.text) for r in rows)


def test_mix_stage_gives_shards_in_their_order(spark, docs_of):
    rows = [(i, f"{i} " + "w " * (i * 37 % 300), "abc"[i % 3]) for i in range(900)]
    docs = docs_of(rows, 5)
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, "").collect()]
    want = mixing.mixed(docs).orderBy("shard", "place").collect()
    assert got == [(r.doc_id, r.text) for r in want] and len({r.shard for r in want}) == 16


def test_run_gives_the_packed_pieces(spark, sf001):
    out = corpus_pipeline.run(spark, sf001)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_pipeline_on_hard_rows(spark, docs_of):
    """Null, empty, very long and repeated texts, null ids and sources, and no rows at all, through every stage."""
    rng = random.Random(9)
    some = [f"{a}{b}{c}" for a in ("mar", "ten", "sol", "vir", "pan") for b in ("di", "lo", "ne", "ra") for c in ("n", "ther", "st", "m")]
    told = lambda n: "\n".join(" ".join(rng.choices(some, k=14)).capitalize() + "." for _ in range(n))
    prose, long = told(6), told(4000)
    rows = [(1, None), (2, ""), (3, prose, None), (4, prose, "b"), (4, prose, "b"), (None, prose + "\nAnd so it ended.", "b"), (5, long, "b"), (6, " \n ", "a")]
    docs = docs_of(rows)
    for docs in (docs, docs.where("doc_id > 99")):
        n_in = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").cache()
            n = docs.count()
            assert (n > 0) == (n_in > 0)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
