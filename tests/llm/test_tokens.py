"""Encoding, token counts, token files, packing and toxicity."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenvec.llm import packing, token_counts, token_files, toxicity
from lumenvec.llm.encoding import encoder, library, tokenizer_path

PATH = tokenizer_path()
PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", "1", "½", "é", "ſ", "\xa0", "　", " ", "\x1c", "\x85", "​", "。", "😀", "!!", "...",
          "<|endoftext|>", "<|end", "\t", "\r\n", "ß", "Ǆ", "x,", "***",
          "|", "_", "-", "@", "\"", "`", "x***", "a_b", "^", "~"]
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "hello world, it's me\nthe end."), (4, "hello world, it's me\nthe end."),
    (5, "word " * 9000), (6, "x" * 30000), (7, "<|endoftext|> a <|endoftext|>"), (None, "no id"), (8, "é\n" * 5000), (9, "<|endoftext|>"),
]


def ids_of(text):
    return library(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=60))
def test_units_give_the_librarys_ids(text):
    assert encoder(PATH).ids(text) == np.array(ids_of(text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join), st.integers(8, 40), st.integers(1, 8))
def test_chunks_resynchronise(text, chunk, overlap):
    assert token_counts.count_tokens(encoder(PATH), text, chunk, overlap) == len(ids_of(text))


def test_overlap_is_widened(monkeypatch):
    """One part longer than any overlap: the chunk reaches back to the last proven place."""
    enc = encoder(PATH)
    for text in ("a " + "x" * 3000 + " b c", " " * 700 + "a", "<|endoftext|>" * 40, "1234" * 500):
        for chunk, overlap in ((50, 4), (64, 32), (700, 16)):
            assert token_counts.count_tokens(enc, text, chunk, overlap) == len(ids_of(text))


def test_unbroken_texts_take_linear_work(monkeypatch):
    """Characters given to the library for a text without any stable place: a few times its length."""
    enc, read = encoder(PATH), []
    plain = token_counts.parts
    monkeypatch.setattr(token_counts, "parts", lambda e, t: read.append(len(t)) or plain(e, t))
    for n in (40_000, 160_000):
        read.clear()
        text = "".join(chr(0x4E00 + (i * 7919) % 20_000) for i in range(n))
        assert token_counts.count_tokens(enc, text, 2048, 64) == len(ids_of(text))
        assert sum(read) < 8 * n


def test_counted_rows(docs_of):
    d = docs_of(ROWS).withColumn("n_tokens", F.lit("mine"))
    out = token_counts.counted(d, PATH, chunk=1000, overlap=16)
    assert out.columns == [*d.columns, "n_bytes", "_n_tokens"]
    got = sorted(((str(r.doc_id), r.n_bytes, r["_n_tokens"]) for r in out.collect()))
    assert got == sorted((str(i), len((t or "").encode()), len(ids_of(t))) for i, t in ROWS)
    assert token_counts.counted(d.where("doc_id > 99"), PATH).count() == 0


def as_ids(text):
    return np.array([*ids_of(text), 0], "<u4")


@pytest.mark.parametrize("length,rows", [(2048, 64), (16, 3), (1, 1)])
def test_token_files_round_trip(docs_of, length, rows):
    data = [r for r in ROWS if r[0] != 5 or length > 1]
    files = token_files.write(docs_of(data), PATH, length=length, rows=rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(files).collect()), key=lambda r: r[1])
    want, at = [], 0
    for d, t in sorted(data, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        x = as_ids(t)
        want.append((-1 if d is None else d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    # Random access: the sequences of all files, put together, are the stream.
    stream = np.concatenate([as_ids(t) for _, t in sorted(data, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))])
    parts = []
    for f in files.orderBy("part").collect():
        assert f.file.startswith("file:///")  # made whole on the driver
        reader = token_files.SequenceReader(f.file)
        own = [reader.sequence(i) for i in reversed(range(len(reader)))][::-1]
        if length % 8 == 0:
            assert not any(m.flags.owndata for _, m in own)  # the mask's bits are a view too
        own = [(i, token_files.unpacked(m, length)) for i, m in own]
        assert all(len(i) == len(m) == length for i, m in own) and all(m.all() for _, m in own[:-1])
        if length > 1:
            assert not own[0][0].flags.owndata  # a view of the mapped file
        parts += [i[m] for i, m in own]
    assert np.array_equal(np.concatenate(parts), stream)


def test_token_files_of_an_empty_table(docs_of):
    files = token_files.write(docs_of(ROWS).where("doc_id > 99"), PATH)
    assert files.count() == 0 and token_files.read(files).count() == 0


def check_packing(got, rows, size):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = []
    for d, t in rows:
        x, at, piece = as_ids(t), 0, 0
        while at < len(x):
            n = (len(x) - at) % size or size
            want.append((str(d), piece, at, n, zlib.crc32(x[at : at + n].tobytes())))
            at, piece = at + n, piece + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    return len(by)


def test_packing_is_whole_and_tight(docs_of, corpus):
    for rows, plan in ((corpus, packing.Plan()), (ROWS, packing.Plan()), (corpus, packing.Plan(size=300, shard=64, epochs=3, islands=3))):
        got = packing.pack(docs_of(rows), PATH, plan).collect()
        n = check_packing(got, rows, plan.size)
        assert n <= 1.03 * sum(r.length for r in got) / plan.size + 8 * (plan.shard < 1000) + 1
    assert packing.pack(docs_of(ROWS).where("doc_id > 99"), PATH).count() == 0


def test_crossing_improves_and_keeps_every_piece():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(20, 60, 300))[::-1].astype(np.int64) * 10
    plan = packing.Plan(size=1000, crossings=40)
    first = packing.begin(lengths, plan, rng)
    for giver in first:
        child = packing.cross(lengths, giver, first[0], plan, rng)
        fill = np.bincount(child, weights=lengths)
        assert len(child) == len(lengths) and fill.max() <= plan.size and fill.min() > 0
    done = packing.evolve(lengths, first, plan, rng)
    best = max(packing.fitness(lengths, g, plan.size) for g in first)
    assert packing.fitness(lengths, done[0], plan.size) >= best and len(done) == plan.population


def test_crossing_beats_the_first_population():
    """Lengths on which best fit leaves room: children of crossings need fewer sequences."""
    gains = 0
    for seed in range(3):
        rng = np.random.default_rng(seed)
        lengths = np.sort(rng.integers(200, 520, 400))[::-1].astype(np.int64)
        plan = packing.Plan(size=1000, crossings=150, inject=0.1)
        first = packing.begin(lengths, plan, rng)
        done = packing.evolve(lengths, first, plan, rng)
        before = max(packing.fitness(lengths, g, plan.size) for g in first)
        after = packing.fitness(lengths, done[0], plan.size)
        assert after >= before
        gains += after > before
    assert gains == 3


def plain_risk(theta, rows, pos, long, prior):
    """(whole risk, its second part) of the linear score, text by text."""
    z = np.array([sum(theta[f] * v for f, v in zip(*r)) + theta[-2] + theta[-1] * n for r, n in zip(rows, long)])
    as_pos, as_neg = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
    rest = as_neg[~pos].mean() - prior * as_neg[pos].mean()
    return prior * as_pos[pos].mean() + rest, rest


def test_risk_steps_follow_finite_differences():
    """Against the risk's slope, or up its second part where that is below zero."""
    rng, seen = np.random.default_rng(2), set()
    rows = [(sorted(rng.choice(6, 3, replace=False).tolist()), rng.random(3).tolist()) for _ in range(40)]
    pos, long = np.arange(40) < 15, rng.random(40)
    row = np.repeat(np.arange(40), 3)
    flat, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    for prior in (0.1, 0.5, 0.9):
        for _ in range(20):
            theta = rng.normal(size=8)
            grad, rest = toxicity.risk_step(theta, row, flat.astype(int), value, long, pos, prior)
            assert np.isclose(rest, plain_risk(theta, rows, pos, long, prior)[1])
            seen.add(bool(rest < 0))
            for k in range(8):
                d = np.zeros(8)
                d[k] = 1e-6
                up, down = (plain_risk(theta + x, rows, pos, long, prior) for x in (d, -d))
                want = (up[0] - down[0] if rest >= 0 else down[1] - up[1]) / 2e-6
                assert np.isclose(grad[k], want, atol=1e-7)
    assert seen == {True, False}


def test_best_fit_takes_the_tightest_room():
    group = [0, 0, 0]
    assert packing.best_fit([3, 5, 4], [0, 1, 2], 10, group, [4, 3, 10]) == 3
    assert group == [1, 2, 0]  # 3 into room 3, 5 into 10, 4 into 4


def test_nnpu_on_held_out_rows(spark, sf001):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").select("doc_id", "score", "toxic", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.h]
    hit = sum(r.toxic == 1 and r.score >= 0.3 for r in held)
    assert hit >= 0.8 * sum(r.toxic for r in held) and hit >= 0.75 * sum(r.score >= 0.3 for r in held)


def test_risk_never_learns_positives_by_heart():
    """Positives that look like everything else: the corrected risk keeps scores at the prior."""
    rng = np.random.default_rng(1)
    n = 400
    indices = [rng.choice(50, 5, replace=False) for _ in range(n)]
    values = [np.ones(5)] * n
    positive = np.arange(n) < 60
    w, bias, by = toxicity.fit_nnpu(indices, values, np.zeros(n), positive, 50, 0.2)
    z = np.array([w[i].sum() + bias for i in indices])
    p = 1 / (1 + np.exp(-z))
    assert abs(p[~positive].mean() - 0.2) < 0.1


def test_toxicity_sample_has_one_text_for_each_label(spark, docs_of):
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100, 300)], "doc_id bigint, quality int, toxic int")
    known = [k for k in range(100, 300) if zlib.crc32(str(k).encode()) % 4 != 2]
    hot = next(k for k in known if k % 5 == 0)
    rows = [(k, f"words {k}") for k in range(100, 300)] + [(hot, f"other words {i}") for i in range(500)]
    found, prior = toxicity.sample(docs_of(rows), labels)
    got = [tuple(r) for r in found.collect()]
    assert sorted(p for p, _ in got) == sorted([False] * len(known) + [True] * sum(k % 5 == 0 for k in known))
    assert len(set(got)) == len(got) and prior == sum(k % 5 == 0 for k in known) / len(known)


def test_toxicity_hard_rows(spark, docs_of):
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100, 300)] + [(None, 1, 1), (101, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = [(k, f"some words {k} and more" + (" awful horrid" if k % 5 == 0 else "")) for k in range(100, 300)]
    rows += [(None, "awful"), (1, None), (2, ""), (3, "awful " * 40000), (4, "plain words"), (4, "plain words")]
    model = toxicity.train(docs_of(rows), labels)
    got = toxicity.scored(docs_of(rows), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and by[1] == by[2] and by[3] > 5 * by[4] and by[None] > 5 * by[4]
    none = toxicity.train(docs_of(rows), labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(docs_of(rows), none).collect()} == {0.0}
    empty = docs_of(rows).where("doc_id > 999")
    assert toxicity.scored(empty, toxicity.train(empty, labels)).count() == 0
    assert math.isclose(model.prior, 0.2, abs_tol=0.06)
