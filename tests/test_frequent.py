"""The most frequent items by summaries, against a plain count."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import reports as R
from lumenvec.operators.frequent import Summary, candidates, most_frequent, summaries
from lumenvec.plans.catalog import SUBWORD64, WORDS64
from lumenvec.sources.tables import table
from lumenvec.sources.vocab import corpus_piece_vocabulary, corpus_word_vocabulary


def counted(rows, n):
    """(group, rank, item, n) by plain counting."""
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, Counter())[x] += 1
    top = {g: sorted(c.items(), key=lambda p: (-p[1], p[0]))[:n] for g, c in groups.items()}
    return sorted(((g, i, x, k) for g, t in top.items() for i, (x, k) in enumerate(t, 1)), key=repr)


def zipf_rows(seed=1):
    """One group of long tail, one with even counts, a small one, a null one, a hot item."""
    rng = np.random.default_rng(seed)
    rows = [("tail", f"w{min(int(x), 10**9)}") for x in rng.zipf(1.3, 12_000)]
    rows += [("even", f"e{i % 3000}") for i in range(6000)]
    rows += [("small", x) for x in ("a", "b", "b", None)] + [("none", None)]
    rows += [(None, f"n{i % 7}") for i in range(100)] + [("hot", "x")] * 4000
    rng.shuffle(rows)
    return [(g, x) for g, x in rows]


def test_a_summary_is_never_short_by_more_than_it_says():
    items = [x for _, x in zipf_rows(2) if x is not None]
    true, s = Counter(items), Summary(64)
    for at in range(0, len(items), 500):
        s.add(pa.table({"0": items[at : at + 500]}))
        assert s.rows <= 8 * 64
    t = s.table()
    counts = dict(zip(t.column("0").to_pylist(), t.column("n").to_pylist()))
    assert len(counts) == t.num_rows <= 64 and 0 < s.short <= len(items) / 64
    assert all(counts.get(x, 0) <= n <= counts.get(x, 0) + s.short for x, n in true.items())
    assert Summary(64).table() is None


@pytest.mark.parametrize("counters", [20, 400, 1 << 16])
def test_first_items_are_exact(spark, counters):
    rows = zipf_rows()
    df = spark.createDataFrame(rows, "g string, x string").repartition(3)
    got = most_frequent(df, ["g"], "x", 5, counters)
    assert got.columns == ["g", "rank", "x", "n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == counted(rows, 5)
    one = most_frequent(df, [], "x", 4, counters).collect()
    assert sorted((tuple(r) for r in one)) == [r[1:] for r in counted([(0, x) for _, x in rows], 4)]


def test_few_items_are_counted_again(spark):
    """Of the long tail few items are left for the second count; even counts are counted whole."""
    rows = zipf_rows()
    df = spark.createDataFrame(rows, "g string, x string").repartition(3)
    pairs, sure = candidates(summaries(df, ["g"], "x", 400), ["g"], "x", 5)
    assert {r.g for r in sure.collect()} >= {"tail"} and "even" not in {r.g for r in sure.collect()}
    n = pairs.where(F.col("g") == "tail").count()
    assert 5 <= n <= len({x for g, x in rows if g == "tail"}) // 20


def test_empty_and_null_only(spark):
    df = spark.createDataFrame([("a", None)], "g string, x string")
    assert most_frequent(df, ["g"], "x").count() == 0 == most_frequent(df.limit(0), ["g"], "x").count()


@pytest.mark.parametrize("kind", ["words", "pieces"])
def test_unknown_tokens_by_summaries(spark, sf001, kind):
    """Equal to the whole count for groups of any name, with summaries that are far too small."""
    docs = table(spark, sf001, "documents").withColumn("token", F.col("lang"))
    vocab, profile = (corpus_word_vocabulary(docs), WORDS64) if kind == "words" else (corpus_piece_vocabulary(docs), SUBWORD64)
    want = R.top_unknown(docs, vocab, profile, ["source", "token"], 3)
    got = R.top_unknown_summarised(docs, vocab, profile, ["source", "token"], 3, counters=200)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
