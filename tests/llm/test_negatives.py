"""Hard negatives against plain whole-number arithmetic."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenvec.llm import hard_negatives as H

KIND = "vec_id bigint, label int, embedding array<float>, uid string, a int"


def brute(rows):
    live = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        live.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a, la, qa in live:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lab) for i, lab, q in live if i != a and len(q) == len(qa))
        for ps, p in [(-s, i) for s, i, lab in scored if lab == la][:5]:
            found = [(i, -s) for s, i, lab in scored if lab != la and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **m):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = H.mine(H.rows_of(df, label=moved), F.col("id") % 50 == 0, H.Mining(**m))
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(tuple(r) for r in out.collect())


def near(seed, n=400, dim=12, labels=3):
    """Few directions, so windows are full and scores tie."""
    rnd = random.Random(seed)
    ways = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rnd.randrange(labels), [x + rnd.choice([0, 0, 0.25]) * rnd.gauss(0, 1) for x in rnd.choice(ways)], "u", 1) for i in range(n)]


HARD = [
    *near(5, 120), (200, None, [1.0] * 12, "", 0), (201, 1, None, "", 0), (202, 1, [1.0, None] + [0.0] * 10, "", 0),
    (203, 1, [float("nan")] * 12, "", 0), (204, 1, [float("inf")] * 12, "", 0), (None, 1, [1.0] * 12, "", 0), (250, 1, [1.0, 2.0], "", 0),
    (251, 1, [1.0, 2.0], "", 0), (252, 2, [0.9, 1.5], "", 0), (300, 1, [], "", 0), (301, 1, [], "", 0), (302, 2, [], "", 0),
    (350, 4, [0.0] * 12, "", 0), (400, 5, [3e4] * 12, "", 0), (401, 5, [3e4] * 12, "", 0), (402, 6, [2e4] * 12, "", 0), (-50, 1, [-0.5] * 12, "", 0),
]


@pytest.mark.parametrize("rows", [near(1), near(2, 300, 70, 2), [(i, i % 2, [1.0, 0.5] if i % 2 else [0.8, 0.4], None, 0) for i in range(300)], HARD], ids=["near", "wide", "copies", "hard"])
@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 2, "base_rows": 40}], ids=["one", "cells"])
def test_mining_is_exact(spark, rows, sizes):
    want = brute(rows)
    assert want and run(spark, rows, **sizes) == want


def test_repeated_and_empty(spark):
    rows = near(3, 101)
    twice = run(spark, [*rows, rows[60], rows[60]])
    assert twice == brute([*rows, rows[60], rows[60]])
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0], "", 0)]) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 600), st.integers(0, 29), st.integers(0, 2**32 - 1))
def test_residues_give_exact_products(dim, bits, seed):
    rng = np.random.default_rng(seed)
    most = min(2**bits, int((2**60 / dim) ** 0.5))
    a, b = (rng.integers(-most, most + 1, (3, dim)) for _ in range(2))
    a[0], b[0] = most, -most
    primes = H.primes_for(dim, dim * most * most)
    assert all(p % 2 and min(dim, H.PANEL) * (p // 2) ** 2 < H.EXACT for p in primes) and len(set(primes)) == len(primes)
    got = H.exact_products([H.residues(a, p) for p in primes], [H.residues(b, p) for p in primes], primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
