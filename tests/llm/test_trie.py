"""Conversation prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenvec.llm import conversation_trie as T

KIND = "conv_id bigint, turn bigint, role string, text string, digest string"


def rebuilt_rows(rows):
    """{conv_id: [(role, text), ...]} by the contract."""
    own = {}
    for c, n, r, t, *_ in rows:
        if c is not None:
            r, t = r or "", t or ""
            tie = hashlib.md5(f"{len(r)}:{r}:{t}".encode()).digest()
            own.setdefault(c, []).append(((n is not None, n or 0), tie, (r, t)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += cost
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def made(seed, n=60, copies=0):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rnd.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, k, rnd.choice(["user", "bot", None]), rnd.choice(["", "a", "é", None, "long text"]), "x"))
    for c in range(n, n + copies):  # one large group of copies
        rows += [(c, k, "user", f"same {k}", None) for k in range(11)]
    return rows


def key_of(x):
    return tuple((v is not None, v) for v in x)


HARD = [
    (0, None, "user", "first", "z"), (0, 3, None, None, "z"), (0, 3, None, None, "z"), (0, 3, "user", "tie", "z"), (None, 0, "user", "no id", "z"),
    (6, 0, "user", "x" * 50_000, "z"), (7, 0, "user", "", "z"), (8, 0, "user", "a:1", "z"), (9, 0, "user:1", "a", "z"), (33, 0, "user", "alone", "z"),
    (34, 0, "user", "alone", "z"), (10**12, 0, "user", "alone", "z"),
]


@pytest.mark.parametrize("rows", [made(1), made(2, 40, 300), made(3, 5), HARD, [(7, 0, "u", "t", None)]], ids=["mixed", "copies", "few", "hard", "one"])
@pytest.mark.parametrize("parts", [1, 7])
def test_trie_is_whole(spark, rows, parts):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    out = T.trie(T.rebuilt(T.sequences(df)), parts)
    assert out.columns == list(T.NODE)
    got = [tuple(r)[:-1] for r in out.collect()]
    assert sorted(got, key=key_of) == sorted(brute(rebuilt_rows(rows)), key=key_of)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "user", "no id", None)], KIND)
    assert T.trie(T.rebuilt(T.sequences(df))).count() == 0
    assert T.trie(T.rebuilt(T.sequences(df.where("turn > 5")))).count() == 0


def test_long_conversation(spark):
    """One conversation of many turns and one that leaves it late, over parts."""
    rows = [(c, k, "user", f"t{k if k < 1500 else c * 10_000 + k}", None) for c in (0, 5, 10) for k in range(2000)]
    got = [tuple(r)[:-1] for r in T.trie(T.rebuilt(T.sequences(spark.createDataFrame(rows, KIND))), 3).collect()]
    # Depths of brute() are quadratic here: count instead.
    seqs = rebuilt_rows(rows)
    assert len(got) == len({hashlib.md5(repr(s[:d]).encode()).digest() for s in seqs.values() for d in range(0, len(s) + 1, 1)}) == 3001
    assert sum(r[3] for r in got if r[1] == 1500) == 3 and max(r[5] for r in got) == 3


def test_texts_of_nodes(spark):
    df = spark.createDataFrame(HARD, KIND)
    out = T.with_turns(T.trie(T.rebuilt(T.sequences(df))), df).where("depth = 1").collect()
    want = {s[0] for s in rebuilt_rows(HARD).values() if s}
    assert {(r.last_role, r.last_text) for r in out} == want and ("user", "alone") in want
    digests = T.turn_rows(df, keep=("role", "text")).collect()
    assert len({r.digest for r in digests}) == len({(r.role or "", r.text or "") for r in digests})  # "user:1", "a" is not "user", "a:1"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_range_minima(values, data):
    table = T.RangeMin(np.array(values))
    at = np.array([data.draw(st.integers(0, len(values) - 1))])
    bound = np.array([data.draw(st.integers(0, 7))])
    assert table.right(at, bound)[0] == next((i for i in range(at[0], len(values)) if values[i] < bound[0]), len(values))
    assert table.left(at, bound)[0] == next((i for i in range(at[0], -1, -1) if values[i] < bound[0]), -1)
    hi = np.array([data.draw(st.integers(at[0] + 1, len(values)))])
    assert table.least(at, hi)[0] == min(values[at[0] : hi[0]])
