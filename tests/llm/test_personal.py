"""Personal data: base spans against plain patterns, EM and classifier on planted texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenvec.llm import personal_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and plain_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


PIECES = ["a", ".", "@", "b.c", "-", "1", "22", "255", "256", "0", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "x@y.zz",
          "+1 (555) 555-5555", "10.0.0.1", "\n", "é", "%", "_", ":", "٣", "123456789"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text("a.@-1+ ()25", max_size=40))
def test_base_spans_are_the_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


@pytest.mark.parametrize("unit", ["x", "1", "1 ", "@", "a@", "1.", "+1 ", "(", "+", " ", "4111 1111 1111 1111 ", "[at]", "a.", "+1 (269) 555-3296 "])
def test_long_texts_take_linear_time(unit):
    def took(n):
        text = unit * (n // len(unit))
        t0 = time.process_time()
        P.decided(text, P.Model())
        return time.process_time() - t0

    took(1000)
    assert took(400_000) < 40 * max(took(40_000), 0.05)


def card(rnd):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if plain_luhn(body + c))


def phone(rnd):
    return f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(10**4):04}"


def corpus(seed=3, n=300):
    rnd = random.Random(seed)
    rows, side = [], {}
    for i in range(n):
        words = [rnd.choice(["the", "and", "of", "9", "2021", "3.14", "v1.2.3"]) for _ in range(30)]
        for make in rnd.sample([card, phone, lambda r: f"u{r.randrange(99)}@mail.example.com", lambda r: ".".join(str(r.randrange(1, 224)) for _ in range(4))], 2):
            words.insert(rnd.randrange(len(words)), f"and {make(rnd)} and")
        if i % 10 == 0:  # side by side: the base patterns read one long number
            a, b = phone(rnd), card(rnd)
            side[i] = (a, b)
            words.append(f"and {a} {b} end")
        if i % 7 == 0:
            words.append(f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"')
        rows.append((i, " ".join(words)))
    return rows, side


HARD = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "a@b.cc"), (7, "a@b.cc"), (7, "a@b.cc"), (1003, "999.10.0.0.1 and 10.0.0.2"), (1004, "9" * 5000)]


def test_spans_side_by_side_are_added(spark, docs_of):
    rows, side = corpus()
    docs = docs_of([*rows, *HARD]).withColumns({"spans": F.lit("mine"), "kind": F.lit(1)})
    model = P.train(docs)
    got = P.found(docs, model).collect()
    assert len(got) == len(rows) + len(HARD)
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id in texts and r.doc_id != 7:
            t = texts[r.doc_id]
            assert [(x.kind, x.start, x.end) for x in r.spans if x.base] == plain(t)
            added = {t[x.start : x.end] for x in r.spans if not x.base}
            assert added == set(side.get(r.doc_id, ()))
    by = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in got}
    assert by[1000] == by[1001] == by[1002] == by[1004] == [] and by[None] == [("email", 0, 6)]
    assert ("ip", 17, 25) in by[1003]


def test_empty_and_clean(spark, docs_of):
    assert P.found(docs_of([]), P.train(docs_of([]))).count() == 0
    clean = docs_of([(1, "nothing at all here. 12 or 3.5 of 2020")])
    assert P.found(clean, P.train(clean)).collect()[0].spans == []


def test_em_finds_reliabilities():
    """Votes drawn from known labelers: EM comes near their hit rates without labels."""
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.6
    rates = [0.9, 0.8, 0.75, 0.6, 0.95]
    votes = np.stack([np.where(rng.random(len(truth)) < r, np.where(truth, 1, -1), np.where(truth, -1, 1)) for r in rates], axis=1)
    seen, n = np.unique(votes, axis=0, return_counts=True)
    prior, no, yes, p = P.estimate([(tuple(v.tolist()), int(c)) for v, c in zip(seen, n)])
    assert abs(prior - 0.6) < 0.03
    assert np.allclose([y[2] for y in yes], rates, atol=0.03) and np.allclose([x[0] for x in no], rates, atol=0.03)
    best = {tuple(v.tolist()): q for v, q in zip(seen, p)}
    assert np.mean([(best[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_written_out_address():
    text = "mail to jane.doe (at) example (dot) org today"
    [x] = P.candidates(text, P.base_spans(text), P.islands(text))
    assert text[x[1] : x[2]] == "jane.doe (at) example (dot) org"
    assert P.masked("a b@c.dd e", [("email", 2, 8)]) == "a [EMAIL] e"
