"""Substring dedup, SimHash near-dedup and SpotSigs against brute force."""

import random

import brute
from pyspark.sql import functions as F

from lumenvec.llm import graph, simhash, spotsigs, substring


def passages(seed=1):
    """Documents of few different words, with passages that are shared, cut and altered."""
    rng = random.Random(seed)
    shared = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.choice([49, 50, 51, 70, 200]))] for k in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]
            p = list(rng.choice(shared))
            kind = rng.random()
            if kind < 0.3:
                p = p[rng.randrange(0, 20) :]
            elif kind < 0.5:
                p[rng.randrange(len(p))] = "changed"
            w += p
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    return rows


def run_substring(docs, **kw):
    out = substring.dedup(docs, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("h"))
    return {r.doc_id: tuple(r)[1:] for r in out.collect()}


def test_substring_against_brute_force(docs_of, corpus):
    for rows in (passages(1), passages(2), corpus):
        assert run_substring(docs_of(rows)) == brute.substring_dedup(rows)


def test_substring_small_windows(docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    assert run_substring(docs_of(rows), window=6, gram=3) == brute.substring_dedup(rows, 6)


def test_substring_passages_repeated_in_one_document(docs_of):
    """A document holds a passage several times, also in two rows; a smaller one holds only part of it."""
    rng = random.Random(12)
    few = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(6):
        p = [f"p{k}w{rng.randrange(40)}" for _ in range(rng.choice([120, 200]))]
        part = p[rng.randrange(5, 25) : -rng.randrange(5, 25)]
        rows.append((10 * k, " ".join(few(20) + part + few(20))))
        rows.append((10 * k + 1, " ".join(few(9) + p + few(30) + p + few(7) + p[30:] + few(3))))
        rows.append((10 * k + 1, " ".join(p + few(40) + p)))
        rows.append((10 * k + 2, " ".join(p + few(5) + part)))
    got = sorted(tuple(r) for r in substring.dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
    # Brute force tells the last row of a doc_id.
    want = {(d, *x) for some in (rows, rows[::-1]) for d, x in brute.substring_dedup(some).items()}
    assert got == sorted(want) and len(got) == len(rows)


def test_substring_hard_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "a " * 30000), (6, "a " * 30000), (None, long), (7, "é " * 49)]
    d = docs_of(rows).withColumn("row", F.lit(1)).withColumn("factors", F.lit(2)).withColumn("kept", F.lit(3))
    out = substring.dedup(d)
    assert out.columns == [*d.columns, "_kept", "n_words", "n_removed", "spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.n_removed for k, r in got.items()} == {1: 0, 2: 60, 3: 0, 4: 0, 5: 0, 6: 30000, None: 0, 7: 0}
    assert [(x["from"], x["to"]) for x in got[2].spans] == [(0, 60)] and got[1]["_kept"] == long and got[3]["_kept"] == ""
    twins = docs_of([(1, long), (1, long), (1, long + " more")])
    assert {r.n_removed for r in substring.dedup(twins).collect()} == {0}  # one document to each other
    assert substring.dedup(d.where("doc_id > 99")).count() == 0


def test_simhash_against_brute_force(docs_of, corpus):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(300)] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, " \n"), (102, "A"), (103, "a"), (104, "A b"), (105, "Ä b c"), (106, "ä b c")]
    for r in (rows, corpus):
        got = simhash.grouped(docs_of(r)).collect()
        assert {x.doc_id: (f"{x.fingerprint & (1 << 64) - 1:016x}", x.component_id) for x in got} == brute.simhash_groups(r)


def test_links_of_full_keys(spark):
    """Fingerprints so dense that keys are full take the other way; the components are the same."""
    rng = random.Random(6)
    values = {0, -1} | {sum(1 << rng.randrange(12) for _ in range(3)) for _ in range(200)} | {rng.getrandbits(63) for _ in range(50)}
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    want = brute.components(sorted(values), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for bucket in (3, 1000):
        found = graph.components(simhash.links(prints, bucket=bucket))
        got = {v: v for v in values} | {r.node: r.root for r in found.collect()}
        assert got == want


def test_components_of_chains(spark):
    n = 300
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)] + [(2000, 2000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000} | {2000 + i: 2000 for i in range(200)}
    assert graph.components(df.where("a < 0")).count() == 0


def test_simhash_dedup_hard_rows(docs_of):
    t = " ".join(f"w{i}" for i in range(50))
    d = docs_of([(3, t), (2, t), (2, t), (None, t), (5, "else"), (6, None), (7, "")]).withColumn("nth", F.lit(1))
    out = simhash.dedup(d)
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, t), (None, t), (5, "else"), (6, None)], key=str)
    assert simhash.dedup(d.where("doc_id > 99")).count() == 0


def plain_likeness(a, b):
    a, b = (set(x[i : i + 8] for i in range(0, len(x), 8)) for x in (a, b))
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def plain_signatures(text, chain=2, gap=8):
    """The signatures as tuples of words: (anchor or nothing, following content words)."""
    words = [w.strip(spotsigs.EDGES) for w in (text or "").lower().split()]
    words = [w for w in words if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    if not content:
        return {(w,) for w in words}
    spots, seen = [], 0
    for w in words:
        if w in spotsigs.ANCHORS:
            spots.append((seen, w))
        else:
            seen += 1
    if not spots:
        spots = [(i, None) for i in range(len(content))]
    else:
        spots = [x for x in spots if x[0] < len(content)] or [(0, spots[0][1])]
        starts = [i for i, _ in spots]
        spots += [(i, None) for i in range(len(content)) if i - max([a for a in starts if a <= i], default=-1) >= gap]
    return {(w, *content[i : i + chain]) for i, w in spots}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_spotsigs_rows(docs_of, corpus):
    """Signatures and likeness against word tuples."""
    lists = [" | ".join(f"item{i * j % 97}" for i in range(60)) for j in (3, 5, 5)]
    rows = [*corpus[:60], (900, None), (901, ""), (902, "the of and"), (903, "nothing common here"), (904, "the end"), (905, "..."),
            (906, "a " + lists[0]), (907, lists[1]), (908, lists[2] + " in the end of it all")]
    got = {r.doc_id: r for r in spotsigs.compared(docs_of(rows)).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(ordered):
        t, follow = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + follow[:half]
        own, edit, after = (plain_signatures(x) for x in (t, new, follow))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(new))
        assert (len(r.fingerprint), len(r.edited_fingerprint)) == (8 * len(own), 8 * len(edit))
        assert r.near_edited == jaccard(own, edit) and r.near_next == jaccard(own, after)
    assert got[906].near_edited > 0.2  # a list with one chance anchor


def test_spotsigs_hard_rows(docs_of):
    d = docs_of([(1, "the cat and the dog"), (1, "the cat and the dog"), (None, "the bird")])
    got = sorted(((r.doc_id, r.near_next) for r in spotsigs.compared(d).collect()), key=str)
    assert len(got) == 3 and (1, 1.0) in got
    one = spotsigs.compared(docs_of([(1, "the cat sat")])).first()  # the next one is itself
    assert one.near_next == 1.0
    assert spotsigs.compared(d.where("doc_id > 9")).count() == 0


def test_spotsigs_of_an_id_that_many_rows_share(docs_of):
    """A hot doc_id is dealt to several parts; each part has one row of the next one."""
    rows = [(7 if i % 3 else None, f"the word{i} of all") for i in range(600)] + [(i, f"the end of {i}") for i in range(20)]
    docs = docs_of(rows)
    parts = {}
    for r in spotsigs.in_order(docs).collect():
        parts.setdefault(r.part, []).append(r)
    sizes = [sum(not r.halo for r in p) for p in parts.values()]
    assert sum(sizes) == len(rows) and max(sizes) < 150 and all(sum(r.halo for r in p) == 1 and p[-1].halo for p in parts.values())
    assert sorted((str(r.doc_id), r.n_chars) for r in spotsigs.compared(docs).collect()) == sorted((str(d), len(t)) for d, t in rows)


def test_spotsigs_pairs(docs_of):
    rng = random.Random(8)
    base = [rng.choice(["the", "of", "and"]) if k % 3 == 0 else f"w{k}" for k in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.02 * (i % 4) else f"z{rng.randrange(99)}" for w in base)) for i in range(25)]
    rows += [(50, None), (51, "the a of")]
    found = spotsigs.prints(docs_of(rows))
    prints = {r.fingerprint for r in found.collect() if r.fingerprint}
    for least in (0.6, 0.8):
        got = {frozenset((r.a, r.b)): r.likeness for r in spotsigs.near_pairs(found, least).collect()}
        want = {frozenset((a, b)): plain_likeness(a, b) for a in prints for b in prints if a < b and plain_likeness(a, b) >= least}
        assert got == want
