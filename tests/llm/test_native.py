"""Quality rules, line dedup and mixing: facts against plain code, and hard rows."""

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from lumenvec.llm import line_dedup, mixing, quality_rules

PROSE = "The quick brown fox jumps over the lazy dog again and again until it is tired."
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, PROSE + "\n" + PROSE.replace("quick", "slow") + "\n" + PROSE), (4, PROSE),
    (5, "a b c d e f g h " * 5000), (6, "| Home | About | News | Contact | More |\n" * 5 + PROSE), (7, "x\n\n \ny\nx\n"),
    (None, PROSE), (8, "\n".join(f"{PROSE} {i}." for i in range(3000))),
]


def test_quality_facts(docs_of):
    q = quality_rules.judge(docs_of(ROWS)).select("doc_id", "text", "quality.*").collect()
    assert len(q) == len(ROWS)
    for r in q:
        t = r.text or ""
        w = brute.words(t)
        lines = [x for x in t.split("\n") if brute.words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == (brute.repeat_words(w) if len(w) < 20000 else 40000 if r.doc_id == 5 else brute.repeat_words(w))
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_line_rules(docs_of):
    sea = ["by the sea", "in town", "at a lake", "up north", "on an island", "near the old mill"]
    good = "\n".join(f"{x.capitalize()} day number {i} was calm and {x} all was quiet." for i, x in enumerate(sea))
    bad = ["| Home | About | Contact |", "HELLO WORLD THIS IS LOUD", "Please accept cookies to go on.", "Menu", "a*** b%%% c###", "f() { x; }"]
    more = "\n".join(f"Another one, number {i}, speaks about rain in the hills and the wind." for i in "ab")
    rows = [(i, f"{good}\n{b}\n{more}") for i, b in enumerate(bad)]
    rows.append((99, "\n".join([good.split("\n")[0] + " And some more words for it.", *["| a | b | c | d |"] * 20])))
    got = {r.doc_id: r for r in quality_rules.clean(docs_of(rows)).collect()}
    assert set(got) == set(range(len(bad)))
    for i, b in enumerate(bad):
        assert got[i].text == f"{good}\n{more}"


def test_phrases_are_words_of_short_lines(docs_of):
    """Phrases inside longer words, or in long lines, condemn nothing; unspaced prose ends its sentences."""
    inside = "They design in the morning and assign in the afternoon, so nobody will resign in anger before the long day is over at last. And so on."
    long = "Under the privacy policy of the club every member may speak at the meeting, read the old books and take one home for a week or two."
    prose = "\n".join(f"今天天气很好我们去公园散步{i}{end}" for i, end in zip(range(30), "。！？" * 10))
    menu = "\n".join([inside, long, "Read our privacy policy here.", "Sign in"])
    got = {r.doc_id: r.text for r in quality_rules.clean(docs_of([(1, inside), (2, long), (3, prose), (4, menu)])).collect()}
    assert got == {1: inside, 2: long, 3: prose, 4: f"{inside}\n{long}"}


def test_quality_clash_and_empty(spark, docs_of):
    d = docs_of([(1, PROSE + " After that it sleeps for an hour and dreams.")]).withColumn("quality", F.lit(1)).withColumn("w", F.lit(2))
    out = quality_rules.judge(d)
    assert out.columns == [*d.columns, "_quality"] and out.first()["_quality"].kept
    assert quality_rules.clean(d).columns == d.columns
    assert quality_rules.judge(d.where("doc_id > 5")).count() == 0 == quality_rules.clean(d.where("doc_id > 5")).count()


def test_line_dedup_against_brute_force(docs_of):
    rng = random.Random(3)
    for window in (2, 3):
        rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d e"]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
        rows += [(100, None), (101, ""), (102, "a\n" * 500), (103, "a\n" * 500)]
        out = line_dedup.dedup(docs_of(rows), window=window)
        assert {r.doc_id: r.text for r in out.collect()} == brute.line_dedup(rows, window)


def test_line_dedup_few_long_lines(docs_of):
    """Runs of one or two lines count when they have enough words."""
    rng = random.Random(4)
    lines = ["a b", "c", "d " * 5, "e " * 6, "f g h i", "", "x " * 12]
    for alone in (5, 8):
        rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
        out = line_dedup.dedup(docs_of(rows), alone=alone)
        assert {r.doc_id: r.text for r in out.collect()} == brute.line_dedup(rows, 3, alone)
    long = " ".join(f"w{i}" for i in range(60))
    out = line_dedup.dedup(docs_of([(1, long), (2, long), (3, f"own line\n{long}\nlast")])).collect()
    assert {r.doc_id: r.text for r in out} == {1: long, 2: "", 3: "own line\nlast"}


def test_line_dedup_hard_rows(docs_of):
    run = "one line\ntwo lines\nthree lines\nfour lines"
    d = docs_of([(7, run), (7, run), (7, "else\n" + run), (8, "new\n" + run), (None, run), (9, None)]).withColumn("gone", F.lit("x"))
    out = line_dedup.dedup(d.withColumn("n_lines", F.lit(-1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "n_lines", "_n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    # A null doc_id is the first of all; the equal rows are each other's equals.
    assert (None, run, 0) in got and (9, None, 0) in got and (8, "new", 4) in got and got.count((7, "", 4)) == 2
    assert (7, "else", 4) in got
    assert line_dedup.dedup(d.where("doc_id > 100")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000, 100000]) for i in range(rng.randrange(1, 12))} | {None: 7}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = brute.targets(sizes, (5, 2, 1))
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_hypergeometric_draws(spark):
    n = 4000
    for total, marked, drawn in ((50, 20, 25), (9, 8, 4), (10, 3, 10), (7, 0, 3), (7, 7, 3), (1000, 990, 500)):
        df = spark.range(n).select(
            mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), (F.col("id") + 0.5) / n).alias("x")
        )
        got = {r.x: r.k / n for r in df.groupBy("x").agg(F.count("*").alias("k")).collect()}
        low, high = max(0, drawn - total + marked), min(marked, drawn)
        law = {x: math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn) for x in range(low, high + 1)}
        assert set(got) <= set(law) and all(abs(got.get(x, 0) - p) < 2e-3 for x, p in law.items())


def test_quotas_add_up(spark):
    owed = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "rank int, blocks bigint")
    q = {r["rank"]: r.quotas for r in mixing.shard_quotas(owed).collect()}
    assert {k: sum(v) for k, v in q.items()} == {1: 1000, 2: 37, 3: 0, 4: 5} and all(len(v) == 16 for v in q.values())
    whole = [sum(v[i] for v in q.values()) for i in range(16)]
    assert max(whole) - min(whole) <= 1  # every shard has as many blocks


def mix_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for i in range(400)]
    return rows + [(500, None, "a"), (501, "w " * 30000, "b"), (None, "x y z", "a"), (502, "twin text", "c"), (502, "twin text", "c")]


def test_mix_meets_targets(docs_of):
    rows = mix_rows()
    p = mixing.plan(docs_of(rows)).collect()
    assert len(p) == len(rows)
    again = mixing.plan(docs_of(rows, 7)).collect()
    key = lambda r: (str(r.doc_id), r.taken, str(r.copies))
    assert sorted(p, key=key) == sorted(again, key=key)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in p:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and sum(c.n for c in r.copies) == r.taken
    want = brute.targets(sizes, (5, 2, 1))
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) < 1 for s in sizes)


def test_mixed_rows(docs_of):
    rows = mix_rows()
    d = docs_of(rows).withColumn("shard", F.lit("own")).withColumn("taken", F.lit(0))
    out = mixing.mixed(d)
    assert out.columns == [*d.columns, "_shard", "place"]
    got = out.collect()
    assert sum(len(brute.words(r.text)) for r in got) == sum(r.taken for r in mixing.plan(d).collect())
    assert {r["_shard"] for r in got} <= set(range(16))
    text = {r[0]: r[1] for r in rows}
    assert all((text[r.doc_id] or "").split()[: len(r.text.split())] == r.text.split() for r in got)
    assert mixing.mixed(d.where("doc_id > 1000")).count() == 0 == mixing.plan(d.where("doc_id > 1000")).count()


def test_taken_follows_from_blocks(spark, docs_of):
    """Block by block: whole or not at all but for one, quotas by the tree; other blocks take others, the sums stay."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    d = docs_of(rows)
    source = {r[0]: r[2] for r in rows}
    found = {}
    for name, mix in {"one": mixing.Mix(block=200), "block": mixing.Mix(block=90), "depth": mixing.Mix(block=200, depth=1)}.items():
        goal, _ = mixing.dealt(d, mix, "text", "doc_id", "source")
        block = {r.doc_id: (r["rank"], r.block) for r in mixing.in_blocks(d, goal, mix, "text", "doc_id", "source").collect()}
        p = mixing.plan(d, mix).collect()
        of_block, shards, cut = {}, {}, {}
        for r in p:
            for c in r.copies:
                of_block.setdefault((block[r.doc_id], c.epoch), set()).add(c.shard)
                shards.setdefault(c.shard, set()).add((block[r.doc_id], c.epoch))
                if c.n < r.size:
                    cut.setdefault(block[r.doc_id][0], []).append(r.doc_id)
        for r in p:
            for e in range(2):
                if (block[r.doc_id], e) in of_block and all(c.epoch != e for c in r.copies):
                    cut.setdefault(block[r.doc_id][0], [])  # left out by the cut: its block is the source's one cut block
        assert all(len(v) == 1 for v in of_block.values())
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) == 2**mix.depth
        assert all(len(v) <= 1 for v in cut.values())
        sums = {}
        for r in p:
            sums[source[r.doc_id]] = sums.get(source[r.doc_id], 0) + r.taken
        found[name] = ({r.doc_id: r.taken for r in p}, sums, {r.doc_id: [c.shard for c in r.copies] for r in p})
    one, other, deep = found["one"], found["block"], found["depth"]
    assert one[1] == other[1] == deep[1]
    assert one[0] != other[0] and one[0] == deep[0] and one[2] != deep[2]
