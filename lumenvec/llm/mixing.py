"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

A source's documents are bundled by their hash into *blocks* of about ``block``
words. A source's blocks stand in a random order, another one for each round;
the mix takes blocks in that order, a second round following the first where the
target is more than the source (it is at most twice), until the target's words
are reached; only the very last block is cut, and of its documents one. So the
number of blocks a source owes is exact.

The owed blocks are dealt to the output shards by a binary tree: at each node
the left half of the shards gets half of the node's blocks, and how many of
them come from each source is a draw from the multivariate hypergeometric
distribution (inversion over ten standard deviations about the mode; what lies
beyond is less than a double can tell). The children's quotas add up to their
parent's. A leaf reads its quota of each source as the next disjoint range of
the permuted blocks and puts its documents in an order by hash. What is taken
of a document follows from its block: another block size or seed takes others,
another depth deals them to other shards; the sums stay the same.

Plan: word counts are taken once and written as a narrow table (no text), and
added up by block before any shuffle. Running sums are over blocks, not documents,
and have two levels, so a source holding a third of all rows is spread. A
document finds its block by its own hash, and its copies with the block: documents
are neither numbered nor sorted, but for those of the one cut block of a source.
The tree works on one array for each node, with as many entries as there are
sources: meant for up to some hundred thousand sources.

Defined results: null and blank texts have size 0, are taken 0 times and are
in no shard; a null source is a source, last in order; rows with equal doc_id
are separate documents; rows that agree in doc_id and text share a block; an
empty table gives an empty mix; other columns pass through. Reruns agree: all
draws come from hashes of ``seed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import bind, fresh, n_words, words
from lumenvec.plans.strategy import materialize


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in code point order, repeating; ``share``
    of all words is the mix's size; no source gives more than ``most`` times
    its own; ``depth``: the tree's levels, 2 ** depth shards; ``block``: words
    of a block, about."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    depth: int = 4
    block: int = 4096
    seed: int = 20240611


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, rank, n_docs, source_size, target) from rows (source, size).

    Filling to a level: with lambda words for each unit of weight a source
    gets min(most * size, weight * lambda). Sources in order of
    most * size / weight stop first, so running sums tell who stops and what
    is left for the rest; that is where resharing the excess again and again
    ends."""
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    s = s.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.get(cycle, (F.col("rank") - 1) % len(mix.weights))
    )
    s = s.withColumn("cap", (F.col("source_size") * mix.most).cast("double")).withColumn("stop", F.col("cap") / F.col("weight"))
    up = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = s.withColumns(
        {
            "all": F.sum("source_size").over(everything) * F.lit(mix.share),
            "capped": F.sum("cap").over(up),
            "rest": F.sum("weight").over(everything) - F.sum("weight").over(up),
        }
    )
    s = s.withColumn("stops", F.col("capped") + F.col("stop") * F.col("rest") <= F.col("all"))
    s = s.withColumns(
        {
            "stopped": F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(F.lit(0.0))).over(everything),
            "going": F.sum(F.when(F.col("stops"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything),
        }
    )
    level = (F.col("all") - F.col("stopped")) / F.when(F.col("going") > 0, F.col("going"))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return s.select("source", "rank", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the hash of a key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls are marked, of ``total`` balls with ``marked``
    marked ones: the inverse of the distribution function at ``u``, over the
    values in the order mode, mode + 1, ..., then mode - 1, mode - 2, ..."""

    def limits(x: Column) -> Column:
        low = F.greatest(F.lit(0.0), x["n"] - (x["t"] - x["m"]))
        high = F.least(x["m"], x["n"])
        mode = F.least(high, F.greatest(low, F.floor((x["n"] + 1) * (x["m"] + 1) / (x["t"] + 2)).cast("double")))
        part = x["m"] / x["t"]
        spread = F.sqrt(x["n"] * part * (1 - part) * (x["t"] - x["n"]) / F.greatest(F.lit(1.0), x["t"] - 1))
        reach = F.ceil(spread * 10 + 10).cast("double")
        return F.struct(
            x["m"].alias("m"), x["n"].alias("n"), (x["t"] - x["m"] - x["n"]).alias("rest"), x["u"].alias("u"), mode.alias("mode"),
            F.least(high, mode + reach).alias("up"), F.greatest(low, mode - reach).alias("down"),
        )

    def walk(b: Column, step: int, need: Column) -> Column:
        """From the mode outwards, its weight being 1: the sum of the weights on
        this side (the mode's own only upwards), and where the sum reaches ``need``."""
        start, stop = b["mode"] + step, b["up"] if step > 0 else b["down"]
        some = start * step <= stop * step
        xs = F.when(some, F.sequence(start.cast("long"), F.when(some, stop).otherwise(start).cast("long"), F.lit(step).cast("long")))

        def next_one(a: Column, x: Column) -> Column:
            x = x.cast("double")
            if step > 0:
                ratio = (b["m"] - x + 1) * (b["n"] - x + 1) / (x * (b["rest"] + x))
            else:
                ratio = (x + 1) * (b["rest"] + x + 1) / ((b["m"] - x) * (b["n"] - x))
            p = a["p"] * ratio
            here = a["x"].isNull() & (a["sum"] + p >= need)
            return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.when(here, x).otherwise(a["x"]).alias("x"))

        own = F.lit(1.0 if step > 0 else 0.0)
        zero = F.struct(F.lit(1.0).alias("p"), own.alias("sum"), F.when(own >= need, b["mode"]).alias("x"))
        return F.aggregate(F.coalesce(xs, F.array().cast("array<bigint>")), zero, next_one)

    def invert(b: Column) -> Column:
        never = F.lit(float("inf"))
        sums = F.struct(walk(b, 1, never)["sum"].alias("up"), walk(b, -1, never)["sum"].alias("down"))

        def pick(s: Column) -> Column:
            need = b["u"] * (s["up"] + s["down"])
            above = F.coalesce(walk(b, 1, need)["x"], b["up"])
            return F.when(need <= s["up"], above).otherwise(F.coalesce(walk(b, -1, need - s["up"])["x"], b["down"]))

        return bind(sums, pick)

    def draw(x: Column) -> Column:
        some = bind(bind(x, limits), invert)
        return F.when((x["n"] <= 0) | (x["m"] <= 0), F.lit(0.0)).when(x["m"] >= x["t"], x["n"]).otherwise(some)

    given = F.struct(
        total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("n"), u.alias("u")
    )
    return bind(given, draw).cast("long")


def shard_quotas(owed: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(rank, quotas): for each source its blocks for shards 0, 1, ... in order.

    ``owed`` has (rank, blocks), a row for each source. A node of the tree is a
    row with the array of its blocks by source; splitting it is one pass over
    the array, drawing source after source from what is left of the node."""
    node = owed.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("b")).select(
        F.lit(0).cast("long").alias("shard"),
        F.transform("b", lambda x: x["rank"].cast("long")).alias("ranks"),
        F.transform("b", lambda x: x["blocks"].cast("long")).alias("n"),
    )

    def draw(a: Column, x: Column) -> Column:
        u = uniform(F.lit(mix.seed), F.col("level"), F.col("shard"), x["rank"])
        return bind(
            hypergeometric(a["total"], x["n"], a["drawn"], u),
            lambda n: F.struct(
                (a["total"] - x["n"]).alias("total"),
                (a["drawn"] - n).alias("drawn"),
                F.concat(a["left"], F.array(n)).alias("left"),
            ),
        )

    whole = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        F.col("whole").alias("total"),
        # An odd block goes left or right by the parity of the node.
        F.floor((F.col("whole") + F.col("shard") % 2) / 2).cast("long").alias("drawn"),
        F.array().cast("array<bigint>").alias("left"),
    )
    pairs = F.transform("n", lambda x, i: F.struct(F.get(F.col("ranks"), i).alias("rank"), x.alias("n")))
    left = F.aggregate(pairs, start, draw)["left"]
    both = F.array(
        F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("n")),
        F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("n", "left", lambda x, y: x - y).alias("n")),
    )
    for level in range(mix.depth):
        split = node.withColumn("whole", whole).withColumn("level", F.lit(level)).withColumn("left", left)
        node = split.select("ranks", F.explode(both).alias("x")).select("x.shard", "ranks", "x.n")
    rows = node.select("shard", F.explode(F.arrays_zip("ranks", "n")).alias("x"))
    by = rows.groupBy(F.col("x.ranks").alias("rank")).agg(F.array_sort(F.collect_list(F.struct("shard", "x.n"))).alias("q"))
    return by.select("rank", F.transform("q", lambda x: x["n"]).alias("quotas"))


def in_blocks(docs: DataFrame, goal: DataFrame, mix: Mix, text: str, key: str, source: str) -> DataFrame:
    """Rows of ``docs`` with ``size``, ``h`` (an order within a block) and the columns of ``goal``
    and ``block``; the names are those of ``goal`` and must be free in ``docs``."""
    seeded = lambda n: F.xxhash64(F.lit(mix.seed + n), F.col(f"`{key}`"), F.col("t"))
    own = docs.withColumns({"size": n_words(f"`{text}`"), "t": F.xxhash64(F.col(f"`{text}`"))})
    own = own.withColumns({"h": seeded(0), "block_hash": seeded(1)}).drop("t")
    wide = own.join(goal.withColumnRenamed("source", "own"), F.col(f"`{source}`").eqNullSafe(F.col("own"))).drop("own")
    return wide.withColumn("block", F.pmod("block_hash", F.col("n_blocks"))).drop("block_hash")


def block_copies(words_of: DataFrame, goal: DataFrame, mix: Mix) -> DataFrame:
    """(rank, block, copies, cut): for every block that is taken its copies (epoch, shard, n), n
    in words; ``cut``: one of them ends before the block does. ``words_of``: (rank, block, words)."""
    filled = words_of.where("words > 0").join(goal.select("rank", "source_size", "quota"), "rank")
    turns = filled.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(mix.most)])))
    # Two levels of running sums: of parts of the order by hash, and within a part.
    turns = turns.withColumn("p", F.xxhash64(F.lit(mix.seed + 2), "rank", "block", "epoch"))
    turns = turns.withColumn("part", F.shiftrightunsigned("p", 56))
    turns = materialize(turns, "mix-blocks")
    parts = turns.groupBy("rank", "epoch", "part").agg(F.sum("words").alias("part_words"), F.count(F.lit(1)).alias("part_blocks"))
    up = Window.partitionBy("rank").orderBy("epoch", "part")
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    parts = parts.select("rank", "epoch", "part", before("part_words", up).alias("base"), before("part_blocks", up).alias("first"))
    inside = Window.partitionBy("rank", "epoch", "part").orderBy("p", "block").rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumns({"at": before("words", inside), "nth": F.row_number().over(inside) - 1}).join(parts, ["rank", "epoch", "part"])
    left = F.col("quota") - F.col("base") - F.col("at")
    placed = placed.withColumns({"n": F.least("words", left), "nth": F.col("first") + F.col("nth")}).where("n > 0")
    placed = materialize(placed.select("rank", "block", "epoch", "n", "words", "nth"), "mix-taken")

    every = goal.select("rank").join(placed.groupBy("rank").agg(F.count(F.lit(1)).alias("blocks")), "rank", "left")
    quotas = shard_quotas(every.select("rank", F.coalesce("blocks", F.lit(0)).alias("blocks")), mix)

    def shard_of(nth: Column) -> Column:
        """The shard whose range of blocks holds this one: quotas before it are used up."""
        return F.aggregate(
            "quotas",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
            lambda a, q: F.struct(
                (a["sum"] + q).alias("sum"),
                (a["shard"] + F.when(a["sum"] + q <= nth, F.lit(1)).otherwise(F.lit(0))).alias("shard"),
            ),
        )["shard"]

    dealt = placed.join(quotas, "rank").withColumn("copy", F.struct("epoch", shard_of(F.col("nth")).alias("shard"), "n"))
    return materialize(dealt.groupBy("rank", "block").agg(
        F.array_sort(F.collect_list("copy")).alias("copies"), F.max(F.col("n") < F.col("words")).alias("cut")), "mix-copies")


def with_copies(wide: DataFrame, blocks: DataFrame) -> DataFrame:
    """``in_blocks`` rows with ``copies``: (epoch, shard, n) for each time the mix takes the row, n in words."""
    met = wide.join(blocks, ["rank", "block"], "left")
    none = F.array().cast("array<struct<epoch:int,shard:int,n:bigint>>")
    whole = lambda n: F.transform("copies", lambda c: F.struct(c["epoch"].alias("epoch"), c["shard"].alias("shard"), n(c).cast("long").alias("n")))
    taken = F.filter(whole(lambda c: F.col("size")), lambda c: c["n"] > 0)
    rest = met.where(~F.coalesce("cut", F.lit(False))).withColumn("copies", F.coalesce(taken, none))
    # The one cut block of a source: its documents in the order of their hash, up to the copy's words.
    inside = Window.partitionBy("rank", "block").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = met.where("cut").withColumn("before", F.sum("size").over(inside) - F.col("size"))
    upto = whole(lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), c["n"] - F.col("before"))))
    cut = cut.withColumn("copies", F.filter(upto, lambda c: c["n"] > 0)).drop("before")
    return rest.unionByName(cut).drop("cut")


def dealt(docs: DataFrame, mix: Mix, text: str, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(goal, blocks): each source's target, and the copies of its blocks."""
    sizes = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counted = sizes.select("source", "key", n_words("text").alias("size"), F.xxhash64("text").alias("t"))
    counted = materialize(counted, "mix-sizes")
    goal = targets(counted, mix).select(
        "source", "rank", "source_size", "target", F.floor("target").cast("long").alias("quota"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / mix.block).cast("long")).alias("n_blocks"),
    )
    goal = materialize(goal, "mix-targets")
    ranked = counted.join(goal.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    block = F.pmod(F.xxhash64(F.lit(mix.seed + 1), "key", "t"), F.col("n_blocks"))
    words_of = ranked.groupBy("rank", block.alias("block")).agg(F.sum("size").alias("words"))
    return goal, block_copies(words_of, goal, mix)


def plan(docs: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): a row for each document.

    ``copies``: array of (epoch, shard, n): what the mix takes of it, one entry
    for each round of the source's blocks that reaches it."""
    goal, blocks = dealt(docs, mix, text, key, source)
    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    out = with_copies(in_blocks(lean, goal, mix, "text", "doc_id", "source").drop("text"), blocks)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, with ``shard`` and
    ``place`` (a random order inside the shard). The document at the end of a
    source's target has its first ``n`` words, joined by one space."""
    shard, place = fresh(docs, "shard", "place")
    goal, blocks = dealt(docs, mix, text, key, source)
    names = [f"own_{i}" for i in range(len(docs.columns))]  # no name clashes with the mix's own
    of = dict(zip(docs.columns, names))
    wide = in_blocks(docs.toDF(*names), goal, mix, of[text], of[key], of[source])
    out = with_copies(wide, blocks).withColumn("copy", F.explode("copies"))
    cut = F.array_join(F.slice(words(of[text]), F.lit(1), F.col("copy.n").cast("int")), " ")
    kept = [F.when(F.col("copy.n") == F.col("size"), F.col(n)).otherwise(cut) if c == text else F.col(n) for c, n in of.items()]
    order = F.xxhash64(F.lit(mix.seed + 3), "h", F.col("copy.epoch"))
    return out.select(*[x.alias(c) for x, c in zip(kept, of)], F.col("copy.shard").alias(shard), order.alias(place))
