"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits; two fingerprints link when they differ in at
most ``max_bits`` of them. Equal fingerprints fall together first, so copies
cost nothing further on.

Candidates: the bits form a ring of ``segments`` segments. If two fingerprints
differ in t <= max_bits places, some start on the ring has *every* chain of l
consecutive segments from it holding at most l * max_bits / segments
differences. While that budget is below one, the segments must be equal; these
make a join key (28 bits with 9 segments and 2 bits). The longer chains are
compared in the join, then the full distance.

A key that more than ``bucket`` fingerprints share is not compared pair by
pair. Its fingerprints go the exact way for dense places: each sends itself
and its 64 one-bit neighbours; two fingerprints at most 2 bits apart meet at
one of these values, and at most 65 different fingerprints can meet at one, so
linking them all to the smallest is bounded work and loses no component.

Defined results: null and blank texts have the fingerprint zero and link like
any other; a null doc_id is nobody's smallest unless all are null; equal rows
are in one component; an empty table gives an empty result; other columns pass
through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.common import fresh
from lumenvec.llm.graph import components
from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 9
BUCKET = 256
SEED = 42


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
        counts, n = np.unpackbits(np.array([hash_of(grams[0], SEED)], ">u8").view(np.uint8)).astype(np.int64), 1
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):  # so many shingles' bits at a time
            to = min(n, at + (1 << 15))
            spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())
            h = np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64).astype(">u8")
            counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n)
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_id, fingerprint): one row a document, in Arrow batches where the text lies."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = pa.array([simhash(x, shingle) for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["doc_id", "text_id", "fingerprint"])

    # The ids keep their type; text_id tells rows with one doc_id apart.
    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_id"), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"doc_id {kind}, text_id long, fingerprint long")


def sizes_of(segments: int) -> list[int]:
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def chains(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(start, key, turned, cuts, fingerprint): each fingerprint turned to every
    start on the ring. ``key``: the segments that must be equal; ``cuts``: for
    budgets 1, 2, ... how many bits from the right lie outside the chain."""
    sizes = sizes_of(segments)
    turns = []
    for s in range(segments):
        off = sum(sizes[:s])
        ring = sizes[s:] + sizes[:s]
        f = F.col("fingerprint")
        turned = f if not off else F.shiftleft(f, off).bitwiseOR(F.shiftrightunsigned(f, 64 - off))
        # The longest chain whose budget is still b differences.
        longest = [-(-(b + 1) * segments // max_bits) - 1 for b in range(max_bits)]
        cuts = [64 - sum(ring[:n]) for n in longest]
        turns.append(
            F.struct(
                F.lit(s).alias("start"),
                F.shiftrightunsigned(turned, cuts[0]).alias("key"),
                turned.alias("turned"),
                F.array(*[F.lit(c) for c in cuts[1:]]).cast("array<int>").alias("cuts"),
            )
        )
    return prints.select("fingerprint", F.explode(F.array(*turns)).alias("x")).select("x.*", "fingerprint")


def within(a: Column, b: Column, cuts: Column, max_bits: int) -> Column:
    """The chains from this start keep to their budgets, and the whole distance does."""
    x = a.bitwiseXOR(b)
    ok = F.bit_count(x) <= max_bits
    for k in range(1, max_bits):
        ok = ok & (F.bit_count(F.call_function("shiftrightunsigned", x, F.get(cuts, F.lit(k - 1)))) <= k)
    return ok


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the same components
    as all pairs at most ``max_bits`` apart. ``prints`` has each fingerprint once."""
    if max_bits > 2:
        raise ValueError("the way for full keys covers up to 2 bits")
    rows = chains(prints, max_bits, segments)
    count = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(rows.join(count.where("n > 1"), ["start", "key"]), "simhash-chains")

    a = shared.where(F.col("n") <= bucket).select("start", "key", F.col("turned").alias("t"), "cuts", F.col("fingerprint").alias("a"))
    b = shared.where(F.col("n") <= bucket).select("start", "key", F.col("turned").alias("u"), F.col("fingerprint").alias("b"))
    near = a.join(b, ["start", "key"]).where(
        (F.col("a") < F.col("b")) & within(F.col("t"), F.col("u"), F.col("cuts"), max_bits)
    )

    dense = shared.where(F.col("n") > bucket).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    meets = dense.select(
        "fingerprint", F.explode(F.transform(flips, lambda x: F.col("fingerprint").bitwiseXOR(x))).alias("value")
    )
    met = meets.groupBy("value").agg(F.collect_set("fingerprint").alias("all")).where(F.size("all") > 1)
    star = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return near.select("a", "b").unionByName(star).distinct()


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_id, fingerprint, component_id): the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs, text, key, shingle), "simhash")
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    own = materialize(own, "simhash-distinct")
    root = components(links(own.select("fingerprint"), max_bits))
    linked = own.join(root, F.col("fingerprint") == F.col("node"))
    first = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked.join(first, "root").select(F.col("fingerprint").alias("f"), "component_id")
    label = own.join(of, F.col("fingerprint") == F.col("f"), "left").select(
        "fingerprint", F.when(F.col("f").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")
    )
    # Written first: a join of two plain reads is split where a fingerprint is hot.
    label = materialize(label, "simhash-label")
    return prints.join(label, "fingerprint").select("doc_id", "text_id", "fingerprint", "component_id")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the one whose doc_id names it. Of rows
    that agree in doc_id and text one stays; rows without a doc_id stay."""
    kept, kept_text, nth = fresh(docs, "kept_id", "kept_text", "nth")
    g = grouped(docs, text, key, shingle, max_bits)
    one = g.where("doc_id = component_id").select(F.col("doc_id").alias(kept), F.col("text_id").alias(kept_text)).distinct()
    # A doc_id with several texts in the component keeps the smallest text_id.
    one = one.groupBy(kept).agg(F.min(kept_text).alias(kept_text))
    same = (F.col(f"`{key}`") == F.col(kept)) & (F.xxhash64(f"`{text}`") == F.col(kept_text))
    w = Window.partitionBy(kept, kept_text).orderBy(F.lit(0))
    out = docs.join(one, same).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(kept, kept_text, nth)
    return out.unionByName(docs.where(F.col(f"`{key}`").isNull()))
