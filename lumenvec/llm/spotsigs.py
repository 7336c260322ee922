"""Document fingerprints: SpotSigs.

After every *anchor*, a common word of the language, the next ``chain``
content words (words that are no anchors) are read as one signature; a text's
fingerprint is the set of its signatures. Menus, lists and licence lines have
few common words and so few signatures; running prose has many.

A fingerprint is written as a string: the sorted 32-bit hashes, eight
hexadecimal digits each. The likeness of two fingerprints is the Jaccard
coefficient of their sets. Equal texts have equal fingerprints.

``near_pairs`` finds the pairs of a corpus: fingerprints are partitioned by
set length so that a pair of the wanted likeness lies in one partition or two
neighbouring ones, meet at the rarest signatures (enough of them that no pair
is missed) and are compared with the Jaccard coefficient, pruned by the
lengths first.

Words are lower-cased, without punctuation at their ends. Where ``GAP`` content
words or more have gone by without an anchor (lists, tables, other languages),
each word is read as if an anchor stood before it, and so is each word of a text
without any anchor; this looks at the words before alone, so an edit changes
the signatures near it only. At the end of a text a chain is as long as there
are words.

Defined results: a null or blank text has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0; a null doc_id is the
smallest; rows with one doc_id follow each other by a hash of their text; an
empty table gives an empty result; other columns are not read. A doc_id that
many rows share is dealt to several tasks by that hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """a and are at be by for from in is it of on or that the this to was with
    als auf das dem den der des die ein eine für ich im in ist mit nicht sich und von zu
    au aux dans de des du en est et la le les par pas pour que qui sur un une
    al como con de del el en es la las los no para por que se su un una y""".split()
)
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¡¿"
CHAIN = 2
GAP = 8
WORD_CACHE = 1 << 19


class Words(dict):
    """The hash of a raw lower-case word; its last bit tells an anchor; 1 and 0
    alone are no words (nothing but punctuation)."""

    def __missing__(self, raw: str) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        w = raw.strip(EDGES)
        self[raw] = h = (xxhash.xxh3_64_intdigest(w.encode()) & ~1 | (w in ANCHORS)) if w else 0
        return h


def signatures(text: str | None, words: Words, chain: int = CHAIN):
    """The sorted, distinct 32-bit signatures of a text."""
    import numpy as np

    raw = (text or "").lower().split()
    h = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    h = h[h != 0]
    if not len(h):
        return np.zeros(0, np.uint32)
    anchor = (h & np.uint64(1)).astype(bool)
    content = np.concatenate((h[~anchor], np.zeros(chain, np.uint64)))
    real = len(content) - chain
    if not real:  # anchors only: each is its own signature
        return np.unique((h >> np.uint64(32)).astype(np.uint32))
    if anchor.any():
        first, lead = np.cumsum(~anchor)[anchor], h[anchor]
        if (first < real).any():
            first, lead = first[first < real], lead[first < real]
        else:
            first, lead = np.zeros(1, np.int64), lead[:1]
        # Words far behind the last anchor stand for themselves.
        at = np.arange(real)
        last = np.searchsorted(first, at, side="right") - 1
        far = at[at - np.where(last >= 0, first[last], -1) >= GAP]
        first, lead = np.concatenate((first, far)), np.concatenate((lead, np.zeros(len(far), np.uint64)))
    else:
        first, lead = np.arange(real), np.zeros(real, np.uint64)
    s = lead
    for k in range(chain):
        s = (s ^ content[first + k]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(31)
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


def fingerprint(signs) -> str:
    return signs.astype(">u4").tobytes().hex()


def likeness(a, b, least: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets; 0 where their lengths, or
    the whole comparison, tell that it is under ``least``."""
    import numpy as np

    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (small + large - both)
    return found if found >= least else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Parts:
    """Parts of the rows in the order of falling rank, then rising hash.

    ``cuts`` are quantiles of the ranks; a rank that several of them hit is shared by very
    many rows, which go to as many parts of their own, by their hash."""

    def __init__(self, cuts: list[int]) -> None:
        import numpy as np

        self.cuts, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        width = np.concatenate((np.where(self.times > 1, self.times + 1, 1), [1]))
        self.before = np.cumsum(width[::-1])[::-1] - width  # parts of greater ranks

    def of(self, ranks, hashes):
        import numpy as np

        at = np.searchsorted(self.cuts, ranks, side="left")
        inner = np.minimum(at, max(len(self.cuts) - 1, 0))
        if not len(self.cuts):
            return np.zeros(len(ranks), np.int64)
        times = np.where((at < len(self.cuts)) & (self.times[inner] > 1), self.times[inner], 0)
        share = ((hashes.astype(np.float64) / 2.0**64 + 0.5) * times).astype(np.int64)
        hot = (times > 0) & (self.cuts[inner] == ranks)
        return self.before[at] + np.where(hot, np.minimum(share, np.maximum(times - 1, 0)), times)


def in_order(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(part, halo, rank, doc_id, text): the rows dealt to parts by falling doc_id, sorted
    inside a part, each part followed by a copy of the row that comes next.

    The bounds of the parts are quantiles of the doc_ids; the driver sees as many
    numbers as there are parts. Texts are shuffled once, and one row a part twice."""
    spark = docs.sparkSession
    rank = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))
    lean = docs.select(rank.alias("rank"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = lean.select(F.percentile_approx("rank", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    parts = Parts(cuts or [])

    @F.pandas_udf("int")
    def part(ranks, hashes):
        import pandas as pd

        return pd.Series(parts.of(ranks.to_numpy(), hashes.to_numpy()).astype("int32"))

    dealt = lean.withColumn("h", F.xxhash64("text")).withColumn("part", part("rank", "h"))
    # The first row of each part that has rows: its rank, then its hash, then its text.
    tops = dealt.groupBy("part").agg(F.max("rank").alias("rank"))
    tops = materialize(tops, "part-tops")
    some = [r["part"] for r in tops.select("part").orderBy("part").collect()]
    behind = spark.createDataFrame([(p, some[k - 1]) for k, p in enumerate(some)], "part int, behind int")  # the very first one's: the last
    least = F.min(F.struct("h", F.col("text").isNotNull().alias("some"), "text", "doc_id")).alias("x")
    heads = dealt.join(F.broadcast(tops), ["part", "rank"]).groupBy("part", "rank").agg(least)
    copies = heads.join(F.broadcast(behind), "part").select(F.col("behind").alias("part"), F.lit(1).alias("halo"), "rank", "x.doc_id", "x.text", "x.h")
    own = dealt.select("part", F.lit(0).alias("halo"), "rank", "doc_id", "text", "h")
    order = ("part", "halo", F.col("rank").desc(), "h", F.col("text").asc_nulls_first())
    return own.unionByName(copies).repartition(n // 4, "part").sortWithinPartitions(*order).select("part", "halo", "rank", "doc_id", "text")


def compared(docs: DataFrame, text: str = "text", key: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for every row, the next row being the one with the
    next smaller doc_id (after the smallest: the largest)."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        words, before = Words(), None  # the row that waits for the next one: part, doc_id, text, signatures
        for b in batches:
            ids, out = [], []
            for part, halo, doc_id, t in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                t = t or ""
                signs = signatures(t, words, chain)
                if before and before[0] == part:
                    own_id, own, own_signs = before[1:]
                    new = edited(own, t)
                    new_signs = signatures(new, words, chain)
                    ids.append(own_id)
                    out.append(
                        (len(own), hashlib.sha256(new.encode()).hexdigest(), fingerprint(own_signs), fingerprint(new_signs),
                         likeness(own_signs, new_signs), likeness(own_signs, signs))
                    )
                before = None if halo else (part, doc_id, t, signs)
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column(3).type), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names
            )

    return in_order(docs, text, key).mapInArrow(run, schema)


def prints(docs: DataFrame, text: str = "text", key: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint, signs): each row's fingerprint, as a string and as numbers."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for b in batches:
            found = [signatures(t, words, chain) for t in b.column(1).to_pylist()]
            columns = [pa.array([fingerprint(x) for x in found], pa.string()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "fingerprint", "signs"])

    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"doc_id {kind}, fingerprint string, signs array<long>")


def near_pairs(found: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): different fingerprints, as strings, at least so alike.

    ``found``: (doc_id, fingerprint, signs). Copies count once."""
    sets = found.where(F.size("signs") > 0).groupBy("fingerprint").agg(F.first("signs").alias("signs"))
    n = F.size("signs")
    sets = sets.withColumn("part", F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int"))
    rare = sets.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    long = sets.select("fingerprint", "part", n.alias("n"), F.explode("signs").alias("sign")).join(rare, "sign", "left")
    # A pair agrees in a sign among the rarest n - ceil(least * n) + 1 of each set; signs found once only have no partner.
    w = Window.partitionBy("fingerprint").orderBy(F.coalesce("df", F.lit(1)), "sign")
    keep = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    prefix = long.withColumn("k", F.row_number().over(w)).where((F.col("k") <= keep) & F.col("df").isNotNull())
    a = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "sign", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    b = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "sign", "part")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = a.join(b, ["part", "sign"]).where(shorter & (F.col("na") >= F.col("nb") * least)).select("a", "b").distinct()
    one, two = (sets.select(F.col("fingerprint").alias(x), F.col("signs").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    full = met.join(one, "a").join(two, "b").withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    return full.where(F.col("likeness") >= least).select("a", "b", "likeness")
