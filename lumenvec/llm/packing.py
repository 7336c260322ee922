"""Best-fit packing by a grouping genetic algorithm on islands.

A document is its token ids and an end id. Documents longer than a sequence
are cut into full pieces and one shorter first piece; nothing else is cut.
Full pieces are sequences by themselves. The others are dealt by hash to
shards of about ``shard`` pieces, each a packing problem of its own, so one
island's memory is bounded whatever the corpus holds.

Each shard lives on several islands. An island's individuals are groupings of
the pieces into sequences. They begin as best-fit packings of the pieces in
falling order of length, one exact, the others with the order shaken a little.
To cross two of them, some of the best-filled sequences of one are put whole
into the other; sequences that thereby hold a piece twice are taken apart, and
their remaining pieces are placed again, best fit, longest first. The fitter
(fewer sequences; then the larger sum of squared fills) survive. Between
epochs every island gets the elite of the island before it, through a shuffle
by (shard, island). After the last epoch the best of all islands counts. A
shard at the lower bound, its tokens divided by the sequence length, rests.

Defined results: a null or empty text is its end id alone; every row of the
table, repeated rows too, is packed once; ties are broken by fixed seeds, so
reruns agree up to the numbers given to full pieces; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.encoding import encoder
from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package


@dataclass(frozen=True)
class Plan:
    """``size``: tokens of a sequence; ``shard``: pieces of a shard, about;
    ``islands`` of a shard, ``population`` of an island, ``crossings`` in each
    of ``epochs``; ``inject``: share of a parent's sequences that go over."""

    size: int = 2048
    end_id: int = 0
    shard: int = 4096
    islands: int = 2
    population: int = 4
    crossings: int = 8
    epochs: int = 2
    inject: float = 0.05
    seed: int = 7


def pieces(docs: DataFrame, path: str, plan: Plan = Plan(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): what is to be packed."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        enc, end = encoder(path), np.array([plan.end_id], "<u4").tobytes()
        for b in batches:
            take, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.ids(t) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % plan.size or plan.size  # only the first can be shorter
                    take.append(i)
                    rows.append((piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            new = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), *new], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open sequences by the room they have left, for best fit."""

    def __init__(self, size: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.some = 0  # bit r: a sequence has room r

    def put(self, b: int, room: int) -> None:
        self.at[room].append(b)
        self.some |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``need``, and that room."""
        if not (fit := self.some >> need):
            return None
        room = need + (fit & -fit).bit_length() - 1
        b = self.at[room].pop()
        if not self.at[room]:
            self.some ^= 1 << room
        return b, room


def best_fit(lengths: list[int], order, size: int, group, rooms: list[int]) -> int:
    """Places the pieces of ``order`` into the sequences with ``rooms`` left, opening
    new ones where none fits. Fills ``group``; returns the number of sequences."""
    bins = Bins(size)
    for b, room in enumerate(rooms):
        if room > 0:
            bins.put(b, room)
    n = len(rooms)
    for i in order:
        need = lengths[i]
        if (found := bins.take(need)) is None:
            b, room, n = n, size, n + 1
        else:
            b, room = found
        group[i] = b
        if room > need:
            bins.put(b, room - need)
    return n


def fitness(lengths, group, size: int) -> tuple[int, float]:
    import numpy as np

    fill = np.bincount(group, weights=lengths) / size
    return -len(fill), float((fill**2).sum())


def cross(lengths, giver, taker, plan: Plan, rng):
    """A child of ``taker`` with some of the best-filled sequences of ``giver``."""
    import numpy as np

    fill = np.bincount(giver, weights=lengths)
    n = max(1, int(len(fill) * plan.inject))
    best = np.argsort(-fill, kind="stable")[: max(n, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(best, n, replace=False)] = True
    injected = chosen[giver]
    broken = np.zeros(int(taker.max()) + 1, bool)
    broken[taker[injected]] = True
    loose = broken[taker] & ~injected
    # Numbers from 0: the injected sequences first, then the taker's that stay.
    new_of_giver, new_of_taker = np.cumsum(chosen) - 1, np.cumsum(~broken) - 1 + n
    child = np.where(injected, new_of_giver[giver], new_of_taker[taker])
    used = ~loose
    total = n + int((~broken).sum())
    rooms = (plan.size - np.bincount(child[used], weights=lengths[used], minlength=total)).astype(np.int64)
    order = np.flatnonzero(loose)
    order = order[np.argsort(-lengths[order], kind="stable")]
    best_fit(lengths.tolist(), order.tolist(), plan.size, child, rooms.tolist())
    return child


def begin(lengths, plan: Plan, rng) -> list:
    """An island's first groupings."""
    import numpy as np

    out = []
    for k in range(plan.population):
        shaken = lengths * (1 + 0.03 * k * rng.standard_normal(len(lengths)))
        group = np.zeros(len(lengths), np.int64)
        best_fit(lengths.tolist(), np.argsort(-shaken, kind="stable").tolist(), plan.size, group, [])
        out.append(group)
    return out


def evolve(lengths, groups: list, plan: Plan, rng) -> list:
    """One epoch: the fittest ``population`` of the groupings and their children, best first."""
    least = -(-int(lengths.sum()) // plan.size)
    rank = lambda g: fitness(lengths, g, plan.size)
    ranked = sorted(((rank(g), k, g) for k, g in enumerate(groups)), key=lambda x: x[:2], reverse=True)
    for k in range(plan.crossings):
        if -ranked[0][0][0] <= least:
            break
        a, b = rng.choice(min(len(ranked), plan.population), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = cross(lengths, ranked[a][2], ranked[b][2], plan, rng)
        ranked = sorted([*ranked, (rank(child), len(groups) + k, child)], key=lambda x: x[:2], reverse=True)[: plan.population]
    return [g for _, _, g in ranked]


def _epoch(islands: DataFrame, plan: Plan, epoch: int) -> DataFrame:
    """(shard, island, lengths, groups) -> the same after one epoch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            done = []
            for shard, island, lengths, groups in zip(*[c.to_pylist() for c in b.columns]):
                rng = np.random.default_rng([plan.seed, epoch, shard, island])
                size = np.array(lengths, np.int64)
                known = [np.array(g, np.int64) for g in groups or []] or begin(size, plan, rng)
                done.append([g.tolist() for g in evolve(size, known, plan, rng)])
            columns = [*b.columns[:3], pa.array(done, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "island", "lengths", "groups"])

    return islands.mapInArrow(run, "shard long, island int, lengths array<int>, groups array<array<int>>")


def groupings(shards: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(shard, grp): for rows (shard, lengths) the best grouping of the pieces, in their order."""
    here = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(plan.islands - 1))).alias("island"), "lengths",
        F.lit(None).cast("array<array<int>>").alias("groups"),
    )
    # Islands are small rows and long work: a fixed number of tasks, not one by size.
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    for epoch in range(plan.epochs):
        here = materialize(_epoch(here.repartition(tasks, "shard", "island"), plan, epoch), "packing-islands")
        if epoch + 1 < plan.epochs and plan.islands > 1:
            elite = here.select(
                "shard", F.pmod(F.col("island") + 1, F.lit(plan.islands)).alias("island"), F.slice("groups", 1, 1).alias("elite")
            )
            here = here.join(elite, ["shard", "island"]).select(
                "shard", "island", "lengths", F.concat("groups", "elite").alias("groups")
            )
    best = here.select("shard", "island", F.get("groups", F.lit(0)).alias("grp"), "lengths")
    fill = F.aggregate(  # the squared fills are settled inside an island; here fewer sequences, then the first island
        "grp", F.lit(0), lambda a, x: F.greatest(a, x + 1)
    )
    return best.groupBy("shard").agg(F.min_by("grp", F.struct(fill, F.col("island"))).alias("grp"))


def pack(docs: DataFrame, path: str, plan: Plan = Plan(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row a piece."""
    ship_package(docs.sparkSession)
    cut = materialize(pieces(docs, path, plan, text, key), "packing-pieces")
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    full = cut.where(F.col("length") == plan.size).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = cut.where(F.col("length") < plan.size)
    n = max(1, round(part.count() / plan.shard))
    shard = F.pmod(F.xxhash64(F.lit(plan.seed), *names), F.lit(n))
    # Rows that agree in all columns would meet in one shard; their number spreads them again.
    twin = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    dealt = part.withColumn("twin", twin).withColumn("shard", F.pmod(shard + F.col("twin") - 1, F.lit(n)))
    item = F.struct((-F.col("length")).cast("int").alias("less"), *names)
    shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(item)).alias("items"))
    shards = materialize(shards, "packing-shards")
    grouped = groupings(shards.select("shard", F.transform("items", lambda x: -x["less"]).alias("lengths")), plan)
    rows = shards.join(grouped, "shard").select("shard", F.posexplode(F.arrays_zip("items", "grp")).alias("at", "x"))
    w = Window.partitionBy("shard", "x.grp").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    packed = rows.select(
        *[F.col(f"x.items.{c}").alias(c) for c in names],
        (F.col("shard") * (1 << 32) + F.col("x.grp")).alias("sequence_id"),
        F.coalesce(F.sum("x.items.length").over(w), F.lit(0)).cast("long").alias("offset"),
    )
    return full.unionByName(packed)
