"""Conversation prefix trie, by range minima over sorted longest common prefixes.

A conversation is a sequence of turns; every distinct beginning of d turns is a
node of depth d. The sequences are sorted, so the conversations that start with
one prefix stand side by side: a node is an interval of the order. ``lcp[i]`` is
the number of turns that conversation i shares with the one before it. A
candidate prefix (conversation i, depth d) binary-searches the ends of its
interval in a sparse table of range minima: to the right the first lcp below d,
to the left (for its parent) the last one below d - 1. No candidate needs
another one's answer and there is no stack.

Scale: sequences are dealt by range and sorted; each part is one packed row, in
which a turn is 16 bytes of digest and its length, never its text. A part
answers its own candidates. What is left open is the intervals that reach over
an edge between parts, at most one for each depth that both sides of the edge
share. Every part tells its share of those (counts, sums, the least
conversation); the shares are added up by key. The driver sees the first and last
sequence of each part and its falling lcp from the right, never a conversation
more. Conversations that end at an open node are hashed in their order from
pieces of 256 ids, as a stream. One conversation's digests are one row: 16
bytes for each of its turns; a part is what one task sorts.

Defined results: a null role or text is empty; turns go by their number, null
first, then by digest; rows that repeat are turns of their own; rows without
conv_id belong to no conversation; a conversation without turns is a member of
the root; an empty table has no nodes; other columns are not read. Turns are
told apart by 128-bit digests of role and text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.plans.strategy import bounded_broadcast, materialize
from lumenvec.session import ship_package

PIECE = 256
TURN = "struct<digest:binary,n_bytes:int>"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest")


def turn_rows(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, turn, digest, n_bytes, *keep): a row a turn, without its text."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, F.lit(":"), t)))
    rows = conversations.where(F.col(f"`{key}`").isNotNull())
    return rows.select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"),
        F.octet_length(t).alias("n_bytes"), *keep,
    )


def sequences(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, turns ARRAY<STRUCT<digest, n_bytes>>): the turns of each conversation in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "digest", "n_bytes")))
    own = turn_rows(conversations, **columns).groupBy("conv_id").agg(ordered.alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Sequences that share beginnings: of conversation c the first h turns come from
    the first conversation of its block of ``group`` ids, h = crc32(c) % ``heads``,
    and its own turns after its first h follow."""
    own = materialize(own, "turns")
    c = F.col("conv_id")
    first = own.where(F.pmod(c, F.lit(group)) == 0).select(c.alias("first_id"), F.slice("turns", 1, heads).alias("head"))
    both = own.join(first, c - F.pmod(c, F.lit(group)) == F.col("first_id"), "left")
    h = (F.crc32(c.cast("string")) % heads).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(f"array<{TURN}>"))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


class RangeMin:
    """Sparse table: the minima of all runs whose length is a power of two."""

    def __init__(self, values) -> None:
        import numpy as np

        self.n, self.rows = len(values), [np.asarray(values)]
        while 2 ** len(self.rows) <= self.n:
            half = 2 ** (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo, hi):
        """The minimum of values[lo:hi], for arrays of non-empty ranges."""
        import numpy as np

        k = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for level in np.unique(k):
            at = k == level
            row = self.rows[level]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - 2**level])
        return out

    def right(self, at, bound):
        """The first place from ``at`` on whose value is below ``bound``; n if there is none."""
        import numpy as np

        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = at + 2**k <= self.n
            fits[fits] = row[at[fits]] >= bound[fits]
            at += np.where(fits, 2**k, 0)
        return at

    def left(self, at, bound):
        """The last place up to ``at`` whose value is below ``bound``; -1 if there is none."""
        import numpy as np

        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = at - 2**k + 1 >= 0
            fits[fits] = row[at[fits] - 2**k + 1] >= bound[fits]
            at -= np.where(fits, 2**k, 0)
        return at


def common(left, left_size: int, right, right_size: int) -> int:
    """Shared first turns of two sequences of digests."""
    n = 0
    while n < min(left_size, right_size) and left[n] == right[n]:
        n += 1
    return n


def packed(seqs: DataFrame, parts: int) -> DataFrame:
    """One row a part of the sorted sequences: (part, conv_ids, sizes, lcps, n_bytes,
    digests, first_key, last_key, fall_value, fall_at); lcps[0] is left at 0."""
    ship_package(seqs.sparkSession)
    keyed = seqs.select(
        F.transform("turns", lambda x: x["digest"]).alias("key"), F.transform("turns", lambda x: x["n_bytes"]).alias("n_bytes"), "conv_id"
    )
    dealt = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        digests, sizes, lengths, ids = [], [], [], []
        for b in batches:
            if b.num_rows:
                digests.append(b"".join(b.column(0).flatten().to_pylist()))
                sizes.append(np.diff(b.column(0).offsets.to_numpy()))
                lengths.append(b.column(1).flatten().to_numpy(zero_copy_only=False))
                ids.append(b.column(2).to_numpy())
        if not ids:
            return
        flat = np.frombuffer(b"".join(digests), "u8").reshape(-1, 2)
        size = np.concatenate(sizes).astype(np.int64)
        lcp = lcps(flat, size)
        ends = np.cumsum(size)
        key = lambda i: [flat[k].tobytes() for k in range(ends[i] - size[i], ends[i])]
        # From the right, the places where lcp falls below all that stand after it.
        back = np.minimum.accumulate(lcp[:0:-1]) if len(lcp) > 1 else np.zeros(0, np.int64)
        fresh_low = np.concatenate(([True], back[1:] < back[:-1])) if len(back) else np.zeros(0, bool)
        at = np.flatnonzero(fresh_low)
        row = {
            "part": TaskContext.get().partitionId(), "conv_ids": np.concatenate(ids), "sizes": size, "lcps": lcp,
            "n_bytes": np.concatenate(lengths).astype(np.int64), "digests": flat.tobytes(), "first_key": key(0), "last_key": key(len(size) - 1),
            "fall_value": back[at], "fall_at": len(lcp) - 1 - at,
        }
        yield pa.RecordBatch.from_pydict({k: pa.array([v], kinds[k]) for k, v in row.items()})

    import pyarrow as pa

    longs = pa.list_(pa.int64())
    kinds = {"part": pa.int32(), "conv_ids": longs, "sizes": longs, "lcps": longs, "n_bytes": longs, "digests": pa.binary(),
             "first_key": pa.list_(pa.binary()), "last_key": pa.list_(pa.binary()), "fall_value": longs, "fall_at": longs}
    schema = ("part int, conv_ids array<long>, sizes array<long>, lcps array<long>, n_bytes array<long>, digests binary, "
              "first_key array<binary>, last_key array<binary>, fall_value array<long>, fall_at array<long>")  # fmt: skip
    return materialize(dealt.mapInArrow(run, schema), "sorted-turns")


def lcps(flat, size):
    """Turns each sequence shares with the one before it, the first 0; ``flat`` has all digests in a row."""
    import numpy as np

    n = len(size)
    start = np.cumsum(size) - size
    shared = np.minimum(size[1:], size[:-1])
    out = np.zeros(n, np.int64)
    some = np.flatnonzero(shared)
    if len(some):
        m = shared[some]
        begin = np.cumsum(m) - m
        step = np.arange(m.sum()) - np.repeat(begin, m)
        same = (flat[np.repeat(start[some], m) + step] == flat[np.repeat(start[some + 1], m) + step]).all(axis=1)
        out[some + 1] = np.minimum.reduceat(np.where(same, np.repeat(m, m), step), begin)
    return out


def edges_of(parts: list) -> dict[int, tuple]:
    """part -> (rows before it, lcp with the part before, with the part after, the
    row where the interval of each depth 0..lcp over its left edge begins)."""
    found, before, prior, lefts = {}, 0, None, []
    for p in parts:
        edge = -1
        if prior is not None:
            edge = common(prior["last_key"], len(prior["last_key"]), p["first_key"], len(p["first_key"]))
            base, own_edge, prior_lefts = found[prior["part"]][0], found[prior["part"]][1], lefts
            lefts = []
            falls = list(zip(prior["fall_value"], prior["fall_at"]))
            k = len(falls)  # values fall from first to last: the first one below d is the place
            for d in range(edge + 1):
                while k and falls[k - 1][0] < d:
                    k -= 1
                if k < len(falls):
                    lefts.append(base + falls[k][1])
                else:
                    lefts.append(base if own_edge < d else prior_lefts[d])
            found[prior["part"]] = (*found[prior["part"]][:2], edge, found[prior["part"]][3])
        found[p["part"]] = (before, edge, -1, lefts)
        before += p["n"]
        prior = p
    return found


def part_nodes(conv, size, lcp, n_bytes, digests, before: int, edge: int, after: int, lefts) -> Iterator[dict]:
    """The nodes and open shares of one part, as dicts of equal-length arrays.

    ``kind`` 0: whole nodes; 1: shares of nodes that reach over an edge; 2: pieces
    of the ids that end at an open node."""
    import hashlib

    import numpy as np

    n = len(conv)
    lcp = lcp.copy()
    lcp[0] = edge
    nxt = np.append(lcp[1:], after)
    lows, least = RangeMin(lcp), RangeMin(conv)
    ends = np.cumsum(size)
    run = np.concatenate(([0], np.cumsum(n_bytes)))  # bytes before each turn of the part
    start = ends - size
    total = run[ends] - run[start]
    new = run[ends] - run[np.minimum(start + np.maximum(lcp, 0), ends)]
    sums = {"total": total, "new": new, "leaves": (nxt < size).astype(np.int64)}
    sums = {k: np.concatenate(([0], np.cumsum(v))) for k, v in sums.items()}
    begins = np.flatnonzero(lcp < size)  # rows that begin a child of the prefix they share
    by_depth = np.sort((lcp[begins] + 1) * (n + 1) + begins)
    copies = RangeMin((lcp == size).astype(np.int64))  # 1 where a row is a copy of the one before

    def shares(lo, hi, d, own):
        """Counts and sums over rows lo:hi of nodes of depth d; own: the node begins at row lo."""
        base = np.where(d > 0, run[start[lo] + np.maximum(d - 1, 0)] - run[start[lo]], 0)
        distinct = sums["new"][hi] - sums["new"][lo] - np.where(own, new[lo] - (total[lo] - base), 0)
        kids = np.searchsorted(by_depth, (d + 1) * (n + 1) + hi) - np.searchsorted(by_depth, (d + 1) * (n + 1) + lo + own)
        return {
            "conv_id": least.least(lo, hi), "n_convs": hi - lo, "n_children": kids + (own & (size[lo] > d)),
            "n_leaves": sums["leaves"][hi] - sums["leaves"][lo],
            "saved_tokens": sums["total"][hi] - sums["total"][lo] - (hi - lo) * base - distinct,
        }

    empty = hashlib.sha256(b"").hexdigest()
    turn_digest = lambda lo, d: [digests[16 * (start[i] + k - 1) : 16 * (start[i] + k)] if k else None for i, k in zip(lo.tolist(), d.tolist())]
    ids_of = lambda lo, hi: ",".join(map(str, conv[lo:hi].tolist()))

    def pieces(left, d, lo, hi):
        at = np.arange(lo, hi, PIECE)
        m = len(at)
        return {"kind": np.full(m, 2), "node": np.full(m, left), "depth": np.full(m, d), "first": before + at,
                "ids": [ids_of(a, min(a + PIECE, hi)) for a in at.tolist()]}

    def copies_end(lo, d):
        """Where the rows that are the prefix itself end (lo, if there are none)."""
        there = size[lo] == d
        stop = copies.right(np.minimum(lo + 1, n), np.ones(len(lo), np.int64))
        return np.where(there, stop, lo)

    # Nodes that began in an earlier part: rows 0:hi share their first d turns.
    if edge >= 0:
        d = np.arange(edge + 1)
        lo = np.zeros(edge + 1, np.int64)
        hi = lows.right(lo + 1, d) if n > 1 else np.full(edge + 1, n)
        yield {"kind": np.full(edge + 1, 1), "node": np.asarray(lefts), "depth": d, **shares(lo, hi, d, np.zeros(edge + 1, bool))}
        if size[0] == edge:
            yield pieces(lefts[edge], edge, 0, int(copies_end(np.array([0]), np.array([edge]))[0]))

    # Candidates: row i begins the nodes of depth lcp[i] + 1 to its size. So many rows at a time.
    per_row = size - lcp
    step = np.cumsum(per_row)
    for a, b in chunks(step, 1 << 16):
        m = per_row[a:b]
        lo = np.repeat(np.arange(a, b), m)
        d = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lcp[a:b], m) + 1
        if not len(lo):
            continue
        hi = lows.right(lo + 1, d)
        opened = (hi == n) & (after >= d)
        up = d - 1
        p_lo = lows.left(lo, np.maximum(up, 0))  # the root's parent is not asked for
        p_hi = lows.right(lo + 1, up)
        p_open = (d > 0) & ((p_lo < 0) | ((p_hi == n) & (after >= up)))
        p_known = (d > 0) & ~p_open
        parent = np.full(len(lo), -1, np.int64)
        parent[p_known] = least.least(p_lo[p_known], p_hi[p_known])
        over = np.minimum(np.maximum(up, 0), max(len(lefts) - 1, 0))
        p_node = np.where(p_lo >= 0, before + p_lo, np.asarray(lefts, np.int64)[over] if len(lefts) else -1)
        stop = copies_end(lo, d)
        sha = [None if o else (hashlib.sha256(ids_of(x, y).encode()).hexdigest() if y > x else empty)
               for x, y, o in zip(lo.tolist(), stop.tolist(), opened.tolist())]
        yield {
            "kind": opened.astype(np.int64), "node": before + lo, "depth": d, **shares(lo, hi, d, np.ones(len(lo), bool)),
            "parent_conv_id": masked(parent, p_known), "parent_node": masked(p_node, p_open), "ends_sha256": sha, "digest": turn_digest(lo, d),
        }
        for i in np.flatnonzero(opened & (stop > lo)).tolist():
            yield pieces(before + lo[i], d[i], int(lo[i]), int(stop[i]))


def masked(values, there):
    import pyarrow as pa

    return pa.array(values, pa.int64(), mask=~there)


def chunks(running, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose ``running`` totals grow by about ``most``."""
    import numpy as np

    a = 0
    while a < len(running):
        b = int(np.searchsorted(running, (running[a - 1] if a else 0) + most)) + 1
        yield a, min(b, len(running))
        a = b


FIELDS = {
    "kind": "int", "node": "long", "depth": "long", "conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long",
    "saved_tokens": "long", "parent_conv_id": "long", "parent_node": "long", "ends_sha256": "string", "digest": "binary", "first": "long", "ids": "string",
}


def trie(seqs: DataFrame, parts: int | None = None) -> DataFrame:
    """Nodes of the trie over (conv_id, turns): the columns of ``NODE``; ``digest`` is of the node's last turn."""
    import pyarrow as pa

    spark = seqs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = packed(seqs, parts)
    narrow = table.select("part", F.size("conv_ids").alias("n"), "first_key", "last_key", "fall_value", "fall_at")
    edges = edges_of(sorted(narrow.collect(), key=lambda r: r["part"]))  # a row a part
    n_open = sum(len(e[3]) for e in edges.values())
    shipped = spark.sparkContext.broadcast(edges)
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            for i in range(b.num_rows):
                long = [b.column(k)[i].values.to_numpy() for k in (1, 2, 3, 4)]
                for rows in part_nodes(*long, b.column(5)[i].as_py(), *shipped.value[b.column(0)[i].as_py()]):
                    m = len(rows["kind"])
                    yield pa.RecordBatch.from_pydict(
                        {c: (v if isinstance(v := rows[c], pa.Array) else pa.array(np.asarray(v) if isinstance(v, np.ndarray) else v, kinds[k]))
                         if c in rows else pa.nulls(m, kinds[k]) for c, k in FIELDS.items()}
                    )

    made = table.select("part", "conv_ids", "sizes", "lcps", "n_bytes", "digests").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in FIELDS.items()))
    made = materialize(made, "trie-parts")
    adds = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    own = [F.max(c).alias(c) for c in ("parent_node", "parent_conv_id", "digest")]
    opened = made.where("kind = 1").groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), *adds, *own)
    opened = materialize(opened.join(ends(made.where("kind = 2")), ["node", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "trie-open")

    cols = [c for c in FIELDS if c not in ("kind", "first", "ids")]
    every = made.where("kind = 0").select(*cols).unionByName(opened.select(*cols))
    # Parents over an edge are as few as the depths that parts share there: the bound is counted.
    above = opened.select(F.col("node").alias("parent_node"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("open_parent"))
    out = every.join(bounded_broadcast(above, n_open), ["parent_node", "depth"], "left")
    return out.withColumn("parent_conv_id", F.coalesce("open_parent", "parent_conv_id")).select(*NODE)


def ends(pieces: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the digest of the ids that end at each open node, in order, as a stream."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        held, digest, done = None, None, []
        for b in batches:
            for node, depth, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if (node, depth) != held:
                    if held:
                        done.append((*held, digest.hexdigest()))
                    held, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if held:
            done.append((*held, digest.hexdigest()))
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["node", "depth", "ends_sha256"])

    dealt = pieces.select("node", "depth", "first", "ids").repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return dealt.mapInArrow(run, "node long, depth long, ends_sha256 string")


def with_turns(nodes: DataFrame, conversations: DataFrame, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes with role and text of their last turn (null at the root)."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    said = turn_rows(conversations.select(F.lit(0).alias("key"), F.lit(0).alias("turn"), r.alias("role"), t.alias("text")), "key", keep=("role", "text"))
    said = said.select("digest", F.col("role").alias("last_role"), F.col("text").alias("last_text")).dropDuplicates(["digest"])
    return nodes.join(said, "digest", "left")
