"""Exact top-k cosine search (O24) and pair scoring.

Both sides are written once as packed blocks (ids, vectors as bytes) of at most
``block`` rows. Every base block meets every query block of its dimension in one
join, which is what exact search costs. A meeting is one matrix product in numpy;
scores below a query's k-th best so far are dropped by one comparison, and what
is left is merged into the query's k best (rows tied after rounding by smallest id).
A task gives k rows a query, never pairs as rows. Spark then keeps k per
query with a window whose ``row_number() <= k`` is a ``WindowGroupLimit``
before the shuffle. Nothing passes through the driver.

How blocks meet follows from their written bytes. A query side of at most
``MAX_SENT_BYTES`` is broadcast, and the base is read once and not moved. A larger
one is dealt to the cells of a grid whose rows and columns are chosen so that the
copies of both sides together are fewest and a cell has ``CELL_BYTES`` of queries or
about that. A task holds a cell's queries and streams its base blocks past them, so a
block is moved once a cell, not once a meeting.

``topk_pruned`` gives the same rows and first skips pairs of blocks: blocks are made of
vectors that lie close together, and a pair whose centers and radii allow no
score as high as the k-th known one is never multiplied.

Defined results: rows whose id is null, or whose vector is null, empty, holds a null or a
value that is not finite (error rows, texts with a zero vector), match nothing
and find nothing; vectors meet only those of their length; rows that repeat
are found each time; without queries or base rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.functions.vectors import dot
from lumenvec.plans.strategy import materialize

# Scores are ranked after rounding to this many places, ties by base id.
SCORE_DIGITS = 6
# Query blocks up to this size are sent to every executor.
MAX_SENT_BYTES = 4 << 20
# Query vectors of a cell, about; a task holds one cell's at a time.
CELL_BYTES = 24 << 20
# Queries that meet a base block at a time: a bound on a task's scores.
STEP = 1024
# Vectors of no larger values are compared in single precision first.
HALF_MOST = 1e12


def packed(rows: DataFrame, block: int) -> DataFrame:
    """(id, vec) -> (ids, mat, dim): blocks of at most ``block`` rows with a whole vector."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sizes = pc.list_value_length(b.column(1))
            for part in (p for n in pc.unique(sizes) for p in slices(b.filter(pc.equal(sizes, n)))):
                ids = part.column(0).to_numpy()
                mat = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
                good = np.isfinite(mat).all(axis=1)
                ids, mat = ids[good], mat[good]
                if len(ids):
                    yield pa.RecordBatch.from_pydict(
                        {"ids": pa.array([ids.tolist()]), "mat": pa.array([mat.tobytes()], pa.binary()), "dim": pa.array([mat.shape[1]], pa.int32())}
                    )

    def slices(rows):
        return [rows.slice(at, block) for at in range(0, rows.num_rows, block)]

    clean = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0)).select("id", F.col("vec").cast("array<double>").alias("vec"))
    return clean.mapInArrow(run, "ids array<long>, mat binary, dim int")


def _blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    return materialize(packed(rows, block), name)


def grid(cells: int, q_bytes: int, b_bytes: int) -> tuple[int, int]:
    """(rows, columns) of a grid of about ``cells`` for the query and the base blocks. Query blocks are
    copied to every column, base blocks to every row: the fewest bytes are moved near this ratio."""
    rows = round((cells * max(q_bytes, 1) / max(b_bytes, 1)) ** 0.5)
    rows = max(1, min(cells, rows))
    return rows, max(1, -(-cells // rows))


def _bytes(blocks: DataFrame, column: str) -> int:
    return blocks.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def _together(q_blocks: DataFrame, b_blocks: DataFrame, b_mat: str = "b_mat") -> DataFrame:
    """Each query block with each base block of its dimension; ``b_mat``: the base column that holds most bytes."""
    spark = q_blocks.sparkSession
    q_bytes, b_bytes = _bytes(q_blocks, "q_mat"), _bytes(b_blocks, b_mat)
    columns = [*(c for x in (q_blocks, b_blocks) for c in x.columns if c != "dim"), "dim"]
    if q_bytes <= MAX_SENT_BYTES:
        return b_blocks.join(F.broadcast(q_blocks), "dim").select(*columns)
    rows, cols = grid(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), q_bytes, b_bytes)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_side = q_blocks.withColumn("qc", F.pmod(F.xxhash64("q_ids"), F.lit(rows)).cast("int")).withColumn("bc", copies(cols))
    b_side = b_blocks.withColumn("bc", F.pmod(F.xxhash64("b_ids"), F.lit(cols)).cast("int")).withColumn("qc", copies(rows))
    return q_side.join(b_side, ["qc", "bc", "dim"]).select(*columns)


def dealt(q_blocks: DataFrame, b_blocks: DataFrame, wanted: DataFrame | None = None, b_size: str = "mat") -> DataFrame:
    """Both sides in one table, dealt to the cells of a grid: (cell, dim, base, block, ids, ...), sorted, so
    that a cell's query blocks of a dimension stand before its base blocks.

    Both sides: (block, ids, mat or ``b_size``, dim, ...). ``wanted``: (q_block, b_block, ...),
    the pairs that shall meet (all without it): a base block goes only to cells where it has some, with
    them as ``wanted``, an array of structs of the columns but ``b_block``."""
    spark = q_blocks.sparkSession
    q_bytes, b_bytes = _bytes(q_blocks, "mat"), _bytes(b_blocks, b_size)
    cells = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows, cols = grid(cells, q_bytes, b_bytes)
    rows = max(rows, -(-q_bytes // CELL_BYTES))
    cols = max(1, -(-cells // rows))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q_side = q_blocks.withColumn("qc", F.pmod(F.xxhash64("block"), F.lit(rows)).cast("int"))
    b_side = b_blocks.withColumn("bc", F.pmod(F.xxhash64("block"), F.lit(cols)).cast("int"))
    if wanted is None:
        b_side = b_side.withColumn("qc", copies(rows))
    else:
        rest = [c for c in wanted.columns if c != "b_block"]
        pairs = wanted.withColumn("qc", F.pmod(F.xxhash64("q_block"), F.lit(rows)).cast("int"))
        # As many entries as a cell has query blocks.
        of = pairs.groupBy(F.col("b_block").alias("block"), "qc").agg(F.collect_list(F.struct(*rest)).alias("wanted"))
        b_side = b_side.join(of, "block")
    q_side = q_side.withColumn("bc", copies(cols)).withColumn("base", F.lit(False))
    both = q_side.unionByName(b_side.withColumn("base", F.lit(True)), allowMissingColumns=True)
    both = both.withColumn("cell", F.col("qc") * cols + F.col("bc")).drop("qc", "bc")
    return both.repartition(rows * cols, "cell").sortWithinPartitions("cell", "dim", "base")


class Best:
    """The k best rows of each of the queries that a task holds, so far."""

    def __init__(self, dim: int, k: int, exclude_self: bool) -> None:
        self.dim, self.k, self.exclude_self = dim, k, exclude_self
        self.spans: dict[str | None, tuple[int, int]] = {}
        self.own, self.mats, self.size = [], [], 0
        self.mat = None

    def add(self, block: str | None, ids, mat) -> None:
        """A block of queries; all come before the first meeting."""
        self.spans[block] = (self.size, self.size + len(ids))
        self.own.append(ids)
        self.mats.append(mat)
        self.size += len(ids)

    def ready(self) -> None:
        import numpy as np

        if self.mat is None:
            self.mat = np.concatenate(self.mats) if self.mats else np.zeros((0, self.dim))
            self.query = np.concatenate(self.own) if self.own else np.zeros(0, np.int64)
            self.own = self.mats = None
            small = np.abs(self.mat).max(initial=0) <= HALF_MOST
            self.half, self.length = (self.mat.astype(np.float32) if small else None), np.linalg.norm(self.mat, axis=1) if small else None
            self.score = np.full((self.size, self.k), -np.inf)
            self.found = np.zeros((self.size, self.k), np.int64)

    def meet(self, ids, mat, wanted: list[str] | None = None) -> None:
        """A base block and all queries, or those of the blocks ``wanted``."""
        self.ready()
        spans = [(0, self.size)]
        if wanted is not None:
            spans = []
            for lo, hi in sorted(self.spans[w] for w in wanted):
                if spans and spans[-1][1] == lo:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
        for lo, hi in spans:
            for at in range(lo, hi, STEP):
                self._step(at, min(at + STEP, hi), ids, mat)

    def _step(self, lo: int, hi: int, ids, mat) -> None:
        import numpy as np

        kth = self.score[lo:hi, -1]
        unit = 10.0**-SCORE_DIGITS  # scores are compared after rounding
        if self.half is None or (kth == -np.inf).any() or np.abs(mat).max(initial=0) > HALF_MOST:
            with np.errstate(over="ignore", invalid="ignore"):
                score = self.mat[lo:hi] @ mat.T
            least = np.where(np.isfinite(kth), kth, -np.inf)
            new = np.flatnonzero(kth == -np.inf)
            if len(new) and score.shape[1] > self.k:  # fewer than k so far: no row below the block's own k best
                seen = score[new]
                seen[~np.isfinite(seen)] = -np.inf
                if self.exclude_self:
                    seen[self.query[lo:hi][new][:, None] == ids[None, :]] = -np.inf
                least[new] = np.partition(seen, -self.k, axis=1)[:, -self.k]
            least = least - (1.01 * unit + 1e-15 * np.where(np.isfinite(least), np.abs(least), 0))
            at = np.flatnonzero(score >= least[:, None])
            row, column = np.divmod(at, score.shape[1])
            self.offer(lo + row, ids[column], score[row, column])
            return
        # Single precision tells which rows can't matter: it loses less than ``off`` of a score.
        off = 2.0**-23 * (self.dim + 4) * self.length[lo:hi] * np.linalg.norm(mat, axis=1).max(initial=0) + 1e-30
        least = kth - (1.01 * unit + 1e-15 * np.abs(kth)) - 2 * off
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        at = np.flatnonzero(self.half[lo:hi] @ mat.astype(np.float32).T >= least[:, None])
        for part in range(0, len(at), 1 << 15):
            row, column = np.divmod(at[part : part + (1 << 15)], len(mat))
            self.offer(lo + row, ids[column], np.einsum("ij,ij->i", self.mat[lo + row], mat[column]))

    def offer(self, row, ids, score) -> None:
        """Base rows and their scores for queries by place."""
        import numpy as np

        self.ready()
        score = np.round(score, SCORE_DIGITS)
        kth, last = self.score[row, -1], self.found[row, -1]
        good = np.isfinite(score) & ((score > kth) | ((score == kth) & (ids < last)))
        if self.exclude_self:
            good &= self.query[row] != ids
        row, ids, score = row[good], ids[good], score[good]
        if not len(row):
            return
        rows, group = np.unique(row, return_inverse=True)
        n = len(rows)
        group = np.concatenate([np.repeat(np.arange(n), self.k), group])
        score = np.concatenate([self.score[rows].ravel(), score])
        ids = np.concatenate([self.found[rows].ravel(), ids])
        # Falling score, then rising id.
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        nth = np.arange(len(group)) - np.searchsorted(group, np.arange(n))[group]
        top = nth < self.k
        self.score[rows[group[top]], nth[top]] = score[top]
        self.found[rows[group[top]], nth[top]] = ids[top]

    def rows(self) -> Iterator:
        import numpy as np
        import pyarrow as pa

        self.ready()
        for lo in range(0, self.size, 1 << 15):
            row, nth = np.nonzero(np.isfinite(self.score[lo : lo + (1 << 15)]))
            yield pa.RecordBatch.from_pydict(
                {"query_id": self.query[lo + row], "doc_id": self.found[lo + row, nth], "score": self.score[lo + row, nth]}
            )


FOUND = "query_id bigint, doc_id bigint, score double"


def block_of(batch, row: int, dim: int, ids: str = "ids", mat: str = "mat"):
    """(ids, matrix) of a block in an Arrow batch."""
    import numpy as np

    return batch.column(ids)[row].values.to_numpy(), np.frombuffer(batch.column(mat)[row].as_buffer()).reshape(-1, dim)


def _meet(k: int, exclude_self: bool):
    """Pairs of blocks as rows; the queries that a task has met are kept, so that earlier blocks rule rows of later ones out."""

    def run(batches: Iterator) -> Iterator:
        held, size = {}, 0
        for b in batches:
            for row, dim in enumerate(b.column("dim").to_pylist()):
                q_ids, q = block_of(b, row, dim, "q_ids", "q_mat")
                key = (dim, q_ids.tobytes(), q.tobytes())
                if key not in held:
                    if size + q.nbytes > CELL_BYTES:
                        for best in held.values():
                            yield from best.rows()
                        held, size = {}, 0
                    held[key], size = Best(dim, k, exclude_self), size + q.nbytes
                    held[key].add(None, q_ids.copy(), q.copy())
                held[key].meet(*block_of(b, row, dim, "b_ids", "b_mat"))
        for best in held.values():
            yield from best.rows()

    return run


def _meet_cells(k: int, exclude_self: bool):
    """The rows of ``dealt``, cell by cell."""

    def run(batches: Iterator) -> Iterator:
        at, best = None, None
        for b in batches:
            wanted = b.column("wanted") if "wanted" in b.schema.names else None
            for row, (cell, dim, base) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "dim", "base")))):
                if at != (cell, dim):
                    if best:
                        yield from best.rows()
                    at, best = (cell, dim), Best(dim, k, exclude_self)
                ids, mat = block_of(b, row, dim)
                if base:
                    best.meet(ids, mat, None if wanted is None else [w["q_block"] for w in wanted[row].as_py()])
                else:
                    best.add(b.column("block")[row].as_py(), ids.copy(), mat.copy())
        if best:
            yield from best.rows()

    return run


def topk_similar(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    base_id: str = "doc_id",
    base_vec: str = "embedding",
    exclude_self: bool = False,
    block: int = 1024,
) -> DataFrame:
    """(query_id, rank, doc_id, score) with the k best base rows per query.

    Score is the dot product, i.e. the cosine for unit vectors (O14 output).
    Without queries or base rows the result is empty."""
    from lumenvec.session import ship_package

    spark = queries.sparkSession
    ship_package(spark)
    q = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).alias("vec"))
    b = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(base_vec).alias("vec"))
    q_blocks, b_blocks = _blocks(q, block, "topk-queries"), _blocks(b, block, "topk-base")
    if _bytes(q_blocks, "mat") <= MAX_SENT_BYTES:
        sides = [x.select(F.col("ids").alias(f"{n}_ids"), F.col("mat").alias(f"{n}_mat"), "dim") for x, n in ((q_blocks, "q"), (b_blocks, "b"))]
        return _best(_together(*sides), k, exclude_self)
    q_blocks, b_blocks = (x.withColumn("block", F.sha2(F.concat("mat", F.to_json("ids").cast("binary")), 256)) for x in (q_blocks, b_blocks))
    return ranked(dealt(q_blocks, b_blocks).mapInArrow(_meet_cells(k, exclude_self), FOUND), k)


def _best(met: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k best of each query from blocks that have met."""
    return ranked(met.mapInArrow(_meet(k, exclude_self), FOUND), k)


def ranked(cand: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query's candidates."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def clustered_blocks(rows: DataFrame, block: int = 1024, pivots: int = 64, name: str = "topk-clusters") -> DataFrame:
    """(id, vec) -> (block_id, ids, mat, dim, n, center, radius): blocks of vectors that lie close together.

    Up to ``pivots`` vectors of each length, those with the least hashes, stand for the places; every
    row goes to its nearest one and rows are sorted by (pivot, distance), so that neighbours
    in a block are near each other and rows with one vector spread over blocks. The pivots
    only shape the blocks; no result depends on them."""
    from lumenvec.session import ship_package

    spark = rows.sparkSession
    ship_package(spark)
    clean = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0)).select("id", F.col("vec").cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    clean = clean.where(whole).withColumn("dim", F.size("vec"))
    # A bounded sample: pivots of each length.
    first = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    chosen = clean.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= pivots).select("dim", "vec").collect()
    shipped = spark.sparkContext.broadcast([(r["dim"], r["vec"]) for r in chosen])

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of = {}
        for dim, vec in shipped.value:
            of.setdefault(dim, []).append(vec)
        of = {d: np.array(v) for d, v in of.items()}
        for b in batches:
            near, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            dims = b.column(2).to_numpy()
            flat, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                mat = flat[(ends[at] - d)[:, None] + np.arange(d)]
                gap = (mat**2).sum(1)[:, None] - 2 * mat @ of[d].T + (of[d] ** 2).sum(1)[None, :]
                near[at], far[at] = gap.argmin(axis=1), np.sqrt(np.maximum(gap.min(axis=1), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far)], ["id", "vec", "dim", "pivot", "far"])

    def pack(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        def made(dim, ids, mats):
            mat = np.concatenate(mats)
            center = mat.mean(axis=0)
            radius = float(np.sqrt(((mat - center) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_pydict({
                "block_id": [uuid.uuid4().hex], "ids": pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), "mat": pa.array([mat.tobytes()], pa.binary()),
                "dim": pa.array([dim], pa.int32()), "n": pa.array([len(mat)], pa.int32()), "center": [center.tolist()], "radius": [radius],
            })

        held, ids, mats, size = None, [], [], 0  # (dim, pivot) of the block that is being filled
        for b in batches:
            keys = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                while lo < hi:
                    if held != tuple(keys[lo]) or size == block:
                        if size:
                            yield made(held[0], ids, mats)
                        held, ids, mats, size = tuple(keys[lo].tolist()), [], [], 0
                    part = b.slice(lo, min(hi - lo, block - size))
                    ids.append(part.column(0).to_numpy())
                    mats.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    size, lo = size + part.num_rows, lo + part.num_rows
        if size:
            yield made(held[0], ids, mats)

    placed = clean.select("id", "vec", "dim").mapInArrow(place, "id long, vec array<double>, dim int, pivot int, far double")
    dealt = placed.repartitionByRange("dim", "pivot", "far", "id").sortWithinPartitions("dim", "pivot", "far", "id")
    return materialize(dealt.mapInArrow(pack, "block_id string, ids array<long>, mat binary, dim int, n int, center array<double>, radius double"), name)


def block_pairs(q_blocks: DataFrame, b_blocks: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(q_block, b_block, bound, least, kept): all pairs of blocks of one dimension, and which of them can matter.

    No score of a pair is above ``bound``, by the blocks' centers and radii. ``least``: every
    query of the block has k scores of at least that much already, found where its
    block meets the base block with the highest bound (with rows enough for k); pairs
    whose bound is below it are skipped."""
    q = q_blocks.select(F.col("block_id").alias("q_block"), "dim", F.col("center").alias("qc"), F.col("radius").alias("qr"))
    b = b_blocks.select(F.col("block_id").alias("b_block"), "dim", F.col("center").alias("bc"), F.col("radius").alias("br"), "n")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    q, b = q.withColumn("ql", length("qc")), b.withColumn("bl", length("bc"))
    bound = dot("qc", "bc") + F.col("ql") * F.col("br") + F.col("qr") * F.col("bl") + F.col("qr") * F.col("br")
    # Dealt by query blocks, so that the pairs of one dimension are not one task's.
    deals = int(q_blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    q = q.withColumn("deal", F.pmod(F.xxhash64("q_block"), F.lit(deals)).cast("int"))
    b = b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    pairs = q.repartition(deals, "dim", "deal").join(b.repartition(deals, "dim", "deal"), ["dim", "deal"]).select("q_block", "b_block", "n", bound.alias("bound"))
    pairs = materialize(pairs, "block-pairs")
    enough = pairs.where(F.col("n") > k)  # one more than k, as one row can be the query itself
    best = enough.groupBy("q_block").agg(F.max_by("b_block", "bound").alias("b_block"))
    met = best.join(_side(q_blocks, "q"), "q_block").join(_side(b_blocks, "b"), "b_block").select("q_ids", "q_mat", "b_ids", "b_mat", "dim", "q_block")
    least = met.mapInArrow(_kth(k, exclude_self), "q_block string, least double")
    least = materialize(least, "block-least")
    # Scores are compared after rounding.
    slack = 10.0**-SCORE_DIGITS
    return pairs.join(least, "q_block", "left").withColumn("kept", F.col("least").isNull() | (F.col("bound") + slack >= F.col("least")))


def _side(blocks: DataFrame, side: str) -> DataFrame:
    names = {"q": ("q_block", "q_ids", "q_mat"), "b": ("b_block", "b_ids", "b_mat")}[side]
    out = blocks.select(*[F.col(c).alias(n) for c, n in zip(("block_id", "ids", "mat"), names)], *(["dim"] if side == "q" else []))
    return out


def _kth(k: int, exclude_self: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for q_ids, q_mat, b_ids, b_mat, dim in zip(*[c.to_pylist() for c in b.columns[:5]]):
                score = np.round(np.frombuffer(q_mat).reshape(-1, dim) @ np.frombuffer(b_mat).reshape(-1, dim).T, SCORE_DIGITS)
                if exclude_self:
                    score[np.array(q_ids)[:, None] == np.array(b_ids)[None, :]] = -np.inf
                out.append(float(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k].min()))
            yield pa.RecordBatch.from_arrays([b.column(5), pa.array(out, pa.float64())], ["q_block", "least"])

    return run


def topk_pruned(queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "embedding", base_id: str = "doc_id",
                base_vec: str = "embedding", exclude_self: bool = False, block: int = 1024, pivots: int = 64) -> DataFrame:
    """The rows of ``topk_similar``, skipping pairs of blocks that can't hold one of the k best.

    Worth it where vectors lie in clusters; where they don't, every pair is kept and
    the clustering is extra work."""
    q = clustered_blocks(queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).alias("vec")), block, pivots, "topk-queries")
    b = clustered_blocks(base.select(F.col(base_id).cast("bigint").alias("id"), F.col(base_vec).alias("vec")), block, pivots, "topk-base")
    kept = materialize(block_pairs(q, b, k, exclude_self).where("kept").select("q_block", "b_block"), "kept-pairs")
    q, b = (x.select(F.col("block_id").alias("block"), "ids", "mat", "dim") for x in (q, b))
    return ranked(dealt(q, b, kept).mapInArrow(_meet_cells(k, exclude_self), FOUND), k)


def pair_scores(pairs: DataFrame, emb: DataFrame, a: str = "id_a", b: str = "id_b", key: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """Dot-product score for given (id_a, id_b) pairs: two equi-joins.

    Pairs whose side has no embedding get a NULL score (left joins).
    """
    ea = emb.select(F.col(key).alias(a), F.col(vec).alias("_va"))
    eb = emb.select(F.col(key).alias(b), F.col(vec).alias("_vb"))
    j = pairs.join(ea, a, "left").join(eb, b, "left")
    return j.select(*pairs.columns, F.round(dot("_va", "_vb"), SCORE_DIGITS).alias("score"))
