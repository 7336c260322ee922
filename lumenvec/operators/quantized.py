"""Exact top-k over int8 codes (O23, O24): a first pass on codes, the rest rescored.

``code_blocks`` writes a table once that any number of searches read. A base vector
is kept whole and as one signed byte a component, c = round(x / s) with
s = max|x| / 127, next to s and the length of what the code leaves out, e = x - s c.
For any query q, Cauchy-Schwarz gives |q.x - s q.c| <= |q| |e|: each code tells a
lower and an upper bound of the exact score (the length of e is raised by what
floating point can lose).

``topk_codes`` gives the rows of ``search.topk_similar`` in three steps. Every query
block meets every base block's codes, an eighth of the vectors' bytes, and keeps
of each query the rows whose upper bound reaches the k-th lower one that the task has seen. The
k-th lower bound over all blocks is a score that k rows are known to have; rows
below it go. What is left gets its exact score from the whole vectors, of which only
those rows are unpacked, and Spark ranks them.

Where many rows lie closer together than codes can tell (copies, dense clusters), a
block would leave many rows of a query. A meeting with more than ``most`` of them for
a query passes on its k best bounds only and, unless the k-th bound rules it out, is done
again on whole vectors by one matrix product, which keeps k rows a query. So no
query has more than ``most`` rows from a block, and none is lost.

Defined results: those of ``search.topk_similar``, for nulls, values that are not
finite, vectors of several lengths, repeated rows and empty sides.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.functions.vectors import dot
from lumenvec.operators.search import SCORE_DIGITS, _meet, dealt, packed, ranked
from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

LEVELS = 127
# Queries of a block that are compared at a time: a bound on a task's memory.
STEP = 1024
# Scores are compared after rounding.
SLACK = 10.0**-SCORE_DIGITS
# Rows that a task holds before it looks which of them are ruled out by now.
HELD = 1 << 20
CODES = "block_id string, ids array<long>, mat binary, dim int, codes binary, scales binary, errors binary"
BOUNDS = "q_block string, q_pos int, b_block string, b_pos int, lower double, upper double"


def lengths(mat):
    """Lengths of the rows, or a little more: squares of values below 1e-154 are lost."""
    import numpy as np

    return np.linalg.norm(mat, axis=1) + 1e-150 * mat.shape[1]


def quantised(mat):
    """(codes int8, scales, errors) of the rows of a matrix: no inner product with a query q
    differs from scale * (q . codes) by more than ``lengths`` of q * error."""
    import numpy as np

    scales = np.abs(mat).max(axis=1) / LEVELS
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        codes = np.clip(np.nan_to_num(np.rint(mat / scales[:, None])), -LEVELS, LEVELS).astype(np.int8)
        errors = lengths(mat - scales[:, None] * codes)
        # Sums of mat.shape[1] products lose at most so much, on either side.
        errors = errors + 4 * (mat.shape[1] + 2) * np.finfo(np.float64).eps * lengths(mat)
    return codes, scales, errors


def code_blocks(base: DataFrame, base_id: str = "doc_id", base_vec: str = "embedding", block: int = 1024) -> DataFrame:
    """(block_id, ids, mat, dim, codes, scales, errors), written: a search's first pass reads all but ``mat``."""
    ship_package(base.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at, (mat, dim) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                parts = quantised(np.frombuffer(mat).reshape(-1, dim))
                row = b.slice(at, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), *row.columns, *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                    ["block_id", "ids", "mat", "dim", "codes", "scales", "errors"],
                )

    rows = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(base_vec).alias("vec"))
    return materialize(packed(rows, block).mapInArrow(run, CODES), "code-blocks")


class Bounds:
    """Of each query that a task holds, the base rows that bounds leave, so far.

    Beyond ``most`` rows of a block a query gets its k best lower bounds there under place -1."""

    def __init__(self, dim: int, k: int, exclude_self: bool, most: int) -> None:
        self.dim, self.k, self.exclude_self, self.most = dim, k, exclude_self, most
        self.names, self.begin, self.own, self.mats, self.size = [], [], [], [], 0
        self.mat, self.left, self.n_left, self.full = None, [], 0, HELD

    def add(self, block: str, ids, mat) -> None:
        """A block of queries; all come before the first meeting."""
        self.names.append(block)
        self.begin.append(self.size)
        self.own.append(ids)
        self.mats.append(mat)
        self.size += len(ids)

    def ready(self) -> None:
        import numpy as np

        if self.mat is None:
            self.mat = np.concatenate(self.mats) if self.mats else np.zeros((0, self.dim))
            self.query = np.concatenate(self.own) if self.own else np.zeros(0, np.int64)
            self.own = self.mats = None
            self.length = lengths(self.mat)
            self.lower = np.full((self.size, self.k), -np.inf)  # the k best lower bounds of each query

    def meet(self, block: str, ids, codes, scales, errors) -> None:
        import numpy as np

        self.ready()
        codes = codes.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            # One product gives the upper bounds: (q, |q|) . (scale * code, error).
            base = np.concatenate([codes * scales[:, None], errors[:, None]], axis=1)
        for lo in range(0, self.size, STEP):
            hi = min(lo + STEP, self.size)
            kth = self.lower[lo:hi, -1]
            with np.errstate(over="ignore", invalid="ignore"):
                upper = np.concatenate([self.mat[lo:hi], self.length[lo:hi, None]], axis=1) @ base.T
                new = np.flatnonzero(kth == -np.inf)
                least = kth.copy()
                if len(new) and len(ids) > self.k:  # fewer than k known so far: the block's own k best lower bounds
                    own = upper[new] - 2.000001 * self.length[lo:hi][new][:, None] * errors
                    own[~np.isfinite(own)] = -np.inf
                    if self.exclude_self:
                        own[self.query[lo:hi][new][:, None] == ids[None, :]] = -np.inf
                    least[new] = np.partition(own, -self.k, axis=1)[:, -self.k]
                # Rounding of the sums above: what is near the bound is looked at again.
                least = least - SLACK - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
            at = np.flatnonzero(~(upper < least[:, None]))
            row, column = np.divmod(at, len(ids))
            if self.exclude_self:
                good = self.query[lo + row] != ids[column]
                row, column = row[good], column[good]
            if len(row):
                self._bound(block, lo + row, column, codes, scales, errors)

    def _bound(self, block: str, row, column, codes, scales, errors) -> None:
        import numpy as np

        near = np.empty(len(row))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(row), 1 << 15):
                part = slice(at, at + (1 << 15))
                near[part] = np.einsum("ij,ij->i", self.mat[row[part]], codes[column[part]])
            near, off = near * scales[column], self.length[row] * errors[column]
            lower, upper = near - off, near + off
        lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
        # Best lower bounds first, query by query; the k best of each join those of earlier blocks.
        order = np.lexsort((-lower, row))
        row, column, lower, upper = (x[order] for x in (row, column, lower, upper))
        rows, first, count = np.unique(row, return_index=True, return_counts=True)
        nth = np.arange(len(row)) - np.repeat(first, count)
        top = nth < self.k
        best = np.full((len(rows), self.k), -np.inf)
        best[np.repeat(np.arange(len(rows)), count)[top], nth[top]] = lower[top]
        self.lower[rows] = -np.sort(-np.concatenate([self.lower[rows], best], axis=1), axis=1)[:, : self.k]
        kept = upper + SLACK >= self.lower[row, -1]
        group = np.repeat(np.arange(len(rows)), count)
        dense = (np.bincount(group[kept], minlength=len(rows)) > self.most)[group]
        highest = np.maximum.reduceat(upper, first)[group]
        again = dense & top
        place, upper = np.where(again, -1, column), np.where(again, highest, upper)
        kept = (kept & ~dense) | again
        self.left.append((block, row[kept], place[kept], lower[kept], upper[kept]))
        self.n_left += int(kept.sum())
        if self.n_left > self.full:
            self._prune()
            self.full = max(HELD, 2 * self.n_left)

    def _prune(self) -> None:
        """Bounds that later blocks have raised rule earlier rows out."""
        import numpy as np

        out = []
        for block, row, *rest in self.left:
            good = np.flatnonzero(rest[-1] + SLACK >= self.lower[row, -1])
            if len(good):
                out.append((block, row[good], *(x[good] for x in rest)))
        self.left, self.n_left = out, sum(len(x[1]) for x in out)

    def rows(self) -> Iterator:
        import numpy as np
        import pyarrow as pa

        self.ready()
        self._prune()
        names, begin = pa.array(self.names, pa.string()), np.array(self.begin, np.int64)
        for block, row, place, lower, upper in self.left:
            of = np.searchsorted(begin, row, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(of)), pa.array(row - begin[of], pa.int32()), pa.repeat(pa.scalar(block), len(row)), pa.array(place, pa.int32()), pa.array(lower), pa.array(upper)],
                ["q_block", "q_pos", "b_block", "b_pos", "lower", "upper"],
            )


def _bounds(k: int, exclude_self: bool, most: int):
    """The rows of ``search.dealt``, cell by cell."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        at, held = None, None
        for b in batches:
            for row, (cell, dim, base) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "dim", "base")))):
                if at != (cell, dim):
                    if held:
                        yield from held.rows()
                    at, held = (cell, dim), Bounds(dim, k, exclude_self, most)
                name, ids = b.column("block")[row].as_py(), b.column("ids")[row].values.to_numpy()
                if base:
                    codes, scales, errors = (b.column(c)[row].as_py() for c in ("codes", "scales", "errors"))
                    held.meet(name, ids, np.frombuffer(codes, np.int8).reshape(-1, dim), np.frombuffer(scales), np.frombuffer(errors))
                else:
                    held.add(name, ids.copy(), np.frombuffer(b.column("mat")[row].as_py()).reshape(-1, dim))
        if held:
            yield from held.rows()

    return run


def _unpacked(blocks: DataFrame, wanted: DataFrame, id_name: str, prefix: str) -> DataFrame:
    """The rows of ``blocks`` at the places ``wanted`` tells: (block, pos, id, vector)."""
    block, pos = f"{prefix}_block", f"{prefix}_pos"
    # A block has at most its own rows as places.
    places = wanted.groupBy(block).agg(F.collect_set(pos).alias("places"))
    asked = places.join(blocks.select(F.col("block_id").alias(block), "ids", "mat", "dim"), block).select(block, "places", "ids", "mat", "dim")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, at, ids, mat, dim in zip(*[c.to_pylist() for c in b.columns]):
                at = np.sort(np.array(at, np.int32))
                vectors = np.frombuffer(mat).reshape(-1, dim)[at]
                ends = np.arange(0, vectors.size + 1, dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(np.array(ids)[at], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))],
                    [block, pos, id_name, f"{prefix}_vec"],
                )

    return asked.mapInArrow(run, f"{block} string, {pos} int, {id_name} bigint, {prefix}_vec array<double>")


def left_by_codes(q_blocks: DataFrame, b_blocks: DataFrame, k: int, exclude_self: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What codes leave: (pairs of rows to rescore, pairs of blocks to do again on whole vectors)."""
    q = q_blocks.select(F.col("block_id").alias("block"), "ids", "mat", "dim")
    b = b_blocks.select(F.col("block_id").alias("block"), "ids", "codes", "scales", "errors", "dim")
    met = dealt(q, b, b_size="codes")
    bounds = materialize(met.mapInArrow(_bounds(k, exclude_self, 4 * k if most is None else max(most, k)), BOUNDS), "code-bounds")
    query = ("q_block", "q_pos")
    order = Window.partitionBy(*query).orderBy(F.desc("lower"))
    first = bounds.select(*query, "lower", F.row_number().over(order).alias("nth")).where(F.col("nth") <= k)
    known = first.groupBy(*query).agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    reaches = F.col("least").isNull() | (F.col("upper") + F.lit(10.0**-SCORE_DIGITS) >= F.col("least"))
    left = materialize(bounds.join(known, list(query), "left").where(reaches).select(*query, "b_block", "b_pos"), "code-left")
    again = materialize(left.where("b_pos < 0").select("q_block", "b_block").distinct(), "dense-pairs")
    return left.where("b_pos >= 0").join(again, ["q_block", "b_block"], "left_anti"), again


def topk_codes(
    queries: DataFrame,
    blocks: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    exclude_self: bool = False,
    block: int = 1024,
    most: int | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the rows of ``topk_similar`` from a base written by ``code_blocks``.

    ``most``: how many rows a query may have left in one block (4 k if not given)."""
    ship_package(queries.sparkSession)
    q = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vec).alias("vec"))
    q_blocks = materialize(packed(q, block).withColumn("block_id", F.uuid()), "code-queries")
    pairs, again = left_by_codes(q_blocks, blocks, k, exclude_self, most)
    exact = pairs.join(_unpacked(blocks, pairs, "doc_id", "b"), ["b_block", "b_pos"])
    exact = exact.join(_unpacked(q_blocks, pairs, "query_id", "q"), ["q_block", "q_pos"])
    unit = F.lit(10.0**SCORE_DIGITS)
    exact = exact.select("query_id", "doc_id", (F.rint(dot("q_vec", "b_vec") * unit) / unit).alias("score"))
    exact = exact.where(F.abs("score") < F.lit(float("inf")))
    whole = again.join(q_blocks.select(F.col("block_id").alias("q_block"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), "dim"), "q_block")
    whole = whole.join(blocks.select(F.col("block_id").alias("b_block"), F.col("ids").alias("b_ids"), F.col("mat").alias("b_mat")), "b_block")
    whole = whole.select("q_ids", "q_mat", "b_ids", "b_mat", "dim").mapInArrow(_meet(k, exclude_self), "query_id bigint, doc_id bigint, score double")
    return ranked(exact.unionByName(whole), k)
