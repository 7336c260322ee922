"""Hard-negative mining with exact scores from residue-number-system products.

Vectors are whole numbers: every component x becomes floor(scale * x). The score
of two rows is their inner product, exact, though all multiplying is done in
float32: for each of several small odd primes the components are reduced to
residues around zero, and the residue matrices are multiplied in panels so
narrow that every sum stays below 2^24, where float32 holds whole numbers
exactly. Balanced mixed-radix digits (Chinese remaindering) then give the signed
score. There are as many primes as the largest squared length of any row asks
for: by the Cauchy-Schwarz inequality no score is larger.

Anchors meet all rows in cells, one group of anchors with one group of rows; a
cell holds at most ``anchor_rows`` and ``base_rows`` vectors, and both are
dealt by row number, so no label or copy makes a cell large. A first round
keeps each cell's best positives of each anchor; windows choose among cells. A
second round takes their scores along and keeps, for each anchor and positive,
the cell's best rows of other labels whose score lies in the window
low * positive <= 100 * score <= high * positive. No row is left out of a cell:
results are exact.

Defined results: a row without id, label or vector, with a component that is
null or not finite, or of a squared length of 2^60 or more (scores would not fit
64 bits) takes no part; rows whose vectors differ in length never meet; a row
is no positive of an anchor with its own id; rows that repeat count each time,
and anchors that repeat give their results each time; an anchor without
positives, or a positive without negatives in its window, gives no row; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

EXACT = 1 << 24  # float32 holds every whole number up to here
PANEL = 256
MOST_SQUARED = 2.0**60


@dataclass(frozen=True)
class Mining:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchor_rows: int = 1 << 15
    base_rows: int = 1 << 17


def primes_for(dim: int, largest: int) -> list[int]:
    """Odd primes whose residues multiply exactly over a panel and whose product exceeds twice ``largest``."""
    width = max(1, min(dim, PANEL))
    half = int((EXACT / width) ** 0.5)
    p, found, product = 2 * half - 1, [], 1
    while product <= 2 * largest + 1:
        while any(p % q == 0 for q in range(3, int(p**0.5) + 1, 2)):
            p -= 2
        found.append(p)
        product *= p
        p -= 2
    return found


def residues(q, prime: int):
    """Residues of whole numbers around zero, as float32."""
    import numpy as np

    half = prime // 2
    return (np.mod(q + half, prime) - half).astype(np.float32)


def exact_products(a, b, primes: list[int]):
    """a @ b.T as int64; ``a`` and ``b``: for each prime, the residue matrix of the rows."""
    import numpy as np

    digits, weight, out = [], 1, None
    for k, p in enumerate(primes):
        dim, half = a[k].shape[1], p // 2
        r = np.zeros((len(a[k]), len(b[k])), np.int32)
        for at in range(0, dim, PANEL):
            r += (a[k][:, at : at + PANEL] @ b[k][:, at : at + PANEL].T).astype(np.int32)
            r %= p
        # What is left of the score after the digits so far, divided by their weight.
        w = 1
        known = np.zeros_like(r)
        for digit, q in zip(digits, primes):
            known = (known + digit * (w % p)) % p
            w *= q
        digit = (r - known) % p * pow(w % p, -1, p) % p if k else r
        digits.append(np.where(digit > half, digit - p, digit).astype(np.int32))
        with np.errstate(over="ignore"):
            part = digits[-1].astype(np.int64) * np.int64(_wrapped(weight))
            out = part if out is None else out + part
        weight *= p
    return out


def _wrapped(x: int) -> int:
    """A whole number modulo 2^64 as a signed one."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def best(scores, n: int):
    """Places of the n highest scores, of equal ones the first."""
    import numpy as np

    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:n]


def rows_of(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(id, label, q, dim, squared): the rows that take part, as whole numbers."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    q = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    whole = F.forall(F.col(f"`{vector}`"), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(2.0**31 / scale), F.lit(False)))
    lean = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), F.when(whole, q).alias("q"))
    lean = lean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull())
    squared = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    lean = lean.withColumn("q", F.col("q").cast("array<int>")).withColumns({"dim": F.size("q"), "squared": squared})
    return lean.where(F.col("squared") < MOST_SQUARED)


def mine(rows: DataFrame, anchors: Column, m: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from
    ``rows_of`` rows; ``anchors`` tells which of them are anchors."""
    spark = rows.sparkSession
    ship_package(spark)
    uid = F.monotonically_increasing_id()
    rows = materialize(rows.withColumns({"uid": uid, "is_anchor": F.coalesce(anchors, F.lit(False))}), "whole-vectors")
    n, n_anchors, largest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_anchor").cast("long")), F.lit(0)), F.max("squared")).first()
    cores = max(spark.sparkContext.defaultParallelism, 1)
    # Cells as even as hashing deals them; as many as there are cores for, where rows are few.
    a_groups = max(1, -(-n_anchors // m.anchor_rows))
    b_groups = max(1, -(-n // m.base_rows), min(2 * cores, n // 1024))
    limit = int((largest or 0) * (1 + 1e-9)) + 1  # a sum of doubles

    base = rows.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(b_groups)))
    base = base.select(F.explode(F.sequence(F.lit(0), F.lit(a_groups - 1))).alias("a"),
                       *[F.col(c).alias(c) for c in ("b", "dim", "id", "label", "q")])

    def cells(anchor_rows: DataFrame) -> DataFrame:
        dealt = anchor_rows.withColumn("a", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(a_groups)).cast("int"))
        return dealt.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b_groups - 1).cast("long"))))

    def met(anchor_rows: DataFrame, columns: list[str], found, schema: str) -> DataFrame:
        keys = ("a", "b", "dim")
        left = cells(anchor_rows).select(*keys, *columns).groupBy(*keys)
        return left.cogroup(base.groupBy(*keys)).applyInArrow(lambda x, y: in_cell(x, y, found, limit), schema)

    own = ["uid", "id", "label", "q"]
    anchor_rows = rows.where("is_anchor").select(*own, "dim")
    near = met(anchor_rows, own, lambda *x: cell_positives(*x, m), "uid long, id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= m.positives)
    wanted = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("p"))  # at most m.positives
    wanted = materialize(wanted.select(F.col("uid").alias("of"), F.col("p.id").alias("p_ids"), F.col("p.score").alias("p_scores")), "positives")

    asked = anchor_rows.join(wanted, F.col("uid") == F.col("of"))
    hard = met(asked, [*own, "p_ids", "p_scores"], lambda *x: cell_negatives(*x, m),
               "uid long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("uid", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m.negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def in_cell(left, right, found, limit: int):
    """One cell: scores by blocks of anchors, ``found(left, right ids, labels, blocks)``."""
    import numpy as np

    if not left.num_rows or not right.num_rows:
        return found(left.slice(0, 0), np.zeros(0, np.int64), {}, iter(()))
    right = right.sort_by([("label", "ascending"), ("id", "ascending")])
    ids, labels = (right.column(c).to_numpy() for c in ("id", "label"))
    dim = right.column("dim")[0].as_py()
    names, starts = np.unique(labels, return_index=True)
    spans = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(labels)])))
    matrix = lambda t: t.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim).astype(np.int64)
    primes = primes_for(dim, limit)
    base, anchors = matrix(right), matrix(left)
    base_r, anchor_r = ([residues(x, p) for p in primes] for x in (base, anchors))
    step = max(1, (1 << 21) // max(1, len(base)))  # so many scores at a time

    def blocks():
        for at in range(0, len(anchors), step):
            yield at, exact_products([x[at : at + step] for x in anchor_r], base_r, primes)

    return found(left, ids, spans, blocks())


def cell_positives(left, ids, spans, blocks, m: Mining):
    """The cell's best rows of each anchor's own label."""
    import numpy as np
    import pyarrow as pa

    uids, own, labels = (left.column(c).to_pylist() for c in ("uid", "id", "label"))
    out = [[], [], []]
    for at, scores in blocks:
        for i, row in enumerate(scores, at):
            lo, hi = spans.get(labels[i], (0, 0))
            other = np.flatnonzero(ids[lo:hi] != own[i])
            place = other[best(row[lo:hi][other], m.positives)] + lo
            out[0].append(np.full(len(place), uids[i]))
            out[1].append(ids[place])
            out[2].append(row[place])
    return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["uid", "id", "score"])


def cell_negatives(left, ids, spans, blocks, m: Mining):
    """The cell's best rows of other labels in the window of each anchor's positives."""
    import pyarrow as pa

    uids, own, labels, p_ids, p_scores = (left.column(c).to_pylist() for c in ("uid", "id", "label", "p_ids", "p_scores"))
    out = []
    for at, scores in blocks:
        for i, row in enumerate(scores, at):
            # Whole-number bounds of the window: low * p <= 100 * score <= high * p.
            windows = [(-(-m.low * p // 100), m.high * p // 100) for p in p_scores[i]]
            place, value, there = outside(row, ids, spans.get(labels[i], (0, 0)), windows)
            for nth, (lo, hi) in enumerate(windows):
                first = there(hi)
                for k in range(first, min(first + m.negatives, len(place))):
                    if value[k] < lo:
                        break
                    out.append((uids[i], own[i], nth, p_ids[i][nth], p_scores[i][nth], int(ids[place[k]]), int(value[k])))
    names = ["uid", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"]
    columns = list(zip(*out)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int32() if n == "nth" else pa.int64()) for c, n in zip(columns, names)], names)


def outside(row, ids, span, windows):
    """Rows out of ``span`` with a score in any window, best first, equal ones by id:
    (places, their scores, the first of them not above a score)."""
    import numpy as np

    ok = (row >= min(lo for lo, _ in windows)) & (row <= max(hi for _, hi in windows))
    ok[span[0] : span[1]] = False
    at = np.flatnonzero(ok)
    at = at[np.lexsort((ids[at], -row[at]))]
    value = row[at]
    return at, value, lambda most: int(np.searchsorted(-value, -most))
