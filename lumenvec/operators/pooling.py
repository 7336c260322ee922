"""Masked mean pooling, L2 normalisation and preview.

One rule for every dimension: float64 ``h * mask`` is summed, so a NaN under
mask 0 is NaN, and a row without a vector adds nothing. Rows of one key lie
together in most inputs, so each Arrow batch first sums its own rows per key;
the partial sums are dealt by key and summed again while they stream by. A
task holds one batch and one key's sums, whatever the key's size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.vectors import preview

MIN_MASK = 1e-9  # Fixed value: the clamp on the mask sum.

SUMS = "sums array<double>, mask_sum double, n_rows long, n_missing long"


def _matrix(column, dim: int):
    """A list column as a float64 matrix and which rows have a vector."""
    import numpy as np
    import pyarrow as pa

    there = np.array(column.is_valid().to_numpy(zero_copy_only=False), bool)
    out = np.zeros((len(column), dim))
    flat = column.drop_null().flatten()
    out[there] = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, dim)
    return out, there


def _sums_of_keys(keys, mat, rest) -> tuple:
    """Sums over equal neighbours: (keys, vectors, the other columns)."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(mat, first, axis=0), [np.add.reduceat(x, first) for x in rest]


def _batch(keys, mat, mask, n, missing):
    import pyarrow as pa

    dim = mat.shape[1]
    flat = pa.array(mat.reshape(-1))
    sums = pa.ListArray.from_arrays(pa.array(range(0, (len(keys) + 1) * dim, dim), pa.int32()), flat)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), sums, pa.array(mask, pa.float64()), pa.array(n, pa.int64()), pa.array(missing, pa.int64())],
        ["key", "sums", "mask_sum", "n_rows", "n_missing"],
    )


def _partial(dim: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            order = np.argsort(keys, kind="stable")
            mat, there = _matrix(b.column(1), dim)
            mask = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            rest = [mask[order], np.ones(len(keys), np.int64), (~there).astype(np.int64)[order]]
            k, s, (m, n, missing) = _sums_of_keys(keys[order], (mat * mask[:, None])[order], rest)
            yield _batch(k, s, m, n, missing)

    return run


def _final(dim: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held = None  # the last key so far, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            mat, _ = _matrix(b.column(1), dim)
            rest = [b.column(i).to_numpy() for i in (2, 3, 4)]
            if held:
                keys, mat = np.concatenate((held[0], keys)), np.concatenate((held[1], mat))
                rest = [np.concatenate((h, x)) for h, x in zip(held[2], rest)]
            k, s, (m, n, missing) = _sums_of_keys(keys, mat, rest)
            held = (k[-1:], s[-1:], [x[-1:] for x in (m, n, missing)])
            if len(k) > 1:
                yield _batch(k[:-1], s[:-1], m[:-1], n[:-1], missing[:-1])
        if held:
            yield _batch(held[0], held[1], *held[2])

    return run


def masked_mean_pool(
    long: DataFrame, dim: int, key: str = "doc_id", hidden_col: str = "hidden", mask_col: str = "attention"
) -> DataFrame:
    """Per key and dimension ``sum(h * mask) / max(sum(mask), 1e-9)``.

    A key whose mask is all 0, or that has no vector, pools to zeros; a null mask
    is 0; rows without a key are in no pool; an empty table gives no rows. Returns
    (key, pooled ARRAY<DOUBLE>, mask_sum DOUBLE, n_rows, n_missing); the last
    counts rows without a vector, or with one of another length than ``dim``."""
    from lumenvec.session import ship_package

    ship_package(long.sparkSession)
    hidden = F.col(hidden_col).cast("array<double>")
    rows = long.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.when(F.size(hidden) == dim, hidden).alias("h"),
        F.coalesce(F.col(mask_col).cast("double"), F.lit(0.0)).alias("m"),
    )
    partial = rows.mapInArrow(_partial(dim), f"key long, {SUMS}")
    total = partial.repartition("key").sortWithinPartitions("key").mapInArrow(_final(dim), f"key long, {SUMS}")
    den = F.greatest(F.col("mask_sum"), F.lit(MIN_MASK))
    return total.select(
        F.col("key").alias(key), F.transform("sums", lambda x: x / den).alias("pooled"), "mask_sum", "n_rows", "n_missing"
    )


def embedding_preview(df: DataFrame, col: str = "embedding", n: int = 10) -> DataFrame:
    """Shape and first ``n`` values."""
    return df.withColumn("shape", F.size(col)).withColumn("head", preview(col, n))
