"""Array-valued vector expressions (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squared_norm(col: Column | str) -> Column:
    return F.aggregate(_c(col), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x)


def l2_normalize(col: Column | str) -> Column:
    """x / sqrt(sum(x^2)); a zero vector gives NaN in every slot (no guard,
    like the reference), written so ANSI mode never divides by zero.

    The norm is bound once through a one-element array, so it is not
    recomputed for every element inside the lambda."""
    v = _c(col)
    once = F.transform(
        F.array(F.sqrt(squared_norm(v))),
        lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n)),
    )
    return F.when(v.isNotNull(), once[0])


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two equal-length arrays."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NaN when either side has zero norm."""
    den = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(den == 0, F.lit(float("nan"))).otherwise(dot(a, b) / den)


def max_abs_diff(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.array_max(diffs)


def preview(col: Column | str, n: int = 10) -> Column:
    """First n values, as the reference prints them."""
    return F.slice(_c(col), 1, n)


def static_vector(id_col: Column | str, dim: int) -> Column:
    """Deterministic test vector: (((id*31 + d*17) % 129) - 64) / 64.

    Values are dyadic, so any summation order gives the same double.
    """
    i = _c(id_col).cast("bigint")
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: ((((i * 31 + d.cast("bigint") * 17) % 129) - 64).cast("double") / F.lit(64.0)),
    )
