"""Arrow batches in parts of a bounded size.

Spark hands a task up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows at a
time, whatever they hold. Operators that make several arrays from a batch do so part
by part, so that a task's memory is that of one batch and the arrays of one part.
"""

from __future__ import annotations

from collections.abc import Iterator

# What a part has at most: rows, and items of its lists together (a single row may have more).
PART_ROWS = 1024
PART_ITEMS = 1 << 18
# Bytes of a part's texts, where texts are cut in the tasks (a single text may have more).
PART_BYTES = 1 << 20
# Values of the vectors that are pooled at a time, one for each row and dimension.
POOLED_VALUES = 1 << 20


def cuts(sizes, rows: int = PART_ROWS, items: int = PART_ITEMS) -> Iterator[tuple[int, int]]:
    """(begin, end) of the parts of rows of such sizes, in order."""
    import numpy as np

    ends = np.cumsum(np.asarray(sizes, np.int64))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(int(np.searchsorted(ends, before + items, side="right")), lo + rows))
        yield lo, hi
        lo = hi


def is_text(column) -> bool:
    import pyarrow as pa

    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def parts(batch, column: int, rows: int = PART_ROWS, items: int | None = None) -> Iterator:
    """``batch`` in slices, in order; ``column``: the list column whose items count, or the text column whose bytes do."""
    import pyarrow.compute as pc

    text = is_text(batch.column(column))
    sizes = (pc.binary_length if text else pc.list_value_length)(batch.column(column)).fill_null(0).to_numpy()
    for lo, hi in cuts(sizes, rows, items or (PART_BYTES if text else PART_ITEMS)):
        yield batch.slice(lo, hi - lo)
