"""The n most frequent items of each group, exact, without counting every item.

Counting all distinct items shuffles all of them, which for the unknown words of a
large corpus is nearly its whole vocabulary. Here a first pass keeps a Space-Saving
summary a task: at most ``counters`` (group, item) pairs with a count that is never
too high, and one number, the most that any pair of the task can be short of or lack
(counted and merged as Arrow tables; whenever there are too many pairs, the count of
the first that has to go is taken off all, and those that have nothing left go). Summaries
merge by adding: a pair's count is at least the sum of its counts and at most that
plus the sum of all tasks' numbers (M).

In a group, the n-th highest lower bound is a count that n items are known to reach.
Where it is above M, an item that no summary holds can't be among the first n, nor one
whose upper bound lies below it: the others (``candidates``) are few. A second pass
counts them exactly. A group whose bound is not above M (few rows, or very even
counts) is counted whole in that pass. So the result is exact for any number of
items and groups; what a task holds is bounded by ``counters``.

Defined results: a null group is a group, a null item is no item; ties come in the
order of items; groups without items give no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

COUNTERS = 1 << 16


class Summary:
    """Space-Saving counts of one task's keys, an Arrow table with a count ``n`` in its last
    column. ``short``: no key's true count is above its count here by more."""

    def __init__(self, counters: int):
        self.counters, self.parts, self.rows, self.short = counters, [], 0, 0

    def add(self, keys) -> None:
        """A table of keys, a row for each time one is seen."""
        import pyarrow as pa

        for at in range(0, keys.num_rows, 4 * self.counters):
            part = keys.slice(at, 4 * self.counters)
            self.parts.append(part.append_column("n", pa.repeat(pa.scalar(1, pa.int64()), part.num_rows)))
            self.rows += part.num_rows
            if self.rows > 8 * self.counters:
                self.merge(2 * self.counters)

    def merge(self, most: int) -> None:
        """One row a key; if those are more than ``most``, the largest ``counters`` counts stay, less the next one."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.parts:
            return
        t = pa.concat_tables(self.parts)
        keys = t.column_names[:-1]
        t = t.group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])
        if t.num_rows > most:
            n = t.column("n").to_numpy()
            off = int(np.partition(n, len(n) - self.counters - 1)[len(n) - self.counters - 1])
            t = t.set_column(len(keys), "n", pc.subtract(t.column("n"), off)).filter(pa.array(n > off))
            self.short += off
        self.parts, self.rows = [t], t.num_rows

    def table(self):
        self.merge(self.counters)
        return self.parts[0] if self.parts else None


def summaries(rows: DataFrame, by: list[str], item: str, counters: int = COUNTERS) -> DataFrame:
    """(*by, item, n, short) of every task: its pairs with their counts, and in a row without item what they can be short of."""
    ship_package(rows.sparkSession)
    lean = rows.select(*by, item).where(F.col(item).isNotNull())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = Summary(counters)
        for b in batches:
            s.add(pa.Table.from_batches([b]).rename_columns([str(i) for i in range(b.num_columns)]))
        t = s.table()
        if t is None:
            return
        columns = pa.schema(zip([*by, item, "n", "short"], [*t.schema.types, pa.int64()]))
        for b in t.combine_chunks().to_batches(1 << 14):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], schema=columns)
        lost = [*(pa.nulls(1, x) for x in t.schema.types), pa.array([s.short], pa.int64())]
        yield pa.RecordBatch.from_arrays(lost, schema=columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema) + ", n long, short long"
    return lean.mapInArrow(run, schema)


def candidates(found: DataFrame, by: list[str], item: str, n: int) -> tuple[DataFrame, DataFrame]:
    """From ``summaries``: (the pairs that can be among the first n of their group, the groups for which that is sure)."""
    missing = found.agg(F.coalesce(F.sum("short"), F.lit(0))).first()[0]
    merged = found.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.sum("n").alias("least"))
    merged = materialize(merged, "frequent-merged")
    w = Window.partitionBy(*by).orderBy(F.desc("least"))
    top = merged.select(*by, "least", F.row_number().over(w).alias("nth")).where(F.col("nth") <= n)
    groups = top.groupBy(*by).agg(F.min("least").alias("nth_least"), F.count(F.lit(1)).alias("items"))
    # With nothing short, a group of fewer than n items is known whole.
    sure = groups.where((F.lit(missing) == 0) | ((F.col("items") == n) & (F.col("nth_least") > missing)))
    sure = materialize(sure.select(*by, "nth_least"), "frequent-groups")
    pairs = merged.join(_renamed(sure, by, "_g"), _same(by, "_g")).where(F.col("least") + missing >= F.col("nth_least"))
    return materialize(pairs.select(*by, item), "frequent-candidates"), sure.select(*by)


def _renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{i}" for i, c in enumerate(columns)})


def _same(columns: list[str], prefix: str) -> Column:
    """Equal in all columns, nulls too."""
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(columns)))


def most_frequent(rows: DataFrame, by: list[str], item: str, n: int = 5, counters: int = COUNTERS) -> DataFrame:
    """(*by, rank, item, n): the ``n`` most frequent items of each group (count desc, item asc).

    ``rows`` is read twice. Groups and items are numbers, dates or strings; without ``by`` all rows
    are one group; no column may be called n, rank or short."""
    if not by:
        return most_frequent(rows.select(F.lit(0).alias("_all"), item), ["_all"], item, n, counters).drop("_all")
    found = materialize(summaries(rows, by, item, counters), "frequent-summaries")
    pairs, sure = candidates(found, by, item, n)
    lean = rows.select(*by, item).where(F.col(item).isNotNull())
    j = lean.join(_renamed(sure, by, "_g").withColumn("_sure", F.lit(True)), _same(by, "_g"), "left")
    j = j.join(_renamed(pairs, [*by, item], "_p").withColumn("_near", F.lit(True)), _same([*by, item], "_p"), "left")
    counts = j.where(F.col("_near") | F.col("_sure").isNull()).groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc(item))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.select(*by, F.col("rank").cast("bigint").alias("rank"), item, "n")
