"""Column expressions and row helpers shared by the training-data operators.

A *word* is a maximal run of characters other than space and U+0009-U+000D;
words keep their case and punctuation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def words(text: str | Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), WHITE), "")


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row.

    Inside a lambda an expression is computed again for each element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores put before them until none clashes with a column."""
    out, taken = [], {c.lower() for c in df.columns}
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
