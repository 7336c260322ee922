"""Pre-tokens of texts in Arrow batches (O6 where a task takes them on at once).

What ``functions.text.v3_pretokens`` gives, as array work on the bytes of a part's texts: no object
and no regular expression for an occurrence. The JVM trims; the tasks cut; the word prefix is put before
the distinct pre-tokens. Which code points are letters or digits is asked of the JVM once an application,
so both ways have the same pre-tokens, whatever its Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.text import LETTER_OR_DIGIT, WORD_PREFIX, unicode_trim

CODE_POINTS = 0x110000
SURROGATES = range(0xD800, 0xE000)  # no characters of their own

#: Kinds of bytes: between pre-tokens, of an ASCII word, the first or only one of another character, a later one.
SPACE, WORD, OTHER, LATER = range(4)


def _kinds():
    import numpy as np

    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x80:0xC0] = LATER
    kinds[list(b"\t\n\f\r ")] = SPACE
    kinds[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = WORD
    return kinds


_LETTERS: dict[str, bytes] = {}


def letters_and_digits(spark: SparkSession) -> bytes:
    """For every code point, 1 where the JVM's pattern of letters and digits finds it; a table of fixed size."""
    app = spark.sparkContext.applicationId
    if app not in _LETTERS:
        points = spark.range(0, SURROGATES.start, 1, 1).union(spark.range(SURROGATES.stop, CODE_POINTS, 1, 1))
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = points.where(char.rlike(LETTER_OR_DIGIT)).agg(F.collect_list("id")).first()[0]
        table = bytearray(CODE_POINTS)
        for c in found:
            table[c] = 1
        _LETTERS[app] = bytes(table)
    return _LETTERS[app]


def trimmed(col: Column | str) -> Column:
    """The text as the tasks cut it: trimmed, a null one empty, bytes that are no UTF-8 replaced as a Java string has them."""
    return F.make_valid_utf8(unicode_trim(col))


def pretokens(texts):
    """(place of each row's first pre-token, and the end; all pre-tokens in a row, without prefix) of an Arrow
    column of trimmed texts."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.string()).fill_null("")
    rows = len(texts)
    if not rows or not texts.buffers()[2]:
        return np.zeros(rows + 1, np.int64), pa.array([], pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + rows + 1]
    data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    kind = _kinds()[data]
    word = kind == WORD
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begin[first] = word[first]  # words don't go on in the next row
    begin |= kind == OTHER
    kept = kind != SPACE
    own = data[kept]
    offsets = np.append(np.flatnonzero(begin[kept]), len(own)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(own))
    return np.searchsorted(np.flatnonzero(begin), at), found


def prefixed(words: list[str], letters: bytes) -> list[str]:
    """Pre-tokens with the word prefix where they have a letter or digit: words but of underscores have."""
    return [WORD_PREFIX + w if (letters[ord(w)] if len(w) == 1 else w.strip("_")) else w for w in words]
