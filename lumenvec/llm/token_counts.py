"""Token counts with overlap resynchronisation.

A text of up to ``chunk`` characters is encoded in one go. A longer one is
encoded in overlapping chunks, each with the places (character offsets) at
which a part of it begins; the ids of a part depend on the part alone. Two
neighbouring chunks are spliced at a place inside their overlap where *both*
begin a part. That place is stable: the left chunk reads the text from a
proven place on, so it is right up to the last parts before its cut end
(these, and as many characters as the longest added token has, are left out);
and a scan that begins a part at a right place goes on as the whole scan does.
If the overlap has no such place it is doubled; when it reaches back to the
last proven place, the chunk begins there, which needs no alignment, and is twice
as long as what had been read from there. So counts are exact for every text and
the work grows with its length; memory is bounded by the chunk or twice the
longest stretch without a stable place (such as a line of CJK without a sign).

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are
counted each by itself, whatever they share; an empty table gives an empty
result; other columns pass through, the new ones take names that don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenvec.llm.common import fresh
from lumenvec.llm.encoding import Encoder, encoder
from lumenvec.session import ship_package

CHUNK = 1 << 14
OVERLAP = 256


def parts(enc: Encoder, text: str):
    """(places, before): where parts begin, and how many tokens come before each
    place; the last place is the end of the text, with all its tokens before it."""
    import numpy as np

    if (lines := enc.units(text)) is not None:
        width, count = [], []
        for k, words in enumerate(lines):
            if k:
                width.append(1)
                count.append(len(enc.newline))
            width.append(len(words[0]))
            count.append(len(enc.first[words[0]]))
            width += [len(w) + 1 for w in words[1:]]
            count += [len(enc.spaced[w]) for w in words[1:]]
        ends, tokens = np.cumsum(width), np.cumsum(count) // 4
        return np.concatenate(([0], ends)), np.concatenate(([0], tokens))
    e = enc.tokenizer.encode(text, add_special_tokens=False)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    # An added token in the text starts the count of words anew or has none.
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])) | (word < 0)) if len(word) else np.zeros(0, np.int64)
    offsets = e.offsets  # a new list each time it is asked for
    at = np.array([offsets[i][0] for i in starts], np.int64)
    return np.concatenate((at, [len(text)])), np.concatenate((starts, [len(word)]))


def count_tokens(enc: Encoder, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The tokens of one text, chunk by chunk where it is long."""
    import numpy as np

    if not text:
        return 0
    if len(text) <= chunk:
        return len(enc.ids(text)) // 4
    margin = max([len(a) for a in enc.added], default=0)
    proven, total = 0, 0
    start, end = 0, chunk
    places, before = parts(enc, text[:end])
    while end < len(text):
        wide = overlap
        while True:
            # White space at a chunk's edge would send the chunk to the library as a whole.
            at = max(proven, end - wide)
            at -= at > proven and text[at] in " \n"
            to = max(at + chunk, end + chunk // 2, at + 2 * (end - at) if at == proven else 0)
            to = min(len(text), to)
            to += to < len(text) and text[to - 1] in " \n"
            new, new_before = parts(enc, text[at:to])
            new = new + at
            if at == proven:
                splice, i, j = proven, int(np.searchsorted(places, proven)), 0
                break
            # Not the left chunk's last parts, nor the right one's cut first part.
            left = places[:-3]
            left = left[(left > at) & (left <= end - margin)]
            both = left[np.isin(left, new[1:-1])]
            if len(both):
                splice = int(both[-1])
                i, j = int(np.searchsorted(places, splice)), int(np.searchsorted(new, splice))
                break
            wide *= 2
        k = int(np.searchsorted(places, proven))
        total += int(before[i] - before[k])
        proven, start, end = splice, at, to
        places, before = new, new_before
    k = int(np.searchsorted(places, proven))
    return total + int(before[-1] - before[k])


def counted(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens``, in Arrow batches where the text lies."""
    ship_package(docs.sparkSession)
    n_bytes, n_tokens = fresh(docs, "n_bytes", "n_tokens")
    at = docs.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            found = pa.array([count_tokens(enc, t, chunk, overlap) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, n_tokens])

    # The bytes are counted first; only the text's own column is read in Python.
    wide = docs.withColumn(n_bytes, F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long"))
    return wide.mapInArrow(run, StructType([*wide.schema.fields, StructField(n_tokens, LongType())]))
