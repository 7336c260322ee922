"""Substring dedup by relative Lempel-Ziv parsing.

A document is factored against what documents with smaller doc_ids hold: a
factor is a run of words that is there too. Factors of at least ``window``
words are duplicate spans and are cut out.

* **Reference blocks.** Every ``window`` consecutive words choose one anchor,
  the ``gram``-word shingle with the smallest hash (the first of equals), so
  equal passages choose equal anchors. All windows that choose one anchor make
  up its *block*, about 70 words; blocks cover the text, and every document's
  blocks are in the index under their anchor's hash. An anchor found in one
  document only ends there.
* **Factoring.** A block whose words all match the block of a smaller document
  is a factor as a whole. The index keeps one entry for each different block,
  with its first document, so a passage in millions of documents is one entry.
* **Factor boundaries.** Where an anchor has several different blocks, a factor
  may begin or end inside. The first document of each of these blocks lists
  the windows of every place it has the block at, in all its rows; a window
  whose words also start in a smaller document belongs to a factor. Every
  holder with a larger doc_id has a smaller document with all of it already.
* **Greedy parse.** Within a document the matched windows, in order, are joined
  into the longest factors; their words go.

Anchors and blocks depend on words alone, so the result is exactly: a word
goes if a window over it has the same words as a window of a document with a
smaller doc_id. Texts travel once, to meet their factors; both uses share that
exchange. All groupings are minima and counts that combine before the shuffle.

Defined results: null and blank texts have no words and lose none; texts
shorter than a window lose none; rows with one doc_id are one document to each
other, so neither loses to the other; a null doc_id is not smaller than any
and none is smaller than it; an empty table gives an empty result; other
columns pass through ``dedup``, and helper columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lumenvec.llm.common import fresh
from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

WINDOW = 50
GRAM = 16
#: A worker keeps the hashes of this many distinct words at most.
WORD_CACHE = 1 << 19


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def blocks(words: list[bytes], hashes: WordHashes, window: int, gram: int):
    """(first window, windows, anchor hash) of each block, in order."""
    import numpy as np

    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - gram + 1
    mix = np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * mix + h[j : j + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    per = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1) + np.arange(n - per + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    count = np.diff(np.concatenate((first, [len(at)])))
    return first, count, grams[at[first]].view(np.int64)


def spans(words: list[bytes]):
    """The words joined by one space, and each word's first byte (one more than words)."""
    import numpy as np

    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return b" ".join(words), starts


def index(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, first, n, anchor, block) from rows (doc_id, row, text): the blocks of every text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        hashes = WordHashes()
        for b in batches:
            out = [[], [], [], [], []]
            for i, text in enumerate(b.column(2).to_pylist()):
                words = (text or "").encode().split()
                if len(words) < window:
                    continue
                first, n, anchor = blocks(words, hashes, window, gram)
                joined, starts = spans(words)
                ends = starts[first + n + window - 1] - 1
                block = [xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(starts[first].tolist(), ends.tolist())]
                for column, values in zip(out, (np.full(len(first), i), first, n, anchor, np.array(block, np.uint64).view(np.int64))):
                    column.append(values)
            take, first, n, anchor, block = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            take = pa.array(take)
            columns = [b.column(0).take(take), b.column(1).take(take), pa.array(first, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(anchor), pa.array(block)], ["doc_id", "row", "first", "n", "anchor", "block"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row long, first int, n int, anchor long, block long"
    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def boundary_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, first, content) from rows (doc_id, row, text, spans): each window of the listed blocks."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            take, at, content = [], [], []
            for i, (text, listed) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if not listed:
                    continue
                joined, starts = spans((text or "").encode().split())
                first = np.concatenate([np.arange(x["first"], x["first"] + x["n"]) for x in listed])
                ends = starts[first + window] - 1
                content += [xxhash.xxh3_128_digest(joined[x:y]) for x, y in zip(starts[first].tolist(), ends.tolist())]
                take.append(np.full(len(first), i))
                at.append(first)
            take = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64))
            at = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), at, pa.array(content, pa.binary())],
                ["doc_id", "row", "first", "content"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "row", "text", "spans").mapInArrow(run, f"doc_id {kind}, row long, first int, content binary")


def cut(words: list, factors: list[dict], window: int) -> tuple[list, list[tuple[int, int]]]:
    """What is left of the words, and the duplicate spans (from, to): matched
    windows in order, each joined to the factor it continues."""
    merged: list[list[int]] = []
    for first, n in sorted((x["first"], x["n"]) for x in factors):
        end = first + n + window - 1
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([first, end])
    left, at = [], 0
    for a, b in merged:
        left += words[at:a]
        at = b
    return left + words[at:], [(a, b) for a, b in merged]


def factors(docs: DataFrame, texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, first, n): runs of windows of each row that a smaller document has.

    ``docs``: (doc_id, row, text); ``texts``: the same, dealt by row. A row is known by
    doc_id and the hash of its text together: a hash alone can stand for two."""
    blocks_of = materialize(index(docs.where("doc_id IS NOT NULL"), window, gram), "rlz-blocks")
    # Every table that is joined by a key is written first: a join of two plain
    # reads is one that Spark can split where a key is hot.
    shared = blocks_of.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    shared = materialize(shared.select("anchor"), "rlz-anchors")
    found = materialize(blocks_of.join(shared, "anchor"), "rlz-shared")

    entries = found.groupBy("anchor", "block").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    entries = materialize(entries, "rlz-entries")
    later = found.join(
        entries.where("last > doc_id").select("anchor", "block", F.col("doc_id").alias("smallest")), ["anchor", "block"]
    ).where("doc_id > smallest")

    open_ = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    firsts = entries.join(materialize(open_, "rlz-open"), "anchor").select("anchor", "block", "doc_id")
    # Every place of the block in its first document, not only the first one.
    places = found.join(materialize(firsts, "rlz-firsts"), ["anchor", "block", "doc_id"], "left_semi")
    listed = places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    edges = texts.join(listed, ["doc_id", "row"])
    windows = materialize(boundary_windows(edges, window), "rlz-windows")
    least = windows.groupBy("content").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("last"))
    least = materialize(least.where("smallest < last").select("content", "smallest"), "rlz-least")
    inner = windows.join(least, "content").where("doc_id > smallest")
    return later.select("doc_id", "row", "first", "n").unionByName(inner.select("doc_id", "row", "first", F.lit(1).alias("n")))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one space), ``n_words``,
    ``n_removed`` and ``spans`` (the duplicate spans in words, from and to).

    Texts that lose nothing have their words in ``kept`` all the same."""
    ship_package(docs.sparkSession)
    row, of, of_key, found, kept, n_words, n_removed, spans_ = fresh(
        docs, "row", "of_row", "of_key", "factors", "kept", "n_words", "n_removed", "spans"
    )
    own = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    per = factors(own, own, window, gram).groupBy(F.col("doc_id").alias(of_key), F.col("row").alias(of))
    per = per.agg(F.collect_list(F.struct("first", "n")).alias(found))
    wide = docs.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    # Rows without a doc_id have no factors.
    joined = wide.join(per, (F.col(f"`{key}`") == F.col(of_key)) & (F.col(row) == F.col(of)), "left").drop(row, of, of_key)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for t, f in zip(texts, b.column(b.num_columns - 1).to_pylist()):
                words = (t or "").encode().split()
                left, cuts = cut(words, f or [], window)
                out.append((b" ".join(left).decode(), len(words), len(words) - len(left), [{"from": x, "to": y} for x, y in cuts]))
            columns = list(zip(*out)) or [()] * 4
            span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            new = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), span))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], kept, n_words, n_removed, spans_])

    span = StructType([StructField("from", IntegerType()), StructField("to", IntegerType())])
    more = [(kept, StringType()), (n_words, LongType()), (n_removed, LongType()), (spans_, ArrayType(span))]
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, k) for n, k in more]]))
