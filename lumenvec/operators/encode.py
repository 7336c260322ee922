"""Encoders: token ids -> pooled sentence vectors.

Two encoders share one output contract
``(doc_id, pooled ARRAY<DOUBLE>, mask_sum, n_tokens, inference_time, setup_time,
call_seq, call_time, call_id, error)``, one row for each text:

* ``StaticEncoder`` (O12a): a token-vector table. Where the vocabulary and the
  table keep under ``MAX_SHIPPED_BYTES``, texts stay rows: the JVM splits words, or trims the
  texts that the tasks cut; parts of an Arrow batch look their tokens up, count them and pool their vectors by a
  sparse product (``encode_rows``), so that a task holds one batch and the arrays of one part; no explode, no shuffle, any dimension, batch or stream.
  Beyond that bound nothing is sent whole: the vectors are cut into blocks of
  dimensions, and each block meets the token counts of every text in a sparse
  product (``encode_blocks``). Both give the same rows.
* ``OnnxEncoder`` (O12b): an ONNX model run by ``mapInPandas`` over Arrow
  batches; see ``lumenvec.operators.onnx_batch``.

Defined results of the static encoder, either way: a null text is an empty one
and pools its two markers; a null doc_id and repeated rows pass through, each with
its own result; a token id without a vector, or a vector of another length,
makes the row an error that counts such tokens; an unknown task of a strict
profile is an error; an empty table gives no rows. Columns in ``keep`` come
through as ``keep_<name>``, whatever their names.

Timings: a *call* is one part of an Arrow batch. ``inference_time`` is a row's share of its
call (gathering and pooling), ``call_time`` when the call began, ``call_id`` tells
calls apart across tasks, ``setup_time`` (once a task) is the time until the
table is at hand. ``encode_blocks`` has no call of its own for a row: its rows
have no timings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.functions.vectors import static_vector
from lumenvec.operators.batches import PART_ROWS, POOLED_VALUES, parts
from lumenvec.operators.pooling import MIN_MASK
from lumenvec.operators.subword import piece_counts
from lumenvec.operators.tokens import (
    RowIds, framed, id_rows, lookup_ids, raw_tokens, sent_letters, sent_vocabulary, task_ids, token_ids, uncut_tokens,
)
from lumenvec.plans.strategy import materialize
from lumenvec.profiles import Profile
from lumenvec.session import ship_package
from lumenvec.sources.vocab import Vocabulary

# What may be sent to every executor: tokens, ids and vectors together.
MAX_SHIPPED_BYTES = 512 << 20
# What a task holds of the vector table at a time where it can't be sent.
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class StaticEncoder:
    """``task_scale``: with a task list, (task_id + 1) * task_scale is added to
    every dimension of every vector, as the stand-in for a task adapter."""

    vectors: DataFrame  # (id BIGINT, v ARRAY<DOUBLE>), one row per token id
    dim: int
    row_bound: int | None = None
    runtime: str = "static"
    task_scale: float = 0.0


def fixture_vectors(vocab: Vocabulary, dim: int = 64, task_scale: float = 0.0) -> StaticEncoder:
    """Deterministic vectors for every id the vocabulary can emit, plus 0."""
    ids = vocab.reverse.select("id").unionByName(vocab.specials.select("id"))
    ids = ids.unionByName(ids.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("id"))).distinct()
    vec = ids.select("id", static_vector("id", dim).alias("v"))
    bound = None if vocab.row_bound is None else 2 * vocab.row_bound + 1
    return StaticEncoder(vectors=vec, dim=dim, row_bound=bound, task_scale=task_scale)


def vocabulary_bytes(vocab: Vocabulary) -> int:
    size = F.coalesce(F.sum(F.octet_length("token").cast("long") + 16), F.lit(0))
    return vocab.tokens.unionByName(vocab.specials.select(F.col("content").alias("token"), "id")).agg(size).first()[0]


def vector_bytes(enc: StaticEncoder) -> int:
    return enc.vectors.count() * (8 * enc.dim + 8)


def _finished(pooled: DataFrame) -> DataFrame:
    err = F.when(F.col("n_missing") > 0, F.format_string("%d token ids have no vector", F.col("n_missing")))
    err = F.coalesce(F.col("task_error"), err)
    timings = {"inference_time": "double", "setup_time": "double", "call_seq": "int", "call_time": "double", "call_id": "string"}
    return pooled.select(
        "doc_id",
        F.when(err.isNull(), F.col("pooled")).alias("pooled"),
        "mask_sum",
        "n_tokens",
        *[F.col(c) if c in pooled.columns else F.lit(None).cast(k).alias(c) for c, k in timings.items()],
        err.alias("error"),
        *[F.col(c) for c in pooled.columns if c.startswith("keep_")],
    )


def _with_task(rows: DataFrame, profile: Profile, tasks: DataFrame | None, own: bool) -> DataFrame:
    """``rows`` with ``task_id`` and ``task_error``; ``own``: they have a column ``task``."""
    if tasks is None:
        return rows.withColumns({"task_id": F.lit(0).cast("long"), "task_error": F.lit(None).cast("string")})
    return task_ids(rows if own else rows.withColumn("task", F.lit(profile.task)), tasks, profile)


def _carried(texts: DataFrame, text_col: str, id_col: str, own_task: bool, keep: list[str] | None) -> DataFrame:
    """(doc_id, text[, task], keep_...): what a row needs, under names of our own."""
    extra = [F.col(c).alias(f"keep_{c}") for c in keep or []]
    task = [F.col("task")] if own_task else []
    return texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *task, *extra)


def encode_rows(
    texts: DataFrame,
    vocab: Vocabulary,
    profile: Profile,
    enc: StaticEncoder,
    text_col: str = "text",
    id_col: str = "doc_id",
    tasks: DataFrame | None = None,
    keep: list[str] | None = None,
    unit: bool = False,
) -> DataFrame:
    """O12a + O13 row by row: one output row per text, in Arrow batches. ``unit``: with O14, the
    pooled vectors are normalised where they are made, as ``functions.vectors.l2_normalize`` does."""
    import numpy as np

    spark = texts.sparkSession
    own_task = tasks is not None and "task" in texts.columns
    lean = _carried(texts, text_col, id_col, own_task, keep)
    extra = [c for c in lean.columns if c.startswith("keep_")]
    rows = uncut_tokens(lean, profile, keep=[*(["task"] if own_task else []), *extra])
    rows = _with_task(rows, profile, tasks, own_task).select("doc_id", "tokens", "task_id", "task_error", *extra)
    words, unk_id = sent_vocabulary(vocab, profile)
    letters = sent_letters(spark, profile)
    ship_package(spark)

    dim, scale = enc.dim, enc.task_scale if tasks is not None else 0.0
    most = max(1, min(PART_ROWS, POOLED_VALUES // max(dim, 1)))
    vectors = enc.vectors.where(F.size("v") == dim).toPandas()
    order = np.argsort(vectors["id"].to_numpy(), kind="stable")
    matrix = np.stack(vectors["v"].to_numpy()).astype(np.float64)[order] if len(vectors) else np.zeros((0, dim))
    shipped = spark.sparkContext.broadcast((vectors["id"].to_numpy()[order], matrix))
    finite = bool(np.isfinite(matrix.sum()))

    def run(batches: Iterator) -> Iterator:
        import time
        import uuid

        import pyarrow as pa

        t0 = time.perf_counter()
        vector_ids, mat = shipped.value
        setup, task_run, call = time.perf_counter() - t0, uuid.uuid4().hex, 0
        ids, pieces = words.value
        places = places_of_tokens(vector_ids, ids | {None: unk_id})
        made = RowIds((places, pieces), profile, places[None], letters=letters.value)
        for b in (part for whole in batches for part in parts(whole, 1, most)):
            offsets, places = made.of(b.column(1))
            began, t0 = time.time(), time.perf_counter()
            n = np.diff(offsets).astype(np.int64)
            row, there = np.repeat(np.arange(b.num_rows), n), places >= 0
            missing = np.bincount(row[~there], minlength=b.num_rows)
            means = sparse_product(*row_counts(row[there], places[there], b.num_rows, len(mat)), b.num_rows, mat, finite)
            means /= np.maximum(n, MIN_MASK)[:, None]
            if scale:
                means += (b.column(2).fill_null(0).to_numpy()[:, None] + 1) * scale
            if unit:
                unit_rows(means)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(means.reshape(-1)))
            share, m = (time.perf_counter() - t0) / b.num_rows, b.num_rows
            timings = [pa.array([share] * m), pa.array([setup] + [None] * (m - 1), pa.float64()), pa.array([call] * m, pa.int32()),
                       pa.array([began] * m), pa.array([f"{task_run}-{call}"] * m)]
            setup, call = None, call + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), lists, pa.array(n.astype(float)), pa.array(n), pa.array(missing), *timings, *b.columns[3:]],
                ["doc_id", "pooled", "mask_sum", "n_tokens", "n_missing", "inference_time", "setup_time", "call_seq", "call_time", "call_id",
                 "task_error", *extra],
            )

    kinds = dict(rows.dtypes)
    schema = ("doc_id long, pooled array<double>, mask_sum double, n_tokens long, n_missing long, inference_time double, "
              "setup_time double, call_seq int, call_time double, call_id string, task_error string")  # fmt: skip
    return _finished(rows.mapInArrow(run, ", ".join([schema, *[f"`{c}` {kinds[c]}" for c in extra]])))


def unit_rows(rows) -> None:
    """Each row over its length, in place; a row of length 0 is NaN throughout. The squares are added one
    after the other, as the expression does, so that both give the same bits."""
    import numpy as np

    if not rows.shape[1]:
        return
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])
        norm[norm == 0] = np.nan
        rows /= norm[:, None]


def places_of_tokens(known, ids: dict) -> dict:
    """``ids`` of tokens as places among the sorted known ids; -1 where an id is not there."""
    import numpy as np

    tokens = [t for t, i in ids.items() if i is not None]
    at, there = place_of(known, np.array([ids[t] for t in tokens], np.int64))
    return ids | dict(zip(tokens, np.where(there, at, -1).tolist()))


def place_of(known, ids):
    """(places of ids among the sorted known ones, whether they are there)."""
    import numpy as np

    if not len(known):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return at, known[at] == ids


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(key, text): each distinct ``text`` by its digest."""
    key = F.unhex(F.sha2("text", 256)).alias("key")
    return texts.select(F.coalesce("text", F.lit("")).alias("text")).select(key, "text").dropDuplicates(["key"])


def piece_counts_and_vectors(texts: DataFrame, vocab: Vocabulary, profile: Profile, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token_counts`` of the subword profile by the numbers of pieces, and ``vectors`` by the same numbers.

    The ids are looked up by joins with the vocabulary's table, once for each piece and not for
    each occurrence: a piece's number takes the vector of its id."""
    rows = raw_tokens(distinct_texts(texts), profile, id_col="key", keep=["key"])
    counts, numbers = piece_counts(framed(rows, profile), vocab, profile)
    ids = lookup_ids(numbers, vocab, profile).select(F.col("number"), "token_id")
    own = vectors.join(ids, F.col("id") == F.col("token_id")).select(F.col("number").alias("id"), "v")
    return counts, own


def token_counts(texts: DataFrame, vocab: Vocabulary, profile: Profile, ship_vocabulary: bool) -> DataFrame:
    """(key, ids, n): each distinct ``text`` by its digest, and its token ids with their counts.

    Copies of a text are counted once. ``ship_vocabulary``: ids are looked up
    row by row in a vocabulary that is sent; else by joins with its table."""
    once = distinct_texts(texts)
    if not ship_vocabulary:
        ids = token_ids(once, vocab, profile, id_col="key")
        per = ids.groupBy(F.col("doc_id").alias("key"), "token_id").agg(F.count(F.lit(1)).alias("n"))
        # A row a text: as many entries as it has different tokens.
        per = per.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("token_id", "n"))).alias("x"))
        return per.select("key", F.col("x.token_id").alias("ids"), F.col("x.n").alias("n"))
    rows = id_rows(once.withColumn("doc_id", F.lit(0)), vocab, profile, keep=["key"]).select("key", "ids")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in (part for whole in batches for part in parts(whole, 1)):
            at, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            found = [np.unique(flat[lo:hi], return_counts=True) for lo, hi in zip(at[:-1], at[1:])]
            sizes = pa.array(np.concatenate(([0], np.cumsum([len(x) for x, _ in found]))), pa.int32())
            columns = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
            lists = [pa.ListArray.from_arrays(sizes, pa.array(c, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["key", "ids", "n"])

    return rows.mapInArrow(run, "key binary, ids array<long>, n array<long>")


#: A product by whole matrices costs about as much as gathering so many vectors one by one, for each entry.
DENSE_SHARE = 16
#: Vectors that are at hand once more for a product, or for the sum of a row.
PRODUCT_VECTORS = 4096


def row_counts(row, at, rows: int, many: int):
    """(row, at, n): the different places, of ``many``, in each row, in order, and how often they are there."""
    import numpy as np

    key = row * many + at
    if rows * many <= DENSE_SHARE * len(key):
        n = np.bincount(key, minlength=rows * many)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    return key // max(many, 1), key % max(many, 1), n


def sparse_product(row, at, n, rows: int, mat, finite: bool):
    """(rows x width): the sum of ``n`` times the vectors ``mat[at]`` for each row, whose entries stand in order.

    The vectors that many rows have go by matrix products, which need finite vectors (0 times
    infinity is none); the others vector by vector."""
    import numpy as np

    sums, n = np.zeros((rows, mat.shape[1])), n.astype(float)
    often = np.bincount(at, minlength=len(mat)) * DENSE_SHARE >= max(rows, 1)
    if finite and often.any():
        used = np.flatnonzero(often)
        place = np.where(often, np.cumsum(often) - 1, -1)[at]
        for lo in range(0, len(used), PRODUCT_VECTORS):
            own = used[lo : lo + PRODUCT_VECTORS]
            here = (place >= lo) & (place < lo + len(own))
            counts = np.bincount(row[here] * len(own) + place[here] - lo, weights=n[here], minlength=rows * len(own))
            sums += counts.reshape(rows, len(own)) @ mat[own]
        row, at, n = (x[place < 0] for x in (row, at, n))
    ends = np.cumsum(np.bincount(row, minlength=rows))
    for i in np.unique(row).tolist():
        for k in range(ends[i - 1] if i else 0, ends[i], PRODUCT_VECTORS):
            part = slice(k, min(k + PRODUCT_VECTORS, ends[i]))
            sums[i] += n[part] @ mat[at[part]]
    return sums


def block_sums(counts: DataFrame, vectors: DataFrame, dim: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, sums, n_tokens, n_missing): the sparse product of token counts and token vectors.

    ``counts``: (key, ids, n); ``vectors``: (id, v). The vectors' columns are cut
    into blocks of dimensions, so narrow that a block of all ids takes
    ``block_bytes`` at most; a block goes to several cells, and each text to one
    cell of every block. A task reads its cells one after the other: the block's
    vectors first, then the texts as a stream, so it holds one block at a time,
    whatever the table's size. The block sums of a text come together by key."""
    spark = counts.sparkSession
    ship_package(spark)
    vectors = vectors.where(F.size("v") == dim).select("id", F.col("v").cast("array<double>").alias("v"))
    width = max(1, min(dim, block_bytes // (8 * max(vectors.count(), 1))))
    blocks = -(-dim // width)
    cells = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // blocks))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    table = vectors.select(every.alias("block"), "id", "v").select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "id", F.slice("v", F.col("block") * width + 1, F.lit(width)).alias("v")
    )
    asked = counts.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).withColumn("block", every)
    both = table.unionByName(asked, allowMissingColumns=True).repartition("block", "cell")
    both = both.sortWithinPartitions("block", "cell", F.col("id").asc_nulls_last()).select("block", "cell", "id", "v", "key", "ids", "n")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cell, ids, vecs, mat, finite = None, [], [], None, True
        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if lo == hi:
                    continue
                if tuple(place[lo]) != cell:
                    cell, ids, vecs, mat = tuple(place[lo]), [], [], None
                own = b.slice(lo, hi - lo)
                is_vector = pc.is_valid(own.column(2))
                some = own.filter(is_vector)
                if some.num_rows:
                    ids.append(some.column(2).to_numpy())
                    vecs.append(some.column(3).flatten().to_numpy().reshape(some.num_rows, -1))
                texts = own.filter(pc.invert(is_vector))
                if not texts.num_rows:
                    continue
                wide = min(width, dim - cell[0] * width)
                if mat is None:  # vectors stand before texts in a cell
                    known = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                    mat = np.concatenate(vecs) if vecs else np.zeros((0, wide))
                    vecs = []
                    finite = bool(np.isfinite(mat).all())
                most = max(1, min(PART_ROWS, POOLED_VALUES // wide))
                for own in parts(texts, 5, most):
                    m = own.num_rows
                    row = np.repeat(np.arange(m), pc.list_value_length(own.column(5)).to_numpy())
                    flat, n = (own.column(k).flatten().to_numpy() for k in (5, 6))
                    at, there = place_of(known, flat)
                    total, missing = (np.bincount(row, weights=x, minlength=m).astype(np.int64) for x in (n, n * ~there))
                    sums = sparse_product(row[there], at[there], n[there], m, mat, finite)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * wide, pa.int32()), pa.array(sums.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(4), own.column(0), lists, pa.array(total), pa.array(missing)], ["key", "block", "sums", "n_tokens", "n_missing"]
                    )

    found = both.mapInArrow(run, "key binary, block int, sums array<double>, n_tokens long, n_missing long")
    if blocks == 1:  # a text is in one cell: its sums are whole
        return found.drop("block")
    per = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("block", "sums"))).alias("x"), F.max("n_tokens").alias("n_tokens"), F.max("n_missing").alias("n_missing")
    )  # a row a text, as many entries as there are blocks
    return per.select("key", F.flatten("x.sums").alias("sums"), "n_tokens", "n_missing")


def encode_blocks(
    texts: DataFrame,
    vocab: Vocabulary,
    profile: Profile,
    enc: StaticEncoder,
    text_col: str = "text",
    id_col: str = "doc_id",
    tasks: DataFrame | None = None,
    keep: list[str] | None = None,
    ship_vocabulary: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """O12a + O13 for a vector table of any size, batch only: the rows of ``encode_rows``.

    Each distinct text is pooled once; rows find their text's vector by its
    digest, and the task's offset is added then."""
    own_task = tasks is not None and "task" in texts.columns
    lean = _carried(texts, text_col, id_col, own_task, keep)
    if ship_vocabulary or profile.tokens == "words":
        counts, vectors = token_counts(lean, vocab, profile, ship_vocabulary), enc.vectors
    else:
        counts, vectors = piece_counts_and_vectors(lean, vocab, profile, enc.vectors)
    sums = block_sums(counts, vectors, enc.dim, block_bytes)
    # Written, so that the join below reads a plain table and Spark splits a text with very many copies.
    sums = materialize(sums.withColumnRenamed("key", "_key"), "text-sums")
    rows = lean.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).drop("text")
    out = _with_task(rows, profile, tasks, own_task).join(sums, F.col("key") == F.col("_key"))
    offset = (F.coalesce("task_id", F.lit(0)) + 1) * F.lit(enc.task_scale if tasks is not None else 0.0)
    mask = F.col("n_tokens").cast("double")
    pooled = F.transform("sums", lambda x: x / F.greatest(mask, F.lit(MIN_MASK)) + offset)
    return _finished(out.withColumns({"pooled": pooled, "mask_sum": mask}).drop("sums", "key", "_key"))
