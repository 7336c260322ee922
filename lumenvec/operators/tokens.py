"""Tokenising, framing, id lookup, decoding and task ids.

Nested form ``(doc_id, tokens ARRAY<STRING>)`` stays row-local (no shuffle).
Long form ``(doc_id, pos, token)`` is what joins against vocabularies; the
vocabulary side is broadcast only under a proven row bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.text import frame, unicode_trim, v2_words, v3_pretokens
from lumenvec.operators.batches import is_text, parts
from lumenvec.operators.pretokens import letters_and_digits, prefixed, pretokens, trimmed
from lumenvec.plans.strategy import bounded_broadcast
from lumenvec.profiles import Profile
from lumenvec.sources.vocab import Vocabulary


def raw_tokens(
    texts: DataFrame, profile: Profile, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """O5 (words) / O6 (pre-tokens) in nested form: (doc_id, tokens, *keep)."""
    fn = v2_words if profile.tokens == "words" else v3_pretokens
    return texts.select(F.col(id_col).alias("doc_id"), fn(text_col).alias("tokens"), *(keep or []))


def uncut_tokens(texts: DataFrame, profile: Profile, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, tokens, *keep) as ``RowIds`` takes it in the tasks: the raw tokens in the words
    profile, in the subword profile the trimmed text, which is cut there."""
    if profile.tokens == "words":
        return raw_tokens(texts, profile, keep=keep)
    return texts.select("doc_id", trimmed("text").alias("tokens"), *(keep or []))


def explode_tokens(nested: DataFrame, col: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """Nested -> long form (doc_id, pos, token), pos from 0.

    ``posexplode_outer`` + a null filter instead of ``posexplode``: for the
    latter Catalyst infers ``size(tokens) > 0`` and pushes that filter, i.e.
    the whole tokenisation, below an earlier repartition into the scan task.
    """
    keep = keep or []
    out = nested.select("doc_id", *keep, F.posexplode_outer(col).alias("pos", "token"))
    return out.where(F.col("pos").isNotNull())


def truncate(tokens: Column, max_tokens: int | None) -> Column:
    """Optional truncation so that the framed sequence fits ``max_tokens``."""
    if max_tokens is None:
        return tokens
    return F.slice(tokens, 1, max(max_tokens - 2, 0))


def framed(nested: DataFrame, profile: Profile, col: str = "tokens") -> DataFrame:
    """Put the profile's markers around each token array."""
    body = truncate(F.col(col), profile.max_tokens)
    return nested.withColumn(col, frame(body, profile.first, profile.last))


def unknown_id(vocab: Vocabulary, profile: Profile) -> Column:
    """Id of the unknown token as a scalar subquery; 0 when it has none."""
    sub = vocab.specials.where(F.col("content") == profile.unk).select(F.max("id"))
    return F.coalesce(sub.scalar(), F.lit(0).cast("bigint"))


#: The columns of long-form ids; ``stands_for`` only in the subword profile.
OWN = ("doc_id", "pos", "sub", "token", "token_id", "in_vocab", "attention", "token_type", "stands_for")


def kept_name(column: str) -> str:
    """How a kept column comes out: as it is, or as ``keep_<name>`` where the ids have a column of that name."""
    return f"keep_{column}" if column.lower() in OWN else column


def lookup_ids(long: DataFrame, vocab: Vocabulary, profile: Profile, token_col: str = "token", stands_for: str | None = None) -> DataFrame:
    """Vocabulary id, else special id, else the unknown token's id, else 0.

    Adds ``token_id``, ``in_vocab`` (matched either table), ``attention`` (1)
    and ``token_type`` (0). ``stands_for`` names the column that tells what an
    unknown piece stands for, if there is one: the unknown token itself is in
    the tables, what it stands for is not."""
    v = bounded_broadcast(
        vocab.tokens.select(F.col("token").alias("_vt"), F.col("id").alias("_vid")), known_rows=vocab.row_bound
    )
    s = bounded_broadcast(
        vocab.specials.select(F.col("content").alias("_st"), F.col("id").alias("_sid")), known_rows=vocab.row_bound
    )
    out = long.join(v, F.col(token_col) == F.col("_vt"), "left").join(s, F.col(token_col) == F.col("_st"), "left")
    found = F.col("_vid").isNotNull() | F.col("_sid").isNotNull()
    if stands_for:
        found = found & F.col(stands_for).isNull()
    return out.select(
        *[c for c in long.columns],
        F.coalesce("_vid", "_sid", unknown_id(vocab, profile)).alias("token_id"),
        found.alias("in_vocab"),
        F.lit(1).cast("bigint").alias("attention"),
        F.lit(0).cast("bigint").alias("token_type"),
    )


def token_ids(
    texts: DataFrame,
    vocab: Vocabulary,
    profile: Profile,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Texts -> long form (doc_id, pos, sub, token, token_id, in_vocab, attention, token_type, *keep).

    Words profile: O5 -> O8 -> O9, ``pos`` 0 is the first marker, ``sub`` 0.
    Subword profile: O6 -> O8 -> O7 -> O9; ``pos`` is the position in the
    framed pre-token sequence (markers at 0 and n+1) and ``sub`` the piece
    within that pre-token; ``stands_for`` is the character an unknown piece
    stands for. With ``max_tokens`` only as many pre-tokens are cut as can give
    a piece that stays. Columns of ``texts`` named in ``keep`` go along with every
    token, under ``kept_name``. A null or empty text is its two markers; a null
    doc_id and repeated rows pass through."""
    keep = keep or []
    inner = [f"_kept_{i}" for i in range(len(keep))]  # no name of a kept column meets the ids' own
    lean = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, inner)])
    nested = raw_tokens(lean, profile, keep=inner)
    if profile.tokens == "words":
        long = explode_tokens(framed(nested, profile), keep=inner).withColumn("sub", F.lit(0))
        ids = lookup_ids(long.select("doc_id", "pos", "sub", "token", *inner), vocab, profile)
    else:
        from lumenvec.operators.subword import segment_rows

        # Every pre-token gives at least one piece, so the first max_tokens - 2 are enough.
        end = F.size("tokens") + 1 if profile.max_tokens is not None else F.lit(None).cast("int")
        fr = framed(nested.withColumn("end", end), profile)
        ids = lookup_ids(segment_rows(fr, vocab, profile), vocab, profile, stands_for="stands_for")
    return ids.withColumnsRenamed({n: kept_name(c) for n, c in zip(inner, keep)})


#: Words whose ids a task keeps.
UNIT_CACHE = 1 << 18
#: It starts anew when it has kept more ids than this (very long words have many).
UNIT_CACHE_IDS = 1 << 22


class WordUnits:
    """The ids of raw tokens, kept in one row of numbers: each token's place there and its size."""

    def __init__(self, ids: dict[str, int], unk_id: int) -> None:
        self.ids, self.unk_id = ids, unk_id
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.number: dict[str, int] = {}
        self.begin, self.size, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def ids_of(self, words: list[str]):
        """(sizes, ids in a row) of words seen for the first time."""
        import numpy as np

        return np.ones(len(words), np.int64), np.array([self.ids.get(w, self.unk_id) for w in words], np.int64)

    def of(self, words: list[str]):
        """(begin, size, flat): the ids of word i are flat[begin[i]:begin[i] + size[i]]."""
        import numpy as np

        if len(self.number) + len(words) > UNIT_CACHE or len(self.flat) > UNIT_CACHE_IDS:
            self._forget()
        at = list(map(self.number.get, words))
        if new := [w for w, k in zip(words, at) if k is None]:
            size, flat = self.ids_of(new)
            self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
            self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            at = [self.number[w] if k is None else k for w, k in zip(words, at)]
        at = np.array(at, np.int64)
        return self.begin[at], self.size[at], self.flat


class PieceUnits(WordUnits):
    """The same for pre-tokens, which are cut into pieces. With ``letters`` they come without their prefix."""

    def __init__(self, ids: dict[str, int], unk_id: int, pieces: list[str], letters: bytes | None = None) -> None:
        import numpy as np

        from lumenvec.operators.subword import PieceTrie

        super().__init__(ids, unk_id)
        self.letters = letters
        self.trie = PieceTrie(pieces)
        self.piece_ids = np.array([*[ids[p] for p in pieces], unk_id], np.int64)  # the last one is for -1

    def ids_of(self, words: list[str]):
        import numpy as np

        of, _, piece = self.trie.cut(words if self.letters is None else prefixed(words, self.letters))
        return np.bincount(of, minlength=len(words)), self.piece_ids[piece]


class PieceNumbers(WordUnits):
    """The numbers of the pieces of pre-tokens; an unknown character with code point c is -1 - c."""

    def __init__(self, pieces: list[str]) -> None:
        from lumenvec.operators.subword import PieceTrie

        self.trie = PieceTrie(pieces)
        self._forget()

    def ids_of(self, words: list[str]):
        import numpy as np

        from lumenvec.operators.subword import code_points

        of, at, piece = self.trie.cut(words)
        codes, begin, _ = code_points(words)
        unknown = piece < 0
        piece[unknown] = -1 - codes[begin[of[unknown]] + at[unknown]]
        return np.bincount(of, minlength=len(words)), piece


class RowIds:
    """The framed ids of rows of raw tokens, in a task; keeps what it has looked up.
    ``unk_piece``: the id of an unknown piece, ``unk_id`` unless given. ``letters``: the
    letters and digits (``letters_and_digits``), where rows are texts (``uncut_tokens``)."""

    def __init__(self, shipped: tuple, profile: Profile, unk_id: int, unk_piece: int | None = None, letters: bytes | None = None) -> None:
        ids, pieces = shipped
        self.first, self.last = (ids.get(x, unk_id) for x in (profile.first, profile.last))
        self.body = None if profile.max_tokens is None else max(profile.max_tokens - 2, 0)
        words = profile.tokens == "words"
        self.units = WordUnits(ids, unk_id) if words else PieceUnits(ids, unk_id if unk_piece is None else unk_piece, pieces, letters)

    def of(self, column):
        """(offsets, ids in a row) of an Arrow column of token lists, or of texts; a null one has its markers."""
        import numpy as np
        import pyarrow.compute as pc

        rows = len(column)
        if is_text(column):
            words_of, words = pretokens(column)
        else:
            words_of, words = np.concatenate(([0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy()))), column.flatten()
        coded = words.dictionary_encode()
        begin, size, flat = self.units.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.to_numpy()
        # Each word's ids in a row, then each row's ids between its markers.
        n = size[index]
        before = np.concatenate(([0], np.cumsum(n)))
        own = flat[np.repeat(begin[index] - before[:-1], n) + np.arange(before[-1])]
        starts = before[words_of]
        row = np.repeat(np.arange(rows), np.diff(starts))
        if self.body is not None:
            kept = np.arange(len(own)) - starts[row] < self.body
            own, row = own[kept], row[kept]
        ends = np.cumsum(np.bincount(row, minlength=rows) + 2)
        out = np.empty(ends[-1] if rows else 0, np.int64)
        out[np.arange(len(own)) + 2 * row + 1] = own
        out[np.concatenate(([0], ends[:-1]))], out[ends - 1] = self.first, self.last
        return np.concatenate(([0], ends)), out


def sent_letters(spark: SparkSession, profile: Profile):
    """A broadcast of ``RowIds``' letters and digits, which the words profile does without."""
    return spark.sparkContext.broadcast(None if profile.tokens == "words" else letters_and_digits(spark))


def sent_vocabulary(vocab: Vocabulary, profile: Profile):
    """(broadcast for ``RowIds``, the unknown token's id)."""
    specials = {r["content"]: r["id"] for r in vocab.specials.collect()}
    tokens = {r["token"]: r["id"] for r in vocab.tokens.collect()}
    shipped = vocab.tokens.sparkSession.sparkContext.broadcast((specials | tokens, sorted(tokens)))
    return shipped, specials.get(profile.unk, 0)


def id_rows(
    texts: DataFrame, vocab: Vocabulary, profile: Profile, text_col: str = "text", id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Texts -> (doc_id, ids ARRAY<BIGINT>, *keep): the ids of ``token_ids`` in order, row by row.

    The JVM tokenises; the distinct tokens of a part of an Arrow batch are looked up, or cut
    (subword), in the vocabulary, which is sent by broadcast (a model artifact);
    a task keeps what it has looked up for its next parts. No explode, no
    shuffle, so it also runs on a stream. A null text has its two markers, a null
    id and repeated rows pass through."""
    from lumenvec.session import ship_package

    ship_package(texts.sparkSession)
    keep = keep or []
    nested = raw_tokens(texts, profile, text_col, id_col, keep)
    nested = nested.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", *keep)
    shipped, unk_id = sent_vocabulary(vocab, profile)

    def run(batches):
        import pyarrow as pa

        made = RowIds(shipped.value, profile, unk_id)
        for b in batches:
            for part in parts(b, 1):
                offsets, out = made.of(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], ["doc_id", "ids", *keep])

    kinds = dict(nested.dtypes)
    return nested.mapInArrow(run, ", ".join(["doc_id long, ids array<long>", *[f"`{c}` {kinds[c]}" for c in keep]]))


def decode_rows(rows: DataFrame, vocab: Vocabulary, profile: Profile, sep: str = "", strip: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<BIGINT>) -> (doc_id, text), row by row, in Arrow arrays:
    ids become places in the vocabulary's names, which are gathered and joined. Null
    ids are unknown ones, a null or empty array is an empty text.

    Unknown ids read as the unknown token, pieces join with ``sep`` ("" in the
    reference), the word prefix becomes a space, the texts in ``strip`` (the
    profile's bos and eos unless given) are removed and the result is trimmed."""
    from lumenvec.session import ship_package

    spark = rows.sparkSession
    ship_package(spark)
    known = sorted((r["id"], r["token"]) for r in vocab.reverse.where(F.col("id").isNotNull()).collect())
    shipped, unk = spark.sparkContext.broadcast(known), profile.unk

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = np.array([i for i, _ in shipped.value], np.int64)
        names = pa.array([*[t for _, t in shipped.value], unk], pa.string())
        for b in (part for whole in batches for part in parts(whole, 1)):
            column = b.column(1)
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())))
            flat = column.flatten()
            own = flat.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            there = (ids[at] == own if len(ids) else np.zeros(len(own), bool)) & flat.is_valid().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(np.where(there, at, len(ids)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join(lists, sep)], ["doc_id", "text"])

    joined = rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
    text = F.replace("text", F.lit("▁"), F.lit(" "))
    for x in (profile.bos, profile.eos) if strip is None else strip:
        text = F.replace(text, F.lit(x), F.lit(""))
    return joined.select("doc_id", unicode_trim(text).alias("text"))


def decode(ids: DataFrame, vocab: Vocabulary, profile: Profile, sep: str = "", strip: tuple[str, ...] | None = None) -> DataFrame:
    """O10 on long-form ids (doc_id, pos[, sub], token_id): each document's ids
    come together first (bounded by that one text), then ``decode_rows``."""
    order = ["pos", "sub"] if "sub" in ids.columns else ["pos"]
    g = ids.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "token_id"))).alias("p"))
    rows = g.select("doc_id", F.transform("p", lambda x: x["token_id"]).alias("ids"))
    return decode_rows(rows, vocab, profile, sep, strip)


def task_ids(df: DataFrame, tasks: DataFrame, profile: Profile, task_col: str = "task") -> DataFrame:
    """First position of the task name in the task list.

    Strict profiles (v3) put an error on rows whose task is unknown; lenient
    ones (v2) use 0. Adds ``task_id`` and ``task_error``.
    """
    first = tasks.groupBy(F.col("task").alias("_tn")).agg(F.min("task_id").alias("_tid"))
    j = df.join(bounded_broadcast(first), F.col(task_col) == F.col("_tn"), "left")
    if profile.strict_task:
        err = F.when(
            F.col("_tid").isNull(), F.concat(F.lit("task type '"), F.coalesce(F.col(task_col), F.lit("")), F.lit("' not found"))
        )
        tid = F.col("_tid")
    else:
        err = F.lit(None).cast("string")
        tid = F.coalesce("_tid", F.lit(0).cast("bigint"))
    return j.select(*df.columns, tid.alias("task_id"), err.alias("task_error"))
