"""Greedy longest-match subword segmentation (O7) as DataFrame work.

Pre-tokens are cut in Arrow batches with the vocabulary's pieces at hand (a model
artifact, sent by broadcast). Texts are cut row by row (``segment_rows``,
``piece_counts``): the distinct pre-tokens of a window are cut at once, a task keeps
what it has cut, and no occurrence is shuffled or joined. ``segment_table`` cuts a
table of distinct pre-tokens.

The pieces are a packed trie of numpy arrays (``PieceTrie``); all pre-tokens of
a batch are walked through it at once, one character a step, instead of trying
substrings one by one. Very long pre-tokens, of which a step would move only
one or two, are cut one by one.

Positions are code points throughout, so an emoji is one unit, as chosen for
the unknown-character step. A piece that is the unknown token keeps the
character it stands for in ``stands_for``.

Defined results: an empty pre-token has no pieces; without pieces every
character is unknown; repeated pre-tokens have a row each in ``segment_table``; an
empty table gives no rows. With ``max_tokens``, ``doc_id`` has to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.profiles import Profile
from lumenvec.sources.vocab import Vocabulary


def greedy_pieces(token: str, pieces, longest: int, unk: str) -> list[tuple[str, str | None]]:
    """Longest vocabulary piece from the left, as (piece, None); no match: one
    code point as (unknown token, that code point)."""
    out, i, n = [], 0, len(token)
    while i < n:
        for ln in range(min(longest, n - i), 0, -1):
            if token[i : i + ln] in pieces:
                out.append((token[i : i + ln], None))
                i += ln
                break
        else:
            out.append((unk, token[i]))
            i += 1
    return out


#: Pre-tokens longer than this are cut one by one.
LONG = 256
CODE = 21  # bits of a code point


class PieceTrie:
    """The pieces as a trie: edges sorted by (node, character), and the piece that ends at each node.

    Built level by level, so its size is that of the pieces' common beginnings."""

    def __init__(self, pieces: list[str]) -> None:
        import numpy as np

        self.pieces = pieces
        self.known = set(pieces)
        self.longest = max(map(len, pieces), default=1)
        codes, begin, size = code_points(pieces)
        node = np.zeros(len(pieces), np.int64)  # where each piece has come to
        keys, n = [], 1
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for depth in range(self.longest if pieces else 0):
            live = np.flatnonzero(size > depth)
            edge = (node[live] << CODE) | codes[begin[live] + depth]
            found, which = np.unique(edge, return_inverse=True)
            keys.append(found)
            node[live] = n + which
            n += len(found)
            done = live[size[live] == depth + 1]
            ends.append((node[done], done))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        child = np.arange(1, n)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.child = self.keys[order], child[order]
        self.piece = np.full(n, -1, np.int64)
        for at, which in ends:
            self.piece[at] = which

    def next(self, node, code):
        """The node each edge leads to; -1 where there is none."""
        import numpy as np

        if not len(self.keys):
            return np.full(len(node), -1, np.int64)
        key = (node << CODE) | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def cut(self, tokens: list[str]):
        """(token, start, piece) arrays of the pieces of all tokens, in order: ``piece`` is the
        number of the vocabulary piece, or -1 for one unknown character."""
        import numpy as np

        codes, begin, size = code_points(tokens)
        token = np.flatnonzero((size > 0) & (size <= LONG))
        end = begin + size
        start = begin[token].copy()
        cursor, node = start.copy(), np.zeros(len(token), np.int64)
        best_end, best = np.full(len(token), -1, np.int64), np.full(len(token), -1, np.int64)
        out = [(np.zeros(0, np.int64),) * 3]
        while len(token):
            to = np.full(len(token), -1, np.int64)
            inside = cursor < end[token]
            to[inside] = self.next(node[inside], codes[cursor[inside]])
            moved = to >= 0
            cursor = cursor + moved
            node = np.where(moved, to, 0)
            ended = np.where(moved, self.piece[node], -1)
            best_end, best = np.where(ended >= 0, cursor, best_end), np.where(ended >= 0, ended, best)
            if not moved.all():  # these have gone as far as they can: one piece is cut
                k = np.flatnonzero(~moved)
                out.append((token[k], start[k] - begin[token[k]], best[k]))
                start[k] = np.where(best[k] >= 0, best_end[k], start[k] + 1)
                cursor[k], best_end[k], best[k] = start[k], -1, -1
                live = start < end[token]
                if not live.all():
                    token, start, cursor, node, best_end, best = (x[live] for x in (token, start, cursor, node, best_end, best))
        number = {}
        for t in np.flatnonzero(size > LONG).tolist():
            number = number or {p: i for i, p in enumerate(self.pieces)}
            at, own = 0, []
            for p, source in greedy_pieces(tokens[t], self.known, self.longest, ""):
                own.append((t, at, number[p] if source is None else -1))
                at += len(p) if source is None else 1
            out.append(tuple(np.array(x, np.int64) for x in zip(*own)))
        of, at, piece = (np.concatenate(x) for x in zip(*out))
        # No two pieces begin at one character, so the places where they begin give the order.
        order = np.full(len(codes), -1, np.int64)
        order[begin[of] + at] = np.arange(len(of))
        order = order[order >= 0]
        return of[order], at[order], piece[order]


def code_points(texts: list[str]):
    """(all code points in a row, where each text begins, its size)."""
    import numpy as np

    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    return codes, np.cumsum(size) - size, size


def segment_table(distinct_tokens: DataFrame, vocab: Vocabulary, profile: Profile, col: str = "token") -> DataFrame:
    """(token) distinct -> (token, pieces ARRAY<STRING>, sources ARRAY<STRING>)."""
    from lumenvec.session import ship_package

    spark = distinct_tokens.sparkSession
    ship_package(spark)
    shipped = sent_pieces(vocab)
    unk = profile.unk

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        trie = PieceTrie(shipped.value)
        names = pa.array([*trie.pieces, unk], pa.string())
        for b in batches:
            tokens = b.column(0).to_pylist()
            of, at, piece = trie.cut(tokens)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(tokens))))), pa.int32())
            unknown = piece < 0
            pieces = names.take(pa.array(np.where(unknown, len(trie.pieces), piece)))
            sources = np.full(len(of), None, object)
            sources[unknown] = [tokens[t][i] for t, i in zip(of[unknown].tolist(), at[unknown].tolist())]
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pieces, pa.array(sources, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["token", "pieces", "sources"])

    tokens = distinct_tokens.select(F.col(col).alias("token")).where(F.col("token").isNotNull())
    return tokens.mapInArrow(run, "token string, pieces array<string>, sources array<string>")


#: Pre-tokens of a part that are cut, and given on, at a time.
WINDOW = 1 << 16


class FramedPieces:
    """The pieces of rows of framed pre-tokens, in a task, as numbers: a piece's place in ``names``; an unknown
    character with code point c is -1 - c. ``names`` ends with the unknown token and the two markers."""

    def __init__(self, pieces: list[str], profile: Profile) -> None:
        from lumenvec.operators.tokens import PieceNumbers

        self.units = PieceNumbers(pieces)
        self.unk = len(pieces)
        self.names = [*pieces, profile.unk, profile.first, profile.last]

    def windows(self, column) -> Iterator[tuple]:
        """(rows, pos, numbers, sub) of at most ``WINDOW`` pre-tokens of an Arrow column of token lists at a time, in
        order; each piece has its row, its pre-token's place in the row, its number and its place in the
        pre-token. The first and the last pre-token of a row are its markers, whatever their texts."""
        import numpy as np
        import pyarrow.compute as pc

        ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64))
        starts = np.concatenate(([0], ends[:-1]))
        words = column.flatten()
        for lo in range(0, len(words), WINDOW):
            coded = words.slice(lo, WINDOW).dictionary_encode()
            place = np.arange(lo, lo + len(coded))
            row = np.searchsorted(ends, place, side="right")
            begin, size, flat = self.units.of(coded.dictionary.to_pylist())
            index = coded.indices.to_numpy()
            first, last = place == starts[row], place == ends[row] - 1
            n = np.where(first | last, 1, size[index])
            before = np.cumsum(n) - n
            sub = np.arange(n.sum()) - np.repeat(before, n)
            numbers = np.empty(len(sub), np.int64)
            body = np.repeat(~(first | last), n)
            numbers[body] = flat[(np.repeat(begin[index], n) + sub)[body]]
            numbers[before[first]], numbers[before[last]] = self.unk + 1, self.unk + 2
            yield np.repeat(row, n), np.repeat(place - starts[row], n), numbers, sub


def sent_pieces(vocab: Vocabulary):
    """A broadcast of the vocabulary's pieces, sorted."""
    return vocab.tokens.sparkSession.sparkContext.broadcast(sorted(r["token"] for r in vocab.tokens.select("token").collect()))


def segment_rows(rows: DataFrame, vocab: Vocabulary, profile: Profile) -> DataFrame:
    """(doc_id, tokens, end, ...) framed pre-tokens -> (doc_id, pos, sub, token, stands_for, ...) pieces.

    ``(pos, sub)`` orders the pieces: ``pos`` is the pre-token position, for the last marker ``end``
    where that is given (truncated rows), and ``sub`` the piece index within it. The markers pass through as one piece. Row by
    row: no shuffle and no join; a text of any length is given on in windows. With ``max_tokens`` a
    document keeps its first ``max_tokens - 2`` pieces between the markers."""
    from lumenvec.session import ship_package

    if rows.isStreaming:
        raise ValueError("long-form pieces need a batch input; use the row-local encoder for streams")
    ship_package(rows.sparkSession)
    rest = [c for c in rows.columns if c not in ("doc_id", "tokens", "end")]
    rows = rows.select("doc_id", "tokens", "end", *rest)
    shipped = sent_pieces(vocab)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from lumenvec.operators.batches import parts

        made = FramedPieces(shipped.value, profile)
        names = pa.array(made.names, pa.string())
        for b in (part for whole in batches for part in parts(whole, 1)):
            end = b.column(2).fill_null(-1).to_numpy()
            for row, pos, numbers, sub in made.windows(b.column(1)):
                unknown = numbers < 0
                codes, which = np.unique(-1 - numbers[unknown], return_inverse=True)
                stands_for = np.zeros(len(numbers), np.int64)
                stands_for[unknown] = which
                chars = pa.array([chr(c) for c in codes.tolist()] or [""], pa.string())
                at_end = (numbers == made.unk + 2) & (end[row] >= 0)
                x = pa.StructArray.from_arrays(
                    [
                        pa.array(np.where(at_end, end[row], pos), pa.int32()), pa.array(sub, pa.int32()),
                        names.take(pa.array(np.where(unknown, made.unk, numbers))),
                        chars.take(pa.array(stands_for, mask=~unknown)), pa.array(numbers > made.unk),
                    ],
                    ["pos", "sub", "token", "stands_for", "is_marker"],
                )
                lo, hi = int(row[0]), int(row[-1]) + 1
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(lo, hi + 1)), pa.int32()), x)
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(0), lists, *own.columns[3:]], ["doc_id", "p", *rest])

    kinds = dict(rows.dtypes)
    schema = f"doc_id {kinds['doc_id']}, p array<struct<pos: int, sub: int, token: string, stands_for: string, is_marker: boolean>>"
    out = rows.mapInArrow(run, ", ".join([schema, *[f"`{c}` {kinds[c]}" for c in rest]]))
    out = out.select("doc_id", *rest, F.explode("p").alias("x")).select("doc_id", "x.*", *rest)
    if profile.max_tokens is not None:
        w = Window.partitionBy("doc_id", "is_marker").orderBy("pos", "sub")
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("is_marker") | (F.col("_n") <= max(profile.max_tokens - 2, 0)))
    return out.select("doc_id", "pos", "sub", "token", "stands_for", *rest)


def piece_counts(texts: DataFrame, vocab: Vocabulary, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(key, tokens) rows of framed pre-tokens -> (key, ids, n): the numbers of a row's pieces, markers
    included, and how often it has each; and the table of numbers, (number, token).

    Row by row, as ``segment_rows``: the counts of a text are at hand where it is cut, so none of its tokens
    is moved. What a number's id is can be looked up once for each piece."""
    from lumenvec.session import ship_package

    spark = texts.sparkSession
    ship_package(spark)
    shipped = sent_pieces(vocab)
    numbers = spark.createDataFrame(list(enumerate(FramedPieces(shipped.value, profile).names)), "number long, token string")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from lumenvec.operators.batches import parts

        made = FramedPieces(shipped.value, profile)
        many = len(made.names)
        for b in (part for whole in batches for part in parts(whole, 1)):
            found = [np.unique(row * many + np.where(x < 0, made.unk, x), return_counts=True) for row, _, x, _ in made.windows(b.column(1))]
            which, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)
            offsets = pa.array(np.searchsorted(which, np.arange(b.num_rows + 1) * many), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (which % many, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["key", "ids", "n"])

    return texts.select("key", "tokens").mapInArrow(run, "key binary, ids array<long>, n array<long>"), numbers
