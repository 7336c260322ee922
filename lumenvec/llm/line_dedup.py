"""Line dedup: winnowing over line hashes.

The lines of a document that have a word form a sequence. A run of lines counts
as repeated text when it has ``window`` lines, or fewer with ``alone`` words or
more. In every window of ``window`` consecutive lines, and in every pair of
lines and every line with ``alone`` words, the line with the smallest hash (the
first of equals) is the fingerprint, so two equal runs choose the same line at
the same place. One row for each chosen (fingerprint, line place) goes on, with
the digests of the lines around it. Then

1. places join by fingerprint: each content with two places or more keeps its
   first place and its count, which Spark combines before the shuffle; places
   whose line is found once drop out;
2. matches are extended, a line at a time, first to the right and then to the
   left, and at every step the places that no longer match another one drop
   out; so a place is compared with all others by key, never pair by pair;
3. each extended run that counts and was there before, in a smaller
   (doc_id, line), is deleted. Longer runs are the union of these.

Every run of ``window`` lines that repeats has its fingerprint in common, so none
is missed. The result is exactly: a line goes if a run that counts covers it and
the same run begins at a smaller (doc_id, line). A line that millions of
documents share is one row a task in each count, and the joins are of two
written tables, which Spark splits where a line is hot. Nothing but line numbers
and digests is shuffled; texts meet their deleted line numbers in one join by
document.

Defined results: null and blank texts have no lines and stay as they are;
lines without words are never compared and stay; of equal rows (same doc_id and
text) none is earlier than the other by (doc_id, line), so both stay; a null
doc_id sorts first; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import bind, col, fresh, words
from lumenvec.plans.strategy import materialize

WINDOW = 3
#: Words that make a run of fewer lines count.
ALONE = 50


def numbered(text: Column) -> Column:
    """Every line with its number from 0 and whether it has a word."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("at"), x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("full")),
    )


def chosen(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, alone: int = ALONE) -> DataFrame:
    """(doc_id, text_id, at, own, around): one row for each chosen line.

    ``at`` is its number among the lines with a word; ``around`` has the digest
    and the number of words of the lines that a run can reach, itself at ``own``."""

    def places(lines: Column) -> Column:
        def of_windows(h: Column) -> Column:
            last = F.size(lines) - window
            least = lambda i: i + F.array_position(F.slice(h, i + 1, window), F.array_min(F.slice(h, i + 1, window))).cast("int") - 1
            wide = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), least))
            n = lambda i: F.coalesce(F.get(lines, i)["n"], F.lit(0))
            every = F.transform(lines, lambda x, i: i.cast("int"))
            single = F.filter(every, lambda i: n(i) >= alone)
            pair = F.filter(every, lambda i: (i + 1 < F.size(lines)) & (n(i) + n(i + 1) >= alone))
            pair = F.transform(pair, lambda i: i + (F.get(h, i + 1) < F.get(h, i)).cast("int"))
            return F.array_distinct(F.concat(wide, single, pair))

        def row(i: Column) -> Column:
            begin = F.greatest(F.lit(0), i - (window - 1))
            around = F.slice(lines, begin + 1, i - begin + window)
            return F.struct(i.alias("at"), (i - begin).alias("own"), F.transform(around, lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("around"))

        return F.transform(bind(F.transform(lines, lambda x: x["h"]), of_windows), row)

    def lined(x: Column) -> Column:
        return F.struct(F.xxhash64(x["line"]).alias("h"), F.unhex(F.md5(x["line"])).alias("d"), F.size(words(x["line"])).alias("n"))

    full = F.transform(F.filter(numbered(col(f"`{text}`")), lambda x: x["full"]), lined)
    told = docs.select(F.col(f"`{key}`").alias("doc_id"), digest(text).alias("text_id"), F.explode(bind(full, places)).alias("x"))
    return told.select("doc_id", "text_id", "x.*")


def digest(text: str) -> Column:
    """Tells apart texts that share a doc_id."""
    return F.xxhash64(F.col(f"`{text}`"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, alone: int = ALONE) -> DataFrame:
    """(doc_id, text_id, removed): the line numbers, among lines with a word, that lie in
    a later copy of a run. One row for each document that loses a line."""
    line = F.get("around", F.col("own"))
    runs = chosen(docs, text, key, window, alone).select(
        "doc_id", "text_id", "at", "own", "around", F.lit(0).alias("left"), F.lit(0).alias("right"), line["d"].alias("run"), line["n"].alias("n_words")
    )
    runs, later = materialize(runs, "chosen-lines"), None
    for lines in range(1, window + 1):
        places = runs.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        runs = materialize(runs.join(materialize(places.drop("n"), "line-places"), "run"), "matched-lines")
        counts = F.lit(True) if lines == window else F.col("n_words") >= alone
        gone = runs.where(counts & (F.struct("doc_id", "at") > F.col("first")))
        gone = gone.select("doc_id", "text_id", (F.col("at") - F.col("left")).alias("from"), (F.col("at") + F.col("right")).alias("to"))
        later = gone if later is None else later.unionByName(gone)
        if lines < window:
            runs = extended(runs.drop("first"))
    spans = later.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    covered = F.flatten(F.transform("spans", lambda x: F.sequence(x["from"], x["to"])))
    return spans.select("doc_id", "text_id", F.array_distinct(covered).alias("removed"))


def extended(runs: DataFrame) -> DataFrame:
    """The runs with one more line: to the right (while none was added to the left), and to the left.

    ``run`` is a digest of the lines and of the way they were added in, so two
    runs meet only with the chosen line at the same place."""

    def more(side: str, at: Column) -> Column:
        line = F.get("around", at)
        of = F.unhex(F.md5(F.concat(F.lit(f"{side}:"), F.hex("run"), F.hex(line["d"]))))
        step = {x: (F.col(x) + F.lit(int(x == side))).alias(x) for x in ("left", "right")}
        return F.struct(*step.values(), of.alias("run"), (F.col("n_words") + line["n"]).alias("n_words"))

    right = F.when((F.col("left") == 0) & (F.col("own") + F.col("right") + 1 < F.size("around")), more("right", F.col("own") + F.col("right") + 1))
    left = F.when(F.col("own") > F.col("left"), more("left", F.col("own") - F.col("left") - 1))
    both = runs.select("doc_id", "text_id", "at", "own", "around", F.explode(F.filter(F.array(right, left), lambda x: x.isNotNull())).alias("x"))
    return both.select("doc_id", "text_id", "at", "own", "around", "x.*")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, alone: int = ALONE) -> DataFrame:
    """``docs`` without the later copies of runs: the text loses those lines.

    Adds ``n_lines`` and ``n_removed`` (both of lines with a word)."""
    gone, gone_key, gone_text, found, n_lines, n_removed = fresh(
        docs, "gone", "gone_key", "gone_text", "found", "n_lines", "n_removed"
    )
    hit = repeats(docs, text, key, window, alone).toDF(gone_key, gone_text, gone)
    same = F.col(f"`{key}`").eqNullSafe(F.col(gone_key)) & (digest(text) == F.col(gone_text))

    def told(lines: Column) -> Column:
        def without(own: Column) -> Column:
            def left(cut: Column) -> Column:
                keep = F.array_except(F.transform(lines, lambda x: x["at"]), cut)
                return F.array_join(F.transform(keep, lambda i: F.get(lines, i)["line"]), "\n")

            cut = F.transform(F.col(gone), lambda i: F.get(own, i))
            whole = F.col(gone).isNull()
            return F.struct(
                F.size(own).cast("long").alias("n_lines"),
                F.when(whole, F.lit(0)).otherwise(F.size(F.col(gone))).cast("long").alias("n_removed"),
                F.when(whole, F.col(f"`{text}`")).otherwise(bind(cut, left)).alias("text"),
            )

        return bind(F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["at"]), without)

    return (
        docs.join(hit, same, "left")
        .withColumn(found, bind(numbered(col(f"`{text}`")), told))
        .withColumn(n_lines, F.col(found)["n_lines"])
        .withColumn(n_removed, F.col(found)["n_removed"])
        .withColumn(text, F.col(found)["text"])
        .drop(gone, gone_key, gone_text, found)
    )


def has_words(text: str) -> Column:
    return F.size(words(text)) > 0
