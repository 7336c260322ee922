"""Quality rules: line-first cleaning.

Every line of a text is judged by itself (punctuation, navigation, symbols,
shouting, boilerplate). Lines that fail are removed; a document that loses too
many of its words this way is rejected, as is one that fails the base rules
(too few words, or too many words in repeated windows). All of it is built-in
expressions over one row: no shuffle, no Python.

Defined results: a null or blank text has no words and fails the base rules;
lines without words are neither judged nor counted as repeats, and stay where
they are in the cleaned text; repeated rows are judged each by itself; an
empty table gives an empty result; other columns are left alone, and helper
columns are named so that none clashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import bind, col, fresh, words

SYMBOLS = "#*$%&|<>"

# Phrases of pages, not of prose (lower case).
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign in",
    "terms of service",
    "terms of use",
)


# What may end a short line, and what parts words for a phrase.
SENTENCE_ENDS = r".!?…:;,\"'”’)\]。！？；：，、」』）】"
NO_WORD = r"[^\p{L}\p{N}]"
PHRASE = f"(?:^|{NO_WORD})(?:{'|'.join(BOILERPLATE)})(?:$|{NO_WORD})"


@dataclass(frozen=True)
class Rules:
    """Thresholds. ``window``: words of a repeated window; ``max_repeat_pct``:
    words in repeated windows, percent; ``max_symbols``: symbols a word in a
    line; ``max_separators``: navigation separators a line may hold;
    ``short_line``: words below which a line must end a sentence;
    ``phrase_line``: words below which a boilerplate phrase condemns a line;
    ``max_lost``: share of a document's words that failing lines may hold."""

    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    max_symbols: float = 0.5
    max_separators: int = 2
    short_line: int = 4
    phrase_line: int = 20
    max_lost: float = 0.5


def repeat_words(w: Column, size: int) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in ``w``.

    Windows are compared by a 64-bit hash of their words' hashes within one document. Sorting
    (hash, start) puts equal windows side by side, so the cost stays
    n log n for any text; texts without a repeat stop at the distinct count.
    """
    starts = F.sequence(F.lit(0), F.size(w) - size)
    of_words = F.transform(w, lambda x: F.xxhash64(x))
    hashes = bind(of_words, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts_of(s: Column) -> Column:
            twin = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
            kept = F.filter(s, lambda x, k: twin(k - 1, x["h"]) | twin(k + 1, x["h"]))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        covered = F.aggregate(
            bind(pairs, starts_of),
            F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n")),
        )["n"]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    return F.when(F.size(w) <= size, F.lit(0)).otherwise(bind(hashes, repeated)).cast("long")


def symbols(line: Column) -> Column:
    return F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))


def line_fails(line: Column, n: Column, n_symbols: Column, rules: Rules) -> Column:
    """The rules for one line with ``n`` words. What most lines pass comes first and is cheap."""
    marks = ("|", "»", "›", "•", ">")
    some = F.lit(False)
    for x in marks:
        some = some | line.contains(x)
    separators = F.regexp_count(line, F.lit(rf"(?:^|\s)[{''.join(marks)}](?=\s|$)"))
    letters = F.regexp_replace(line, r"[^\p{L}]+", "")
    shouting = (line == F.upper(line)) & (line != F.lower(line)) & (F.char_length(letters) >= 12)
    unended = (n < rules.short_line) & ~line.rlike(rf"[{SENTENCE_ENDS}]\s*$")

    def phrase(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | low.contains(p)
        return found & low.rlike(PHRASE)  # as whole words; few lines come this far

    return (
        (n_symbols > n * rules.max_symbols)
        | unended
        | shouting
        | (some & (separators > rules.max_separators))
        | (line.contains("{") & line.contains("}"))
        | ((n < rules.phrase_line) & bind(F.lower(line), phrase))
    )


def quality(text: Column, rules: Rules = Rules()) -> Column:
    """A text's facts, verdict and cleaned text as one struct. Every step is a
    lambda variable for the next, so none is computed twice, wherever
    Catalyst moves the expression."""

    def line_facts(line: Column) -> Column:
        def told(x: Column) -> Column:
            fails = (F.size(x["w"]) > 0) & line_fails(line, F.size(x["w"]), x["n_symbols"], rules)
            return F.struct(line.alias("line"), x["w"].alias("w"), x["n_symbols"].alias("n_symbols"), fails.alias("fails"))

        return bind(F.struct(words(line).alias("w"), symbols(line).alias("n_symbols")), told)

    def total(lines: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + of(x))

    def facts(lines: Column, w: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
        left = F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"])
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            total(lines, lambda x: x["n_symbols"]).alias("n_symbols"),
            bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w, rules.window).alias("n_repeat_words"),
            total(lines, lambda x: F.when(x["fails"], F.size(x["w"])).otherwise(F.lit(0))).alias("n_lost"),
            F.array_join(left, "\n").alias("cleaned"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_pct * m["n_words"])
        kept = ~failed & (m["n_lost"] <= m["n_words"] * rules.max_lost)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost", "cleaned")
        return F.struct(*[m[x].alias(x) for x in names], failed.alias("base_failed"), kept.alias("kept"))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_facts)
    # Words never cross lines, so the lines' words are the text's.
    both = bind(lines, lambda x: bind(F.flatten(F.transform(x, lambda y: y["w"])), lambda w: facts(x, w)))
    return bind(both, verdict)


def judge(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the struct column ``quality``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, n_lost, base_failed, kept, and the
    cleaned text. If ``docs`` has a column of that name, underscores go before it."""
    (own,) = fresh(docs, "quality")
    return docs.withColumn(own, quality(col(f"`{text}`"), rules))


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, their text without the lines that failed."""
    (own,) = fresh(docs, "quality")
    # A generator, so that the filter stays above it and the rules run once a row.
    kept = F.filter(F.array(quality(col(f"`{text}`"), rules)), lambda x: x["kept"])
    judged = docs.select("*", F.explode_outer(kept).alias(own)).where(F.col(own).isNotNull())
    return judged.withColumn(text, F.col(own)["cleaned"]).drop(own)
