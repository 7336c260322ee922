"""Column expressions for the two tokenizer profiles.

Everything here is a built-in Spark expression (JVM side, whole-stage
codegen where Spark supports it); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: these must stay equal to the tokenizer being reproduced.
# Unicode White_Space as Go's unicode.IsSpace defines it (Java's \s misses
# U+0085, U+00A0 and U+3000, so the class is spelled out).
WHITE_SPACE = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same set as code points, for the character-set trim.
WHITE_SPACE_CODE_POINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# v3 pre-tokenizer: RE2 "\w+|[^\w\s]" where \w and \s are ASCII and \s
# has no vertical tab.
PRETOKEN_PATTERN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\t\n\f\r ]"
# The same for Java's regular expressions, whose \w is ASCII and one table lookup a character (a class of
# ranges is a chain of calls: four times slower).
JVM_PRETOKEN_PATTERN = r"\w+|[^\w\t\n\f\r ]"
# A pre-token holding a Unicode letter or decimal digit gets the prefix.
LETTER_OR_DIGIT = r"[\p{L}\p{Nd}]"
WORD_PREFIX = "▁"
# Go lowercases rune by rune with simple case mapping; Java applies the
# final-sigma and dotted-I special cases, so map those two first.
SPECIAL_UPPER = "Σİ"
SPECIAL_LOWER = "σi"
# --- end of fixed values.

EDGE_SPACE = f"^{WHITE_SPACE}+|{WHITE_SPACE}+\\z"
WHITE_SPACE_CHARS = "".join(map(chr, WHITE_SPACE_CODE_POINTS))


def _text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # The reference takes a Go string, whose zero value is "".
    return F.coalesce(c, F.lit(""))


def go_lower(col: Column | str) -> Column:
    """Lowercase the way Go's strings.ToLower does."""
    return F.lower(F.translate(_text(col), SPECIAL_UPPER, SPECIAL_LOWER))


def unicode_trim(col: Column | str) -> Column:
    """strings.TrimSpace: strip Unicode white space at both ends.

    ``btrim`` with the character set (no regex); same result as removing
    ``EDGE_SPACE`` matches, which is what the SQL oracle does."""
    return F.btrim(_text(col), F.lit(WHITE_SPACE_CHARS))


def v2_words(col: Column | str) -> Column:
    """Lowercase, split on Unicode white space, drop empty pieces."""
    parts = F.split(go_lower(col), WHITE_SPACE + "+")
    return F.filter(parts, lambda w: w != F.lit(""))


def v3_pretokens(col: Column | str) -> Column:
    """Trim, find all ASCII words / single other characters, prefix letters."""
    matches = F.regexp_extract_all(unicode_trim(col), F.lit(JVM_PRETOKEN_PATTERN), 0)
    return F.transform(
        matches,
        lambda m: F.when(m.rlike(LETTER_OR_DIGIT), F.concat(F.lit(WORD_PREFIX), m)).otherwise(m),
    )


def frame(tokens: Column, first: str, last: str) -> Column:
    """Wrap a token array in its begin/end markers."""
    return F.concat(F.array(F.lit(first)), tokens, F.array(F.lit(last)))
