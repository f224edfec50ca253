"""String expressions: whitespace rules, lexicon lines, numbering, n-grams."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let

# The code points a Unicode-aware whitespace split treats as separators,
# first as Java character class body, then as the characters themselves.
WS_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the word-start marker of subword vocabularies.
WORD_START = "\u2581"


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.btrim(col, F.lit(WHITESPACE))


_NOT_SPACE = WHITESPACE.replace(" ", "")


def plain_spaces(col: Column, keep: str = "") -> Column:
    """Every whitespace character as a plain space, except those in ``keep``."""
    chars = "".join(c for c in _NOT_SPACE if c not in keep)
    return F.translate(col, chars, " " * len(chars))


def tokens(col: Column) -> Column:
    """Whitespace tokens; no lower-casing, no punctuation stripping.

    Splitting at one plain character needs no regular expression, which would be
    compiled again for every row.
    """
    return F.array_remove(F.split(plain_spaces(col), " "), "")


def text_lines(col: Column) -> Column:
    """Lines of a text held in one cell, with universal newlines."""
    return F.split(unix_newlines(col), "\n")


def unix_newlines(col: Column) -> Column:
    has_cr = F.contains(col, F.lit("\r"))
    return F.when(has_cr, F.regexp_replace(col, r"\r\n?", "\n")).otherwise(col)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Java character class body of all characters whose Unicode type is a digit.

    Besides decimal digits these are superscripts, Ethiopic and circled digits and the
    like, which neither ``\\d`` nor ``\\p{Nd}`` matches.
    """
    ranges: list[list[int]] = []
    for code in range(0x110000):
        if chr(code).isdigit() and unicodedata.category(chr(code)) != "Nd":
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return r"\p{Nd}" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def all_digits(col: Column) -> Column:
    return col.rlike(f"^[{digit_class()}]+$")


def lexicon_line_is_data(line: Column) -> Column:
    """Neither blank, nor a ``#`` comment, a ``$`` marker or a ``|`` header row."""
    return (
        (F.length(line) > 0)
        & ~F.startswith(line, F.lit("#"))
        & ~F.startswith(line, F.lit("$"))
        & ~F.contains(line, F.lit("|"))
    )


def lexicon_entry(line: Column) -> Column:
    """``struct<word, morphemes>`` of one lexicon line; word is null if nothing is left.

    A leading row number is dropped, every further field loses its edge hyphens and
    disappears when nothing but hyphens was there. Inner hyphens stay.
    """

    def parse(fields: Column) -> Column:
        first = F.when(all_digits(F.get(fields, F.lit(0))), F.lit(1)).otherwise(F.lit(0))

        def build(skip: Column) -> Column:
            rest = F.slice(fields, skip + 2, F.greatest(F.size(fields), F.lit(1)))
            clean = F.transform(rest, lambda m: F.btrim(m, F.lit("-")))
            return F.struct(
                F.get(fields, skip).alias("word"), F.array_remove(clean, "").alias("morphemes")
            )

        return let(first, build)

    return let(tokens(line), parse)


def char_ngrams(token: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """All n-grams of ``<token>``, shortest first, duplicates kept."""

    def of_wrapped(w: Column) -> Column:
        def of_size(n: Column) -> Column:
            return F.when(
                F.length(w) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n)
                ),
            ).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(n_min), F.lit(n_max)), of_size))

    return let(F.concat(F.lit("<"), token, F.lit(">")), of_wrapped)


def ngram_rows(tokens: DataFrame, token: str, n_min: int = 3, n_max: int = 5) -> DataFrame:
    """(ngram): a row for each element of ``char_ngrams`` of each token, without a function per element."""
    w, size, at = F.col("__w"), F.col("__size"), F.col("__at")
    wrapped = tokens.select(F.concat(F.lit("<"), token, F.lit(">")).alias("__w")).select(w, F.length(w).alias("__size"))
    starts = F.when(size >= n_min, F.sequence(F.lit(1), size - (n_min - 1)))
    placed = wrapped.select(w, size, F.explode(starts).alias("__at"))
    grams = [F.when(at + (n - 1) <= size, F.substring(w, at, F.lit(n))) for n in range(n_min, n_max + 1)]
    return placed.select(F.explode(F.array(*grams)).alias("ngram")).filter("ngram is not null")


def strip_numbering(col: Column) -> Column:
    """Drop one leading ``N.`` or ``N)`` and the surrounding whitespace."""
    return strip(F.regexp_replace(col, rf"^\p{{Nd}}+[{WS_CLASS}]*[.)][{WS_CLASS}]*", ""))


def split_packed(col: Column, compat: bool = False) -> Column:
    """Cut a packed cell before each number marker and drop blank pieces.

    ``compat=True`` also cuts inside multi-digit numbers ("12." gives "1" and "2."),
    as a plain zero-width lookahead does.
    """
    guard = "" if compat else r"(?<!\p{Nd})"
    pieces = F.split(col, rf"{guard}(?=\p{{Nd}}+[{WS_CLASS}]*[.)])")
    return F.filter(pieces, lambda p: F.length(strip(p)) > 0)


def subword_surface(token: Column) -> Column:
    """Token without its word-start marker; null when shorter than two characters."""
    bare = F.when(F.startswith(token, F.lit(WORD_START)), F.substr(token, F.lit(2))).otherwise(token)
    return F.when(F.length(bare) >= 2, bare)


def run_name(system: Column, task: Column, language: Column, seed: Column) -> Column:
    return F.concat_ws("__", system, task, language, F.concat(F.lit("seed"), seed.cast("string")))


def count_marker(col: Column, marker: str) -> Column:
    """Non-overlapping occurrences of ``marker`` in a text."""
    gone = F.length(F.replace(col, F.lit(marker), F.lit("")))
    return F.floor((F.length(col) - gone) / F.lit(len(marker))).cast("bigint")


def truncate(arr: Column, max_length: int) -> Column:
    return F.slice(arr, 1, max_length)


def short_hash(col: Column, width: int = 12) -> Column:
    return F.substring(col, 1, width)
