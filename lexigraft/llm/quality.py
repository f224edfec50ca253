"""Quality rules as columns, run as a short-circuit cascade ordered by rejection per cost.

All is built-in expressions: counts come from regular expressions, repeated lines and five-word
windows from arrays inside the row, so nothing is shuffled. A window is known by a 64-bit hash of its
five words' hashes. ``order_rules`` times each rule on a sample and counts what it rejects there; the
rule that rejects most for its cost comes first, and a row that fails skips what comes after. The
order changes the time only: a row is kept if no rule fails.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

WINDOW = 5
SAMPLE_ROWS = 1000
SAMPLE_FILES = 8
SYMBOL_SHARE = 0.1
UPPER_SHARE = 0.5
LINE_SHARE = 0.5
WORD_LENGTHS = (2, 20)
BULLET_SHARE = 0.9
ELLIPSIS_SHARE = 0.3
LETTER_SHARE = 0.5

LINE = r"[^\n]+"
BULLET = r"(\A|\n)[ \t]*[-*•]"
ELLIPSIS = r"(\.\.\.|…)[ \t]*(\n|\z)"
#: From a word's first letter to its end.
LETTERED = r"\p{L}[^\x20\x09-\x0D]*"

_BLANKS = " \t\n\x0b\f\r"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def n_words(text: Column) -> Column:
    return _count(text, WORD)


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(text).cast("long") - _count(text, SPACE)


def n_symbols(text: Column) -> Column:
    return _count(text, r"[#*$%&|<>]")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    once = F.array_distinct(lines)
    return (F.size(lines) - F.size(once)).cast("long")


def window_hashes(text: Column) -> Column:
    """A hash for each five-word window, in order; empty for fewer words."""
    words = F.transform(F.split(F.btrim(text, F.lit(_BLANKS)), f"{SPACE}+"), lambda w: F.xxhash64(w))
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + F.lit(k)) for k in range(1, WINDOW)]))
    return F.element_at(F.transform(F.array(words), windows), 1)


def covered_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, each counted once."""
    def covered(keyed: Column) -> Column:
        # sorted by hash, then place: equal hashes are neighbours
        again = F.filter(
            F.transform(keyed, lambda s, j: F.when((F.get(keyed, j - 1)["h"] == s["h"]) | (F.get(keyed, j + 1)["h"] == s["h"]), s["i"])),
            lambda p: p.isNotNull(),
        )
        def total(places: Column) -> Column:
            # a window adds its words up to the next one's start
            steps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)
        return F.element_at(F.transform(F.array(F.sort_array(again)), total), 1)
    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, F.element_at(F.transform(F.array(keyed), covered), 1)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (null text: 0).

    Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.withColumns(
        {
            "n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text), "__windows": window_hashes(text),
        }
    )
    return counted.withColumn("n_repeat_words", covered_words(F.col("__windows"))).drop("__windows")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


#: Name -> is the row rejected? Each takes the text column and may use the counts of ``measure``.
RULES: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda text: F.col("n_symbols") > F.lit(SYMBOL_SHARE) * F.col("n_words"),
    "word_length": lambda text: ~F.col("word_chars").between(F.lit(WORD_LENGTHS[0]) * F.col("n_words"), F.lit(WORD_LENGTHS[1]) * F.col("n_words")),
    "lines": lambda text: F.col("n_dup_lines") > F.lit(LINE_SHARE) * _count(text, r"\n(?=[^\n])"),
    "bullets": lambda text: _count(text, BULLET) > F.lit(BULLET_SHARE) * _count(text, LINE),
    "ellipses": lambda text: _count(text, ELLIPSIS) > F.lit(ELLIPSIS_SHARE) * _count(text, LINE),
    "letters": lambda text: _count(text, LETTERED) < F.lit(LETTER_SHARE) * F.col("n_words"),
    "upper_case": lambda text: _count(text, r"\p{Lu}") > F.lit(UPPER_SHARE) * _count(text, r"\p{L}"),
}


def sample_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text) of ``SAMPLE_ROWS`` rows or fewer.

    Of a table of files the rows come from ``SAMPLE_FILES`` files that a hash of the name picks, so no
    more is read or sent than these hold, whatever the size of the table. Null texts count as rows.
    """
    picked = docs
    files = sorted(docs.inputFiles(), key=lambda f: hashlib.md5(f.encode()).hexdigest())
    if len(files) > SAMPLE_FILES:
        try:
            picked = docs.filter(F.col("_metadata.file_name").isin([unquote(f.rpartition("/")[2]) for f in files[:SAMPLE_FILES]]))
            picked.schema  # noqa: B018  only a plain table of files knows where its rows are
        except AnalysisException:
            picked = docs
    return picked.select(F.col(text_col).cast("string").alias("text")).limit(SAMPLE_ROWS)


def order_rules(docs: DataFrame, rules: dict[str, Callable[[Column], Column]] = RULES, text_col: str = "text") -> list[str]:
    """Rule names, most rejections per second first, on the rows of ``sample_rows``.

    Ties, and rules that reject nothing, go by cost. An empty table keeps the given order. A null text
    counts as an empty one.
    """
    sample = measure(sample_rows(docs, text_col)).persist()

    def run(column: Column) -> tuple[float, int]:
        start = time.perf_counter()
        got = sample.agg(F.count(F.when(column, 1))).first()[0]
        return time.perf_counter() - start, got

    try:
        run(F.lit(True))
        floor = min(run(F.lit(True))[0] for _ in range(2))
        found = {}
        for name, rule in rules.items():
            failing = rule(F.coalesce(F.col("text"), F.lit("")))
            seconds, rejected = min(run(failing) for _ in range(2))
            cost = max(1e-4, seconds - floor)
            found[name] = (-rejected / cost, cost)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda name: found[name])


def cascade(measured: DataFrame, order: list[str], rules: dict[str, Callable[[Column], Column]] = RULES, text_col: str = "text") -> Column:
    """Does the row pass every rule? Stops at the first that rejects it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(rules[name](text), False).otherwise(verdict)
    return verdict
