"""Morphological lexicon: building it from lines and segmenting tokens with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexicon_entry, lexicon_line_is_data, strip


def parse_lexicon(lines: DataFrame, order: list[Column]) -> DataFrame:
    """``value`` lines -> (word, morphemes); the last entry with morphemes wins.

    ``order`` says which line of a word is later. Entries without morphemes never
    overwrite. Per word only the current best entry is kept, on the map side too.
    """
    entry = lines.filter(lexicon_line_is_data(strip(F.col("value")))).withColumn(
        "__entry", lexicon_entry(strip(F.col("value")))
    )
    # validity is tested inside the aggregate: a filter on the parsed entry would be pushed
    # below the parse and repeat it
    counts = F.size("__entry.morphemes") > 0
    best = F.max_by(F.when(counts, F.col("__entry.morphemes")), F.when(counts, F.struct(*order)))
    return (
        entry.groupBy(F.col("__entry.word").alias("word"))
        .agg(best.alias("morphemes"))
        .filter("morphemes is not null")
    )


Segmenter = Callable[[Column], Column]


def segment(tokens: DataFrame, lexicon: DataFrame | Segmenter) -> DataFrame:
    """Add ``morphemes``: the token's own entry, else its lower-cased form's, else empty.

    ``tokens`` should be distinct; both joins are then free of hot keys. In the place of a lexicon a
    function may stand that makes ``array<string>`` of the token column; its nulls count as empty.
    """
    if not isinstance(lexicon, DataFrame):
        return tokens.withColumn("morphemes", F.coalesce(lexicon(F.col("token")), F.array().cast("array<string>")))
    exact = lexicon.select(F.col("word").alias("token"), F.col("morphemes").alias("__exact"))
    lower = lexicon.select(F.col("word").alias("__lower"), F.col("morphemes").alias("__low"))
    return (
        tokens.join(exact, "token", "left")
        .withColumn("__lower", F.lower("token"))
        .join(lower, "__lower", "left")
        .withColumn("morphemes", F.coalesce("__exact", "__low", F.array().cast("array<string>")))
        .drop("__exact", "__low", "__lower")
    )
