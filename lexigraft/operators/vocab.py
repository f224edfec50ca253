"""Vocabulary operators: expansion, id maps, anchors, label inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_START, subword_surface
from .keys import dense_index


class TooFewAnchors(ValueError):
    """The shared vocabulary is smaller than the required minimum."""


def frequency_vocabulary(words: DataFrame, marker_every: int | None = None) -> DataFrame:
    """``word`` rows -> (token, word, n, id), most frequent first, ids dense from 0."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    ranked = dense_index(counts, [F.col("n").desc(), F.col("word")], "id")
    token = F.col("word")
    if marker_every:
        token = F.when(F.col("id") % marker_every == 0, F.concat(F.lit(WORD_START), token)).otherwise(token)
    return ranked.select(token.alias("token"), "word", "n", "id")


def missing_tokens(vocab: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """Distinct requested tokens the vocabulary does not hold yet."""
    return new_tokens.select("token").distinct().join(vocab.select("token"), "token", "left_anti")


def expand_vocabulary(vocab: DataFrame, new_tokens: DataFrame) -> DataFrame:
    """(token, id, added): old rows unchanged, missing tokens appended in sorted order."""
    first = vocab.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("first"))
    fresh = dense_index(missing_tokens(vocab, new_tokens), [F.col("token")], "pos")
    appended = fresh.crossJoin(F.broadcast(first)).select(
        "token", (F.col("first") + F.col("pos")).alias("id"), F.lit(True).alias("added")
    )
    return vocab.select("token", "id", F.lit(False).alias("added")).unionByName(appended)


def token_ids(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, id) of the requested tokens that exist in the vocabulary."""
    return tokens.select("token").distinct().join(vocab.select("token", "id"), "token")


def vocabulary_sizes(expanded: DataFrame) -> DataFrame:
    """One row: total rows, rows added, old size."""
    added = F.coalesce(F.sum(F.col("added").cast("bigint")), F.lit(0))
    return expanded.agg(
        F.count("*").alias("n_rows"), added.alias("n_added"), (F.count("*") - added).alias("old_size")
    )


def expansion_report(vocab: DataFrame, new_tokens: DataFrame, head: int = 20) -> DataFrame:
    """First ``head`` requested tokens with their ids, next to requested and added counts."""
    expanded = expand_vocabulary(vocab, new_tokens)
    counts = new_tokens.agg(F.countDistinct("token").alias("requested")).crossJoin(
        expanded.agg(F.sum(F.col("added").cast("bigint")).alias("added"))
    )
    first = token_ids(expanded, new_tokens).orderBy("token").limit(head)
    return first.crossJoin(F.broadcast(counts))


def anchors(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vocabulary rows whose surface the vector space covers; spelling variants all count."""
    surfaces = vocab.withColumn("surface", subword_surface(F.col("token"))).filter("surface is not null")
    return surfaces.join(vectors.withColumnRenamed("word", "surface"), "surface")


def require_anchors(anchor_rows: DataFrame, minimum: int = 1000) -> int:
    n = anchor_rows.count()
    if n < minimum:
        raise TooFewAnchors(f"{n} shared tokens, at least {minimum} are needed")
    return n


def label_inventory(*tagged: DataFrame) -> DataFrame:
    """(label, id) over the union of all given ``tag`` columns, sorted, ids from 0."""
    union = tagged[0].select("tag").distinct()
    for t in tagged[1:]:
        union = union.unionByName(t.select("tag").distinct())
    return dense_index(union.distinct(), [F.col("tag")], "id").select(F.col("tag").alias("label"), "id")
