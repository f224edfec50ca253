"""Named-entity data preparation and scoring. Sentences are arrays; one row is one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.tags import entity_spans, span_overlap

IGNORED = -100  # fixed value: label of positions that do not count


def tags_of(sentence: Column) -> Column:
    return F.transform(sentence, lambda t: t["tag"])


def spans(sentences: DataFrame, tags: str, keys: list[str]) -> DataFrame:
    """(keys, etype, start, end), one row per entity."""
    return sentences.select(*keys, F.explode(entity_spans(F.col(tags))).alias("s")).select(
        *keys, "s.etype", "s.start", "s.end"
    )


def span_counts(predicted: Column, gold: Column) -> Column:
    """``struct<tp,fp,fn>`` of one sentence by set algebra on its spans, a batch of sentences at a time."""
    return span_overlap(predicted, gold)


def entity_f1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (x 100) over sentences paired by ``keys``.

    Sentences without a partner are ignored. Counting happens inside each row, so only
    three numbers per task are shuffled after the pairing.
    """
    pairs = predicted.select(*keys, F.col("tags").alias("__p")).join(
        gold.select(*keys, F.col("tags").alias("__g")), keys
    )
    counts = pairs.select(span_counts(F.col("__p"), F.col("__g")).alias("c")).agg(
        *[F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]
    )
    return counts.select("tp", "fp", "fn", *micro_scores())


def ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def micro_scores() -> list[Column]:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * p * r, p + r)
    return [(100 * p).alias("precision"), (100 * r).alias("recall"), (100 * f1).alias("f1")]


def first_piece_labels(word_ids: Column, label_ids: Column) -> Column:
    """Label of each piece: the word's label on its first piece, -100 elsewhere.

    ``word_ids`` is null for special pieces. Both arrays are already truncated together.
    """
    def of_sentence(x: Column) -> Column:
        def label(word: Column, i: Column) -> Column:
            previous = F.get(x["words"], i - F.lit(1))
            opens = word.isNotNull() & ((i == 0) | ~word.eqNullSafe(previous))
            return F.when(opens, F.get(x["labels"], word)).otherwise(F.lit(IGNORED))

        return F.transform(x["words"], label)

    return let(F.struct(word_ids.alias("words"), label_ids.alias("labels")), of_sentence)


def piece_word_ids(words: Column, width: int, max_length: int) -> Column:
    """Word index per piece with one special piece at either end, cut to ``max_length`` pieces.

    Pieces are fixed-width chunks of a word, standing in for a subword model.
    """
    body = F.flatten(
        F.transform(
            words,
            lambda w, i: F.array_repeat(
                i, F.greatest(F.ceil(F.length(w) / F.lit(width)).cast("int"), F.lit(1))
            ),
        )
    )
    special = F.array(F.lit(None).cast("int"))
    return F.concat(special, F.slice(body, 1, max_length - 2), special)


def decode_predictions(scores: Column, labels: Column) -> Column:
    """``array<struct<predicted,gold>>`` label ids at counted positions; argmax takes the first maximum."""
    both = F.transform(
        F.arrays_zip(scores.alias("s"), labels.alias("l")),
        lambda x: F.struct(
            (F.array_position(x["s"], F.array_max(x["s"])) - 1).cast("int").alias("predicted"),
            x["l"].alias("gold"),
        ),
    )
    return F.filter(both, lambda x: x["gold"] != IGNORED)


def split_counts(sentences: DataFrame) -> DataFrame:
    """(split, sentences, tokens)."""
    return sentences.groupBy("split").agg(
        F.count("*").alias("sentences"), F.sum(F.size("sentence").cast("bigint")).alias("tokens")
    )


def type_profile(sentences: DataFrame, tags: str) -> DataFrame:
    return spans(sentences, tags, []).groupBy("etype").agg(F.count("*").alias("n"))
