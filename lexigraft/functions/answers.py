"""Question-answering expressions: location, validation, overlap, windows, spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, once
from .text import strip, tokens


def locate(context: Column, answer: Column) -> Column:
    """0-based first occurrence in code points, -1 when absent."""
    return F.instr(context, answer) - F.lit(1)


def answer_is_valid(context: Column, answer: Column) -> Column:
    """The text at ``answer_start`` is the answer; a missing start counts as -1."""
    start = F.coalesce(answer["answer_start"], F.lit(-1))
    found = F.substr(context, start + F.lit(1), F.length(answer["text"]))
    return (start >= 0) & F.coalesce(found == answer["text"], F.lit(False))


def valid_answers(context: Column, answers: Column) -> Column:
    return F.filter(answers, lambda a: answer_is_valid(context, a))


def question_class(context: Column, answers: Column) -> Column:
    return (
        F.when(answers.isNull() | (F.size(answers) == 0), F.lit("unanswerable"))
        .when(F.size(valid_answers(context, answers)) > 0, F.lit("extractive"))
        .otherwise(F.lit("abstractive"))
    )


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays, in n log n.

    Both sides are merged into one sorted run in which the right side of a token
    precedes its left side; a constant-size state then walks the run once.
    """
    merged = F.array_sort(
        F.concat(
            F.transform(right, lambda t: F.struct(t.alias("t"), F.lit(0).alias("side"))),
            F.transform(left, lambda t: F.struct(t.alias("t"), F.lit(1).alias("side"))),
        )
    )
    start = F.struct(
        F.lit(None).cast("string").alias("t"), F.lit(0).alias("open"), F.lit(0).alias("hits")
    )

    def step(acc: Column, item: Column) -> Column:
        left_open = F.when(acc["t"].eqNullSafe(item["t"]), acc["open"]).otherwise(F.lit(0))
        is_right = item["side"] == 0
        hit = (~is_right) & (left_open > 0)
        return F.struct(
            item["t"].alias("t"),
            F.when(is_right, left_open + 1).when(hit, left_open - 1).otherwise(left_open).alias("open"),
            (acc["hits"] + F.when(hit, 1).otherwise(0)).alias("hits"),
        )

    return F.aggregate(merged, start, step, lambda acc: acc["hits"])


def overlap_f1(prediction: Column, gold: Column) -> Column:
    """Token-overlap F1 of one pair; both empty 1, one empty 0."""

    def of_tokens(pair: Column) -> Column:
        p, g = pair["p"], pair["g"]

        def score(hits: Column) -> Column:
            precision = hits / F.size(p)
            recall = hits / F.size(g)
            return (
                F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0))
                .when((F.size(p) == 0) | (F.size(g) == 0) | (hits == 0), F.lit(0.0))
                .otherwise(F.lit(2.0) * precision * recall / (precision + recall))
            )

        return let(multiset_overlap(p, g), score)

    return let(F.struct(tokens(prediction).alias("p"), tokens(gold).alias("g")), of_tokens)


def exact_match(prediction: Column, gold: Column) -> Column:
    return (strip(prediction) == strip(gold)).cast("double")


#: Code points that part tokens: what Unicode calls white space, and the four separators before the blank.
_BLANKS = np.zeros(0x3001, np.bool_)
_BLANKS[[c for c in range(0x3001) if chr(c).isspace()]] = True
#: Code points that are scanned at a time, unless one text has more.
_SCAN_POINTS = 4 << 20


def offsets_of(texts: pa.Array) -> pa.Array:
    """The starts and ends of the tokens of each text, by one scan over the batch's code points.

    All texts lie one after the other as UTF-32; where blank turns to sign a token starts, where sign
    turns to blank, or a text ends, it ends. Counts of starts by text are differences of a running sum.
    """
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(texts) > 1 and lengths.sum() > _SCAN_POINTS:
        half = len(texts) // 2
        return pa.concat_arrays([offsets_of(texts[:half]), offsets_of(texts[half:])])
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    sign = ~_BLANKS[np.minimum(points, len(_BLANKS) - 1)] | (points >= len(_BLANKS))
    ends_of = np.cumsum(lengths)
    first = np.zeros(len(points) + 1, np.bool_)
    first[np.concatenate([[0], ends_of])] = True
    # a token never goes across the border of two texts
    starts = np.nonzero(sign & (first[:-1] | ~np.append(False, sign[:-1])))[0]
    ends = np.nonzero(sign & (first[1:] | ~np.append(sign[1:], False)))[0] + 1
    cuts = np.searchsorted(starts, np.concatenate([[0], ends_of]))
    base = np.repeat(np.concatenate([[0], ends_of[:-1]]) if len(ends_of) else ends_of, np.diff(cuts))
    found = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), found)


def token_offsets(text: Column) -> Column:
    """``array<struct<start,end>>``: code-point offsets of the whitespace tokens of a text; null has none."""
    return once(F.arrow_udf("array<struct<start:int,end:int>>")(offsets_of))(text)


def window_starts(n: Column, capacity: Column, stride: int) -> Column:
    """Start positions of overlapping windows; none begins after one reached the end."""

    def starts(x: Column) -> Column:
        step = x["capacity"] - F.lit(stride)
        count = F.when(x["n"] <= x["capacity"], F.lit(1)).otherwise(
            F.lit(1) + F.ceil((x["n"] - x["capacity"]) / step).cast("int")
        )
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)

    return let(F.struct(n.alias("n"), capacity.alias("capacity")), starts)


def window_label(offsets: Column, start_char: Column, end_char: Column, shift: Column) -> Column:
    """Feature-relative ``struct<start,end>``; (0,0) unless the window holds the whole answer.

    Offsets ascend, so the last token starting at or before the answer and the first one
    ending at or after it follow from two counts.
    """
    inside = (F.get(offsets, F.lit(0))["start"] <= start_char) & (
        F.get(offsets, F.size(offsets) - 1)["end"] >= end_char
    )
    first = F.size(F.filter(offsets, lambda o: o["start"] <= start_char)) - 1
    last = F.size(F.filter(offsets, lambda o: o["end"] < end_char))
    none = F.lit(0)
    return F.struct(
        F.when(inside, first + shift).otherwise(none).alias("start"),
        F.when(inside, last + shift).otherwise(none).alias("end"),
    )


def n_best(scores: Column, n: int) -> Column:
    """``array<struct<score,pos>>`` of the n largest, ties by smaller position."""
    ranked = F.array_sort(
        F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("pos")))
    )
    return F.transform(
        F.slice(ranked, 1, n), lambda r: F.struct((-r["neg"]).alias("score"), r["pos"].alias("pos"))
    )


def best_window_span(
    starts: Column, ends: Column, is_context: Column, n: int = 20, max_len: int = 64
) -> Column:
    """Best admissible (start, end) of one window, null if there is none.

    Ends are ranked, so the first admissible one is the best partner of a start: at most
    n candidates per window remain instead of n * n.
    """

    def pick(best: Column) -> Column:
        in_context = best["c"]

        def for_start(s: Column, rank: Column) -> Column:
            fits = F.filter(
                F.transform(best["e"], lambda e, r: F.struct(e["score"], e["pos"], r.alias("rank"))),
                lambda e: (e["pos"] >= s["pos"])
                & (e["pos"] - s["pos"] + 1 <= max_len)
                & F.coalesce(F.get(in_context, e["pos"]), F.lit(False)),
            )
            return let(
                F.get(fits, F.lit(0)),
                lambda e: F.when(
                    F.coalesce(F.get(in_context, s["pos"]), F.lit(False)) & e.isNotNull(),
                    F.struct(
                        (s["score"] + e["score"]).alias("score"),
                        (-rank).alias("neg_s_rank"),
                        (-e["rank"]).alias("neg_e_rank"),
                        s["pos"].alias("start"),
                        e["pos"].alias("end"),
                    ),
                ),
            )

        return F.array_max(F.transform(best["s"], for_start))

    ranked = F.struct(n_best(starts, n).alias("s"), n_best(ends, n).alias("e"), is_context.alias("c"))
    return let(ranked, pick)
