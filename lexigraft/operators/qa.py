"""Question-answering data preparation, span selection and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.arrays import positions
from .keys import dense_index

SPECIALS = 4       # fixed value: special pieces of a question/context pair
CONTEXT_SHIFT = 3  # fixed value: specials that precede the context, next to the question


def locate_answers(triples: DataFrame) -> DataFrame:
    """Add answer_start, the first place of the answer in its context (-1 = not found)."""
    return triples.withColumn("answer_start", A.locate(F.col("context"), F.col("answer")))


def to_squad(triples: DataFrame, order: list[Column], title: str, id_prefix: str) -> DataFrame:
    """Locate each answer; id carries the input position, so dropped rows leave gaps.

    ``order`` must identify a row: only these keys are sorted and numbered, the texts stay out of it.
    Columns: idx, id, title, context, question, answer, answer_start (-1 = not found).
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = triples.select(*[c.alias(n) for c, n in zip(order, names, strict=True)], "context", "question", "answer")
    numbers = dense_index(keyed.select(*names), [F.col(n) for n in names], "idx")
    return locate_answers(keyed.join(numbers, names)).select(
        "idx",
        F.concat(F.lit(f"{id_prefix}-"), F.col("idx").cast("string")).alias("id"),
        F.lit(title).alias("title"),
        "context",
        "question",
        "answer",
        "answer_start",
    )


def located_counts(located: DataFrame) -> DataFrame:
    return located.agg(
        F.count_if(F.col("answer_start") >= 0).alias("kept"),
        F.count_if(F.col("answer_start") < 0).alias("dropped"),
    )


def squad_items(located: DataFrame) -> DataFrame:
    """Kept rows as (id, title, context, qas) articles with one question each."""
    answer = F.struct(F.col("answer").alias("text"), F.col("answer_start").cast("int").alias("answer_start"))
    question = F.struct("id", "question", F.array(answer).alias("answers"), F.lit(False).alias("is_impossible"))
    return located.filter("answer_start >= 0").select("id", "title", "context", F.array(question).alias("qas"))


def question_classes(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """(keys, cls): the class of every question."""
    return paragraphs.select(*keys, "context", F.explode("qas").alias("qa")).select(
        *keys, A.question_class(F.col("context"), F.col("qa.answers")).alias("cls")
    )


def classify(paragraphs: DataFrame) -> DataFrame:
    """(extractive, abstractive, unanswerable) question counts over all paragraphs."""
    cls = question_classes(paragraphs)
    return cls.agg(
        *[F.count_if(F.col("cls") == c).alias(c) for c in ("extractive", "abstractive", "unanswerable")]
    )


def keep_valid(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with only the valid answers of the questions that have any; others drop out."""
    def keep(qa: Column) -> Column:
        return qa.withField("answers", A.valid_answers(F.col("context"), qa["answers"]))

    kept = F.filter(F.transform("qas", keep), lambda qa: F.size(qa["answers"]) > 0)
    return paragraphs.withColumn("qas", kept).filter(F.size("qas") > 0)


def split_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("split").agg(
        F.count("*").alias("contexts"), F.sum(F.size("qas").cast("bigint")).alias("qa_pairs")
    )


# ---------------------------------------------------------------- windows

def context_windows(
    examples: DataFrame, max_length: int = 384, stride: int = 128, keys: tuple[str, ...] = ("id",), long_questions: str = "raise"
) -> DataFrame:
    """(keys, window, q_len, first, n_tokens, offsets): overlapping windows over the context tokens.

    ``examples`` has question and context. Only the context is cut; consecutive windows
    share ``stride`` tokens. Windows are built inside the row. A question that leaves no room for a
    window fails the job, or with ``long_questions="skip"`` has no windows (``too_long`` finds it).
    A null question has no windows; a context without tokens has one, which is empty.
    """
    if long_questions not in ("raise", "skip"):
        raise ValueError(f"long_questions is 'raise' or 'skip', not {long_questions!r}")
    sized = (
        examples.withColumn("offsets", A.token_offsets(F.col("context")))
        .withColumn("q_len", F.size(A.tokens(F.col("question"))))
        .withColumn("__capacity", F.lit(max_length - SPECIALS) - F.col("q_len"))
        .withColumn("__n", F.size("offsets"))
    )
    none = F.array().cast("array<int>")
    step_ok = F.col("__capacity") > stride
    starts = A.window_starts(F.size("offsets"), F.col("__capacity"), stride)
    return (
        sized.withColumn(
            "__starts",
            F.when(F.col("question").isNull(), none).when(step_ok, starts).otherwise(
                none
                if long_questions == "skip"
                else F.raise_error(F.lit("question too long: no room for a context window"))
            ),
        )
        .select("*", F.posexplode("__starts").alias("window", "first"))
        .withColumn("offsets", F.slice("offsets", F.col("first") + 1, F.col("__capacity")))
        .withColumn("n_tokens", F.least(F.col("__capacity"), F.col("__n") - F.col("first")))
        .drop("__starts", "__capacity", "__n")
    )


def too_long(examples: DataFrame, max_length: int = 384, stride: int = 128) -> DataFrame:
    """The examples whose question leaves no room for a window."""
    return examples.filter(F.lit(max_length - SPECIALS) - F.size(A.tokens(F.col("question"))) <= stride)


def label_windows(windows: DataFrame) -> DataFrame:
    """Add ``label.start`` and ``label.end`` for the first answer (``a_start``, ``a_text``)."""
    end_char = F.col("a_start") + F.length("a_text")
    shift = F.col("q_len") + F.lit(CONTEXT_SHIFT)
    return windows.withColumn("label", A.window_label(F.col("offsets"), F.col("a_start"), end_char, shift))


def masked_offsets(windows: DataFrame) -> DataFrame:
    """Add ``feature_offsets``: one entry per piece, null outside the context."""
    null = F.lit(None).cast("struct<start:int,end:int>")
    return windows.withColumn(
        "feature_offsets",
        F.concat(F.array_repeat(null, F.col("q_len") + CONTEXT_SHIFT), F.col("offsets"), F.array(null)),
    )


def best_spans(
    features: DataFrame, n_best: int = 20, max_answer_len: int = 64, key: str = "id"
) -> DataFrame:
    """(key, score, window, a_start, a_end, a_text) of the best span over all windows of an example.

    ``a_text`` is there if the features carry their context: it is cut where the context lies, so that
    no context is moved.
    ``features`` has feature_offsets and the score arrays s_scores, e_scores. Equal
    scores resolve by window, start rank and end rank. Each window yields one candidate
    and candidates are combined on the map side, however many windows an example has.
    """
    is_context = F.transform("feature_offsets", lambda o: o.isNotNull())
    found = A.best_window_span(F.col("s_scores"), F.col("e_scores"), is_context, n_best, max_answer_len)
    # exploded, so that the fields below do not search the window again; a window without a span has no row
    best = features.withColumn("__best", F.explode(F.array_compact(F.array(found))))
    a_start = F.get("feature_offsets", F.col("__best.start"))["start"]
    a_end = F.get("feature_offsets", F.col("__best.end"))["end"]
    text = [F.substr("context", a_start + 1, a_end - a_start).alias("a_text")] if "context" in features.columns else []
    candidate = best.select(
        key,
        F.struct(
            F.col("__best.score").alias("score"),
            (-F.col("window")).alias("neg_window"),
            F.col("__best.neg_s_rank").alias("s"),
            F.col("__best.neg_e_rank").alias("e"),
            a_start.alias("a_start"),
            a_end.alias("a_end"),
            *text,
        ).alias("c"),
    )
    return candidate.groupBy(key).agg(F.max("c").alias("c")).select(
        key,
        F.col("c.score").alias("score"),
        (-F.col("c.neg_window")).alias("window"),
        F.col("c.a_start").alias("a_start"),
        F.col("c.a_end").alias("a_end"),
        *[F.col("c.a_text").alias("a_text") for _ in text],
    )


def predicted_texts(examples: DataFrame, best: DataFrame, key: str = "id") -> DataFrame:
    """(key, prediction): text of the best span, empty without one.

    The span's text is taken from ``best`` where it has one, else cut from the examples' context.
    """
    if "a_text" in best.columns:
        found = examples.select(key).join(best.select(key, "a_text"), key, "left")
        return found.select(key, F.coalesce("a_text", F.lit("")).alias("prediction"))
    text = F.substr("context", F.col("a_start") + 1, F.col("a_end") - F.col("a_start"))
    return examples.select(key, "context").join(best, key, "left").select(
        key, F.coalesce(text, F.lit("")).alias("prediction")
    )


# ---------------------------------------------------------------- scoring

def score_questions(references: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """(key, f1, em): best over the gold texts; a missing prediction is the empty text.

    A question without gold texts scores 0.
    """
    pairs = references.select(key, "golds").join(predictions.select(key, "prediction"), key, "left")
    pred = F.coalesce("prediction", F.lit(""))
    return pairs.withColumn("__p", pred).select(
        key,
        F.coalesce(F.array_max(F.transform("golds", lambda g: A.overlap_f1(F.col("__p"), g))), F.lit(0.0)).alias("f1"),
        F.coalesce(F.array_max(F.transform("golds", lambda g: A.exact_match(F.col("__p"), g))), F.lit(0.0)).alias("em"),
    )


def dataset_scores(scored: DataFrame) -> DataFrame:
    """One row: f1 and exact match x 100 over all reference questions."""
    n = F.greatest(F.count("*"), F.lit(1))
    return scored.agg(
        F.count("*").alias("n"),
        (100 * F.coalesce(F.sum("f1"), F.lit(0.0)) / n).alias("f1"),
        (100 * F.coalesce(F.sum("em"), F.lit(0.0)) / n).alias("exact_match"),
    )


def feature_positions(windows: DataFrame) -> Column:
    """Positions 0..L-1 of a feature: question, context and special pieces."""
    return positions(F.col("feature_offsets"))
