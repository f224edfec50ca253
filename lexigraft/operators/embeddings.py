"""Embedding rows for new tokens: averages, fallback chain, initializers, drift."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import char_ngrams
from ..functions.vector_sums import exact_sums, of_width
from ..session import stable
from .keys import lookup_join
from .lexicon import Segmenter, segment
from .ngrams import block_means, frozen_blocks

_MAX_MATRIX_ROWS = 8192  # an alignment matrix is d x d; the driver holds it
NGRAM_SCALE = 0.02       # fixed value: scale of n-gram vectors


class IncompatibleDimension(ValueError):
    """Two vector spaces that must share a width do not."""


class MissingAlignmentMatrix(ValueError):
    """A square alignment matrix is required and there is no default."""


class MissingParameter(ValueError):
    """A mandatory run parameter was not given."""


# ---------------------------------------------------------------- guards

def width_profile(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    size = F.size(vec).cast("bigint")
    return vectors.agg(
        F.count("*").alias("n_rows"), F.min(size).alias("min_width"), F.max(size).alias("max_width")
    )


def vector_width(vectors: DataFrame, vec: str = "vec") -> int:
    """The one width of a vector table; an empty or ragged table is an error."""
    p = width_profile(vectors, vec).first()
    if not p["n_rows"]:
        raise IncompatibleDimension("the vector table is empty")
    if p["min_width"] != p["max_width"]:
        raise IncompatibleDimension(f"widths range from {p['min_width']} to {p['max_width']}")
    return p["min_width"]


def check_dimensions(vector_dim: int, model_dim: int) -> None:
    """Vectors are never reshaped, cut or padded to fit."""
    if vector_dim != model_dim:
        raise IncompatibleDimension(
            f"vectors are {vector_dim}-dimensional, the embedding space is {model_dim}-dimensional"
        )


def load_matrix(matrix: DataFrame | None, dim: int) -> np.ndarray:
    """Collect a (row, vec) table as a dim x dim float32 matrix after checking its shape."""
    if matrix is None:
        raise MissingAlignmentMatrix("no alignment matrix was supplied; the identity is not assumed")
    if dim > _MAX_MATRIX_ROWS:
        raise IncompatibleDimension(f"a {dim} x {dim} matrix exceeds the {_MAX_MATRIX_ROWS} rows that the driver holds")
    n = matrix.count()
    if n != dim:
        raise IncompatibleDimension(f"matrix has {n} rows, expected {dim}")
    check_dimensions(vector_width(matrix), dim)
    rows = sorted(matrix.select("row", "vec").collect(), key=lambda r: r["row"])
    if [r["row"] for r in rows] != list(range(dim)):
        raise IncompatibleDimension("matrix rows must be numbered 0..d-1")
    return np.array([r["vec"] for r in rows], dtype=np.float32).astype(np.float64)


# ---------------------------------------------------------------- elementwise aggregation

def sum_vectors(
    rows: DataFrame, keys: list[str], dim: int, vec: str = "vec", weight: Column | None = None
) -> DataFrame:
    """(keys, n, weight, sums): elementwise (weighted) sum, equal to the last bit however the rows are dealt out.

    Rows without a vector or a weight are not counted; a group of such rows has n = 0 and zero sums.
    A vector of another width than ``dim`` fails the job: nothing is cut or padded. A null cell adds
    nothing; weights may be zero or negative.
    """
    return exact_sums(rows, keys, dim, F.col(vec), F.lit(1.0) if weight is None else weight)


def mean_vectors(rows: DataFrame, keys: list[str], dim: int, vec: str = "vec") -> DataFrame:
    """(keys, n, vec): elementwise mean per key over the rows that have a vector; keys without one are absent."""
    sums = sum_vectors(rows, keys, dim, vec).filter("n > 0")
    return sums.select(*keys, "n", F.transform("sums", lambda s: s / F.col("n")).alias("vec"))


# ---------------------------------------------------------------- the fallback chain

#: An auxiliary vector space: a table (word, vec), or a function that makes the vector, or null, of a word column.
Vectors = DataFrame | Callable[[Column], Column]


def with_vectors(rows: DataFrame, word: str, vectors: Vectors, name: str = "vec", how: str = "left") -> DataFrame:
    """``rows`` with the vector of column ``word``; null if there is none, or with ``how`` inner no row."""
    if isinstance(vectors, DataFrame):
        known = vectors.filter(F.col("vec").isNotNull()).select(F.col("word").alias(word), F.col("vec").alias(name))
        return rows.join(known, word, how)
    made = rows.withColumn(name, vectors(F.col(word)))
    return made.filter(F.col(name).isNotNull()) if how == "inner" else made


def morpheme_means(segmented: DataFrame, vectors: Vectors, dim: int) -> DataFrame:
    """(token, n, vec): mean over the covered morphemes; tokens without one are absent."""
    probe = segmented.select("token", F.explode("morphemes").alias("word"))
    return mean_vectors(with_vectors(probe, "word", vectors, how="inner"), ["token"], dim)


def whole_token_vectors(tokens: DataFrame, vectors: Vectors) -> DataFrame:
    """(token, vec): vec is null where the vector table has no such word. Vectors are handed on as they are."""
    return with_vectors(tokens.select("token"), "token", vectors)


def ngram_means(
    tokens: DataFrame, ngram_vectors: DataFrame, dim: int, n_min: int = 3, n_max: int = 5
) -> DataFrame:
    """(token, n, vec): mean over the token's n-grams found in ``ngram_vectors(ngram, vec)``.

    Vectors go to blocks of tokens, see ``ngrams``. What no block takes, such as a text without blanks that has
    more n-grams than a block, gets a row for each n-gram.
    """
    known = ngram_vectors.filter(F.col("vec").isNotNull())
    blocks = frozen_blocks(tokens, dim, n_min, n_max)
    means = block_means(blocks, known, dim)
    rest = blocks.filter("block is null").select("token", F.col("times").cast("int").alias("times"))
    if rest.isEmpty():
        return means
    copies = rest.select("token", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("token")
    probe = copies.select("token", F.explode(char_ngrams(F.col("token"), n_min, n_max)).alias("ngram"))
    return means.unionByName(mean_vectors(lookup_join(probe, known, "ngram", "vec"), ["token"], dim))


def lexical_vectors(tokens: DataFrame, lexicon: DataFrame | Segmenter, vectors: Vectors, dim: int) -> DataFrame:
    """(token, vec, origin) from morphemes, else from the whole token, else null.

    The lexicon may be a segmenter function, the vectors a function of a word; the rows are the same.
    """
    seg = segment(tokens.select("token"), lexicon)
    morph = morpheme_means(seg, vectors, dim).select("token", F.col("vec").alias("__m"))
    return (
        with_vectors(tokens.select("token").join(morph, "token", "left"), "token", vectors, "__w")
        .withColumn("__w", of_width(F.col("__w").cast("array<double>"), dim))
        .select(
            "token",
            F.coalesce("__m", "__w").alias("vec"),
            F.when(F.col("__m").isNotNull(), "morpheme")
            .when(F.col("__w").isNotNull(), "whole_token")
            .otherwise("char_ngram")
            .alias("origin"),
        )
    )


def origins(tokens: DataFrame, lexicon: DataFrame, vector_words: DataFrame) -> DataFrame:
    """(token, origin) of the fallback chain from the covered words alone, without any vector."""
    seg = segment(tokens.select("token"), lexicon)
    known = vector_words.select("word", F.lit(True).alias("known"))
    probe = seg.select("token", F.explode("morphemes").alias("word"))
    hits = lookup_join(probe, known, "word", "known")
    by_morpheme = hits.groupBy("token").agg(F.bool_or("known").alias("__m"))
    whole = vector_words.select(F.col("word").alias("token"), F.lit(True).alias("__w"))
    return (
        tokens.select("token")
        .join(by_morpheme, "token", "left")
        .join(whole, "token", "left")
        .select(
            "token",
            F.when(F.col("__m"), "morpheme").when(F.col("__w"), "whole_token").otherwise("char_ngram").alias("origin"),
        )
    )


def initial_vectors(
    tokens: DataFrame,
    lexicon: DataFrame | Segmenter,
    vectors: Vectors,
    dim: int,
    matrix: np.ndarray | None = None,
    ngram_vectors: DataFrame | None = None,
    n_min: int = 3,
    n_max: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(token, origin, vec) for distinct tokens: morphemes, whole token, character n-grams.

    The map is linear, so it is applied once per token to the mean. N-gram vectors live
    in the target space already. Without an n-gram table they are drawn in place.
    """
    base = lexical_vectors(tokens, lexicon, vectors, dim)
    uncovered = F.col("origin") == "char_ngram"
    if ngram_vectors is None:
        grams = F.when(uncovered, char_ngrams(F.col("token"), n_min, n_max))
        if matrix is not None:
            base = base.withColumn("vec", V.apply_matrix(F.col("vec"), matrix))
        drawn = V.with_gaussian_ngram_mean(base, grams, "__drawn", dim, NGRAM_SCALE, seed)
        return drawn.select("token", "origin", F.coalesce("vec", "__drawn").alias("vec"))
    rest = base.filter(uncovered)
    covered = base.filter(~uncovered)
    if matrix is not None:
        covered = covered.withColumn("vec", V.apply_matrix(F.col("vec"), matrix))
    grams = ngram_means(rest, ngram_vectors, dim, n_min, n_max).select("token", "vec")
    filled = rest.select("token", "origin").join(grams, "token", "left")
    return covered.select("token", "origin", "vec").unionByName(filled.select("token", "origin", "vec"))


# ---------------------------------------------------------------- embedding matrix rows

def upsert_rows(matrix_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace rows by id, append unknown ids, keep all others."""
    keep = matrix_rows.select("id", "vec").join(new_rows.select("id"), "id", "left_anti")
    as_double = F.col("vec").cast("array<double>").alias("vec")
    return keep.select("id", as_double).unionByName(new_rows.select("id", as_double))


def cell_std(rows: DataFrame) -> DataFrame:
    """Sample standard deviation over all cells."""
    known = F.filter("vec", lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double"))
    squares = F.aggregate(known, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sums = rows.agg(F.sum(F.size(known)).cast("bigint").alias("n_cells"), F.sum(total).alias("s"), F.sum(squares).alias("q"))
    n = F.coalesce("n_cells", F.lit(0).cast("bigint"))
    variance = (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)
    return sums.select(n.alias("n_cells"), F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"))


@dataclass(frozen=True)
class InitInputs:
    """Everything an initializer may draw on; unused parts stay None."""

    tokens: DataFrame                       # (token, id) of the new tokens
    old_rows: DataFrame                     # (id, vec) of the existing rows
    current_rows: DataFrame | None = None   # (id, vec) after resizing, for ``default``
    lexicon: DataFrame | Segmenter | None = None
    vectors: Vectors | None = None          # auxiliary (word, vec), or a function of a word
    aux_rows: DataFrame | None = None       # normalised auxiliary vectors (id, vec) of old tokens
    ngram_vectors: DataFrame | None = None
    matrix: DataFrame | None = None
    dim: int = 0
    top_k: int = 10
    seed: int = 42
    options: dict[str, Any] | None = None


def default_init(x: InitInputs) -> DataFrame:
    """The rows as the resized model has them."""
    return x.tokens.join(x.current_rows, "id").select("token", "id", "vec")


def random_init(x: InitInputs) -> DataFrame:
    """Gaussian rows at the spread of the old rows, one stream per (seed, token)."""
    std = cell_std(x.old_rows).select("std")
    drawn = x.tokens.withColumn("vec", V.gaussian(F.col("token"), x.dim, x.seed))
    return drawn.crossJoin(F.broadcast(std)).select(
        "token", "id", F.transform("vec", lambda v: v * F.col("std")).alias("vec")
    )


def similarity_init(x: InitInputs) -> DataFrame:
    """Softmax-weighted mix of the rows of the k most similar old tokens, else the mean row."""
    from .similarity import class_weights, neighbour_classes

    aux = with_vectors(x.tokens, "token", x.vectors, how="inner")
    known = aux.select(F.col("id").alias("query_id"), "vec")
    # equal vectors have equal neighbours and one mix
    members, near = neighbour_classes(known, x.aux_rows, x.top_k, x.dim)
    rows = lookup_join(class_weights(near).withColumnRenamed("ref_id", "id"), x.old_rows, "id", "vec")
    sums = sum_vectors(rows, ["cls"], x.dim, weight=F.col("weight")).select("cls", F.col("sums").alias("__mix"))
    mixed = members.join(sums, "cls").select(F.col("query_id").alias("id"), "__mix")
    mean = mean_row(x.old_rows, x.dim).select(F.col("vec").alias("__mean"))
    return (
        x.tokens.join(mixed, "id", "left")
        .join(F.broadcast(mean), F.lit(True), "left")
        .select("token", "id", F.coalesce("__mix", "__mean").alias("vec"))
    )


def lexical_init(x: InitInputs) -> DataFrame:
    """The lexical fallback chain, mapped by the alignment matrix."""
    w = load_matrix(x.matrix, x.dim)
    made = initial_vectors(
        x.tokens, x.lexicon, x.vectors, x.dim, w, x.ngram_vectors, seed=x.seed
    )
    return x.tokens.join(made, "token").select("token", "id", "vec")


INITIALIZERS: dict[str, Callable[[InitInputs], DataFrame]] = {
    "default": default_init,
    "random": random_init,
    "focus": similarity_init,
    "lexical": lexical_init,
}


def initialize(kind: str, inputs: InitInputs) -> DataFrame:
    if kind not in INITIALIZERS:
        raise ValueError(f"unknown initializer {kind!r}; expected one of {sorted(INITIALIZERS)}")
    return INITIALIZERS[kind](inputs)


def compare_initializers(kinds: list[str], inputs: InitInputs) -> DataFrame:
    """The same tokens under every requested kind, one row set per kind."""
    parts = [
        initialize(k, inputs).select(
            F.lit(k).alias("kind"), "token", "id", F.col("vec").cast("array<double>").alias("vec")
        )
        for k in kinds
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mean_row(rows: DataFrame, dim: int) -> DataFrame:
    """One row: the elementwise mean of all rows."""
    return mean_vectors(rows, [], dim)


# ---------------------------------------------------------------- drift

def check_penalty(reg_lambda: float | None) -> float:
    if reg_lambda is None or reg_lambda != reg_lambda:
        raise MissingParameter("the drift penalty weight is mandatory")
    if reg_lambda < 0:
        raise ValueError(f"the drift penalty weight must not be negative, got {reg_lambda}")
    return float(reg_lambda)


def drift_penalty(current: DataFrame, initial: DataFrame, reg_lambda: float | None) -> DataFrame:
    """One row: weight times the mean squared cell difference over the initial rows."""
    weight = check_penalty(reg_lambda)
    pairs = initial.select("id", F.col("vec").alias("__mu")).join(current.select("id", "vec"), "id")
    cells = pairs.select(
        V.squared_distance(F.col("vec"), F.col("__mu")).alias("sq"), F.size("__mu").alias("d")
    ).agg(F.sum("sq").alias("sq"), F.sum("d").alias("n_cells"))
    if weight == 0.0:
        return cells.select("n_cells", F.lit(0.0).alias("penalty"))
    return cells.select("n_cells", (F.lit(weight) * F.col("sq") / F.col("n_cells")).alias("penalty"))


def drift_gradient(current: DataFrame, initial: DataFrame, reg_lambda: float | None) -> DataFrame:
    """(id, grad): per-cell derivative of the penalty."""
    weight = check_penalty(reg_lambda)
    pairs = initial.select("id", F.col("vec").alias("__mu")).join(current.select("id", "vec"), "id")
    cells = initial.agg(F.sum(F.size("vec")).alias("__cells"))
    return pairs.crossJoin(F.broadcast(cells)).select(
        "id",
        F.zip_with(
            "vec",
            "__mu",
            lambda e, m: F.lit(2.0 * weight) * (e.cast("double") - m.cast("double")) / F.col("__cells"),
        ).alias("grad"),
    )


def changed_frozen_rows(before: DataFrame, after: DataFrame, old_size: int) -> DataFrame:
    """(id, max_change) of rows below ``old_size`` that differ between two snapshots."""
    pairs = (
        before.filter(F.col("id") < old_size)
        .select("id", F.col("vec").alias("__b"))
        .join(after.filter(F.col("id") < old_size).select("id", "vec"), "id")
    )
    change = F.array_max(
        F.zip_with("vec", "__b", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    )
    return pairs.withColumn("max_change", change).filter("max_change > 0").select("id", "max_change")
