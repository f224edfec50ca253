"""Orthogonal alignment of two vector spaces from their shared tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vector_sums import of_width
from .embeddings import check_dimensions, sum_vectors

IDENTITY_RTOL, IDENTITY_ATOL = 1e-5, 1e-8  # fixed values of the identity test


_DIGITS = 20  # binary digits of a slice: products of two slices add up exactly over _ROWS rows
_ROWS = 4096
_FLUSH = 1 << 10  # sums of so many products stay below 2**63


def _slices(m: np.ndarray) -> dict[int, np.ndarray]:
    """``m`` as a sum of whole matrices times 2**(20 t); only slices that are not zero."""
    if m.size and not np.abs(m).max() < 2.0**59:
        raise ValueError("a cell is not finite or too large for an exact product")
    out, rest = {}, m
    for t in range(2, -6, -1):
        unit = 2.0 ** (_DIGITS * t)
        whole = np.rint(rest / unit)
        rest = rest - whole * unit
        if whole.any():
            out[t] = whole
    return out


def gram_rows(pairs: DataFrame, dim: int) -> DataFrame:
    """(row, vec): the d x d sum of y x^T over ``pairs(x, y)``, equal to the last bit however they are dealt out.

    Cells are cut into whole slices of 20 binary digits, so that each matrix product of slices is exact.
    A task adds up products of equal unit as integers and emits them row by row; the rows are then
    summed by row index, so nothing larger than one matrix row is ever one record.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        products = 0

        def rows() -> Iterator[pd.DataFrame]:
            for unit, total in sums.items():
                # an integer of more than 53 digits goes as two doubles
                high = (total >> 32) << 32
                for part in (high, total - high):
                    if part.any():
                        yield pd.DataFrame({"row": np.arange(len(part), dtype=np.int32), "vec": list(part * 2.0 ** (_DIGITS * unit))})

        for b in batches:
            for at in range(0, len(b), _ROWS):
                some = b.iloc[at : at + _ROWS]
                left, right = (_slices(np.stack(some[c].to_numpy()).astype(np.float64)) for c in ("y", "x"))
                for t, y in left.items():
                    for u, x in right.items():
                        product = (y.T @ x).astype(np.int64)
                        sums[t + u] = sums[t + u] + product if t + u in sums else product
                products += 1
                if products == _FLUSH:
                    yield from rows()
                    sums, products = {}, 0
        yield from rows()

    sized = pairs.select(of_width(F.col("x"), dim).alias("x"), of_width(F.col("y"), dim).alias("y"))
    parts = sized.mapInPandas(partial, "row int, vec array<double>")
    return sum_vectors(parts, ["row"], dim).select("row", F.col("sums").alias("vec"))


def procrustes(pairs: DataFrame, x_dim: int, y_dim: int) -> np.ndarray:
    """The orthogonal W minimising ||W X - Y||; only the d x d Gram matrix reaches the driver."""
    check_dimensions(x_dim, y_dim)
    rows = gram_rows(pairs, x_dim).collect()
    gram = np.zeros((y_dim, x_dim))
    for r in rows:
        gram[r["row"]] = r["vec"]
    u, _s, vt = np.linalg.svd(gram)
    return u @ vt


def matrix_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(w)], "row int, vec array<double>"
    )


def is_identity(matrix: DataFrame) -> DataFrame:
    """One row: whether every cell is within tolerance of the identity."""
    cells = matrix.select("row", F.posexplode("vec").alias("col", "w"))
    unit = F.when(F.col("row") == F.col("col"), F.lit(1.0)).otherwise(F.lit(0.0))
    close = F.abs(F.col("w") - unit) <= F.lit(IDENTITY_ATOL) + F.lit(IDENTITY_RTOL) * F.abs(unit)
    return cells.agg(F.bool_and(close).alias("is_identity"))


def describe(dim: int, source: str, identity: bool) -> str:
    return f"W {dim}x{dim} from {source} (frozen{', identity' if identity else ''})"


def residuals(pairs: DataFrame, w: np.ndarray) -> DataFrame:
    """One row: anchors, ||W X - Y||_F and ||X - Y||_F."""
    mapped = pairs.withColumn("wx", V.apply_matrix(F.col("x"), w))
    return mapped.agg(
        F.count("*").alias("anchors"),
        F.sqrt(F.sum(V.squared_distance(F.col("wx"), F.col("y")))).alias("residual"),
        F.sqrt(F.sum(V.squared_distance(F.col("x"), F.col("y")))).alias("unaligned"),
    )


def orthogonality_error(w: np.ndarray) -> float:
    return float(np.abs(w @ w.T - np.eye(len(w))).max())


def alignment_record(
    pairs: DataFrame,
    w: np.ndarray,
    language: str,
    vector_words: DataFrame,
    path: str | None = None,
    vector_model: str | None = None,
    backbone: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """One-row record of an alignment: where W and its models lie, anchors, widths, residuals, objective."""
    d = len(w)
    words = vector_words.agg(F.count("*").alias("vector_vocab_size"))
    return residuals(pairs, w).crossJoin(words).select(
        F.lit(language).alias("language"),
        F.lit(path).cast("string").alias("path"),
        F.lit(vector_model).cast("string").alias("vector_model"),
        F.lit(backbone).cast("string").alias("backbone"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.array(F.lit(w.shape[0]), F.lit(w.shape[1])).cast("array<bigint>").alias("shape"),
        F.lit("orthogonal map found before training and kept frozen").alias("source"),
        F.col("anchors").alias("anchor_tokens"),
        F.lit(d).cast("bigint").alias("vector_dimension"),
        F.lit(d).cast("bigint").alias("model_dimension"),
        "vector_vocab_size",
        F.round("residual", 4).alias("residual_frobenius"),
        F.round("unaligned", 4).alias("unaligned_frobenius"),
        F.lit(orthogonality_error(w)).alias("orthogonality_max_abs_error"),
        F.lit("orthogonal Procrustes: minimise ||W X - Y||_F over W^T W = I").alias("objective"),
    )
