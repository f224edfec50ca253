"""Vector expressions on ``array<float|double>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import once, positions

DOUBLES = T.ArrayType(T.DoubleType())
_CELLS = 1 << 14    # normals made at a time
_HASHES = 1 << 16   # n-grams of which the different ones are drawn at a time


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def weighted_total(a: Column) -> Column:
    """Sum of (position + 1) * value: a cheap order-sensitive fingerprint."""
    return F.aggregate(
        F.zip_with(a, positions(a), lambda v, i: v.cast("double") * (i + 1)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def _mix(z: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, elementwise on uint64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def normals(base: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Box-Muller normals from a hash per row and a constant per dimension."""
    with np.errstate(over="ignore"):
        a = _mix(base + lane)
        b = _mix(a ^ np.uint64(0xD1B54A32D192ED03))
    u1 = ((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    u2 = (b >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def lanes(dim: int) -> np.ndarray:
    """One constant per dimension, so that equal hashes differ by dimension."""
    return np.arange(1, dim + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)


def normal_rows(hashes: np.ndarray, dim: int) -> np.ndarray:
    """A row of normals for each hash, made so many rows at a time that all steps stay in a core's cache."""
    out, lane = np.empty((len(hashes), dim)), lanes(dim)
    step = max(1, _CELLS // dim)
    for at in range(0, len(hashes), step):
        out[at : at + step] = normals(hashes[at : at + step, None], lane)
    return out


def as_lists(known: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Arrow lists with ``rows`` at the known positions and null elsewhere."""
    ends = np.concatenate([[0], np.cumsum(np.where(known, rows.shape[1], 0))])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()), mask=pa.array(~known)
    )


def gaussian(key: Column, dim: int, seed: int) -> Column:
    """Standard normal vector, a pure function of (seed, key, dim).

    The key is hashed on the JVM; the task only turns 64-bit hashes into normals.
    """

    @F.arrow_udf(DOUBLES)
    def draw(hashes: pa.Array) -> pa.Array:
        base = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return as_lists(np.ones(len(base), dtype=bool), normal_rows(base, dim))

    return once(draw)(F.xxhash64(F.lit(seed), key))


def with_gaussian_ngram_mean(
    df: DataFrame, ngrams: Column, name: str, dim: int, scale: float, seed: int
) -> DataFrame:
    """Add the mean of the Gaussian vectors of an n-gram array, without joining a vector table.

    Every n-gram vector is a pure function of (seed, n-gram, dim), so drawing it where
    it is needed replaces a shuffle of vectors. Null or empty input gives null.
    """

    @F.arrow_udf(DOUBLES)
    def mean(hashes: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False)
        flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        filled = sizes > 0
        counts = sizes[filled]
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        out = np.empty((len(counts), dim))
        at = 0
        while at < len(counts):
            # an n-gram that several rows have is drawn once for all of them
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + _HASHES, side="right")) - 1)
            different, where = np.unique(flat[starts[at] : starts[end]], return_inverse=True)
            drawn = normal_rows(different, dim)
            for i in range(at, end, 128):  # bounds the n-gram rows held at once
                j = min(end, i + 128)
                rows = drawn[where[starts[i] - starts[at] : starts[j] - starts[at]]]
                out[i:j] = np.add.reduceat(rows, starts[i:j] - starts[i], axis=0) * (scale / counts[i:j, None])
            at = end
        return as_lists(filled, out)

    # the one-element explode keeps the lambda out of the Python function's argument
    hashes = F.transform(ngrams, lambda g: F.xxhash64(F.lit(seed), g))
    return (
        df.select("*", F.explode(F.array(hashes)).alias("__hashes"))
        .withColumn(name, once(mean)("__hashes"))
        .drop("__hashes")
    )


def apply_matrix(vec: Column, matrix: np.ndarray) -> Column:
    """``matrix @ vec`` per row in Arrow batches; null vectors stay null."""

    @F.arrow_udf(DOUBLES)
    def multiply(batch: pa.Array) -> pa.Array:
        known = batch.is_valid().to_numpy(zero_copy_only=False)
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return as_lists(known, flat.reshape(known.sum(), matrix.shape[1]) @ matrix.T)

    return once(multiply)(vec)
