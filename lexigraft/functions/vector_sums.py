"""Elementwise vector sums that do not depend on the order of rows, and fail on a second width.

A double is cut into whole multiples of fixed units, 2**30, 1, 2**-30, ... 2**-120, of at most 30 binary
digits each. The parts are added up as 64-bit integers, which is exact in any order; carries are passed
on whenever sums meet. Only the finished sum is turned into a double again, so that equal rows give
equal bits however they are dealt out. Bits below 2**-120 are rounded off value by value; a cell that is
not finite makes its sum NaN; a cell of 2**59 or more fails the job.

Each Arrow batch adds up its own groups before the shuffle; a row that is alone in its batch travels as
it is. After it the sorted rows of a key pass by, with one sum held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = 2.0 ** np.arange(30, -121, -30)
_BITS = 30
_LARGEST = 2.0**59
_SLICE_BYTES = 8 << 20


def of_width(vec: Column, dim: int) -> Column:
    """``vec`` as it is; a vector of another width than ``dim`` fails the job."""
    message = F.concat(F.lit(f"IncompatibleDimension: expected vectors of width {dim}, found width "), F.size(vec).cast("string"))
    return F.when(vec.isNull() | (F.size(vec) == dim), vec).otherwise(F.raise_error(message))


def parts_of(values: np.ndarray) -> np.ndarray:
    """(rows, units + 1, cells): the multiples of each unit, and whether the cell is not finite."""
    bad = ~np.isfinite(values)
    rest = np.where(bad, 0.0, values)
    if rest.size and np.abs(rest).max() >= _LARGEST:
        raise ValueError("a cell is too large for an exact sum")
    out = np.empty((len(values), len(_UNITS) + 1, values.shape[1]), np.int64)
    for j, unit in enumerate(_UNITS):
        whole = np.rint(rest / unit)
        out[:, j] = whole
        rest = rest - whole * unit
    out[:, -1] = bad
    return out


def joined_parts(parts: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """The parts (units + 1, cells) that are not all zero, by the number of their unit; a part is told in the next
    smaller unit if sums of ``most`` cells, the last carry of them too, stay below 2**62. Totals stay the same."""
    out, held = [], np.zeros(parts.shape[1], np.int64)
    for j in range(len(_UNITS)):
        if int(np.abs(held).max(initial=0)) < (1 << (61 - _BITS)) // max(most, 1):
            held = (held << _BITS) + parts[j]
        else:
            out.append((j - 1, held))
            held = parts[j]
    return [(j, p) for j, p in [*out, (len(_UNITS) - 1, held), (len(_UNITS), parts[-1])] if p.any()]


def carried(sums: np.ndarray) -> np.ndarray:
    """The same totals with parts of at most 30 digits below the first unit: one form for each total."""
    sums = sums.copy()
    for j in range(len(_UNITS) - 1, 0, -1):
        over = (sums[:, j] + (1 << (_BITS - 1))) >> _BITS
        sums[:, j] -= over << _BITS
        sums[:, j - 1] += over
    return sums


def closed(sums: np.ndarray) -> np.ndarray:
    """The totals as doubles."""
    sums = carried(sums)
    total = np.zeros((len(sums), sums.shape[2]))
    for j in range(len(_UNITS) - 1, -1, -1):
        total += sums[:, j] * _UNITS[j]
    return np.where(sums[:, -1] > 0, np.nan, total)


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each row, equal where all columns are; nulls are equal."""
    codes = np.zeros(n, np.int64)
    for c in columns:
        encoded = pc.dictionary_encode(c, null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0]


def exact_sums(rows: DataFrame, keys: list[str], dim: int, vec: Column, weight: Column) -> DataFrame:
    """(keys, n, weight, sums): rows with a vector and a weight, their weights' sum, their weighted sum.

    A vector of another width than ``dim`` fails the job; a null cell adds nothing. A group without any
    such row has n = 0, no weight and zero sums. Without ``keys`` there is one row, also of an empty table.
    """
    cells = dim + 1
    key_names = [f"__k{i}" for i in range(len(keys))]
    picked = rows.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)],
        of_width(vec.cast("array<double>"), dim).alias("__vec"),
        weight.cast("double").alias("__weight"),
    )
    key_fields = picked.schema.fields[: len(keys)]
    sent = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType())), T.StructField("parts", T.BinaryType())])
    made = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def lists(values: np.ndarray, known: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.where(known, cells, 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(~known))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _SLICE_BYTES // (8 * cells * (len(_UNITS) + 1)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                columns = batch.columns[: len(keys)]
                codes = _codes(columns, batch.num_rows)
                vectors, weights = batch.column(len(keys)), batch.column(len(keys) + 1)
                known = pc.and_(vectors.is_valid(), weights.is_valid()).to_numpy(zero_copy_only=False)
                flat = pc.fill_null(vectors.filter(pa.array(known)).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
                w = weights.to_numpy(zero_copy_only=False)[known][:, None]
                values = np.concatenate([w, flat * w], axis=1)
                order = np.argsort(codes, kind="stable")
                starts = _starts(codes[order])
                place = np.cumsum(known) - 1
                n = np.add.reduceat(known[order].astype(np.int64), starts)
                raw, packed = np.zeros((0, cells)), [None] * len(starts)
                sorted_rows = place[order][known[order]]
                alone = n == 1
                ends = np.cumsum(n)
                raw = values[sorted_rows[ends[alone] - 1]]
                for g in np.nonzero(n > 1)[0].tolist():
                    packed[g] = parts_of(values[sorted_rows[ends[g] - n[g] : ends[g]]]).sum(axis=0).tobytes()
                first = pa.array(order[starts])
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(first) for c in columns], pa.array(n), lists(raw, alone), pa.array(packed, pa.binary())], names=[*key_names, "n", "row", "parts"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(_UNITS) + 1, cells)
        step = max(1, _SLICE_BYTES // (8 * shape[0] * shape[1]))
        held: tuple[list[pa.Array], int, np.ndarray] | None = None

        def done(columns: list[pa.Array], n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            total = closed(sums)
            weights = pa.array(total[:, 0], mask=n == 0)
            ends = pa.array(np.arange(len(n) + 1) * dim, pa.int32())
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(n), weights, pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(total[:, 1:]).ravel()))], names=[*key_names, "n", "weight", "sums"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                parts = np.zeros((some.num_rows, *shape), np.int64)
                rows_, packed = some.column(len(keys) + 1), some.column(len(keys) + 2)
                is_row = rows_.is_valid().to_numpy(zero_copy_only=False)
                if is_row.any():
                    parts[is_row] = parts_of(rows_.flatten().to_numpy(zero_copy_only=False).reshape(-1, cells))
                for i in np.nonzero(packed.is_valid().to_numpy(zero_copy_only=False))[0].tolist():
                    parts[i] = np.frombuffer(packed[i].as_buffer(), np.int64).reshape(shape)
                columns = some.columns[: len(keys)]
                starts = _starts(_codes(columns, some.num_rows))
                sums = carried(np.add.reduceat(parts, starts, axis=0))
                n = np.add.reduceat(some.column(len(keys)).to_numpy(zero_copy_only=False), starts)
                firsts = [c.take(pa.array(starts)) for c in columns]
                if held is not None:
                    if all(a.equals(b.slice(0, 1)) for a, b in zip(held[0], firsts, strict=True)):
                        n[0] += held[1]
                        sums[:1] = carried(sums[:1] + held[2])
                    else:
                        yield done(held[0], np.array([held[1]]), held[2])
                if len(starts) > 1:
                    yield done([c.slice(0, len(starts) - 1) for c in firsts], n[:-1], sums[:-1])
                # copies, so that the batch can go
                held = [pa.concat_arrays([c.slice(len(starts) - 1, 1)]) for c in firsts], int(n[-1]), sums[-1:].copy()
        if held is not None:
            yield done(held[0], np.array([held[1]]), held[2])

    parts = picked.mapInArrow(partial, sent)
    if not keys:
        one = parts.repartition(1).mapInArrow(merge, made)
        zeros = F.array_repeat(F.lit(0.0), dim)
        filled = rows.sparkSession.range(1).join(F.broadcast(one), F.lit(True), "left")
        return filled.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "weight", F.coalesce("sums", zeros).alias("sums"))
    merged = parts.repartition(*key_names).sortWithinPartitions(*key_names).mapInArrow(merge, made)
    return merged.select(*[F.col(n).alias(k) for k, n in zip(keys, key_names, strict=True)], "n", "weight", "sums")
