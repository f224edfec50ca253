"""Small helpers for array expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column referenced from within a lambda may be inlined by the optimizer and
    then be computed once per element; a bound lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(arr: Column) -> Column:
    """``[0, 1, ..., n-1]``, empty for an empty or null array."""
    empty = F.array().cast("array<int>")
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - F.lit(1))).otherwise(empty)


def md5_bucket(text: Column) -> Column:
    """First 28 bits of md5 as a bigint; any engine with md5 can reproduce it."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def once(udf):
    """Keep the optimizer from copying or moving a Python function: it then runs once per row."""
    return udf.asNondeterministic()


def digest_heads(digests: list[bytes]) -> np.ndarray:
    """The first 28 bits of each digest."""
    return (np.frombuffer(b"".join(digests), ">u4")[::4] >> 4).astype(np.int64)


def as_arrays(sizes: np.ndarray, known: pa.Array, values: pa.Array) -> pa.Array:
    """Arrow lists of the given sizes over ``values``, null where they are not known."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pc.invert(known))


def md5_buckets(words: Column, prefix: str = "") -> Column:
    """``md5_bucket`` of ``prefix`` and each word of an array; equal words of an Arrow batch are hashed once."""

    @F.arrow_udf("array<bigint>")
    def hashed(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        start = hashlib.md5(prefix.encode(), usedforsecurity=False)
        digests = []
        for word in flat.dictionary.to_pylist():
            m = start.copy()
            m.update(word.encode())
            digests.append(m.digest())
        return as_arrays(sizes, lists.is_valid(), pa.array(digest_heads(digests)).take(flat.indices))

    return once(hashed)(words)


def numbered_md5_buckets(prefix: Column, counts: Column, *kept: Column | str) -> Column:
    """``md5_bucket`` of ``prefix`` followed by 0, 1, ... for ``counts`` numbers; nulls without a prefix.

    Rows wait for their buckets with all columns that are needed later. Large ones are named in ``kept``: they
    go along unread, so that their bytes bound how many rows wait.
    """

    @F.arrow_udf("array<bigint>")
    def hashed(prefixes: pa.Array, counts: pa.Array, *_: pa.Array) -> pa.Array:
        sizes = np.maximum(pc.fill_null(counts, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        numbers = [str(i).encode() for i in range(int(sizes.max(initial=0)))]
        digests = []
        for text, n in zip(prefixes.to_pylist(), sizes.tolist(), strict=True):
            start = hashlib.md5((text or "").encode(), usedforsecurity=False)
            for number in numbers[:n]:
                m = start.copy()
                m.update(number)
                digests.append(m.digest())
        missing = np.repeat(prefixes.is_null().to_numpy(zero_copy_only=False), sizes)
        return as_arrays(sizes, counts.is_valid(), pa.array(digest_heads(digests), mask=missing))

    return once(hashed)(prefix, counts, *kept)
