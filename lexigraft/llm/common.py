"""What the corpus operators share: table access, byte-bounded batches, the registry of their queries."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


#: Rows of a batch that goes to a Python worker: whole texts, some 2 kB each.
TEXT_ROWS = 500
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``TEXT_ROWS`` rows, unless the session says something else than its default.

    With the default of 10,000 a core holds several copies of 20 MB outside the heap, which it never gives back.
    """
    if spark.conf.get(_ROWS_SETTING) == "10000":
        spark.conf.set(_ROWS_SETTING, str(TEXT_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spans_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into consecutive ranges of about ``limit`` bytes; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, strings) of consecutive rows of about ``limit`` bytes; null reads as empty.

    Only one part at a time becomes Python strings, whatever the size of the batch.
    """
    sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
    for a, b in spans_by_bytes(sizes, limit):
        yield a, ["" if x is None else x for x in column.slice(a, b - a).to_pylist()]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """Where the C library can give free memory back to the system, its function for that."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Give unused memory back after a batch or task: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
