"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else reads as a blank; the n-grams of ``ORDERS`` characters that
hold a letter are hashed to ``BUCKETS`` buckets. Training counts every labelled row: each task
adds up a vector of buckets per language, Spark sums these, and the driver gets one number per
language and bucket, which no corpus makes larger. The matrix of log probabilities is broadcast.
A batch is scored as a sparse matrix of n-gram occurrences times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, text_parts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
BATCH_BYTES = 1 << 18
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its row, has the row a letter?); rows in order within each order n."""
    points = np.frombuffer("".join(f"\n{t}\n" for t in (x.lower() for x in texts)).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = _letters()[points]
    mixed = np.where(letter, points + np.uint32(1), np.uint32(0)) * _MULTIPLIERS[3]
    mixed ^= mixed >> np.uint32(15)
    buckets, rows = [], []
    for n in ORDERS:
        m = points.size - n + 1
        if m <= 0:
            continue
        key, inside = np.full(m, n, np.uint32), np.zeros(m, np.bool_)
        for k in range(n):
            key += mixed[k : k + m] * _MULTIPLIERS[k]
            inside |= letter[k : k + m]
        key ^= key >> np.uint32(16)
        key *= np.uint32(0x7FEB352D)
        use = inside & (row[:m] == row[n - 1 :])
        buckets.append((key[use] >> np.uint32(16)) & np.uint32(BUCKETS - 1))
        rows.append(row[:m][use])
    has = np.zeros(len(texts), np.bool_)
    has[row[letter]] = True
    return np.concatenate(buckets), np.concatenate(rows), has


@dataclass(frozen=True)
class Model:
    """Languages in order of their names; log_prob has a row per bucket, a column per language."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text, the first by name among equals, and its posterior."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bucket, row, has = ngrams(texts)
        total = np.tile(self.log_prior, (len(texts), 1))
        for j in range(len(self.languages)):
            total[:, j] += np.bincount(row, weights=self.log_prob[j][bucket], minlength=len(texts))
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], score


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """Count the n-grams of every row that has a text and a label.

    Without such rows the model knows no language. Repeated rows count again. A task holds a vector
    of ``BUCKETS`` numbers for each language it meets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, texts in text_parts(batch.column(0), BATCH_BYTES):
                own = labels[a : a + len(texts)]
                names = sorted(set(own))
                at = np.array([names.index(x) for x in own], np.int64)
                bucket, row, _ = ngrams(texts)
                got = np.bincount(at[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    seen[name] = seen.get(name, 0) + got[k]
                    rows[name] = rows.get(name, 0) + own.count(name)
        for name, counts in seen.items():
            full = np.nonzero(counts)[0]
            bucket = pa.array(np.append(full, -1).astype(np.int32))
            n = pa.array(np.append(counts[full], rows[name]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), bucket, n], ["label", "bucket", "n"])
        release()

    labelled = docs.select(F.col(text_col).cast("string"), F.col(label_col).cast("string")).filter(
        F.col(text_col).isNotNull() & F.col(label_col).isNotNull()
    )
    sums = labelled.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label, bucket, n = sums.column("label").to_pylist(), sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    names = sorted(set(label))
    at = np.array([names.index(x) for x in label], np.int64)
    counts = np.zeros((len(names), BUCKETS))
    rows = np.zeros(len(names))
    is_row = bucket < 0
    counts[at[~is_row], bucket[~is_row]] = n[~is_row]
    rows[at[is_row]] = n[is_row]
    smooth = counts + SMOOTHING
    return Model(names, np.log(rows / max(1.0, rows.sum())), np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def predict(spark: SparkSession, text: Column, model: Model) -> Column:
    """struct(lang string, score double); ``und`` with score 0 for null and for texts without a letter."""
    shared: Broadcast[Model] = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def score(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores = [np.zeros(0)]
        for _, part in text_parts(texts, BATCH_BYTES):
            lang, posterior = shared.value.score(part)
            langs += lang
            scores.append(posterior)
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    return score(text.cast("string"))
