"""A training corpus from ``documents``: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraft.llm import bpe, langid, mixing, near_dedup, pii
from lexigraft.llm.common import small_batches
from lexigraft.llm.queries import BPE_FILE, held_out
from lexigraft.session import scratch_path

LEAST_SCORE = 0.5
SHARD_BYTES = 256 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep rows whose language is found with a posterior of at least ``LEAST_SCORE``."""
    small_batches(spark)
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    scored = docs.withColumn("__found", langid.predict(spark, F.col("text"), model))
    sure = (F.col("__found.lang") != langid.UNKNOWN) & (F.col("__found.score") >= LEAST_SCORE)
    return scored.filter(sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group, and of rows with equal ids one.

    Groups are by five-word shingles and a similarity of 0.8. Rows without an id are kept. Of equal ids
    with different contents the row with the smallest hash stays.
    """
    small_batches(spark)
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text"), shingle_words=5, percent=80).filter("kept and doc_id is not null")
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = named.withColumn("__row", F.row_number().over(first)).filter("__row = 1").select(*docs.columns)
    return one.union(docs.filter(F.col("doc_id").isNull()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data in its text replaced by marks and ``n_chars`` counted anew."""
    small_batches(spark)
    clean = docs.withColumn("text", pii.redact(spark, F.col("text"), pii.train(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, dealt out to shards of about ``SHARD_BYTES`` of text, or to
    one for each core if those are more; a shard is a partition. Which rows are taken does not depend on
    the shards. A null or empty text is never taken; repeated rows, and rows without an id, are rows like any other.
    """
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    return mixing.materialize(docs, mixing.mix(docs, shards), shards)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and the digest of the bytes they decode to, of each row.

    A null or empty text has no ids; repeated rows give repeated rows. A long text is cut for the merges only.
    """
    small_batches(spark)
    path, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern).select("doc_id", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what comes before is written to the shared folder stage by stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
