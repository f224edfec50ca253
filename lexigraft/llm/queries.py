"""The registered queries over ``documents``: each applies one operator to the whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, media, mixing, near_dedup, oracle, packing, periodic_runs, pii, prefix_trie, quality, secrets, spans, token_counts
from .common import QUERIES, SQL, documents, query, small_batches  # noqa: F401

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
SECRETS_FILE = "byte_bpe_50k.tiktoken"
COUNT_FILE = "piece_bpe_32k.model"
PACK_FILE = "word_bpe_49k.json"
TOKEN_LIMIT = 4096


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of their id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", pii.find_personal_data(spark, F.col("text"), pii.train(docs)).alias("found"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("found"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans.joined(spans.base_only(F.col("found")), pii.KINDS), 256).alias("base_sha256"),
        spans.joined(F.col("found"), pii.KINDS).alias("spans"),
    )


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predict(spark, F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    counted = documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts.token_count(text, public_tokenizers.path(COUNT_FILE)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op6_media_columns")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(documents(spark, sf_dir)).withColumn("back", media.read(F.col("media")))
    payload = F.col("back.payload")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("back.hash")).alias("feature"),
    )


@query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select(
        "doc_id", secrets.find_secrets(F.col("text"), public_tokenizers.path(SECRETS_FILE), public_tokenizers.PATTERN).alias("found")
    )
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans.joined(spans.base_only(F.col("found")), secrets.KINDS), 256).alias("base_sha256"),
        spans.joined(F.col("found"), secrets.KINDS).alias("spans"),
    )


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle_words=2, percent=80)


MIX_SHARDS = 64


@query(
    "op9_mixing",
    r"""
    with sized as (
      select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
             md5('17|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as k
      from documents),
    by_source as (
      select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as sid
      from sized group by source),
    weighed as (select *, case sid % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from by_source),
    risen as (
      select *, cap::double / weight as full_at,
             (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, sid rows between unbounded preceding and 1 preceding), 0))::double
               / sum(weight) over (order by cap::double / weight, sid rows between current row and unbounded following) as lvl
      from weighed),
    target as (
      select source, source_size,
             least(cap::double, coalesce((select lvl from risen where lvl <= full_at order by full_at, sid limit 1), 0) * weight) as target
      from risen),
    placed as (
      select doc_id, size, source_size, target,
             coalesce(sum(size) over (partition by s.source order by k rows between unbounded preceding and 1 preceding), 0) as start
      from sized s join target t on s.source is not distinct from t.source)
    select doc_id, size, source_size, target,
           case when size = 0 then 0 else size * greatest(0, least(3, ceil((target - start - size / 2) / source_size)::bigint)) end as taken
    from placed
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), MIX_SHARDS, carry=["doc_id"])
    found = mixed.groupBy("row_id").agg(
        *[F.first(c).alias(c) for c in ("row", "size", "source_size", "target")], F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(0)).alias("taken")
    )
    return found.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op7_quality_rules", oracle.QUALITY)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    counted = quality.measure(docs.select("doc_id", "text"))
    kept = F.when(quality.base_failed(), False).otherwise(quality.cascade(counted, quality.order_rules(docs)))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.base_failed().alias("base_failed"), kept.alias("kept"),
    )


@query("op10_licenses", oracle.LICENSES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) with each conversation's first turns, up to 8, taken from the one whose id is the next lower multiple of five."""
    by_hash = F.crc32(F.col("cid").cast("string").cast("binary")) % 9
    sizes = numbered.groupBy("cid").agg(F.max("place").alias("n"))
    heads = sizes.select(F.col("cid").alias("base"), F.col("n").alias("n_base"))
    based = sizes.withColumn("base", F.col("cid") - F.col("cid") % 5).withColumn("h", by_hash).join(heads, "base", "left")
    known = prefix_trie.written(based.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))), "rebuilt")
    first = numbered.filter("place <= 8 and cid % 5 = 0").withColumnRenamed("cid", "base")
    taken = known.filter("k > 0").select("cid", "base", "k").join(first, "base").filter("place <= k")
    own = numbered.filter(F.col("place") > by_hash).join(known.select("cid", "h", "k"), "cid").withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    columns = ["cid", "place", "letter", "bytes"]
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return taken.select(*columns).unionByName(own.select(*columns)), known.select("cid", length.alias("length"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = prefix_trie.written(prefix_trie.number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "numbered")
    return prefix_trie.prefix_nodes(*rebuilt(numbered)).drop("key")


@query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.encode_pieces(documents(spark, sf_dir), public_tokenizers.path(PACK_FILE))
    pieces = packing.with_piece_ids(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pieces.join(packing.pack(pieces), "piece_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset")
    )


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by a checksum of its id, with all from some place on made periodic."""
    if doc_id is None or not words:
        return words
    tenth, g = divmod(zlib.crc32(str(doc_id).encode()), 10)[::-1]
    if tenth:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(documents(spark, sf_dir), rewrite=repeated_tail)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = found.withColumn("best", F.array_max(ranked)).withColumn("listed", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.expr("(1000 * best.length) div (-best.short)").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
