"""Adaptation corpora: encoding, masking, batching, padding and loss logs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import md5_bucket
from ..functions.text import tokens
from ..session import scratch_path
from .keys import lookup_join, seeded_rank

IGNORED = -100
CHUNK_TOKENS = 1 << 22        # tokens of the lines that are joined and coded together, about
MAX_SHIPPED_BYTES = 64 << 20  # checked size up to which a vocabulary goes to every task


def encode(
    lines: DataFrame,
    vocab: DataFrame,
    unk_id: int,
    max_length: int,
    keys: list[str],
    text: str = "text",
    shipped_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """(keys, ids): ids of the first ``max_length`` whitespace tokens of each line.

    A token listed twice has its smallest id. A vocabulary of up to ``shipped_bytes`` is sent to the
    tasks and looked up in Arrow batches: lines stay where they are. A larger one is joined with
    the tokens, with the same result.
    """
    words = lines.select(*keys, F.slice(tokens(F.col(text)), 1, max_length).alias("words"))
    vocab = vocab.filter("token is not null and id is not null").groupBy("token").agg(F.min("id").alias("id"))
    size = vocab.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
    if size > shipped_bytes:
        return _encode_by_join(words, vocab, unk_id, keys)

    known = vocab.toArrow()
    shipped = lines.sparkSession.sparkContext.broadcast(
        (known["token"].combine_chunks(), known["id"].to_numpy().astype(np.int64))
    )
    schema = words.select(*keys, F.array().cast("array<bigint>").alias("ids")).schema

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = shipped.value
        index = dict(zip(names.to_pylist(), ids.tolist(), strict=True))  # once a task
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("words"))
            flat = col.flatten().dictionary_encode()  # each different word of a batch is looked up once
            coded = np.array([index.get(w, unk_id) for w in flat.dictionary.to_pylist()] or [unk_id], dtype=np.int64)
            coded = coded[flat.indices.fill_null(0).to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy())])
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(coded))
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, out], names=[*keys, "ids"])

    return words.mapInArrow(look_up, schema)


def _encode_by_join(words: DataFrame, vocab: DataFrame, unk_id: int, keys: list[str]) -> DataFrame:
    """Rows of equal keys are one line, their tokens by position; they are joined token by token, all others by chunks."""
    repeated = words.groupBy(*keys).agg(F.count("*").alias("__rows")).filter("__rows > 1").select(*[F.col(k).alias(f"__{k}") for k in keys])
    if repeated.isEmpty():
        return _encode_chunks(words, vocab, unk_id, keys)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    once, more = (words.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    return _encode_chunks(once, vocab, unk_id, keys).unionByName(_encode_tokens(more, vocab, unk_id, keys))


def _encode_tokens(words: DataFrame, vocab: DataFrame, unk_id: int, keys: list[str]) -> DataFrame:
    probe = words.select(*keys, F.posexplode_outer("words").alias("pos", "token"))
    coded = lookup_join(probe, vocab, "token", "id", "left")
    value = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(unk_id)).alias("id")))
    return coded.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v")).select(
        *keys, F.transform("v", lambda x: x["id"].cast("bigint")).alias("ids")
    )


def _encode_chunks(words: DataFrame, vocab: DataFrame, unk_id: int, keys: list[str]) -> DataFrame:
    """Each different token of a chunk of lines is joined once; its id then meets the chunk's lines, which hold token numbers.

    A chunk is what a task reads in a row, up to ``CHUNK_TOKENS`` tokens or one line. Chunks are written once, as both the
    tokens and the lines are read from them.
    """
    spark = words.sparkSession

    def chunk(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in table["words"].chunks])
        flat = pa.concat_arrays([c.flatten() for c in table["words"].chunks]).dictionary_encode()
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat.indices)
        first = np.arange(len(table)) == 0
        tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(len(table), len(flat.dictionary))), pa.int32()), flat.dictionary, mask=pa.array(~first))
        columns = [pa.array(np.full(len(table), number)), *(table[k].combine_chunks() for k in keys), codes, tokens]
        return pa.RecordBatch.from_arrays(columns, names=["__chunk", *keys, "__codes", "__tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            some = len(batch.column(batch.schema.get_field_index("words")).flatten())
            if held and n + some > CHUNK_TOKENS:
                yield chunk(held, number)
                held, n, number = [], 0, number + 1
            if batch.num_rows:
                held.append(batch)
                n += some
        if held:
            yield chunk(held, number)

    at = scratch_path(spark, "chunks")
    number, codes, tokens = (F.lit(None).cast(kind) for kind in ("bigint", "array<int>", "array<string>"))
    schema = words.select(number.alias("__chunk"), *keys, codes.alias("__codes"), tokens.alias("__tokens")).schema
    words.select(*keys, "words").mapInArrow(chunks, schema).write.option("compression", "zstd").parquet(at)
    written = spark.read.schema(schema).parquet(at)
    asked = written.filter("__tokens is not null").select(F.col("__chunk").alias("__asked"), F.posexplode("__tokens").alias("__code", "token"))
    known = lookup_join(asked, vocab, "token", "id").select("__asked", "__code", F.col("id").cast("bigint").alias("id"))
    out = words.select(*keys, F.array().cast("array<bigint>").alias("ids")).schema

    def look_up(lines: pa.Table, known: pa.Table) -> pa.Table:
        codes = lines["__codes"].combine_chunks()
        flat = codes.flatten().to_numpy()
        ids = np.full(int(flat.max(initial=-1)) + 1, unk_id, np.int64)
        ids[known["__code"].to_numpy()] = known["id"].to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy())])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[flat]))
        return pa.Table.from_arrays([*(lines[k] for k in keys), lists], names=[*keys, "ids"])

    lines = written.select("__chunk", *keys, "__codes")
    return lines.groupBy("__chunk").cogroup(known.groupBy("__asked")).applyInArrow(look_up, out)


def masked_copy(
    encoded: DataFrame,
    keys: list[str],
    mask_id: int,
    vocab_size: int,
    special_below: int = 0,
    seed: int = 42,
    epoch: int = 0,
    probability: float = 0.15,
) -> DataFrame:
    """Add ``input_ids`` and ``labels`` for masked-token prediction.

    Each position draws three numbers from (seed, epoch, row key, position): whether it
    is chosen, what happens to it (80 % mask, 10 % random id, 10 % kept) and the random
    id. Ids below ``special_below`` are never chosen. The draw does not depend on layout.
    """
    row_key = F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in keys])

    def draw(name: str, i: Column) -> Column:
        return md5_bucket(F.concat_ws("-", F.lit(name), row_key, i.cast("string"))) % 10000

    def cell(current: Column, i: Column) -> Column:
        chosen = (current >= special_below) & (draw("pick", i) < int(probability * 10000))
        fate = draw("fate", i)
        token = (
            F.when(~chosen | (fate >= 9000), current)
            .when(fate < 8000, F.lit(mask_id))
            .otherwise(special_below + draw("word", i) % (vocab_size - special_below))
        )
        return F.struct(
            token.cast("bigint").alias("token"),
            F.when(chosen, current).otherwise(F.lit(IGNORED)).cast("bigint").alias("label"),
        )

    return (
        encoded.withColumn("__cells", F.transform("ids", cell))
        .withColumn("input_ids", F.transform("__cells", lambda c: c["token"]))
        .withColumn("labels", F.transform("__cells", lambda c: c["label"]))
        .drop("__cells")
    )


def batches(rows: DataFrame, keys: list[str], batch_size: int, seed: int) -> DataFrame:
    """Add ``batch`` and ``slot``: seeded shuffle cut into fixed-size batches."""
    ranked = seeded_rank(rows, seed, keys, "__rank")
    return (
        ranked.withColumn("batch", F.floor(F.col("__rank") / batch_size).cast("bigint"))
        .withColumn("slot", (F.col("__rank") % batch_size).cast("bigint"))
        .drop("__rank")
    )


def pad_batches(batched: DataFrame, pad_id: int) -> DataFrame:
    """Pad ``ids`` to the longest row of the batch and add ``attention_mask``."""
    from pyspark.sql import Window

    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    gap = F.col("__longest") - F.size("ids")
    return (
        batched.withColumn("__longest", longest)
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), gap)))
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("bigint"), gap)))
        .drop("__longest")
    )


def epoch_losses(steps: DataFrame) -> DataFrame:
    """(epoch, n_batches, avg_loss, last_mlm, last_reg) of a step log(epoch, step, loss, mlm, reg)."""
    return steps.groupBy("epoch").agg(
        F.count("*").alias("n_batches"),
        F.avg("loss").alias("avg_loss"),
        F.max_by("mlm", "step").alias("last_mlm"),
        F.max_by("reg", "step").alias("last_reg"),
    )
