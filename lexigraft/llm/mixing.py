"""Mixing sources to target weights: exact quotas, a hypergeometric splitting tree, permuted blocks.

1. A document's size is its number of words. Sources in code point order, null last, weigh
   ``WEIGHTS`` in turn and share all words by weight; a target stops at ``MOST`` times its source's
   size, and the excess is shared again by weight. That is a water level, found by window sums.
2. Each source is put in a seeded random order of its documents, by a hash of id, text and all other
   columns, so that only equal rows tie. A document's place is the number of words before it, from one
   sort of (source, hash, row) without texts and the sums of its partitions; neither a large source
   nor many equal rows meet in a task. The stream of a source is that order, repeated ``MOST`` times.
3. The stream up to the target is cut into blocks of equal words. The sources' block counts are the
   colours of an urn; a tree splits it over the output shards: at each node the left half's share of
   every source is a multivariate hypergeometric draw, the right half has the rest. A shard's
   composition is thus that of a draw without replacement, and the shards together use up each quota
   exactly. Draws are seeded by node: the driver makes the top of the tree, tasks the rest.
4. Each source's blocks are permuted and dealt to the shards by those counts. A copy of a document is
   taken if the block in which its middle lies has been dealt, and goes to that block's shard; the
   documents of a shard are put in random order inside it.

Everything random comes from hashes of the seed, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import scratch_path, stable
from .common import WORD

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
BLOCKS_PER_SHARD = 64
#: Sources up to this number are sent to all tasks; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 1 << 16
#: Sources with a quota that the splitting tree takes, 16 bytes each on the driver.
TREE_SOURCES = 1 << 22
#: Shards below a node that a task works off.
TASK_SHARDS = 256
#: Parts of a source's blocks that are permuted one by one.
PARTS = 1024
_LANE_BITS = 33  # monotonically_increasing_id keeps the row number below this bit


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from (source, size); one row per source, null included."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sid"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = by_source.withColumn("sid", F.row_number().over(in_order) - 1).withColumn("weight", weight)
    cap = F.lit(MOST) * F.col("source_size")
    level = Window.orderBy("full_at", "sid")
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    risen = (
        weighed.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", (total - before).cast("double") / rest)
        # the level holds from the first source that it does not fill
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(Window.partitionBy()))
    )
    share = F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("weight")
    return risen.select("source", "sid", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _halves(low: int, high: int, colours: np.ndarray, counts: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two halves of a node of the splitting tree; a colour of which nothing is left goes no further."""
    middle = (low + high) // 2
    draw = int(counts.sum()) * (middle - low) // (high - low)
    rng = np.random.Generator(np.random.PCG64([seed, low, high]))
    left = rng.multivariate_hypergeometric(counts, draw, method="marginals")
    right = counts - left
    return [(low, middle, colours[left > 0], left[left > 0]), (middle, high, colours[right > 0], right[right > 0])]


def _leaves(stack: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    while stack:
        low, high, colours, counts = stack.pop()
        if high - low == 1 or not counts.size:
            out += [(int(c), low, int(n)) for c, n in zip(colours, counts, strict=True)]
        else:
            stack += _halves(low, high, colours, counts, seed)
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(colour, shard, count) for each colour in each shard.

    Every shard gets its share of the blocks to within one, every colour is used up exactly. Only the
    colours that are left at a node go down, so a level costs at most the number of blocks.
    """
    return _leaves([(0, shards, np.nonzero(quotas)[0], quotas[quotas > 0].astype(np.int64))], seed)


def _tree_top(quotas: np.ndarray, shards: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, colours, counts) of the highest nodes of the tree with at most ``TASK_SHARDS`` shards."""
    out, stack = [], [(0, shards, np.nonzero(quotas)[0], quotas[quotas > 0].astype(np.int64))]
    while stack:
        low, high, colours, counts = stack.pop()
        if high - low <= TASK_SHARDS or not counts.size:
            out.append((low, high, colours, counts))
        else:
            stack += _halves(low, high, colours, counts, seed)
    return out


def deal(spark, quotas: np.ndarray, shards: int, seed: int = SEED) -> DataFrame:
    """(colour, shard, n): the leaves of the splitting tree, the same as ``splitting_tree`` has them."""

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, colours, counts in frame.itertuples(index=False):
                leaves = _leaves([(low, high, np.array(colours), np.array(counts))], seed)
                yield pd.DataFrame(leaves, columns=["colour", "shard", "n"])

    top = [(low, high, colours.tolist(), counts.tolist()) for low, high, colours, counts in _tree_top(quotas, shards, seed)]
    nodes = spark.createDataFrame(top, "low int, high int, colours array<bigint>, counts array<bigint>")
    return nodes.repartition(max(1, min(len(top), 1024)), "low").mapInPandas(finish, "colour int, shard int, n long")


def row_key(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED) -> Column:
    """The seeded hash by which rows are ordered: of id and text, then of all columns.

    Maps and variants have no hash; rows that differ in such a column alone count as equal.
    """
    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    text = F.concat(F.lit(f"{seed}|"), known(id_col), F.lit("|"), F.md5(known(text_col).cast("binary")))
    rest = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return F.concat(F.md5(text.cast("binary")), F.hex(F.xxhash64(*rest)))


def mix(
    docs: DataFrame, shards: int, carry: list[str] | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id"
) -> DataFrame:
    """One row for each document and each copy that the mix takes, or one without a copy if it takes none.

    Columns: ``row`` (struct of the columns ``carry`` of ``docs``, the id by default), row_id (one number
    a row of ``docs``), key (``row_key``), size, source_size, target, start (words before it in its
    source), copy (0, 1, ...; null if left out), shard, place (random order inside a shard). A null text
    has size 0; empty documents are never taken. Repeated rows and rows without an id are rows like any
    other; which of several equal rows is taken makes no difference. An empty table gives no rows.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, f"mix-{name}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    sized = written(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in (carry or [id_col])]).alias("row"),
            row_key(docs, text_col, id_col).alias("key"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "sizes",
    )
    sources = written(source_targets(sized.select("source", "size")), "sources")
    total = sources.agg(F.sum("target"), F.count("*"), F.count(F.when(F.col("target") > 0, 1))).first()
    block_words = max(1, int(total[0] or 0) // (BLOCKS_PER_SHARD * shards))
    near = F.broadcast if total[1] <= BROADCAST_SOURCES else lambda df: df
    if total[2] > TREE_SOURCES:
        raise ValueError(f"{total[2]} sources to mix; the splitting tree takes {TREE_SOURCES}")
    # every source has blocks of its own size, so that they end at its target
    blocks = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.ceil(F.col("target") / F.lit(block_words)))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("blocks", blocks)

    # places: one sort, then sums inside its partitions
    known = sized.join(near(sources.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    lane = F.col("__lane")
    ordered = stable(known.orderBy("sid", "key", "row_id").withColumn("__lane", F.monotonically_increasing_id())).withColumn("part", F.shiftright(lane, _LANE_BITS))
    sums = ordered.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("sid", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "part").orderBy(lane).rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        ordered.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(offsets, ["sid", "part"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("before", "inside", "part", "__lane")
    )

    homes = _homes(sources.select("sid", "blocks").filter("blocks > 0"), shards)
    # as many rows as blocks: about BLOCKS_PER_SHARD a shard and one a source
    homes = F.broadcast(homes) if shards * BLOCKS_PER_SHARD + total[2] <= 1 << 17 else homes
    middle = F.col("__copy") * F.col("source_size") + F.col("start") + F.col("size") / F.lit(2)
    copies = placed.filter("size > 0 and blocks > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    taken = (
        copies.withColumn("block", F.floor(middle * F.col("blocks") / F.col("target")).cast("long"))
        .join(homes, ["sid", "block"])
        .select("row_id", F.col("__copy").alias("copy"), "shard")
    )
    columns = ["row", "row_id", "key", "size", "source_size", "target", "start"]
    return placed.select(*columns).join(taken, "row_id", "left").select(
        *columns, "copy", "shard", F.when(F.col("copy").isNotNull(), F.xxhash64(F.lit(SEED), "key", "copy")).alias("place")
    )


def _homes(wanted: DataFrame, shards: int) -> DataFrame:
    """(sid, block, shard): the blocks of each source, permuted and dealt out by the tree."""
    spark = wanted.sparkSession
    counts = sorted((r["sid"], r["blocks"]) for r in wanted.collect())
    if not counts:
        return spark.createDataFrame([], "sid int, block long, shard int")
    names = spark.createDataFrame([(i, sid) for i, (sid, _) in enumerate(counts)], "colour int, sid int")
    dealt = deal(spark, np.array([n for _, n in counts], np.int64), shards).join(names, "colour")
    high = F.sum("n").over(Window.partitionBy("sid").orderBy("shard"))
    # a shard's share of a source is a range of ranks: it is unfolded, so that the join has equal keys
    ranges = dealt.select("sid", "shard", "n", high.alias("high"))
    ranks = ranges.select("sid", "shard", F.explode(F.sequence(F.col("high") - F.col("n"), F.col("high") - 1)).alias("rank"))
    # ranks are counted part by part of the hash, so that the blocks of one source are many small windows
    mixed = wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("h", F.xxhash64(F.lit(SEED), "sid", "block"))
    mixed = mixed.withColumn("part", F.pmod("h", F.lit(PARTS)))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = mixed.groupBy("sid", "part").agg(F.count("*").alias("n")).select("sid", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("sid", "part").orderBy("h", "block")) - 1
    ranked = mixed.withColumn("inside", inside).join(parts, ["sid", "part"]).select("sid", "block", (F.col("before") + F.col("inside")).alias("rank"))
    return ranked.join(ranks, ["sid", "rank"]).select("sid", "block", "shard")


def materialize(docs: DataFrame, mixed: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them, a partition for each shard, in random order inside.

    Equal rows stand for each other, so a text moves once to meet its copies and once to its shards.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.select(F.struct(*columns).alias("__row"), row_key(docs, text_col, id_col).alias("key")).dropDuplicates(["key"])
    taken = mixed.filter(F.col("copy").isNotNull()).select("key", "shard", "place")
    return one.join(taken, "key").repartitionById(shards, "shard").sortWithinPartitions("place", "key").select("__row.*")
