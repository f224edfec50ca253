"""Global ranks, exact seeded splits and skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

_LANE_BITS = 33  # monotonically_increasing_id keeps the row number below this bit
_PREFIX = 4      # md5 hex digits per bucket: 65,536 buckets whatever the table size


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Number the rows 0,1,2,... in a total order without a one-partition window.

    Range sort, freeze the layout, then add each partition's offset: the offsets
    come from one row per partition.
    """
    lane = "__lane"
    frozen = stable(df.orderBy(*order).withColumn(lane, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(lane), _LANE_BITS)
    local = F.col(lane).bitwiseAND(F.lit((1 << _LANE_BITS) - 1))
    sizes = frozen.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = sizes.select(
        "__part",
        (
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        ).alias("__offset"),
    ).fillna(0, ["__offset"])
    return (
        frozen.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__offset") + local + F.lit(start)).cast("bigint"))
        .drop("__part", "__offset", lane)
    )


def seeded_key(seed: int, *cols: Column) -> Column:
    """Pseudo-random order key: md5 of seed and row key, then the key itself against ties."""
    text = F.concat_ws("\u001f", *[c.cast("string") for c in cols])
    return F.concat(F.md5(F.concat(F.lit(f"{seed}|"), text)), F.lit("|"), text)


def _bucket_offsets(df: DataFrame, key: str) -> DataFrame:
    """(bucket, n, before) for the 16**_PREFIX fixed md5 buckets."""
    counts = df.groupBy(F.substring(key, 1, _PREFIX).alias("__bucket")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(
        Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("__before", F.coalesce(before, F.lit(0)))


def seeded_rank(df: DataFrame, seed: int, cols: list[str], name: str = "rank") -> DataFrame:
    """Dense 0-based rank in seeded random order; rows move once, by md5 bucket."""
    keyed = df.withColumn("__key", seeded_key(seed, *[F.col(c) for c in cols]))
    offsets = _bucket_offsets(keyed, "__key")
    local = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))
    return (
        keyed.withColumn("__bucket", F.substring("__key", 1, _PREFIX))
        .withColumn("__local", local)
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(name, (F.col("__before") + F.col("__local") - 1).cast("bigint"))
        .drop("__key", "__bucket", "__local", "__n", "__before")
    )


def split_80_10_10(df: DataFrame, seed: int, cols: list[str]) -> DataFrame:
    """Add ``split``: int(0.8 n) train, int(0.1 n) dev, the rest test, in seeded order.

    The two border keys are found from a fixed-size histogram plus the rows of the
    border buckets; labelling is then a comparison per row, so the rows themselves
    are never shuffled. ``cols`` must identify a row.
    """
    keyed = df.withColumn("__key", seeded_key(seed, *[F.col(c) for c in cols]))
    keys = keyed.select("__key")
    offsets = _bucket_offsets(keys, "__key")
    n = F.sum("__n").over(Window.partitionBy())
    sized = (
        offsets.withColumn("__train", F.floor(n * F.lit(0.8)).cast("bigint"))
        .withColumn("__dev", F.floor(n * F.lit(0.1)).cast("bigint"))
        .withColumn("__last1", F.col("__train") - 1)
        .withColumn("__last2", F.col("__train") + F.col("__dev") - 1)
    )

    def holds(col: str) -> Column:
        return (F.col(col) >= F.col("__before")) & (F.col(col) < F.col("__before") + F.col("__n"))

    border_buckets = sized.filter(holds("__last1") | holds("__last2"))
    ranked = (
        keys.withColumn("__bucket", F.substring("__key", 1, _PREFIX))
        .join(F.broadcast(border_buckets), "__bucket")
        .withColumn(
            "__rank",
            F.col("__before")
            + F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))
            - 1,
        )
    )
    borders = ranked.agg(
        F.max(F.when(F.col("__rank") == F.col("__last1"), F.col("__key"))).alias("__k1"),
        F.max(F.when(F.col("__rank") == F.col("__last2"), F.col("__key"))).alias("__k2"),
    )
    return (
        keyed.crossJoin(F.broadcast(borders))
        .withColumn(
            "split",
            F.when(F.col("__key") <= F.coalesce("__k1", F.lit("")), "train")
            .when(F.col("__key") <= F.coalesce("__k2", F.lit("")), "dev")
            .otherwise("test"),
        )
        .drop("__key", "__k1", "__k2")
    )


def lookup_join(probe: DataFrame, table: DataFrame, key: str, value: str, how: str = "inner") -> DataFrame:
    """Join ``probe`` with ``table(key, value)``, unique by ``key``.

    ``inner`` keeps the rows whose key the table has, also where its value is null; ``left`` keeps all.
    Keys that many probe rows share are left to the adaptive skew join, which splits their rows over
    tasks; it needs no look at the data beforehand and cannot change a result.
    """
    return probe.join(table.select(key, value), key, how)
