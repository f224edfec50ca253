"""Session-level helpers: shared folder, lineage cuts, input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so that is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lexigraft-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Needed where a value depends on the physical layout (sampled range bounds,
    partition-relative ids): a recomputed partition must not see another layout.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for write-then-read round trips."""
    return f"{shared_dir(spark).rstrip('/')}/lexigraft/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` only if the scan yields too few partitions.

    A large table arrives in far more splits than there are cores and is returned
    unchanged; a small single-file table would otherwise keep all work on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


#: What goes to a Python worker at a time; a worker holds several copies of a batch.
BATCH_BYTES = "4194304b"
_BYTES_SETTING, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``BATCH_BYTES``, unless the session says something else than its default."""
    if spark.conf.get(_BYTES_SETTING, _BYTES_DEFAULT) == _BYTES_DEFAULT:
        spark.conf.set(_BYTES_SETTING, BATCH_BYTES)
