"""Run records, dataset and vector manifests, vector tables, checksums, reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import versions

SCORES = "struct<precision:double,recall:double,f1:double,exact_match:double>"
PROJECTION = (
    "struct<kind:string,source:string,author_supplied:boolean,training_status:string,"
    "trained_during_this_run:boolean>"
)
DATASET = "struct<source:string,split:string,seed:int,status:string,reason:string,note:string>"
VECTORS = "struct<source:string,dimension:int,vocab_size:bigint,sha256:string>"
PROVENANCE = (
    "struct<commit:string,branch:string,dirty:boolean,config_sha256:string,"
    f"dataset_manifest:{DATASET},fasttext:map<string,{VECTORS}>,python:string,"
    "packages:map<string,string>>"
)
RUN_RECORD = (
    "experiment string, system string, task string, language string, seed int, "
    f"reg_lambda double, dev {SCORES}, test {SCORES}, projection {PROJECTION}, "
    f"provenance {PROVENANCE}, unavailable_hyperparameters int, elapsed_seconds double"
)
PARTITIONS = ["language", "task", "system"]


def read_runs(
    spark: SparkSession, path: str, task: str | None = None, language: str | None = None, multiline: bool = False
) -> DataFrame:
    """Run records of a folder; task and language prune partitions when stored by them.

    One record per line, or with ``multiline`` one indented record (or list of records) per file, in
    any depth of folders. A record that does not parse fails the job instead of reading as nulls.
    The vector map of a record's provenance, stored as ``fasttext``, is ``provenance.vectors`` here.
    """
    reader = spark.read.schema(RUN_RECORD).option("mode", "FAILFAST")
    if multiline:
        reader = reader.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    runs = reader.json(path)
    p = F.col("provenance")
    runs = runs.withColumn("provenance", p.withField("vectors", p["fasttext"]).dropFields("fasttext"))
    if task:
        runs = runs.filter(F.col("task") == task)
    if language:
        runs = runs.filter(F.col("language") == language)
    return runs


def write_runs(runs: DataFrame, path: str) -> None:
    p = F.col("provenance")
    stored = runs.withColumn("provenance", p.withField("fasttext", p["vectors"]).dropFields("vectors"))
    stored.write.partitionBy(*PARTITIONS).json(path)


def with_manifest(runs: DataFrame, manifest: Column, folder: Column) -> Column:
    """The dataset manifest of a run, or a record that says that there is none in ``folder``."""
    kind = runs.select(manifest.alias("m")).schema["m"].dataType
    missing = {"status": F.lit("unavailable"), "reason": F.concat(F.lit("no manifest in "), folder), "note": F.lit("the splits cannot be traced to a source")}
    fields = [missing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]
    return F.coalesce(manifest, F.struct(*fields))


@F.arrow_udf(StringType())
def _repeated_sha256(groups: pa.Array) -> pa.Array:
    """The sha256 of each group's digests in order, each as often as it occurs, without making that string."""
    out = []
    for group in groups:
        total = hashlib.sha256()
        for digest, count in ((x["d"], x["n"]) for x in group.as_py()):
            if digest is not None:
                piece = digest.encode()
                whole, rest = divmod(count, 1 << 14)
                block = piece * (1 << 14) if whole else b""
                for _ in range(whole):
                    total.update(block)
                total.update(piece * rest)
        out.append(total.hexdigest())
    return pa.array(out, pa.string())


#: Hexadecimal digits that a level of the checksum tree adds: a node has at most 65,536 children, 4 MB of text.
_TREE_DIGITS = 4
#: Different digests under a leaf, on average at most: some 400 kB.
_LEAF_DIGESTS = 4096
_TREE_LEVELS = 4


def split_manifest(rows: DataFrame, keys: list[str], text: str, n_tokens: Column, split: str = "split", seed: int | None = None) -> DataFrame:
    """(keys, sentences, tokens, counts, checksums, seed): what a prepared data set consists of.

    ``counts`` has rows and tokens per split; a split's checksum is the root of a tree over its rows' own
    sha256 values, so it does not depend on how the rows are stored and no split is gathered. A leaf is
    the sha256 of the values that begin with the same digits, in order, each as often as it occurs;
    any other node is the sha256 of its children's, in order. The tree has one level of four digits up to
    65,536 x 4,096 different rows, and one more for each further factor of 65,536. Equal rows are
    counted before they meet.
    """
    digest = F.coalesce(F.sha2(F.col(text).cast("string"), 256), F.lit(""))  # a null row counts, without a digest
    by = [*keys, split]
    counted = rows.select(*by, digest.alias("d"), n_tokens.cast("bigint").alias("t")).groupBy(*by, "d").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    fan = 16**_TREE_DIGITS
    deeper = [F.when(F.col("m") > _LEAF_DIGESTS * fan**level, 1).otherwise(0) for level in range(1, _TREE_LEVELS)]
    sizes = counted.groupBy(*by).agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    sizes = sizes.select(*by, "n", "t", (F.lit(_TREE_DIGITS) * sum(deeper, F.lit(1))).alias("depth"))
    depths = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], "depth")
    placed = counted.join(depths, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])
    leaves = (
        placed.groupBy(*by, "depth", F.expr("substring(d, 1, depth)").alias("g"))
        .agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("counted"))
        .withColumn("h", _repeated_sha256("counted"))
        .drop("counted")
    )
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256)
    nodes = None
    for level in range(_TREE_LEVELS, 0, -1):
        own = leaves.filter(F.col("depth") == level * _TREE_DIGITS).drop("depth")
        nodes = own if nodes is None else own.unionByName(nodes)
        # what begins with the same digits of the level above; at the root, all
        nodes = nodes.groupBy(*by, F.substring("g", 1, (level - 1) * _TREE_DIGITS).alias("g")).agg(node.alias("h"))
    roots = nodes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("h").alias("sha256"))
    per_split = sizes.join(roots, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])
    entry = F.struct(F.col("n").alias("sentences"), F.col("t").alias("tokens"), "sha256")
    return per_split.groupBy(*keys).agg(
        F.sum("n").alias("sentences"),
        F.sum("t").alias("tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(split).alias("key"), entry.alias("value"))))).alias("files"),
        F.lit(seed).cast("bigint").alias("seed"),
    )


def upsert_manifest(existing: DataFrame, new: DataFrame, key: str = "language") -> DataFrame:
    """New entries replace those of the same key, all others stay."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_manifest_entries(new: DataFrame, path: str, key: str = "language") -> int:
    """Bring ``new`` into the manifest at ``path`` (see ``versions``): the same keys are replaced, all others stay.

    The manifest that is read stays readable while and if the write fails; a new folder starts empty.
    """
    spark = new.sparkSession
    try:
        entries = upsert_manifest(versions.read_table(spark, path), new, key)
    except versions.NoVersion:
        entries = new
    return versions.write_table(entries, path)


def content_checksum(content: Column) -> Column:
    return F.sha2(content, 256)


#: Bytes of a file that a task holds at a time.
RANGE_BYTES = 8 << 20


def open_path(path: str) -> Any:
    """A file by the path that Spark gives it (its names are not escaped), on any store that pyarrow reaches."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file":
        return open("/" + (path if path.startswith("/") else rest).lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(inner)


def stream_sha256(file: Any, range_bytes: int = RANGE_BYTES) -> tuple[int, str]:
    """(length, sha256): ranges are read in order and one after the other, the state of the hash is carried on."""
    state, length = hashlib.sha256(), 0
    while piece := file.read(range_bytes):
        state.update(piece)
        length += len(piece)
    return length, state.hexdigest()


def file_checksums(spark: SparkSession, path: str, open_file: Callable[[str], Any] = open_path, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, length, sha256) per file, of any size: a file is one task, which holds ``range_bytes`` of it.

    Spark lists the files and deals them out; ``open_file`` opens one by its path, for stores
    that pyarrow does not know. A file whose length is not the listed one fails the job. Spark does not
    list empty files, so they have no row.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(name) as file:
                    length, found = stream_sha256(file, range_bytes)
                if length != listed:
                    raise OSError(f"{name} has {length} bytes, {listed} were listed")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length], pa.int64()), pa.array([found])], ["path", "length", "sha256"])

    # the content column is not selected, so no file is read here
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions())
    return files.repartition(tasks, "path").mapInArrow(digest, "path string, length bigint, sha256 string")


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A vector table whose width is checked and never changed."""
    from ..operators.embeddings import check_dimensions, vector_width

    table = spark.read.parquet(path)
    check_dimensions(vector_width(table), dim)
    return table


def write_report(lines: DataFrame, path: str) -> None:
    """``(section, ord, line)`` rows as one ordered text body."""
    lines.orderBy("section", "ord").select(F.col("line").alias("value")).coalesce(1).write.text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.json(path)
