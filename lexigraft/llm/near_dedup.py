"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Each text becomes the set of its word shingles, a digest of that set and a MinHash signature of
   ``BANDS * ROWS`` minima. Equal sets form a class, and only its smallest id goes on.
2. Classes that agree in a band are candidates. A pair of similarity 0.8 agrees in no band with
   probability (1 - 0.8**5)**32 = 3e-6, a more similar pair less often.
3. A candidate's signatures are compared ``BATCH`` minima at a time. After each batch the pair is
   dropped if, under a uniform prior, the posterior probability that its similarity reaches the
   threshold is below ``MISS``. Survivors are verified on their full sets, in whole numbers.
4. Only connected groups are asked for, so a band's bucket is not expanded into all pairs. In a few
   rounds each member is compared with one pivot of its bucket, and what links is merged. Then only
   members of different groups that share a bucket are left; these are compared with each other in
   blocks of at most about ``2 * BLOCK`` rows, so that no pair of candidates is left out and
   none is written down. A tight group costs its size times the rounds, whatever its size.

What several steps read is written to the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import release, text_parts
from .components import connected_components
from .shingles import MinHash, digest, fingerprints, shingle_set

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
PIVOT_ROUNDS = 3
BLOCK = 1024
BATCH_BYTES = 1 << 18
#: Ids of candidates up to this number are sent to all tasks; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1 << 20


@lru_cache(maxsize=8)
def least_matches(n: int, percent: int) -> int:
    """The fewest of n equal minima at which the similarity may still reach ``percent`` / 100.

    The posterior is Beta(m + 1, n - m + 1); its upper tail is a lower tail of Binomial(n + 1).
    """
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= MISS:
            return m
    return n


def may_link(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Indices of the row pairs that the sequential test keeps."""
    kept = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for start in range(0, left.shape[1], BATCH):
        stop = min(start + BATCH, left.shape[1])
        matches += (left[kept, start:stop] == right[kept, start:stop]).sum(axis=1)
        ok = matches >= least_matches(stop, percent)
        kept, matches = kept[ok], matches[ok]
    return kept


def linked(a: set, b: set, percent: int) -> bool:
    """Is the intersection at least ``percent`` hundredths of the union? Empty sets link with nothing."""
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class _Sets:
    """The last few shingle sets that a task has made, by their signatures."""

    def __init__(self, k: int, room: int = 64):
        self.k, self.room, self.kept = k, room, OrderedDict()

    def of(self, key: object, text: pa.Scalar) -> set:
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = shingle_set(text.as_py(), self.k)
            if len(self.kept) > self.room:
                self.kept.popitem(last=False)
        return self.kept[key]


def _signed(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint32).reshape(len(data), -1)


def fingerprint_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, signature) of each row; an empty set has its id's own digest and no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS, ROWS)
        for batch in batches:
            for a, texts in text_parts(batch.column(1), BATCH_BYTES):
                prints = fingerprints(texts, k)
                own = batch.column(0).slice(a, len(texts))
                digests = [digest(p) if p.size else f"empty {i}".encode() for p, i in zip(prints, own.to_pylist(), strict=True)]
                signatures = [minhash.signature(p).tobytes() if p.size else None for p in prints]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(map(len, prints), pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                    ["id", "n", "digest", "signature"],
                )
        release()

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return some.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n bigint, digest binary, signature binary")


def band_table(nodes: DataFrame) -> DataFrame:
    """(key, id, n): a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS, ROWS)
        for batch in batches:
            if batch.num_rows:
                keys = minhash.keys(_signed(batch.column(2))).ravel()
                at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), batch.column(1).take(at)], ["key", "id", "n"])
        release()

    kind = dict(nodes.dtypes)["id"]
    return nodes.select("id", "n", "signature").mapInArrow(run, f"key bigint, id {kind}, n bigint")


def _close(n1: F.Column, n2: F.Column, percent: int) -> F.Column:
    """Sets of such sizes can be similar enough."""
    return (F.lit(100) * F.least(n1, n2)) >= F.lit(percent) * F.greatest(n1, n2)


def verify_pairs(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; ``nodes`` has id, signature and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = may_link(_signed(batch.column(2)), _signed(batch.column(4)), percent)
            some = batch.take(pa.array(kept))
            ok = [linked(sets.of(own.as_py(), left), shingle_set(right.as_py(), k), percent) for own, left, right in zip(some.column(2), some.column(3), some.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    kind = dict(pairs.dtypes)["a"]
    full = pairs.join(nodes.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("text").alias("tb")), "b").join(
        nodes.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("text").alias("ta")), "a"
    )
    return full.select("a", "b", "sa", "ta", "sb", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def verify_blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between rows of different groups in the same block pair.

    ``rows``: key, i, j, block, id, comp, n, signature, text; the rows of one (key, i, j) are those of
    blocks i and j of a bucket. A pair is compared under the first band it shares.
    """

    def block(table: pa.Table, minhash: MinHash) -> list[tuple]:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        signatures = _signed(table.column("signature").combine_chunks())
        comp, n, own = table.column("comp").to_numpy(), table.column("n").to_numpy(), table.column("block").to_numpy()
        keys = minhash.keys(signatures)
        bands = (keys == key).argmax(axis=1)
        left = np.nonzero(own == i)[0]
        right = left if i == j else np.nonzero(own == j)[0]
        ids, texts = table.column("id").to_pylist(), table.column("text")
        numbers: dict[tuple, int] = {}
        sets: dict[int, np.ndarray] = {}
        group = {c: c for c in comp.tolist()}

        def numbered(z: int) -> np.ndarray:
            """The full shingle set as numbers that stand for this block's different shingles."""
            if z not in sets:
                sets[z] = np.array([numbers.setdefault(s, len(numbers)) for s in shingle_set(texts[z].as_py(), k)], np.int32)
            return sets[z]

        def root(c: object) -> object:
            while group[c] != c:
                c = group[c]
            return c

        found = []
        for x in left.tolist():
            others = right[right > x] if i == j else right
            others = others[comp[others] != comp[x]]
            others = others[100 * np.minimum(n[x], n[others]) >= percent * np.maximum(n[x], n[others])]
            first = (keys[others] == keys[x]).argmax(axis=1) == bands[x]
            others = others[first]
            if not others.size:
                continue
            kept = may_link(np.broadcast_to(signatures[x], (others.size, signatures.shape[1])), signatures[others], percent)
            own_set, mark = numbered(x) if kept.size else None, None
            for y in others[kept].tolist():
                one, other = root(comp[x]), root(comp[y])
                if one == other:
                    continue
                right_set = numbered(y)
                if mark is None or mark.size < len(numbers):
                    mark = np.zeros(2 * len(numbers), np.bool_)
                    mark[own_set] = True
                both = int(np.count_nonzero(mark[right_set]))
                if both and 100 * both >= percent * (own_set.size + right_set.size - both):
                    group[max(one, other)] = min(one, other)
                    found.append((ids[x], ids[y]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS, ROWS)
        held: list[pa.RecordBatch] = []
        names = ["key", "i", "j"]
        schema = pa.schema([("a", id_type), ("b", id_type)])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = block(pa.Table.from_batches(held), minhash)
                held.clear()
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, id_type) for c in zip(*pairs, strict=True)], schema=schema)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = [0, *(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(marks[:, a].tolist())
                if now != last:
                    yield from flush()
                last = now
                held.append(batch.slice(a, b - a))
        yield from flush()
        release()

    kind = dict(rows.dtypes)["id"]
    id_type = pa.string() if kind == "string" else pa.int64()
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "block", "id", "comp", "n", "signature", "text").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows link if their shingle sets' intersection is at least ``percent`` hundredths of the union;
    component_id is the smallest id that links reach. Rows with equal ids count as one document, and
    repeated rows give repeated rows. A null or empty text links with nothing. A row without an id
    takes no part; it has no component and is kept. Ids are bigint or string. Other columns are not
    read. Jobs run while the plan is built, as each round depends on the one before.
    """
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, f"near-dedup-{name}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    kind = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    source = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = written(fingerprint_table(source, shingle_words, "id", "text"), "prints")
    classes = prints.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"))
    reps = classes.select(F.col("rep").alias("id")).distinct()
    nodes = prints.filter(F.col("n") > 0).join(reps, "id", "left_semi")
    bands = band_table(nodes)
    # what is known of a bucket is written before its members meet it: a join of two tables can be split
    # by the adaptive skew join, one with an aggregate of the same key in the same stage can't
    sizes = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("low"), F.max("id").alias("high"))
    buckets = written(sizes.filter("m > 1 and low != high").select("key", "m"), "buckets")
    members = written(bands.join(buckets, "key"), "members")

    ids = members.select("id").distinct()
    small = ids.count() <= BROADCAST_IDS
    near = F.broadcast(ids) if small else ids
    full = written(
        nodes.select("id", "signature").join(near, "id", "left_semi").join(
            source.join(near, "id", "left_semi"), "id"
        ),
        "candidates",
    )
    comps = ids.withColumn("comp", F.col("id"))
    tested = None
    for turn in range(PIVOT_ROUNDS):
        own = members.join(comps, "id")
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")))
        pivots = written(own.groupBy("key").agg(first.alias("p")), f"pivots-{turn}")
        pairs = (
            own.join(pivots, "key")
            .filter((F.col("p.ca") != F.col("comp")) & _close(F.col("n"), F.col("p.na"), percent))
            .select(F.col("p.a").alias("a"), F.col("id").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, f"pairs-{turn}")
        links = written(verify_pairs(pairs, full, shingle_words, percent), f"links-{turn}")
        if not links.head(1):
            break
        both = pairs.union(pairs.select("b", "a"))
        tested = both if tested is None else tested.union(both)
        comps = written(_merged(comps, links), f"groups-{turn}")

    # what pivots have not joined: members of different groups that share a bucket. The members of a
    # bucket's largest group need not be compared with each other, so their blocks meet the others' only
    own = members.filter("m > 2").join(comps, "id")
    sizes = own.groupBy("key", "comp").agg(F.count("*").alias("size"))
    shape = sizes.groupBy("key").agg(
        F.sum("size").alias("all"), F.max(F.struct("size", F.col("comp").alias("main"))).alias("top"), F.count("*").alias("groups")
    )
    major = F.ceil(F.col("top.size") / BLOCK).cast("int")
    minor = F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int")
    open_keys = written(shape.filter("groups > 1").select("key", F.col("top.main").alias("main"), major.alias("major"), minor.alias("minor")), "open")
    in_main = F.col("comp") == F.col("main")
    spread = (
        own.join(open_keys, "key")
        .withColumn("block", F.when(in_main, F.col("minor") + F.pmod(F.xxhash64("id"), F.col("major"))).otherwise(F.pmod(F.xxhash64("id"), F.col("minor"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n")
    )
    links = written(verify_blocks(spread.join(full, "id"), shingle_words, percent), "links-rest")
    comps = written(_merged(comps, links), "groups")

    found = prints.select("id", "n", "digest").join(classes, "digest", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (id, comp) after the links (a, b) between ids have joined their groups."""
    edges = links.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(
        comps.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b"
    )
    joined = connected_components(edges.select("u", "v"))
    return comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select(
        "id", F.coalesce("to", "comp").alias("comp")
    )
