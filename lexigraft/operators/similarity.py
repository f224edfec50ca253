"""Top-k similarity between two vector tables: exact with bounds, and approximate by hyperplane tables.

Equal vectors are one class on either side: a class is searched once, whatever the number of its
members, and a class of references stands for its k smallest ids.

Exact search cuts the reference classes into blocks around pivots. A block has a centre c and a radius r,
and for a query q of length 1 no reference of the block scores above q.c + r (Cauchy-Schwarz). A query
first meets the blocks of the highest bounds, then only those whose bound reaches its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.vector_sums import of_width
from ..session import scratch_path

_BLOCK_BYTES = 32 << 20      # vectors of a block on either side
_BROADCAST_BYTES = 256 << 20  # checked size up to which the reference side is shipped whole
_DECIMALS = 9                 # scores are compared at nine decimals
_SLACK = 1e-8                 # what rounding may take from a bound
_BLOCK_ROWS = 256             # references of a block, about
_PIVOTS = 4096                # most pivots: they are shipped to every task
_FIRST = 2                    # blocks that every query meets
_SCORES = 8 << 20             # scores held at once
_FOUND = 8 << 20              # most that queries taken at once may find: k in each block
_HELD = 1 << 18               # found pairs held before they are cut to the best
_GUESS = 2048                 # references of a block that give a first floor
_EXACT = 1 << 16              # pairs scored exactly at once
_LONGEST = 1e15               # vectors up to this length are multiplied in single precision first
_CLASS_NEIGHBOURS = "cls bigint, ref_id bigint, score double, rank bigint"


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)


class Block(NamedTuple):
    """Reference classes by least id: vectors, least ids, all their ids with the ends of each class; vectors in single precision and the greatest length."""

    rows: np.ndarray
    least: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    single: np.ndarray
    longest: float


class Index(NamedTuple):
    """Blocks with their centres and radii."""

    centres: np.ndarray
    radii: np.ndarray
    blocks: list[Block]


def _block_of(vectors: np.ndarray, ids: list) -> Block:
    least = np.array([i[0] for i in ids], np.int64)
    order = np.argsort(least)
    flat = [ids[i] for i in order.tolist()]
    rows = vectors[order]
    with np.errstate(over="ignore"):
        single, longest = rows.astype(np.float32), float(np.linalg.norm(rows, axis=1).max())
    return Block(rows, least[order], np.concatenate([np.asarray(i, np.int64) for i in flat]), np.cumsum([len(i) for i in flat]), single, longest)


def pivots_of(vectors: np.ndarray, block_rows: int) -> np.ndarray:
    """Centres for blocks of about ``block_rows``: evenly spaced rows, moved to their own means twice."""
    count = min(_PIVOTS, max(1, len(vectors) // block_rows))
    centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(np.int64)]
    for _ in range(2):
        home = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        n = np.bincount(home, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each vector."""
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, _SCORES // len(centres))
    return np.concatenate([np.zeros(0, np.int64)] + [(vectors[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(vectors), step)])


def build_index(vectors: np.ndarray, ids: list, block_rows: int = _BLOCK_ROWS) -> Index:
    if not len(vectors):
        return Index(np.zeros((0, vectors.shape[1])), np.zeros(0), [])
    centres = pivots_of(vectors, block_rows)
    home = _nearest(vectors, centres)
    used = np.unique(home)
    blocks = [_block_of(vectors[home == j], [ids[i] for i in np.nonzero(home == j)[0].tolist()]) for j in used.tolist()]
    radii = np.array([np.linalg.norm(b.rows - centres[j], axis=1).max() for b, j in zip(blocks, used.tolist(), strict=True)])
    return Index(centres[used], radii, blocks)


def _pairs(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(met), met.shape[1])


def _best_in(unit: np.ndarray, single: np.ndarray, block: Block, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, class, score) of what may be among a query's k best classes: it reaches ``floor`` and the block's k-th score.

    Products are made in single precision; what may reach the floor by the bound of their error is scored exactly.
    """
    n, d = block.rows.shape
    if not block.longest < _LONGEST:  # also where a cell is no number
        scores = np.round(unit @ block.rows.T, _DECIMALS)
        if n > k:
            floor = np.maximum(floor, np.partition(scores, n - k, axis=1)[:, n - k])
        at, column = _pairs(scores >= floor[:, None])
        return at, column, scores[at, column]
    rough = single @ block.single.T
    off = (d + 8) * 2.0**-23 * block.longest + _SLACK
    open_ = np.nonzero(floor == -np.inf)[0]
    if n > k and len(open_):
        # the k-th score among some references is a floor for that among all
        some = rough[open_, : max(_GUESS, k)]
        floor = floor.copy()
        floor[open_] = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - off
    # twice the bound: the floor itself is rounded to single precision
    at, column = _pairs(rough >= (floor - 2 * off).astype(np.float32)[:, None])
    score = np.empty(len(at))
    for i in range(0, len(at), _EXACT):
        pair = slice(i, i + _EXACT)
        score[pair] = np.einsum("nd,nd->n", unit[at[pair]], block.rows[column[pair]])
    score = np.round(score, _DECIMALS)
    kept = score >= floor[at]
    return at[kept], column[kept], score[kept]


def search(queries: np.ndarray, index: Index, k: int) -> tuple[pd.DataFrame, int]:
    """(query row, ref_id, score, rank) of the k best references of each query, and the number of products made.

    Equal scores go to the smaller id. Scores are rounded before they are compared, so the result does
    not depend on the blocks. Queries are taken so many at a time that scores and bounds stay within ``_SCORES`` and finds within ``_FOUND``.
    """
    m = len(index.blocks)
    step = max(1, min(_FOUND // max(1, m * k), _SCORES // max([1, m, *(len(b.rows) for b in index.blocks)])))
    parts, products = [], 0
    for at in range(0, max(1, len(queries)), step):
        part, made = _search_some(queries[at : at + step], index, k)
        parts.append(part.assign(query=part["query"] + at))
        products += made
    return pd.concat(parts, ignore_index=True), products


class _Found:
    """What queries found so far, cut to the k best classes of each whenever it outgrows ``_HELD``.

    With ``again`` a query may find a class several times, which counts once.
    """

    def __init__(self, index: Index, n: int, k: int, again: bool = False) -> None:
        self.index, self.k, self.again = index, k, again
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.least_held = 0, 0

    def add(self, j: int, at: np.ndarray, column: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((at, np.full(len(at), j), column, score, self.index.blocks[j].least[column]))
        self.held += len(at)
        if self.held > 2 * self.least_held + _HELD:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(query row, block, class, score, least id) of the k best classes by query; the k-th score is the floor from now on."""
        at, home, column, score, least = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if self.again:
            order = np.lexsort((-score, column, home, at))
            at, home, column, score, least = (c[order] for c in (at, home, column, score, least))
            new = np.append(True, (at[1:] != at[:-1]) | (home[1:] != home[:-1]) | (column[1:] != column[:-1]))[: len(at)]
            at, home, column, score, least = (c[new] for c in (at, home, column, score, least))
        order = np.lexsort((least, -score, at))
        at, home, column, score, least = (c[order] for c in (at, home, column, score, least))
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kth = place == self.k - 1
        self.floor[at[kth]] = score[kth]
        kept = place < self.k
        self.parts = [tuple(c[kept] for c in (at, home, column, score, least))]
        self.held = self.least_held = int(kept.sum())
        return self.parts[0]


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query": [], "ref_id": [], "score": [], "rank": []}).astype({"query": "int64", "ref_id": "int64", "rank": "int64"})


def _search_some(queries: np.ndarray, index: Index, k: int) -> tuple[pd.DataFrame, int]:
    unit = _unit(queries.astype(np.float64))
    single = unit.astype(np.float32)
    n, m = len(unit), len(index.blocks)
    if not n or not m or k < 1:
        return _nothing(), 0
    bound = unit @ index.centres.T + index.radii + _SLACK
    first = np.argsort(-bound, axis=1, kind="stable")[:, :_FIRST]
    seen = np.zeros((n, m), np.bool_)
    np.put_along_axis(seen, first, True, axis=1)
    found = _Found(index, n, k)
    products = 0

    def meet(j: int, rows: np.ndarray) -> None:
        nonlocal products
        block = index.blocks[j]
        products += len(rows) * len(block.rows)
        at, column, score = _best_in(unit[rows], single[rows], block, k, found.floor[rows])
        found.add(j, rows[at], column, score)

    for j in range(m):
        rows = np.nonzero(seen[:, j])[0]
        if rows.size:
            meet(j, rows)
    found.best()
    for j in range(m):
        rows = np.nonzero(~seen[:, j] & (bound[:, j] >= found.floor))[0]
        if rows.size:
            meet(j, rows)
    return _ranked(found, k), products


def _ranked(found: _Found, k: int) -> pd.DataFrame:
    """(query, ref_id, score, rank) of the k best ids of each query; where it may find a class again, an id counts once."""
    # the k best classes hold the k best ids: a class past them has k smaller ids before its own
    at, home, column, score, _ = found.best()
    members = [found.index.blocks[j] for j in home.tolist()]
    ids = [b.ids[(b.ends[c - 1] if c else 0) : b.ends[c]] for b, c in zip(members, column.tolist(), strict=True)]
    if not ids:
        return _nothing()
    sizes = np.array([len(i) for i in ids])
    at, score, ref = np.repeat(at, sizes), np.repeat(score, sizes), np.concatenate(ids)
    if found.again:
        order = np.lexsort((-score, ref, at))
        at, score, ref = at[order], score[order], ref[order]
        new = np.append(True, (at[1:] != at[:-1]) | (ref[1:] != ref[:-1]))
        at, score, ref = at[new], score[new], ref[new]
    order = np.lexsort((ref, -score, at))
    at, score, ref = at[order], score[order], ref[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    return pd.DataFrame({"query": at[kept], "ref_id": ref[kept], "score": score[kept], "rank": place[kept] + 1})


# ---------------------------------------------------------------- classes

def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, f"similarity-{name}")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def vector_classes(rows: DataFrame, id_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, cls) of each row with a vector, and (cls, vec); cls is the smallest id of equal vectors.

    Vectors are told apart by two 64-bit hashes. A vector of another width than ``dim`` fails the job.
    """
    vec = of_width(F.col("vec").cast("array<double>"), dim)
    keyed = rows.filter(F.col("vec").isNotNull()).select(F.col(id_col), vec.alias("vec"))
    keyed = keyed.select(id_col, "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    keyed = _written(keyed, "keyed")
    classes = _written(keyed.groupBy("h1", "h2").agg(F.min(id_col).alias("cls"), F.first("vec").alias("vec")), "classes")
    members = keyed.select(id_col, "h1", "h2").join(classes.select("h1", "h2", "cls"), ["h1", "h2"]).select(id_col, "cls")
    return members, classes.select("cls", "vec")


def reference_classes(refs: DataFrame, k: int, dim: int) -> DataFrame:
    """(cls, vec, ids): reference classes with their k smallest ids, ascending."""
    members, classes = vector_classes(refs, "id", dim)
    first = members.withColumn("__n", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("__n") <= k)
    ids = first.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return _written(classes.join(ids, "cls"), "references")


def neighbour_classes(
    queries: DataFrame, refs: DataFrame, k: int, dim: int, broadcast_bytes: int = _BROADCAST_BYTES, block_bytes: int = _BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(members, near): (query_id, cls) of each query, and (cls, ref_id, score, rank) of each class of queries."""
    members, classes = vector_classes(queries, "query_id", dim)
    table = reference_classes(refs, k, dim)
    n_refs, n_queries = table.count(), classes.count()
    if n_refs * (dim + k) * 8 <= broadcast_bytes:
        return members, _written(_against_broadcast(classes, table, n_queries, k, dim), "near")
    rows = max(1, block_bytes // (8 * (dim + k)))
    return members, _written(_against_grid(classes, table, n_queries, n_refs, k, dim, rows), "near")


def _ship_index(table: DataFrame, dim: int):
    frame = table.toPandas().sort_values("cls")
    vectors = np.stack(frame["vec"].to_numpy()) if len(frame) else np.zeros((0, dim))
    return table.sparkSession.sparkContext.broadcast(build_index(vectors, frame["ids"].tolist()))


def _query_parts(classes: DataFrame, n_queries: int) -> DataFrame:
    # the work per query byte is large: partition by work, not by size
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-n_queries // 4096))
    return classes.select("cls", "vec").repartition(tasks, "cls")


def _against_broadcast(classes: DataFrame, table: DataFrame, n_queries: int, k: int, dim: int) -> DataFrame:
    shipped = _ship_index(table, dim)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shipped.value
        step = max(1, _SCORES // max(1, *(len(b.rows) for b in index.blocks), len(index.blocks))) if index.blocks else 1
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                near, _ = search(np.stack(part["vec"].to_numpy()), index, k)
                yield pd.DataFrame({"cls": part["cls"].to_numpy()[near["query"].to_numpy()], **{c: near[c] for c in ("ref_id", "score", "rank")}})

    return _query_parts(classes, n_queries).mapInPandas(score, _CLASS_NEIGHBOURS)


def skipped_share(queries: DataFrame, refs: DataFrame, k: int, dim: int) -> DataFrame:
    """One row: n_products that the exact search makes, n_pairs of classes, and the share it skips."""
    _, classes = vector_classes(queries, "query_id", dim)
    table = reference_classes(refs, k, dim)
    shipped = _ship_index(table, dim)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shipped.value
        for batch in batches:
            if len(batch):
                made = search(np.stack(batch["vec"].to_numpy()), index, k)[1]
                yield pd.DataFrame({"made": [made], "pairs": [len(batch) * sum(len(b.rows) for b in index.blocks)]})

    found = _query_parts(classes, classes.count()).mapInPandas(count, "made bigint, pairs bigint")
    return found.agg(F.sum("made").alias("n_products"), F.sum("pairs").alias("n_pairs")).withColumn("skipped", 1 - F.col("n_products") / F.col("n_pairs"))


def _against_grid(classes: DataFrame, table: DataFrame, n_queries: int, n_refs: int, k: int, dim: int, block_rows: int) -> DataFrame:
    """Queries meet the blocks of their highest bounds, then those that may still hold a better one.

    Pivots come from a bounded sample of references; every reference goes to its nearest pivot, and
    a block larger than ``block_rows`` is cut by a hash. (query part, block) pairs are bounded tasks, and
    a block travels only to the parts of which some query asks for it.
    """
    spark = classes.sparkSession
    count = min(_PIVOTS, max(1, n_refs // block_rows))
    sample = table.orderBy(F.xxhash64("cls")).limit(8 * count).select("vec").toPandas()["vec"]
    pivots = spark.sparkContext.broadcast(pivots_of(np.stack(sample.to_numpy()), 8))

    @F.pandas_udf("bigint")
    def home(vec: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(vec.to_numpy()).astype(np.float64), pivots.value))

    @F.pandas_udf("double")
    def distance(vec: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.stack(vec.to_numpy()) - pivots.value[block.to_numpy()], axis=1))

    homed = _written(table.withColumn("pivot", home("vec")).withColumn("away", distance("vec", "pivot")), "homed")
    sizes = homed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # at most _PIVOTS rows
    cuts = {r["pivot"]: -(-r["n"] // block_rows) for r in sizes}
    first, names = {}, []
    for r in sorted(sizes, key=lambda r: r["pivot"]):
        first[r["pivot"]] = len(names)
        names += [r["pivot"]] * cuts[r["pivot"]]
    layout = spark.createDataFrame([(p, first[p], cuts[p]) for p in cuts], "pivot bigint, first bigint, cuts bigint")
    blocks = homed.join(F.broadcast(layout), "pivot").withColumn("block", F.col("first") + F.pmod(F.xxhash64("cls"), F.col("cuts"))).select("block", "cls", "vec", "ids")
    blocks = _written(blocks, "blocks")
    radius = {r["pivot"]: r["radius"] for r in sizes}
    near = spark.sparkContext.broadcast((pivots.value[names], np.array([radius[p] for p in names])))
    parts = max(1, -(-n_queries // block_rows))
    dealt = _written(classes.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(parts))), "queries")

    @F.pandas_udf("array<bigint>")
    def asked(vec: pd.Series, floor: pd.Series) -> pd.Series:
        """The blocks of the highest bounds where the floor is unknown, else all others that reach it."""
        centres, radii = near.value
        out = []
        step = max(1, _SCORES // len(centres))
        for at in range(0, len(vec), step):
            bound = _unit(np.stack(vec.iloc[at : at + step].to_numpy()).astype(np.float64)) @ centres.T + radii + _SLACK
            first = np.argsort(-bound, axis=1, kind="stable")[:, :_FIRST]
            for row, best, least in zip(bound, first, floor.iloc[at : at + step], strict=True):
                out.append(best if np.isnan(least) else np.setdiff1d(np.nonzero(row >= least)[0], best))
        return pd.Series(out)

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"cls": [], "ref_id": [], "score": [], "rank": []})
        vectors = np.stack(r["vec"].to_numpy())
        index = Index(np.zeros((1, vectors.shape[1])), np.full(1, np.inf), [_block_of(vectors, r["ids"].tolist())])
        out = []
        step = max(1, _SCORES // len(r))
        for at in range(0, len(q), step):
            some = q.iloc[at : at + step]
            found, _ = search(np.stack(some["vec"].to_numpy()), index, k)
            out.append(pd.DataFrame({"cls": some["cls"].to_numpy()[found["query"].to_numpy()], **{c: found[c] for c in ("ref_id", "score", "rank")}}))
        return pd.concat(out, ignore_index=True)

    def meet(wanted: DataFrame) -> DataFrame:
        pairs = wanted.withColumn("block", F.explode(asked("vec", "floor"))).select("part", "block", "cls", "vec")
        pairs = _written(pairs, "pairs")
        right = blocks.join(pairs.select("part", "block").distinct(), "block").select(*[F.col(c).alias(c) for c in ("part", "block")], "vec", "ids")
        return pairs.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(score, _CLASS_NEIGHBOURS)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("cls").orderBy(F.col("score").desc(), "ref_id")
        return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)

    early = _written(best(meet(dealt.withColumn("floor", F.lit(float("nan"))))), "early")
    floors = early.groupBy("cls").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    late = meet(dealt.join(floors, "cls", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    return best(early.unionByName(late))


# ---------------------------------------------------------------- by query

def top_k_similar(
    queries: DataFrame, refs: DataFrame, k: int, dim: int, broadcast_bytes: int = _BROADCAST_BYTES, block_bytes: int = _BLOCK_BYTES
) -> DataFrame:
    """(query_id, ref_id, score, rank) of the k references with the largest dot product.

    ``queries(query_id, vec)`` are normalised here, ``refs(id, vec)`` are taken as they are: the
    score is the cosine only where their length is 1. Rows without a vector are left out.
    A reference side within ``broadcast_bytes`` is shipped to every task and each class of queries
    is finished where it lies. A larger one is cut into blocks that meet only the queries they matter to.
    """
    members, near = neighbour_classes(queries, refs, k, dim, broadcast_bytes, block_bytes)
    return members.join(near, "cls").select("query_id", "ref_id", "score", "rank")


def normalise(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Divide each vector by its length."""
    from ..functions.vectors import norm

    # bound once: named in a column of its own, the length would be made again for each cell
    divided = let(norm(F.col(vec)), lambda length: F.transform(vec, lambda v: v.cast("double") / (length + F.lit(1e-8))))
    return rows.withColumn(vec, divided)


def class_weights(near: DataFrame) -> DataFrame:
    """``near`` with ``weight``: softmax over the scores of a class."""
    per_class = Window.partitionBy("cls")
    e = F.exp(F.col("score") - F.max("score").over(per_class))
    return near.withColumn("__e", e).withColumn("weight", F.col("__e") / F.sum("__e").over(per_class)).drop("__e")


def weighted_neighbours(queries: DataFrame, refs: DataFrame, k: int, dim: int, **kw) -> DataFrame:
    """(query_id, ref_id, score, rank, weight): softmax over the k scores of a query, made once a class."""
    members, near = neighbour_classes(queries, refs, k, dim, **kw)
    return members.join(class_weights(near), "cls").select("query_id", "ref_id", "score", "rank", "weight")


# ---------------------------------------------------------------- approximate

class Tables(NamedTuple):
    """Hyperplane tables: a vector's bucket in each, and the buckets that lie closest to it."""

    planes: np.ndarray  # (tables, bits, cells)
    probes: int

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): the number of the bucket by the signs of the projections."""
        powers = 1 << np.arange(self.planes.shape[1])
        return np.concatenate([(np.einsum("nd,tbd->ntb", v, self.planes) > 0) @ powers for v in self._slices(vectors)])

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the buckets that differ in the signs with the smallest margins in sum."""
        bits = self.planes.shape[1]
        powers = 1 << np.arange(bits)
        # flips by ascending sum of margins are among the subsets of the few smallest ones
        flips = np.array([[(s >> b) & 1 for b in range(bits)] for s in range(1 << min(bits, 8))], np.float64)
        out = []
        for v in self._slices(vectors):
            margins = np.einsum("nd,tbd->ntb", v, self.planes)
            order = np.argsort(np.abs(margins), axis=2, kind="stable")
            small = np.take_along_axis(np.abs(margins), order, axis=2)
            best = np.argsort(small @ flips.T, axis=2, kind="stable")[:, :, : self.probes]
            # bit i of a flip stands for the i-th smallest margin
            masks = (flips[best] * powers[order][:, :, None, :]).sum(axis=3).astype(np.int64)
            out.append(((margins > 0) @ powers)[:, :, None] ^ masks)
        return np.concatenate(out)

    def _slices(self, vectors: np.ndarray) -> list[np.ndarray]:
        tables, bits, _ = self.planes.shape
        step = max(1, _SCORES // (8 * tables * (1 << min(bits, 8))))
        return [vectors[at : at + step] for at in range(0, len(vectors), step)]


def search_tables(queries: np.ndarray, block: Block, tables: Tables, k: int, bucket_rows: int) -> pd.DataFrame:
    """(query row, ref_id, score, rank) of the k best references of the block that share a probed bucket."""
    if not len(queries) or not len(block.rows) or k < 1:
        return _nothing()
    unit = _unit(queries)
    single = unit.astype(np.float32)
    buckets, probed = tables.buckets(block.rows), tables.probed(queries)
    # an id may stand in several classes: so many of them hold k different ids
    most = k * int(np.unique(block.ids, return_counts=True)[1].max())
    found = _Found(Index(np.zeros((1, 1)), np.zeros(1), [block]), len(unit), most, again=True)
    for t in range(len(tables.planes)):
        order = np.argsort(buckets[:, t], kind="stable")
        number = buckets[order, t]
        asked = probed[:, t].ravel()
        by_bucket = np.argsort(asked, kind="stable")
        different, starts = np.unique(asked[by_bucket], return_index=True)
        rows_by_bucket = by_bucket // probed.shape[2]
        for b, i, j in zip(different.tolist(), starts.tolist(), [*starts[1:].tolist(), len(asked)], strict=True):
            lo, hi = np.searchsorted(number, (b, b + 1))
            for at in range(lo, hi, bucket_rows):
                held = order[at : min(hi, at + bucket_rows)]
                part = block._replace(rows=block.rows[held], single=block.single[held])
                step = max(1, _SCORES // len(held))
                for first in range(i, j, step):
                    rows = rows_by_bucket[first : min(j, first + step)]
                    q, column, score = _best_in(unit[rows], single[rows], part, most, found.floor[rows])
                    found.add(0, rows[q], held[column], score)
        if found.parts:
            found.best()
    return _ranked(found, k) if found.parts else _nothing()


def top_k_approximate(
    queries: DataFrame, refs: DataFrame, k: int, dim: int, tables: int = 12, bits: int | None = None, probes: int | None = None,
    bucket_rows: int = 4096, seed: int = 42, block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """(query_id, ref_id, score, rank): as ``top_k_similar`` but only among references that share a probed bucket.

    Each of ``tables`` puts a vector into a bucket by the signs of ``bits`` random projections. A query
    probes, in every table, the ``probes`` buckets that lie closest to it: those that differ in the signs
    with the smallest margins in sum. All that meet are scored exactly. Recall is not guaranteed: it grows
    with tables and probes, and falls with bits. By default a bucket holds about 64 classes of references
    and half of the buckets are probed up to 8. A bucket of more than ``bucket_rows`` is searched in parts.

    References are cut into blocks of ``block_bytes`` by a hash, queries into parts of as many bytes. A task
    makes the tables of one block and searches them for one part, so that a vector travels once
    for each block or part that it meets, not once for each bucket.
    """
    members, classes = vector_classes(queries, "query_id", dim)
    table = reference_classes(refs, k, dim)
    n_refs, n_queries = max(1, table.count()), classes.count()
    bits = max(1, min(16, int(np.log2(n_refs / 64)) if n_refs > 64 else 1)) if bits is None else bits
    probes = max(1, min(8, 1 << (bits - 1))) if probes is None else min(probes, 1 << bits)
    made = Tables(np.random.default_rng(seed).normal(size=(tables, bits, dim)), probes)
    rows = max(1, block_bytes // (8 * (dim + k)))
    blocks = -(-n_refs // rows)
    cores = classes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_queries // rows), min(-(-cores // blocks), n_queries // 256))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = classes.select("cls", "vec", F.pmod(F.xxhash64("cls"), F.lit(parts)).alias("part"), every(blocks).alias("block"))
    right = table.select("vec", F.array_distinct("ids").alias("ids"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block"), every(parts).alias("part"))

    def score(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"cls": [], "ref_id": [], "score": []})
        block = _block_of(np.stack(r["vec"].to_numpy()).astype(np.float64), r["ids"].tolist())
        found = search_tables(np.stack(q["vec"].to_numpy()).astype(np.float64), block, made, k, bucket_rows)
        return pd.DataFrame({"cls": q["cls"].to_numpy()[found["query"].to_numpy()], "ref_id": found["ref_id"], "score": found["score"]})

    keys = ["part", "block"]
    tasks = parts * blocks
    found = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(score, "cls bigint, ref_id bigint, score double")
    order = Window.partitionBy("cls").orderBy(F.col("score").desc(), "ref_id")
    best = found.groupBy("cls", "ref_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order).cast("bigint"))
    near = _written(best.filter(F.col("rank") <= k), "approximate")
    return members.join(near, "cls").select("query_id", "ref_id", "score", "rank")
