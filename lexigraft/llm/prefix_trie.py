"""A z-fast trie over sequences of turns, kept as tables and grown by batches.

A sequence is a string whose letters are turns; its prefix of depth d has a 128-bit key, made from the
running sums of two hashes of (place, turn), so that a prefix of any length is one value to join on.
A node of the compacted trie is the edge above it: the depths ``top`` + 1 to ``depth`` of a sequence
``via`` that passes there. It is found under its handle, the key of the prefix whose length is the
two-fattest number of that range (the one with the most trailing zero bits).

Insertion of a batch:

1. *Fat binary search.* Each sequence looks up the prefix of two-fattest length in what is left of its
   range; a hit moves on to that node's depth, a miss goes below. The number of joins is that of the
   binary digits of the longest sequence, whatever the size of trie and batch. One more look-up, by the
   first letter below, and a comparison along one edge give the exit node and the depth of the exit.
2. *Branching.* Sequences that leave at the same place with the same letter agree at least that far, so
   they have the key of one more letter in common. One of them, by a hash, becomes a leaf there; the
   others now exit somewhere on that leaf's edge, are compared along it, and so on: as one in a random
   order is taken, the rounds are as many as the trie's branchings halve, about the logarithm.
3. *Splitting.* All depths at which an edge was left are cut at once.

Last, edges are expanded: every depth of every edge is a node of the uncompacted trie.

Nothing is held by key in a task: sequences are rows (sequence, depth, key), so a sequence may be of
any length; equal sequences are one from the start, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import dense_index
from ..session import scratch_path

#: Each batch takes this many parts in 16 of the sequences, in the order of a hash.
BATCHES = (2, 14)
#: Depths summed up in one window, and members' ids joined to one text.
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    at = scratch_path(df.sparkSession, f"trie-{name}")
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def number_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(cid, place from 1, letter, bytes) of every turn of a conversation with an id, ordered by turn.

    A null turn comes first, null roles and texts are empty. Turns of one number are in the order of
    their digest. A letter is the digest of role and text. The rows are numbered by a sort of all, so a
    conversation may be of any length.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    letters = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("cid"),
        F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("letter"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = dense_index(letters, [F.col("cid"), F.col("turn").asc_nulls_first(), F.col("letter")], "row")
    first = numbered.groupBy("cid").agg(F.min("row").alias("first"))
    return numbered.join(first, "cid").select("cid", (F.col("row") - F.col("first") + 1).alias("place"), "letter", "bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """(cid, depth, key, bytes, total) from (cid, place, letter, bytes), places gapless from 1.

    ``key`` tells a prefix of any sequence from all others; ``total`` sums ``bytes`` up to the depth. The
    sums go by blocks of ``BLOCK`` places, then inside each.
    """
    hashed = turns.select(
        "cid", F.col("place").alias("depth"), "bytes",
        F.floor(F.col("place") / BLOCK).alias("block"),
        *[F.xxhash64(F.lit(seed), "place", "letter").cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)],
    )
    summed = ["h1", "h2", "bytes"]
    before = Window.partitionBy("cid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("cid", "block").agg(*[F.sum(c).alias(c) for c in summed])
    offsets = blocks.select("cid", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in summed])
    inside = Window.partitionBy("cid", "block").orderBy("depth")
    local = hashed.select("cid", "block", "depth", "bytes", *[F.sum(c).over(inside).alias(f"in_{c}") for c in summed])
    total = {c: F.col(f"in_{c}") + F.col(f"before_{c}") for c in summed}
    key = F.unhex(F.md5(F.concat_ws(":", F.col("depth").cast("string"), *[total[c].cast("string") for c in ("h1", "h2")]).cast("binary")))
    return local.join(offsets, ["cid", "block"]).select("cid", "depth", key.alias("key"), "bytes", total["bytes"].cast("long").alias("total"))


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zero bits, low < high."""
    return F.expr(f"shiftleft(shiftright({high}, length(bin({low} ^ {high})) - 1), length(bin({low} ^ {high})) - 1)")


class Trie:
    """The compacted trie of sequences with prefixes (cid, depth, key, ...), and the sequences in it.

    ``nodes`` has (via, top, depth, handle, first, key): the keys of the handle, of the first letter below
    ``top``, and of the whole.
    """

    def __init__(self, known: DataFrame):
        self.known = known.select("cid", "depth", "key")
        self.nodes = known.sparkSession.createDataFrame([], "via long, top long, depth long, handle binary, first binary, key binary")
        self.empty = True
        self.rounds: list[int] = []

    def key_at(self, rows: DataFrame, cid: str, depth: str, name: str) -> DataFrame:
        """``rows`` with the key of prefix ``depth`` of sequence ``cid``; null if there is none."""
        at = self.known.select(F.col("cid").alias("__cid"), F.col("depth").alias("__depth"), F.col("key").alias(name))
        return rows.join(at, (F.col(cid) == F.col("__cid")) & (F.expr(depth) == F.col("__depth")), "left").drop("__cid", "__depth")

    def locate(self, rows: DataFrame, longest: int) -> DataFrame:
        """(cid, length, via, top, depth, low) of each of ``rows`` (cid, length): its exit edge and a depth on it
        that it shares. Where no edge goes on, ``depth`` is null and ``low`` is the depth of the exit.
        """
        if self.empty:
            nothing = [F.lit(None).cast("long").alias(c) for c in ("via", "top", "depth")]
            return rows.select("cid", "length", *nothing, F.lit(0).cast("long").alias("low"))
        # the root has depth 0 and an empty key
        state = rows.select(
            "cid", "length", F.lit(0).cast("long").alias("a"), F.col("length").alias("b"),
            F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("top"), F.lit(None).cast("long").alias("shared"), F.lit(None).cast("binary").alias("whole"),
        )
        by_handle = self.nodes.select(
            F.col("handle").alias("__handle"), F.col("via").alias("__via"), F.col("top").alias("__top"), F.col("depth").alias("__to"), F.col("key").alias("__whole")
        )
        for _ in range(longest.bit_length()):
            probed = self.key_at(state.withColumn("f", F.when(F.col("a") < F.col("b"), two_fattest("a", "b"))), "cid", "f", "probe")
            met = probed.join(by_handle, F.col("probe") == F.col("__handle"), "left")
            hit = F.col("__to").isNotNull()
            # each step is written: a plan of all steps would grow with the sequences
            state = written(met.select(
                "cid", "length",
                F.when(hit, F.col("__to")).otherwise(F.col("a")).alias("a"),
                F.when(~hit & F.col("f").isNotNull(), F.col("f") - 1).otherwise(F.col("b")).alias("b"),
                F.when(hit, F.col("__via")).otherwise(F.col("via")).alias("via"),
                F.when(hit, F.col("__top")).otherwise(F.col("top")).alias("top"),
                F.when(hit, F.col("f")).otherwise(F.col("shared")).alias("shared"),
                F.when(hit, F.col("__whole")).otherwise(F.col("whole")).alias("whole"),
            ), "search")
        # a is the depth of the deepest node whose handle is a prefix; is the node itself one?
        ends = self.key_at(self.key_at(state, "cid", "a", "own"), "cid", "a + 1", "below")
        through = (F.col("a") == 0) | F.coalesce(F.col("own") == F.col("whole"), F.lit(False))
        asked = ends.withColumn("through", through).withColumn("below", F.when(F.col("through"), F.col("below")))
        by_first = self.nodes.select(F.col("first").alias("__first"), F.col("via").alias("__via"), F.col("top").alias("__top"), F.col("depth").alias("__to"))
        met = asked.join(by_first, F.col("below") == F.col("__first"), "left")
        through = F.col("through")
        return met.select(
            "cid", "length",
            F.when(through, F.col("__via")).otherwise(F.col("via")).alias("via"),
            F.when(through, F.col("__top")).otherwise(F.col("top")).alias("top"),
            F.when(through, F.col("__to")).otherwise(F.col("a")).alias("depth"),
            F.when(through, F.col("a") + F.when(F.col("__to").isNotNull(), 1).otherwise(0)).otherwise(F.col("shared")).alias("low"),
        )

    def along(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``at``, the depth to which each agrees with its edge, from ``low`` on."""
        mine = rows.select("cid", "via", "low", F.least("length", "depth").alias("most")).join(self.known, "cid")
        mine = mine.filter((F.col("depth") > F.col("low")) & (F.col("depth") <= F.col("most"))).select("cid", "via", "depth", "key")
        edge = self.known.select(F.col("cid").alias("via"), "depth", "key")
        agreed = mine.join(edge, ["via", "depth", "key"]).groupBy("cid").agg(F.count("*").alias("__n"))
        return rows.join(agreed, "cid", "left").withColumn("at", F.col("low") + F.coalesce("__n", F.lit(0))).drop("__n")

    def insert(self, rows: DataFrame) -> None:
        """Add sequences ``rows`` (cid, length; length at least 1), none of them in the trie."""
        longest = rows.agg(F.max("length")).first()[0]
        if longest is None:
            return
        left = written(self.along(self.locate(rows, int(longest))), "exits")
        leaves, cuts = [], []
        while True:
            cuts.append(left.filter("at < depth").select("via", "depth", F.col("at").alias("cut")))
            going = self.key_at(left.filter("at < length"), "cid", "at + 1", "letter").select("cid", "length", "at", "letter")
            chosen = going.groupBy("letter").agg(F.min(F.struct(F.xxhash64("cid").alias("__order"), F.col("cid").alias("via"), F.col("length").alias("depth"), F.col("at").alias("top"))).alias("c"))
            leaf = written(chosen.select("letter", "c.via", "c.top", "c.depth"), "leaves")
            leaves.append(leaf.select("via", "top", "depth"))
            rest = going.join(leaf, "letter").filter("cid != via").select("cid", "length", "via", "top", "depth", (F.col("at") + 1).alias("low"))
            left = written(self.along(rest), "left")
            n = left.count()
            self.rounds.append(n)
            if not n:
                break
        new = leaves[0]
        for leaf in leaves[1:]:
            new = new.union(leaf)
        cut = cuts[0]
        for some in cuts[1:]:
            cut = cut.union(some)
        cut = written(cut.distinct(), "cuts")
        whole = self.nodes.select("via", "top", "depth").union(new)
        # the pieces of an edge run from cut to cut; the last one has its end
        touched = whole.join(cut.select("via", "depth").distinct(), ["via", "depth"], "left_semi")
        ends = cut.withColumn("top", F.lit(None).cast("long")).unionByName(touched.withColumn("cut", F.col("depth")))
        by_cut = Window.partitionBy("via", "depth").orderBy("cut")
        top = F.coalesce(F.lag("cut").over(by_cut), F.min("top").over(Window.partitionBy("via", "depth")))
        pieces = ends.select("via", top.alias("top"), F.col("cut").alias("depth"))
        plain = new.join(cut.select("via", "depth").distinct(), ["via", "depth"], "left_anti")
        changed = pieces.unionByName(plain.select("via", "top", "depth"))
        fat = changed.withColumn("__fat", two_fattest("top", "depth"))
        keyed = self.key_at(self.key_at(self.key_at(fat, "via", "__fat", "handle"), "via", "top + 1", "first"), "via", "depth", "key").drop("__fat")
        same = self.nodes.join(cut.select("via", "depth").distinct(), ["via", "depth"], "left_anti")
        self.nodes = written(same.unionByName(keyed), "nodes")
        self.empty = False


def build(sequences: DataFrame, known: DataFrame, batches: tuple[int, ...] = BATCHES) -> Trie:
    """The trie of ``sequences`` (cid, length), batch by batch in the order of a hash."""
    trie, low, parts = Trie(known), 0, sum(batches)
    part = F.pmod(F.xxhash64(F.lit("batch"), "cid"), F.lit(parts))
    for size in batches:
        trie.insert(sequences.filter((F.col("length") > 0) & (part >= low) & (part < low + size)))
        low += size
    return trie


def _sha_of_ids(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, cid): the digest of the ids in order, joined by commas.

    Ids are joined to texts where a sort of all has put them, by at most ``BLOCK``; only these texts meet
    by key, in order, and a digest takes up one at a time. A digest is sequential, so a key's texts pass
    through one task, but no task holds them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def text() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["key", "least", "ids"])

        for batch in batches:
            out: list[pa.RecordBatch] = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == BLOCK):
                    out.append(text())
                    ids = []
                key = k
                ids.append(i)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if ids:
            yield text()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    texts = members.select("key", "cid").repartitionByRange("key", "cid").sortWithinPartitions("key", "cid").mapInArrow(join, "key binary, least bigint, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "least").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Every node of the trie of sequences: the prefixes of ``members`` (cid, length) as given by ``turns``
    (cid, place, letter, bytes), places gapless from 1; a member may have no turn.

    Columns, one row for each distinct prefix, the empty one included: key (null at the root), conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (sum over the
    subtree of (members - 1) x bytes of the last turn), ends_sha256 (ids of the members that end there,
    ascending, joined by commas). No member gives no row.
    """
    every = written(prefixes(turns), "prefixes")
    members = written(
        members.select("cid", "length")
        .join(every.select("cid", F.col("depth").alias("length"), F.col("key")), ["cid", "length"], "left")
        .select("cid", "length", "key"),
        "members",
    )
    alike = members.groupBy("key", "length").agg(F.min("cid").alias("cid"), F.count("*").alias("copies"))
    sequences = written(alike, "sequences")
    known = written(every.join(sequences.select("cid"), "cid", "left_semi"), "known")
    trie = build(sequences.select("cid", "length"), known)
    total = known.select(F.col("cid").alias("via"), F.col("depth").alias("__at"), F.col("key").alias("__key"), F.col("total").alias("__total"))

    # each edge with its parent's key and the bytes above it and in it
    def at(rows: DataFrame, depth: str, key: str, bytes_: str) -> DataFrame:
        there = total.select("via", F.col("__at").alias(depth), F.col("__key").alias(key), F.col("__total").alias(bytes_))
        return rows.join(there, ["via", depth], "left")

    edges = at(at(trie.nodes.select("via", "top", "depth", "key"), "top", "parent", "above"), "depth", "__same", "upto").drop("__same")
    edges = written(edges.withColumn("above", F.coalesce("above", F.lit(0))), "edges")
    children = edges.groupBy("parent").agg(F.count("*").alias("n_children"))

    # what passes through a node: the sequences with a prefix that is a node
    passing = known.select("cid", "key").join(edges.select("key", "depth"), "key").join(sequences.select("cid", "copies"), "cid")
    passing = written(passing, "passing")
    sizes = passing.groupBy("key").agg(F.sum("copies").alias("n_convs"), F.min("cid").alias("conv_id"))
    sized = edges.join(sizes, "key").join(children.filter("parent is not null").withColumnRenamed("parent", "key"), "key", "left")
    sized = written(
        sized.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * (F.col("upto") - F.col("above"))),
        "sized",
    )
    # an edge's worth counts once, with the sequence it goes by; sums from the end of a sequence up
    worth = passing.join(sized.select("key", "via", "leaf", "saved"), "key").withColumn("saved", F.when(F.col("cid") == F.col("via"), F.col("saved")).otherwise(0))
    up = Window.partitionBy("cid").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = worth.select("key", F.sum("leaf").over(up).alias("leaf"), F.sum("saved").over(up).alias("saved"))
    below = below.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("under"))
    ends = _sha_of_ids(members.filter("length > 0"))
    root_ends = _sha_of_ids(members.filter("length = 0").withColumn("key", F.unhex(F.lit("00")))).select(F.col("ends_sha256"))
    root = (
        members.agg(F.count("*").alias("n_convs"), F.min("cid").alias("conv_id"))
        .filter("n_convs > 0")
        .crossJoin(F.broadcast(sized.agg(F.sum(F.when(F.col("top") == 0, 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))))
        .crossJoin(F.broadcast(root_ends.agg(F.max("ends_sha256").alias("ends_sha256"))))
    )
    root = written(root, "root")
    above = sized.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = sized.join(below, "key").join(above, "parent", "left").join(ends, "key", "left").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("root_conv_id"))))
    full = full.select(
        "via", "top", "depth", "above", "conv_id", F.coalesce("parent_conv_id", "root_conv_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "under", "ends_sha256",
    )
    # expand: every depth of an edge, block by block
    starts = full.withColumn("__start", F.explode(F.sequence(F.col("top") + 1, F.col("depth"), F.lit(BLOCK).cast("long"))))
    spread = starts.withColumn("at", F.explode(F.sequence(F.col("__start"), F.least(F.col("__start") + BLOCK - 1, F.col("depth")))))
    there = known.select(F.col("cid").alias("via"), F.col("depth").alias("at"), F.col("key"), F.col("bytes"), F.col("total"))
    nodes = spread.join(there, ["via", "at"])
    last, first = F.col("at") == F.col("depth"), F.col("at") == F.col("top") + 1
    expanded = nodes.select(
        "key",
        "conv_id",
        F.col("at").alias("depth"),
        F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("under") - (F.col("n_convs") - 1) * (F.col("total") - F.col("bytes") - F.col("above"))).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).otherwise(EMPTY_SHA256).alias("ends_sha256"),
    )
    top = root.select(
        F.lit(None).cast("binary").alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    return top.unionByName(expanded)
