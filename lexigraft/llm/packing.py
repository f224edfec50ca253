"""Packing tokenized documents into sequences of bounded length: hierarchical residual best fit.

1. Documents are tokenized and closed by an end token; only what is longer than a sequence is cut. A
   table of pieces is written, and from there on a piece is a number and a length.
2. The pieces are dealt out to groups at random. Each group packs its own, longest first, each into
   the fullest bin that takes it (best fit decreasing). After that no two bins of a group fit together.
3. Bins with at most ``SLACK`` tokens to spare are emitted. The underfull ones of several groups are
   brought together, and are now the items: they are packed like pieces, and so on up the tree, until
   one group is left. If so many stay open that merged groups would pass ``GROUP`` items, groups are
   merged less; if they can't be merged at all, no two of the many bins inside them fit together, and
   what is open is emitted as it is.
4. A bin is called by its first piece. Each level is a table (bin, bin that takes it, place there),
   and a piece's place is the sum of the places on its way up.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import release, text_parts
from .token_counts import chunks

LIMIT = 2048
END = 0
#: A bin with so many tokens to spare, or fewer, is emitted before the last level.
SLACK = 4
#: Items of a group: those of one task.
GROUP = 1 << 17
#: Groups that meet on the next level, at least.
FAN_IN = 8
CHUNK = 1 << 15
#: Matches that a Python worker remembers, of up to ``MEMO_LENGTH`` characters: about 32 MB.
MEMO = 160_000
MEMO_LENGTH = 32

#: What a file has to say so that its matches may be looked up one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: White space below code point 256, as it stands in a class of characters.
_LATIN_SPACE = "\t-\r \x85\xa0"


def byte_signs() -> list[str]:
    """The visible sign of each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + hidden.index(b)) for b in range(256)]


class WordPieces:
    """A tokenizers file. Ids are little-endian unsigned 32-bit integers.

    Texts are encoded in chunks that end at a blank, which no match of such a vocabulary contains. A
    chunk of characters below 256 (they are in normal form) is cut by the file's own pattern, and each
    match is looked up or given to the model; any other chunk goes through the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said["added_tokens"]]
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        self.by_match = (
            (said["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and steps[1:] == [_BYTES]
            and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
            and not any(said["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "unk_token"))
            and said["post_processor"] is None
        )
        self.cut_at_blanks = self.by_match and not any(" " in s for s in self.special)
        self.find = _latin_pattern(split["pattern"]["Regex"]).findall if self.by_match else None
        self.signs = byte_signs()
        self.memo = _Memo(self._match)

    def _match(self, found: str) -> bytes:
        signs = found if found.isascii() and found.isprintable() else "".join([self.signs[b] for b in found.encode()])
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _chunk(self, text: str) -> bytes:
        if not self.by_match or not _is_latin(text) or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.find(text.lower())))

    def encode(self, text: str) -> bytes:
        parts = chunks(text, CHUNK) if self.cut_at_blanks and len(text) > CHUNK else [text]
        return b"".join([self._chunk(p) for p in parts])


class _Memo(dict):
    """Ids by match; a match that is not known is made, and kept if it is short."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, found: str) -> bytes:
        ids = self.make(found)
        if len(found) <= MEMO_LENGTH:
            self[found] = ids
        return ids


def _latin_pattern(pattern: str) -> re.Pattern[str]:
    """``pattern`` for characters below 256: its classes of letters, numbers and white space are spelled out."""
    import regex

    signs = list(map(chr, range(256)))
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(name, "".join(re.escape(c) for c in signs if regex.match(name, c)))
    return re.compile(pattern.replace(r"\s", _LATIN_SPACE))


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """The vocabulary of this Python process."""
    return WordPieces(path)


def encode_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of every row: its token ids and the id ``end``, cut every ``limit`` ids.

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``start`` counts the document's ids before
    the piece. No special tokens are added, special strings in a text become their tokens, as the library
    has it. A null or empty text is the end id alone. Repeated rows give repeated rows, the id may be null,
    other columns are not read. A long text is encoded chunk by chunk and needs 4 bytes an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, close = word_pieces(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for a, texts in text_parts(batch.column(1)):
                ids = [model.encode(t) + close for t in texts]
                rows = [(a + i, k) for i, x in enumerate(ids) for k in range(0, len(x), 4 * limit)]
                cut = [ids[i - a][k : k + 4 * limit] for i, k in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                        pa.array([k // (4 * limit) for _, k in rows], pa.int32()),
                        pa.array([k // 4 for _, k in rows], pa.int64()),
                        pa.array([len(c) // 4 for c in cut], pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    [id_col, "piece", "start", "length", "ids"],
                )
            release()

    some = docs.select(id_col, F.col(text_col).cast("string"))
    return some.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids binary")


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first item of its bin, place in the bin, fill of the bin) of each item; sizes 1 to ``limit`` in falling order.

    Each item goes into the fullest bin that takes it. Bins stand in a list for each number of tokens to
    spare; a bit mask tells which lists have any, so that the best one is the lowest bit from the size on.
    """
    spare: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    bins: list[int] = []
    places: list[int] = []
    free: dict[int, int] = {}
    for item, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            home = spare[room].pop()
            if not spare[room]:
                mask ^= 1 << room
        else:
            room, home = limit, item
        left = room - size
        bins.append(home)
        places.append(limit - room)
        free[home] = left
        if left:
            if not spare[left]:
                mask |= 1 << left
            spare[left].append(home)
    first = np.array(bins, np.int64)
    return first, np.array(places, np.int64), limit - np.array([free[b] for b in bins], np.int64)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(piece_id, sequence_id, place) of every row of ``pieces`` (piece_id long, unique; length, 1 to ``limit``).

    ``pieces`` should be a written table, as it is read several times. A sequence is called by its first
    piece; places leave no gap. The result follows from the ids and lengths alone. An empty table
    gives no rows; a length outside 1 to ``limit`` fails the job.
    """
    spark = pieces.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        at = scratch_path(spark, f"pack-{name}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    def put(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        first, place, fill = best_fit(group["fill"].to_numpy(), limit)
        ids = group["bin"].to_numpy()
        return pd.DataFrame({"bin": ids, "home": ids[first], "place": place, "fill": fill, "part": group["part"].to_numpy()})

    legal = F.when(F.col("length").between(1, limit), F.col("length")).otherwise(F.raise_error(F.lit(f"lengths have to be 1 to {limit}")))
    items = pieces.select(F.col("piece_id").alias("bin"), legal.cast("long").alias("fill"))
    open_ = items.filter(f"fill < {limit}")
    count = open_.count()
    parts = max(1, -(-count // GROUP))
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(parts)))
    levels = []
    while count:
        level = written(open_.groupBy("part").applyInPandas(put, "bin long, home long, place long, fill long, part long"), f"level{len(levels)}")
        levels.append(level.select("bin", "home", F.col("place").alias("__place")))
        open_ = level.filter((F.col("place") == 0) & (F.col("fill") < limit - SLACK)).select(F.col("home").alias("bin"), "fill", "part")
        count = open_.count()
        fewer = max(-(-parts // FAN_IN), -(-count // GROUP))
        if fewer >= parts:
            break
        open_ = open_.withColumn("part", F.floor(F.col("part") * fewer / parts).cast("long"))
        parts = fewer
    placed = pieces.select("piece_id", F.col("piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("place"))
    for level in levels:
        up = placed.join(level, F.col("sequence_id") == F.col("bin"), "left")
        placed = up.select(
            "piece_id", F.coalesce("home", "sequence_id").alias("sequence_id"), (F.col("place") + F.coalesce("__place", F.lit(0))).alias("place")
        )
    return placed


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids) from pieces (piece_id, ids) and their places: the ids of each sequence in order.

    A sequence has at most as many pieces as ids, so no group is large.
    """
    joined = pieces.select("piece_id", "ids").join(placed, "piece_id")
    parts = F.array_sort(F.collect_list(F.struct("place", "ids")))
    grouped = joined.groupBy("sequence_id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return grouped.select("sequence_id", F.size("parts").cast("long").alias("n_pieces"), whole.alias("ids"))


def with_piece_ids(pieces: DataFrame) -> DataFrame:
    """The written table of ``pieces`` with a unique number for each row in ``piece_id``."""
    at = scratch_path(pieces.sparkSession, "pack-pieces")
    pieces.withColumn("piece_id", F.monotonically_increasing_id()).write.parquet(at)
    return pieces.sparkSession.read.parquet(at)
