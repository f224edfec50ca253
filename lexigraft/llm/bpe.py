"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A text is cut by the vocabulary's pattern; each match is merged on its own. The tree has a leaf for
each byte position that holds the rank of the pair starting there, so its root is the leftmost pair
of least rank. A merge joins that pair and updates three leaves (the pair itself, the pair before it
and the leaf that goes) on their way to the root, which costs the logarithm of the match's length,
also in a match of a million letters. Matches of up to 64 bytes are merged many at a time, one tree
per row of a matrix; longer ones have a tree of their own.

Words repeat, so each Python worker keeps what it has encoded, up to ``CACHE_WORDS`` words or
``CACHE_BYTES``; the memo is emptied when full and never changes a result.

``round_trip`` encodes, decodes and digests in one Arrow function: one Python worker a core holds the
vocabulary, and ids go to the JVM only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_parts

CACHE_WORDS = 200_000
CACHE_BYTES = 40 << 20
#: What an entry of the memo takes besides its characters and ids.
_ENTRY_BYTES = 160
BATCH_BYTES = 1 << 20
_NONE = np.int64(1) << 62
#: An empty leaf of the trees in a matrix, whose others are rank << 8 | position.
_NO_LEAF = np.int32(2**31 - 1)
_WIDEST = 64
_ROWS = 4096
#: A blank after white space, or at the start.
_DOUBLE = re.compile(r"(?:^|\s) ")
#: Marks that make one match where they end a word, and the first letter beyond those taken without the pattern.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_BEYOND = "\u0250"


class BytePairs:
    """Ranks of a byte-level BPE vocabulary, fewer than 2**23; a token's rank is its id.

    The pattern has to match letters with the blank before them as one, and marks (no apostrophe) that
    end a word as another; then words of both need not go through it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: each id as the digest of ids has it: decimal, with a comma behind
        self.decimals = [b"%d," % i for i in range(len(self.tokens))]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, _NONE)
        self.pair_ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int64), _NONE)
        if len(self.tokens) >= 1 << 23:
            raise ValueError("a vocabulary has fewer than 8,388,608 ids")
        every = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        #: leaf value, without its position, of each pair of bytes
        self.byte_leaves = self._leaves(*every)
        self.words: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _leaves(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self._pair_rank(left.astype(np.int64), right)
        return np.where(rank < _NONE, rank << 8, _NO_LEAF).astype(np.int32)

    def merge_long(self, piece: bytes) -> list[int]:
        """One match of any length: a segment tree in a list."""
        ranks, tokens = self.ranks, self.tokens
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = int(_NONE)
        parts = [piece[i : i + 1] for i in range(n)]
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        def pair(i: int) -> int:
            j = after[i]
            rank = ranks.get(parts[i] + parts[j]) if j < n else None
            return none if rank is None else rank << 32 | i

        while tree[1] != none:
            rank, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            gone = after[i]
            parts[i], parts[gone] = tokens[rank], b""
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [ranks[p] for p in parts if p]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Matches of at most ``width`` (a power of two) bytes: a tree per row, all rows merge at once.

        Gives the ids as little-endian 32-bit integers.
        """
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int32, rows)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.zeros((rows, width + 1), np.int32)
        inside = np.arange(width + 1, dtype=np.int32) < lengths[:, None]
        ids[inside] = self.byte_ids[raw]
        tree = np.full((rows, 2 * width), _NO_LEAF)
        at = np.arange(width, dtype=np.int32)
        has_pair = at < lengths[:, None] - 1
        both = raw[:-1].astype(np.int32) << 8 | raw[1:]
        within = np.ones(raw.size, np.bool_)
        within[np.cumsum(lengths) - 1] = False
        tree[:, width:][has_pair] = self.byte_leaves[both[within[:-1]]]
        tree[:, width:] |= np.where(tree[:, width:] < _NO_LEAF, at, 0)
        for low in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (rows, width + 1)).copy()
        live = inside.copy()
        leaves, cells = 2 * width, width + 1
        flat, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        active = np.nonzero(tree[:, 1] < _NO_LEAF)[0]
        while active.size:
            top = tree[active, 1]
            i, start = top & 255, active * cells
            here = start + i
            gone = flat_after[here]
            flat_ids[here] = top >> 8
            live[active, gone] = False
            follows = flat_after[start + gone]
            flat_after[here] = follows
            flat_before[start + np.minimum(follows, width)] = i
            # the pair that starts here, if a part follows, and the one that ends here, if a part precedes
            on, back = np.nonzero(follows < lengths[active])[0], np.nonzero(flat_before[here] >= 0)[0]
            ahead = flat_before[here[back]]
            pair = self._leaves(
                flat_ids[np.concatenate([here[on], start[back] + ahead])], flat_ids[np.concatenate([start[on] + follows[on], here[back]])]
            )
            value = np.full(active.size, _NO_LEAF)
            value[on] = pair[: on.size]
            # three leaves and their ways to the root, level by level
            base = active * leaves + width
            flat[base + gone] = _NO_LEAF
            flat[base + i] = np.where(value < _NO_LEAF, value | i, _NO_LEAF)
            value = pair[on.size :]
            flat[base[back] + ahead] = np.where(value < _NO_LEAF, value | ahead, _NO_LEAF)
            root = np.concatenate([active, active, active[back]]) * leaves
            node = np.concatenate([gone, i, ahead]) + width
            for _ in range(width.bit_length() - 1):
                child = root + (node & ~1)
                node >>= 1
                flat[root + node] = np.minimum(flat[child], flat[child + 1])
            active = active[tree[active, 1] < _NO_LEAF]
        ends = np.cumsum(live.sum(axis=1) * 4).tolist()
        kept = ids[live].tobytes()
        return [kept[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge(self, pieces: Iterable[str]) -> dict[str, bytes]:
        by_width: dict[int, list[str]] = {}
        done: dict[str, bytes] = {}
        for p in pieces:
            n = len(p) if p.isascii() else len(p.encode())
            if n > _WIDEST:
                done[p] = np.array(self.merge_long(p.encode()), np.int32).tobytes()
            else:
                by_width.setdefault((n - 1).bit_length(), []).append(p)
        for power, some in by_width.items():
            for start in range(0, len(some), _ROWS):
                part = some[start : start + _ROWS]
                done.update(zip(part, self.merge_many([p.encode() for p in part], 1 << power), strict=True))
        return done

    @staticmethod
    def _words(text: str) -> list[str]:
        """Cut at a blank that follows a visible character: no match of the pattern goes across.

        The first word is kept as it is; the blank before each further one is left out.
        """
        words = text.split(" ")
        if _DOUBLE.search(text):
            kept = words[:1]
            for w in words[1:]:
                if kept[-1] and not kept[-1][-1].isspace():
                    kept.append(w)
                else:
                    kept[-1] += " " + w
            words = kept
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self._words(t) for t in texts]
        first, rest = [words[0] for words in cut], [words[1:] for words in cut]
        new = set().union(*rest).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.words, self.held = {}, 0
            new = set().union(*rest)
        # letters are one match with their blank, and marks behind them another
        ahead: dict[str, str] = {}
        mixed: dict[str, list[str]] = {}
        for w in new:
            letters = w.rstrip(_MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < _BEYOND):
                ahead[w] = letters
            else:
                mixed[w] = self.find(" " + w)
        starts = {w: self.find(w) for w in first}
        words = self.words
        cores = list(set(ahead.values()).difference(words))
        spaced = [" " + w for w in cores]
        tails = {w: w[len(letters) :] for w, letters in ahead.items() if len(letters) < len(w)}
        merged = self._merge({*spaced, *tails.values()}.union(*mixed.values(), *starts.values()))
        fresh = dict(zip(cores, map(merged.__getitem__, spaced), strict=True))
        words.update(fresh)
        marked = {w: words[ahead[w]] + merged[tail] for w, tail in tails.items()}
        other = {w: b"".join([merged[p] for p in found]) for w, found in mixed.items()}
        words.update(marked)
        words.update(other)
        for some in (fresh, marked, other):
            self.held += sum(map(len, some)) + sum(map(len, some.values())) + _ENTRY_BYTES * len(some)
        if self.held > CACHE_BYTES:  # letters that are no word of these texts need not stay
            for w in fresh.keys() - new:
                self.held -= len(w) + len(words.pop(w)) + _ENTRY_BYTES
        get = words.__getitem__
        return [
            np.frombuffer(b"".join([*map(merged.__getitem__, starts[w]), *map(get, some)]), np.int32)
            for w, some in zip(first, rest, strict=True)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> BytePairs:
    """The vocabulary of this Python process."""
    return BytePairs.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row.

    A null or empty text has no ids. Repeated rows give repeated rows; the id may be null. Other
    columns are not read, so their names cannot clash. Memory: a batch is worked off in parts of
    about ``BATCH_BYTES``; a longer text stands alone and needs about 20 times its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for a, texts in text_parts(batch.column(1), BATCH_BYTES):
                ids = bpe.encode(texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), column], [id_col, "ids"])
        release()

    some = docs.select(id_col, F.col(text_col).cast("string"))
    return some.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every column of ``encoded`` and the bytes of its ids, in ``out_col`` (which it replaces if there).

    Null ids give null; an id outside the vocabulary fails the job.
    """

    @F.arrow_udf("binary")
    def read(ids: pa.Array) -> pa.Array:
        bpe = vocabulary(path, pattern)
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), [0 if n is None else n for n in pc.list_value_length(ids).to_pylist()]
        cuts = np.cumsum([0, *ends])
        release()
        return pa.array([None if null else bpe.decode(flat[a:b]) for a, b, null in zip(cuts, cuts[1:], ids.is_null().to_pylist(), strict=False)], pa.binary())

    return encoded.withColumn(out_col, read(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` if asked for) of every row.

    The digests are of the decimal ids joined by commas and of the bytes that they decode to, in lower-case
    hexadecimal digits. A null or empty text has no ids and the digests of nothing. Otherwise as ``encode``
    and ``decode``, in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        decimal, token = bpe.decimals.__getitem__, bpe.tokens.__getitem__
        for batch in batches:
            for a, texts in text_parts(batch.column(1), BATCH_BYTES):
                ids = bpe.encode(texts)
                lists = [x.tolist() for x in ids]
                columns = [
                    batch.column(0).slice(a, len(texts)),
                    pa.array(list(map(len, ids)), pa.int64()),
                    pa.array([hashlib.sha256(b"".join(map(decimal, x))[:-1]).hexdigest() for x in lists], pa.string()),
                    pa.array([hashlib.sha256(b"".join(map(token, x))).hexdigest() for x in lists], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                del lists
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names])
            release()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, kinds)
