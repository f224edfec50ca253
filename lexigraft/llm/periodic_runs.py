"""Periodic runs of words: maximal repetitions found on an enhanced suffix array.

A run is a stretch of words with smallest period q and at least two periods that no neighbouring word
extends. The last square of a run stands at a pair of places i and i + q whose suffixes share exactly
q words, a branching tandem. Two suffixes that share exactly d words lie on the two sides of a split
of an LCP interval of depth d. So, for each split, the suffixes of its smaller side look up in the
inverse suffix array whether the suffix d words on, or d words back, lies on the other side. That is
n log n look-ups, on arrays alone. Each branching square is rotated to the left as long as the words
d apart agree, and squares that grow into the same stretch are merged under their least period.

Everything is numpy over many texts at once: a word's symbol differs from text to text, so that no
two texts share a suffix and one array serves them all. The suffix array comes from names of
substrings of 1, 2, 4, ... words; only names that occur twice are refined. The names also give
common prefixes and common suffixes of two places in as many steps as there are levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, spans_by_bytes

#: Words that a run has at least.
LEAST = 12
BATCH_BYTES = 4 << 20
#: Suffixes that are looked up at a time.
LOOKUPS = 1 << 20
POINTER_ROUNDS = 64

Runs = list[tuple[int, int, int]]


def names(symbols: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Level k names the substring of 2**k symbols at each place by its rank; equal names, equal strings.

    What reaches over the end is told apart. The last level is the inverse suffix array unless
    ``levels`` stops it. Each level ends with a cell of -1 that stands for the place after the last.
    """
    n = len(symbols)
    _, first = np.unique(symbols, return_inverse=True)
    counts = np.bincount(first)
    rank = np.append((np.cumsum(counts) - counts)[first], -1).astype(np.int64)
    out = [rank.astype(np.int32)]
    open_ = np.nonzero(counts[first] > 1)[0]
    width = 1
    while open_.size and (levels is None or len(out) < levels):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + width, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        group = rank[open_]
        at = np.arange(open_.size)
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        key_start = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[open_] = group + key_start - group_start
        out.append(rank.astype(np.int32))
        alone = new_key & np.append(new_key[1:], True)
        open_ = open_[~alone]
        width *= 2
    return out


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal symbols from places ``a`` and ``b`` on."""
    n = len(levels[0]) - 1
    a, b = a.astype(np.int64), b.astype(np.int64)
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal symbols before places ``a`` < ``b``, going back."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        back = a - (1 << k)
        same = (back >= 0) & (levels[k][np.maximum(back, 0)] == levels[k][np.maximum(b - (1 << k), 0)])
        a[same] -= 1 << k
        b[same] -= 1 << k
    return start - a


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each cell the last one before it that is smaller; cell 0 has to be below all others.

    Pointers are doubled; what is left after ``POINTER_ROUNDS``, on long falling stretches, goes by a stack.
    """
    before = np.maximum(np.arange(-1, len(values) - 1), 0)
    todo = np.nonzero(values[before] >= values)[0][1:]
    for _ in range(POINTER_ROUNDS):
        if not todo.size:
            return before
        before[todo] = before[before[todo]]
        todo = todo[values[before[todo]] >= values[todo]]
    if todo.size:
        stack, cells = [0], values.tolist()
        for s in range(1, len(cells)):
            while cells[stack[-1]] >= cells[s] and len(stack) > 1:
                stack.pop()
            before[s] = stack[-1]
            stack.append(s)
    return before


def branching_tandems(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places i, depths d): the suffixes at i and i + d share exactly d symbols."""
    isa = levels[-1][:-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    # lcp[s] is the common prefix of the suffixes s - 1 and s; both ends are below all
    lcp = np.full(n + 1, -1, np.int64)
    close = np.nonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])[0] + 1
    lcp[1:n] = 0
    lcp[close] = common_prefix(levels, sa[close - 1], sa[close])
    before = previous_smaller(lcp)
    end = n - previous_smaller(lcp[::-1])[::-1]
    # the splits of one interval follow each other: the side to the right of a split ends at the next
    split = close[np.lexsort((close, lcp[close], before[close]))]
    low, depth, high = before[split], lcp[split], end[split]
    same = (low[1:] == low[:-1]) & (depth[1:] == depth[:-1])
    high[:-1][same] = split[1:][same]
    left_small = split - low <= high - split
    first, last = np.where(left_small, low, split), np.where(left_small, split, high)
    far_first, far_last = np.where(left_small, split, low), np.where(left_small, high, split)
    sizes = last - first
    ends = np.cumsum(sizes)
    places, depths = [], []
    start = 0
    while start < len(split):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOOKUPS, side="right")))
        some = sizes[start:stop]
        which = np.repeat(np.arange(start, stop), some)
        i = sa[first[which] + np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)]
        d = depth[which]
        for other, at in ((i + d, i), (i - d, i - d)):
            there = (other >= 0) & (other < n)
            rank = isa[np.clip(other, 0, n - 1)]
            there &= (rank >= far_first[which]) & (rank < far_last[which])
            places.append(at[there])
            depths.append(d[there])
        start = stop
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(depths)


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[Runs]:
    """(start, length, period) of every run of ``least`` symbols or more, by start and period, of each text.

    A text is an array of symbols from 0 on. Memory is about 4 bytes times the levels a symbol, and
    100 bytes; there are as many levels as binary digits in the longest repeat.
    """
    out: list[Runs] = [[] for _ in texts]
    # a run of n words repeats at least n / 2 of them: texts without such a repeat are left out
    kept = [j for j, t in enumerate(texts) if len(t) >= least]
    for probe in (True, False):
        if not kept:
            return out
        lengths = np.array([len(texts[j]) for j in kept])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(kept)), lengths)
        vocabulary = np.array([int(texts[j].max()) + 1 for j in kept], np.int64)
        symbols = np.concatenate([texts[j] for j in kept]) + np.repeat(np.cumsum(vocabulary) - vocabulary, lengths)
        if probe:
            level = max(0, ((least + 1) // 2).bit_length() - 1)
            rank = names(symbols, level + 1)[-1][:-1]
            twice = np.bincount(rank, minlength=len(rank))[rank] > 1
            kept = [kept[j] for j in np.unique(owner[twice]).tolist()]
    levels = names(symbols)
    place, period = branching_tandems(levels)
    start = place - common_suffix(levels, place, place + period)
    length = place + 2 * period - start
    long = length >= least
    found = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    # the same stretch under a multiple of its period: the least one comes first
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]
    found = found[first]
    base = np.append(0, ends)[owner[found[:, 0]]] if len(found) else found[:, 0]
    text_of = owner[found[:, 0]].tolist() if len(found) else []
    order = np.lexsort((found[:, 2], found[:, 0]))
    for row in order.tolist():
        out[kept[text_of[row]]].append((int(found[row, 0] - base[row]), int(found[row, 1]), int(found[row, 2])))
    return out


def collapse(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()]


def _symbols(words: list[bytes]) -> np.ndarray:
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(
    docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: each periodic run of ``least`` words or more, by start
    and period, and the text without the repeats, its words joined by one blank.

    Words are runs of anything but ASCII white space. ``rewrite`` may change a row's words (of its id)
    beforehand. A null, empty or blank text has no words, no runs and an empty collapsed text; repeated
    rows give repeated rows, and the id may be null. Other columns are not read. A batch is worked off in
    parts of about ``BATCH_BYTES``; a longer text stands alone and needs about 40 times its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
            for a, b in spans_by_bytes(sizes, BATCH_BYTES):
                some = ids.slice(a, b - a)
                words = [(x or b"").split() for x in column.slice(a, b - a).to_pylist()]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(some.to_pylist(), words, strict=True)]
                found = runs_of([_symbols(w) for w in words], least)
                yield pa.RecordBatch.from_arrays(
                    [
                        some,
                        pa.array(list(map(len, words)), pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(_RUN)),
                        pa.array([b" ".join(collapse(w, r)).decode() for w, r in zip(words, found, strict=True)], pa.string()),
                    ],
                    [id_col, "n_words", "runs", "collapsed"],
                )
            release()

    some = docs.select(id_col, F.col(text_col).cast("string").cast("binary"))
    return some.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words bigint, runs {RUNS_TYPE}, collapsed string")
