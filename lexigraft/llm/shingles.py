"""Word shingles of texts as 128-bit fingerprints, MinHash signatures, and exact shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = 0x5EED
#: A fingerprint: two 64-bit hashes of their own seeds. Signatures are made from the first.
PRINT = np.dtype([("first", np.uint64), ("second", np.uint64)])
_SEEDS = (_SEED, _SEED + 3)


def _draw(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, np.uint64)


_BYTE_VALUES = [_draw(seed, 256) for seed in _SEEDS]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles; fewer words are one shingle, no words none."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def _distinct(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The sorted distinct fingerprints of these halves."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    again = a[1:] == a[:-1]
    if (b[1:] != b[:-1])[again].any():  # different shingles with one first half
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.append(True, ~again)[: a.size]
    out = np.empty(int(new.sum()), PRINT)
    out["first"], out["second"] = a[new], b[new]
    return out


def fingerprints(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct fingerprints of its shingles, of type ``PRINT``.

    A half of a word's value is a sum over its bytes of a random number for the byte times one for the
    place, modulo 2**64; all words of the batch are summed at once.
    """
    data = [t.encode().lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[raw]
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    if not starts.size:
        return [np.zeros(0, PRINT)] * len(texts)
    word = np.cumsum(space[:-1] & ~space[1:])
    place = np.arange(1, raw.size) - starts[np.maximum(word, 1) - 1]
    place[space[1:]] = 0
    words, rolled = [], []
    for seed, of_byte in zip(_SEEDS, _BYTE_VALUES, strict=True):
        values = of_byte[raw[1:]] * _draw(seed + 1, int(place.max(initial=0)) + 1)[place]
        values[space[1:]] = 0
        words.append(_mix(np.add.reduceat(values, starts - 1)))
        roll = np.zeros(max(0, starts.size - k + 1), np.uint64)
        for i in range(k):
            roll = roll * _ODD + words[-1][i : i + roll.size]
        rolled.append(_mix(roll))
    ends = np.cumsum([0, *(len(d) + 1 for d in data)])
    cuts = np.searchsorted(starts, ends + 1)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(_distinct(*[r[a : b - k + 1] for r in rolled]))
        else:
            short = [np.uint64(b - a) * of_byte[:1] for of_byte in _BYTE_VALUES]
            for i in range(a, b):
                short = [s * _ODD + w[i] for s, w in zip(short, words, strict=True)]
            out.append(_distinct(*[_mix(s)[: b - a] for s in short]))
    return out


class MinHash:
    """Signatures of ``bands * rows`` minima, and a key for each band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.Generator(np.random.PCG64(_SEED + 2))
        self.factor = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 2**32, bands * rows, np.uint32)
        self.band_factor = rng.integers(0, 2**63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, prints: np.ndarray) -> np.ndarray:
        x = (prints["first"] >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.factor.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, x.size, _CHUNK):
            part = x[i : i + _CHUNK, None] * self.factor
            part += self.shift
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row of ``signatures`` and band; the band is part of the key."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = (parts * self.band_factor).sum(axis=2, dtype=np.uint64)
        return _mix(key + np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD).view(np.int64)


def digest(prints: np.ndarray) -> bytes:
    return hashlib.blake2b(prints.tobytes(), digest_size=16).digest()
