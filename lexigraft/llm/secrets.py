"""Secret scan: fixed patterns, and random strings found by how badly a vocabulary compresses them.

A byte-level BPE vocabulary needs few tokens for words and many for random strings. A candidate is
a run of at least ``LEAST_CHARS`` key characters outside every base span; it counts as random if it
has fewer than ``CHARS_PER_TOKEN`` characters for each token. Left out before that test are

* known digests and identifiers: hexadecimal strings of an md5, sha1, sha2 or git length, UUIDs,
  numbers and dates;
* words and identifiers: runs of letters that do not mix cases inside, and such runs of three
  letters or more with short numbers (``snake_case``, ``camelCase``, paths), if their letters
  compress like words themselves, to ``WORD_CHARS_PER_TOKEN`` or more.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_parts
from .spans import SPAN_TYPE, by_start

LEAST_CHARS = 16
CHARS_PER_TOKEN = 2.2
WORD_CHARS_PER_TOKEN = 2.0

KINDS = ["assign", "access", "hex", "random"]

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 12, 18

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
# Lengths of md5, sha1, sha224, sha256, sha384 and sha512 in hexadecimal digits.
_DIGESTS = {32, 40, 56, 64, 96, 128}
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile(r"[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4}")
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"[0-9+/_=-]+")


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    found = [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    found += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    found += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    return found


def known(run: str, encode: Callable[[str], list[int]]) -> bool:
    """A digest, an identifier or a word: not a secret whatever its tokens."""
    if _HEXADECIMAL.fullmatch(run) and len(run) in _DIGESTS or _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return True
    letters = []
    for part in re.split(r"[+/_=-]+", run):
        cut = _PART.findall(part)
        if "".join(cut) != part or len(part) > 4 and any(len(c) < 3 and not c.isdigit() for c in cut):
            return False
        # a name of one or two letters says nothing
        if len(part) > 2 or not part.isalpha():
            letters += _LETTERS.findall(part)
    return sum(map(len, letters)) >= WORD_CHARS_PER_TOKEN * sum(len(encode(x)) for x in letters)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def scan_text(text: str, path: str, pattern: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, then random runs that touch none of them, by start and kind."""
    found = base_spans(text)
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    if runs:
        taken = sorted((a, b) for _, a, b, _ in found)
        # the furthest end of the base spans up to each
        reach = list(accumulate((b for _, b in taken), max))
        encode = _encoding(path, pattern).encode_ordinary
        for a, b in runs:
            before = bisect.bisect_left(taken, (b, -1))
            if before and reach[before - 1] > a or known(run := text[a:b], encode):
                continue
            if len(run) < CHARS_PER_TOKEN * len(encode(run)):
                found.append(("random", a, b, False))
    return by_start(found, KINDS)


def find_secrets(text: Column, path: str, pattern: str) -> Column:
    """Spans of ``text`` in code points; null and empty texts have none, repeated rows have the same.

    A text takes time in proportion to its length, and a long one is worked off alone. ``path`` is a tiktoken vocabulary. Kinds: assign, access and hex (``base`` true), random (false).
    """

    @F.arrow_udf(SPAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in scan_text(t, path, pattern)] for _, part in text_parts(texts) for t in part]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return scan(text.cast("string"))
