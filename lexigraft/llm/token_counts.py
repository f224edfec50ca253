"""Token counts of whole texts under a public tokenizer, without moving the tokens themselves.

An Arrow function encodes batches of about ``CALL_BYTES`` and returns lengths only. For a sentence
piece vocabulary a text is first cut into chunks of at least ``CHUNK_BYTES`` characters at safe
boundaries: a blank inside the text that follows a visible character. No piece of such a vocabulary goes across
one, and the blank itself comes back as the prefix that the library puts before each text, so the
chunks' counts add up to the text's. A vocabulary for which that does not hold is not cut.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import spans_by_bytes, text_parts

CHUNK_BYTES = 64
CALL_BYTES = 1 << 18
_BAR = "▁"


def chunks(text: str, least: int) -> list[str]:
    """Cut at each first safe blank from ``least`` characters on; the blank is left out."""
    out, start, n = [], 0, len(text)
    at = text.find(" ", least)
    while at != -1:
        if 0 < at < n - 1 and text[at - 1] not in (" ", _BAR):
            out.append(text[start:at])
            start = at + 1
            at = text.find(" ", max(start + least, at + 1))
        else:
            at = text.find(" ", at + 1)
    out.append(text[start:n])
    return out


class Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        crossing = any(re.search(f"[^{_BAR}]{_BAR}", self.model.id_to_piece(i)) for i in range(n))
        whole, parts = self.model.encode("an b  c"), self.model.encode(["an", "b", " c"])
        self.safe = not crossing and whole == [i for p in parts for i in p]

    def cut(self, text: str) -> list[str]:
        return chunks(text, CHUNK_BYTES) if self.safe else [text]

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))


class Fast:
    """A tokenizers file; special strings in a text are ordinary text only if the file says so."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def cut(self, text: str) -> list[str]:
        return [text]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Pieces | Fast:
    return Pieces(path) if path.endswith(".model") else Fast(path)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    model = tokenizer(path)
    cut = [model.cut(t) for t in texts]
    flat = [c for some in cut for c in some]
    found: list[int] = []
    for a, b in spans_by_bytes(list(map(len, flat)), CALL_BYTES):
        found += model.lengths(flat[a:b])
    ends = np.cumsum([0, *map(len, cut)])
    total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of ``text`` under the tokenizer file at ``path`` (.model or .json).

    Null and empty texts have what the library gives for an empty text. No special tokens are added,
    nothing is truncated. Memory: a text's chunks plus one call's tokens.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(count_texts(part, path) for _, part in text_parts(texts))]))

    return counted(text.cast("string"))
