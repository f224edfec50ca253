"""Media columns: texts kept losslessly as 8-bit grey PNG images, and hashes of their low frequencies.

``write_png`` lays the UTF-8 bytes of a text out in rows of ``WIDTH`` samples, zero bytes filling the
last row, filters them and deflates them into IDAT chunks, each with its checksum. ``read_png`` tests
signature, chunk order and every checksum, inflates and undoes the five filters of the format; rows
with the same vectorizable filter (none, sub, up) are undone together in numpy. ``frequency_hash``
reduces the image to 32 x 32, takes an integer cosine transform and sets a bit for each of the 8 x 8
lowest frequencies above their median; in integers, so that equal images give equal bits anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, spans_by_bytes

WIDTH = 64
BATCH_BYTES = 1 << 20
_LEVEL = 1
_IDAT_BYTES = 1 << 20
# The format's signature and chunk names.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_NONE, _SUB, _UP, _AVERAGE, _PAETH = range(5)

_SIDE, _LOW = 32, 8
_COSINES = np.round(
    4096 * np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))
).astype(np.int64)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(data: bytes, width: int = WIDTH) -> bytes:
    """A grey image of ``data`` and zero bytes up to a positive multiple of ``width``."""
    height = max(1, -(-len(data) // width))
    rows = np.zeros((height, width), np.uint8)
    rows.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    # one filter an image: the one whose differences are smallest in sum
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    choices = ((_NONE, rows), (_SUB, sub), (_UP, up))
    cost = [int(np.minimum(x, -x).sum(dtype=np.int64)) for _, x in choices]
    kind, filtered = choices[int(np.argmin(cost))]
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, filtered
    body = zlib.compress(lines.tobytes(), _LEVEL)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    parts = [body[i : i + _IDAT_BYTES] for i in range(0, len(body), _IDAT_BYTES)]
    return b"".join([_SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", p) for p in parts), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters of 8-bit grey rows, in place."""
    height, width = rows.shape
    cuts = [0, *(np.nonzero(np.diff(kinds))[0] + 1).tolist(), height]
    for a, b in zip(cuts, cuts[1:], strict=False):
        kind, above = kinds[a], rows[a - 1] if a else np.zeros(width, np.uint8)
        if kind == _SUB:
            np.add.accumulate(rows[a:b], axis=1, dtype=np.uint8, out=rows[a:b])
        elif kind == _UP:
            rows[a] += above
            np.add.accumulate(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind in (_AVERAGE, _PAETH):
            for y in range(a, b):
                up = (rows[y - 1] if y else np.zeros(width, np.uint8)).tolist()
                line, left, corner = rows[y].tolist(), 0, 0
                for x in range(width):
                    if kind == _AVERAGE:
                        guess = (left + up[x]) >> 1
                    else:
                        at = left + up[x] - corner
                        guess = min((abs(at - left), 0, left), (abs(at - up[x]), 1, up[x]), (abs(at - corner), 2, corner))[2]
                        corner = up[x]
                    line[x] = left = (line[x] + guess) & 255
                rows[y] = line
        elif kind != _NONE:
            raise ValueError(f"unknown filter {kind}")
    return rows


def read_png(image: bytes) -> np.ndarray:
    """The samples of an 8-bit grey, not interlaced image; ValueError if anything in it is damaged."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, kinds, head, body = 8, [], b"", []
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("cut off")
        (size,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        stated = image[at + 8 + size : at + 12 + size]
        if len(stated) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", stated)[0]:
            raise ValueError(f"checksum of chunk {len(kinds)} is wrong")
        kinds.append(kind)
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    if not kinds or kinds[0] != b"IHDR" or kinds[-1] != b"IEND" or not body:
        raise ValueError("chunks are missing")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit grey images without interlace are read")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("rows are missing")
    lines = lines.reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:].copy())


def frequency_hash(image: np.ndarray) -> bytes:
    """64 bits, most significant first by row: is a low frequency above the median of the 64?"""
    height, width = image.shape
    edge = np.arange(_SIDE + 1)

    def reduce(x: np.ndarray, n: int) -> np.ndarray:
        # means of n / 32 neighbours along the first axis; a small image repeats rows
        low = edge[:-1] * n // _SIDE
        high = np.maximum(low + 1, edge[1:] * n // _SIDE)
        total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])
        return (total[high] - total[low]) // (high - low)[:, None]

    small = reduce(reduce(image, height).T, width).T
    low = (_COSINES @ small @ _COSINES.T).ravel()
    return np.packbits(2 * low > np.sort(low)[31] + np.sort(low)[32]).tobytes()


def _binary(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
    for a, b in spans_by_bytes(sizes, BATCH_BYTES):
        yield a, column.slice(a, b - a).to_pylist()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row: its text as an image. A null text reads as empty.

    Other columns are not read. Memory: a batch's images plus about ten times the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _binary(batch.column(1)):
                data = [t or b"" for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(data)), pa.array(map(len, data), pa.int64()), pa.array(map(write_png, data), pa.binary())],
                    [id_col, "n_bytes", "media"],
                )
            release()

    some = docs.select(id_col, F.col(text_col).cast("string").cast("binary"))
    return some.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes bigint, media binary")


def read(media: Column) -> Column:
    """struct(payload binary, hash binary) of an image column; null for null, a damaged image fails the job."""

    @F.arrow_udf("struct<payload:binary,hash:binary>")
    def back(images: pa.Array) -> pa.Array:
        payload, hashes = [], []
        for _, some in _binary(images):
            for image in some:
                rows = None if image is None else read_png(image)
                payload.append(None if rows is None else rows.tobytes())
                hashes.append(None if rows is None else frequency_hash(rows))
        release()
        return pa.StructArray.from_arrays([pa.array(payload, pa.binary()), pa.array(hashes, pa.binary())], ["payload", "hash"])

    return back(media)
