"""Means of n-gram vectors, with each vector sent once to a block of tokens instead of once for each occurrence.

Tokens are cut into blocks. A block numbers its different n-grams, asks the vector table for each of
them once and adds up the rows of its tokens by these numbers. A block holds at most ``BLOCK_BYTES`` of
vectors and as much of sums, however many tokens or n-grams there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_rows
from ..functions.vector_sums import carried, closed, joined_parts, of_width, parts_of
from ..functions.vectors import as_lists
from ..session import stable

BLOCK_BYTES = 64 << 20
_RUN = 1 << 20     # bytes of text whose n-grams are numbered at a time, or more where a block takes more
_CHARS = 16        # bytes of text, for each vector that a block may hold, at which it is closed


def number_ngrams(words: list[str], n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many n-grams each word has, the numbers of all of them, word by word, and the n-grams in the order of their numbers.

    An n-gram gets its number from that of its first n - 1 characters and its last one, so that only different ones become texts.
    """
    text = "".join(words)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    sizes = range(n_min, n_max + 1)
    counts = {n: np.maximum(lengths - (n - 1), 0) for n in sizes}
    total = np.sum([counts[n] for n in sizes], axis=0)
    begins, slots = np.cumsum(lengths) - lengths, np.cumsum(total) - total
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(chars))
    places, ngrams = np.empty(int(total.sum()), np.int32), []
    number = chars  # of the n-gram that begins at a character, if its word has one there
    for n in range(1, n_max + 1):
        key = number
        if n > 1:
            at = at[at + n <= (begins + lengths)[word[at]]]
            key = (number[at] << 21) | chars[at + (n - 1)]
        coded = pa.array(key).dictionary_encode()
        place = coded.indices.to_numpy()
        number = np.zeros(len(chars), np.int64)
        number[at] = place
        if n >= n_min:
            first = np.empty(len(coded.dictionary), np.int64)
            first[place[::-1]] = at[::-1]
            places[slots[word[at]] + at - begins[word[at]]] = place + len(ngrams)
            slots = slots + counts[n]
            ngrams += [text[i : i + n] for i in first.tolist()]
    return total, places, ngrams


def runs_of(texts: pa.Array, rows: int) -> Iterator[slice]:
    """Runs of at most ``rows`` rows and about ``_RUN`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        by_size = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _RUN, side="right"))
        end = max(at + 1, min(at + rows, by_size))
        yield slice(at, end)
        at = end


def distinct_ngrams(tokens: DataFrame, token: str, n_min: int = 3, n_max: int = 5) -> DataFrame:
    """(ngram): the different n-grams of all tokens; before the shuffle, those of each run of tokens."""
    names = tokens.select(F.col(token).alias("token")).filter("token is not null")
    fits = (F.length("token") <= _RUN // 16) & F.is_valid_utf8("token")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("token")
            for run in runs_of(texts, len(texts)):
                ngrams = number_ngrams([f"<{t}>" for t in texts[run].to_pylist()], n_min, n_max)[2]
                yield pa.RecordBatch.from_arrays([pa.array(ngrams, pa.string())], names=["ngram"])

    return names.filter(fits).mapInArrow(listed, "ngram string").union(ngram_rows(names.filter(~fits), "token", n_min, n_max)).distinct()


def cut_blocks(tokens: DataFrame, n_min: int, n_max: int, most: int) -> DataFrame:
    """(block, token, times, places, ngrams): different tokens, and one row per block with its different n-grams.

    ``places`` are the numbers, in the block's list, of all n-grams of a token. A block has at most ``most`` tokens
    and ``most`` different n-grams. A token that alone may have more, or that is no valid text, has no block; one
    without n-grams, or null, is left out.
    """
    fits = ((F.length("token") + 2) * (n_max - n_min + 1) <= most) & F.is_valid_utf8("token")
    counted = tokens.filter("token is not null").groupBy("token").agg(F.count("*").alias("times"))
    schema = "block long, token string, times long, places array<int>, ngrams array<string>"
    names = ["block", "token", "times", "places", "ngrams"]

    def row_of(block: int | None, tokens: pa.Array, times: pa.Array, places: pa.Array | None, ngrams: pa.Array | None) -> pa.RecordBatch:
        n = len(tokens)
        places = pa.nulls(n, pa.list_(pa.int32())) if places is None else places
        ngrams = pa.nulls(n, pa.list_(pa.string())) if ngrams is None else ngrams
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), tokens, times, places, ngrams], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, goal = 0, max(1, most // 2)  # that many tokens mostly have fewer than ``most`` n-grams

        def blocks(part: int, tokens: pa.Array, times: pa.Array) -> Iterator[pa.RecordBatch]:
            """One block, or those of both halves where it would hold too much."""
            nonlocal made, goal
            total, places, ngrams = number_ngrams([f"<{t}>" for t in tokens.to_pylist()], n_min, n_max)
            if len(tokens) > 1 and (len(tokens) > most or len(ngrams) > most):
                half = len(tokens) // 2
                goal = min(goal, half)  # what comes next is of the same kind
                yield from blocks(part, tokens[:half], times[:half])
                yield from blocks(part, tokens[half:], times[half:])
                return
            block, made = (part << 32) + made, made + 1
            ends = pa.array(np.concatenate([[0], np.cumsum(total)]), pa.int32())
            some = pa.array(total > 0)
            lists = pa.ListArray.from_arrays(ends, pa.array(places)).filter(some)
            yield row_of(block, tokens.filter(some), times.filter(some), lists, None)
            yield row_of(block, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), None, pa.array([ngrams], pa.list_(pa.string())))

        held: list[tuple[pa.Array, pa.Array]] = []
        n_tokens = n_chars = part = 0
        for whole in batches:
            for run in runs_of(whole.column("token"), 2048):
                batch = whole.slice(run.start, run.stop - run.start)
                part, fitting = batch.column("part")[0].as_py(), batch.column("fits")
                rest, batch = batch.filter(pc.invert(fitting)), batch.filter(fitting)
                if rest.num_rows:
                    yield row_of(None, rest.column("token"), rest.column("times"), None, None)
                held.append((batch.column("token"), batch.column("times")))
                n_tokens, n_chars = n_tokens + batch.num_rows, n_chars + batch.column("token").nbytes
                if n_tokens >= goal or n_chars >= _CHARS * most:
                    yield from blocks(part, *[pa.concat_arrays(c) for c in zip(*held, strict=True)])
                    held, n_tokens, n_chars = [], 0, 0
        if n_tokens:
            yield from blocks(part, *[pa.concat_arrays(c) for c in zip(*held, strict=True)])

    return counted.select("token", "times", fits.alias("fits"), F.spark_partition_id().alias("part")).mapInArrow(cut, schema)


def block_means(blocks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(token, n, vec) of the tokens that have a block, from ``vectors(ngram, vec)``; an n-gram may have several.

    Sums are exact, as in ``vector_sums``. A vector of another width than ``dim`` fails the job.
    """
    vec = F.col("vec")
    if vectors.schema["vec"].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    asked = blocks.filter("ngrams is not null").select(F.col("block").alias("to_block"), F.posexplode("ngrams").alias("place", "ngram"))
    sent = asked.join(vectors.select("ngram", of_width(vec, dim).alias("vec")), "ngram").select("to_block", "place", "vec")
    members = blocks.filter("places is not null").select("block", "token", "times", "places")

    def means(words: pa.Table, known: pa.Table) -> pa.Table:
        places = words["places"].combine_chunks()
        at = places.flatten().to_numpy().astype(np.intp)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())])[:-1]
        place = known["place"].to_numpy()
        values = pc.fill_null(known["vec"].combine_chunks().flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
        have = np.bincount(place, minlength=int(at.max(initial=-1)) + 1)
        times = words["times"].to_numpy()
        hits = np.add.reduceat(have[at], starts) if len(at) else np.zeros(0, np.int64)
        covered = hits > 0
        several = bool((times > 1).any())
        out = np.empty((int(covered.sum()), dim))
        for d in range(dim if len(out) else 0):
            parts = parts_of(values[None, :, d].astype(np.float64))[0]
            sums = np.zeros((1, len(parts), len(hits)), np.int64)
            for j, multiples in joined_parts(parts, int(hits.max())):
                of_place = np.zeros(len(have), np.int64)
                np.add.at(of_place, place, multiples)
                sums[0, j] = np.add.reduceat(of_place[at], starts)
            # as if a token's n-grams came as often as the token does
            out[:, d] = closed(carried(sums) * times if several else sums)[0, covered]
        n = (hits * times)[covered]
        vecs = as_lists(np.ones(len(out), bool), out / n[:, None])
        return pa.table([words["token"].filter(pa.array(covered)), pa.array(n, pa.int64()), vecs], names=["token", "n", "vec"])

    return members.groupBy("block").cogroup(sent.groupBy("to_block")).applyInArrow(means, "token string, n long, vec array<double>")


def frozen_blocks(tokens: DataFrame, dim: int, n_min: int, n_max: int) -> DataFrame:
    """``cut_blocks`` of the tokens, written: a block is not to be cut in another way while it is read."""
    return stable(cut_blocks(tokens, n_min, n_max, max(1, BLOCK_BYTES // (8 * dim))))
