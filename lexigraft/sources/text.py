"""Line-oriented inputs: corpora, token lists, lexicons and CoNLL files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.tags import normalize_tag
from ..functions.text import WHITESPACE, WS_CLASS, strip, tokens, unix_newlines
from ..operators.lexicon import parse_lexicon
from ..session import stable

BLOCK = ["file", "block"]


# ---------------------------------------------------------------- files of any size

def file_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, block, at, value): every line with a key that sorts it into file order.

    Files are read in splits; ``block`` is the split's byte offset and ``at`` increases
    within it, so no file has to fit one task. A line ends with any line break, or with ``separator``.
    """
    return spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def corpus_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Stripped non-blank lines; all other columns pass through."""
    return lines.withColumn(value, strip(F.col(value))).filter(F.length(value) > 0)


def token_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct stripped tokens in sorted order."""
    return (
        corpus_lines(lines, value).select(F.col(value).alias("token")).distinct().orderBy("token")
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus_lines(file_lines(spark, path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return token_list(spark.read.text(path))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, morphemes) with the last line of a word winning, in file order."""
    return parse_lexicon(file_lines(spark, path), [F.col("file"), F.col("block"), F.col("at")])


# ---------------------------------------------------------------- CoNLL

def conll_fields(line: Column, variant: str = "evaluation") -> Column:
    """``struct<token,tag>`` of one line, null with fewer than two fields.

    ``evaluation`` takes TAB-separated fields verbatim when there is a TAB;
    ``preparation`` always splits on whitespace and repairs the tag.
    """
    if variant == "evaluation":
        fields = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(tokens(line))
        repair = lambda tag: tag
    elif variant == "preparation":
        fields, repair = tokens(line), normalize_tag
    else:
        raise ValueError(f"unknown CoNLL variant {variant!r}")

    def pick(f: Column) -> Column:
        return F.when(
            F.size(f) >= 2,
            F.struct(F.get(f, F.lit(0)).alias("token"), let(F.element_at(f, -1), repair).alias("tag")),
        )

    return let(fields, pick)


def conll_sentences(text: Column, variant: str = "evaluation") -> Column:
    """``array<array<struct<token,tag>>>`` of a CoNLL text held in one cell, no empty sentences."""
    blocks = F.split(unix_newlines(text), rf"\n[{WS_CLASS}]*\n")
    sentences = F.transform(
        blocks,
        lambda b: F.filter(
            F.transform(F.split(b, "\n"), lambda ln: conll_fields(ln, variant)),
            lambda t: t.isNotNull(),
        ),
    )
    return F.filter(sentences, lambda s: F.size(s) > 0)


def parse_conll(df: DataFrame, text: str, keys: list[str], variant: str = "evaluation") -> DataFrame:
    """(keys, sent_id, sentence) from texts held in cells; sent_id counts within each text."""
    return df.select(
        *keys, F.posexplode(conll_sentences(F.col(text), variant)).alias("sent_id", "sentence")
    )


def sentence_tokens(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: (keys, sent_id, pos, token, tag)."""
    return sentences.select(*keys, "sent_id", F.posexplode("sentence").alias("pos", "t")).select(
        *keys, "sent_id", "pos", "t.token", "t.tag"
    )


class _Place:
    """Where a file split stands: blank lines and token rows so far, and the sentences they opened."""

    def __init__(self) -> None:
        self.gaps = self.nth = self.opened = self.open_at = 0
        self.first_gap = self.last_gap = None

    def pass_by(self, blank: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take in the next lines; (nth, opened so far, nth of the last opening or 0) of their token rows."""
        gap = self.gaps + np.cumsum(blank)
        at = gap[known]
        self.gaps += int(blank.sum())
        if not at.size:
            return at, at, at
        if self.first_gap is None:
            self.first_gap = self.last_gap = int(at[0])
        opens = at != np.append(self.last_gap, at[:-1])
        nth = self.nth + np.arange(1, len(at) + 1)
        opened = self.opened + np.cumsum(opens)
        open_at = np.maximum(np.maximum.accumulate(np.where(opens, nth, 0)), self.open_at)
        self.last_gap, self.nth, self.opened, self.open_at = (int(x[-1]) for x in (at, nth, opened, open_at))
        return nth, opened, open_at


_SUMMARY = "file string, block bigint, gaps bigint, first_gap bigint, last_gap bigint, tokens bigint, opened bigint, last_open bigint"
_PART = {"n_open": "bigint", "nth": "bigint", "open_at": "bigint", "rows": "array<struct<token:string,tag:string>>"}
_FRAGMENT = ", ".join(f"{name} {kind}" for name, kind in _PART.items())
_PARTS = f"array<struct<{', '.join(f'{name}:{kind}' for name, kind in _PART.items())}>>"
_FIELDS = pa.struct([("token", pa.string()), ("tag", pa.string())])


def _parsed(lines: pa.Array, variant: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which lines are blank, which have a token, and the tokens' ``struct<token,tag>``: ``conll_fields``, but no tag is repaired."""
    blank = pc.equal(pc.utf8_trim(lines, characters=WHITESPACE), "").to_numpy(zero_copy_only=False)
    tabbed = np.zeros(len(lines), np.bool_)
    if variant == "evaluation":
        tabbed = pc.match_substring(lines, "\t").to_numpy(zero_copy_only=False)
    known, at = tabbed.copy(), np.nonzero(~tabbed & ~blank)[0]
    spaced = []
    for i, line in zip(at.tolist(), lines.take(pa.array(at)).to_pylist(), strict=True):
        fields = line.split()
        known[i] = len(fields) >= 2
        if known[i]:
            spaced.append((fields[0], fields[-1]))
    fields = pc.split_pattern(lines.filter(pa.array(known & tabbed)), "\t")
    ends = fields.offsets.to_numpy()
    pair = [fields.values.take(pa.array(i)) for i in (ends[:-1], ends[1:] - 1)]
    if spaced:
        order = np.empty(int(known.sum()), np.int64)
        order[np.argsort(~tabbed[known], kind="stable")] = np.arange(len(order))
        pair = [pa.concat_arrays([a, pa.array(b, pa.string())]).take(pa.array(order)) for a, b in zip(pair, zip(*spaced, strict=True), strict=True)]
    return blank, known, pa.StructArray.from_arrays(pair, fields=list(_FIELDS))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch in runs of one file split; a task reads its splits one after another, each in file order."""
    for batch in batches:
        file, block = (pc.dictionary_encode(batch.column(c)) for c in BLOCK)
        codes = file.indices.to_numpy().astype(np.int64) * len(block.dictionary) + block.indices.to_numpy()
        starts = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0] if len(codes) else []
        for i, j in zip(starts, [*starts[1:], len(codes)], strict=True):
            some = batch.slice(i, j - i)
            yield tuple(some.column(c)[0].as_py() for c in BLOCK), some


def _unpacked(records: pa.Array) -> pa.Array:
    """The lines of records that were parted by empty lines; each is followed by such a line.

    Where a split begins within a run of line breaks, a record may come twice, then one that starts with a line break.
    """
    if pc.any(pc.or_(pc.starts_with(records, "\n"), pc.equal(records, ""))).as_py():
        raise ValueError("more than one empty line between two sentences: such files are not plain")
    return pc.split_pattern(pc.binary_join_element_wise(records, "", "\n"), "\n").flatten()


def _parts(batches: Iterator[pa.RecordBatch], variant: str, plain: bool) -> Iterator[tuple[tuple, _Place, bool, pa.RecordBatch | None]]:
    """(split, place, at a border, parts of sentences) as a split is read; only the border of a split cuts a sentence.

    At a border are what comes first in a split and what comes last, the latter once the split has been read,
    when ``place`` is final. A split without a token has None there.
    """
    def cut(starts: np.ndarray, end: int, rows: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, end), pa.int32()), rows)
        n_open, nth, open_at = (x[starts] for x in numbers)
        return pa.RecordBatch.from_arrays([pa.array(n_open), pa.array(nth), pa.array(open_at, mask=open_at == 0), lists], names=list(_PART))

    def whole(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One part of what batches have of it, numbered by the first."""
        if len(some) == 1:
            return some[0]
        rows = pa.concat_arrays([x.column("rows").flatten() for x in some])
        return pa.RecordBatch.from_arrays([*some[0].columns[:3], pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=list(_PART))

    at, place, held = None, _Place(), []  # held: what there is of the sentence that is open
    for key, some in _by_split(batches):
        if key != at:
            if at is not None:
                yield at, place, True, whole(held) if held else None
            at, place, held = key, _Place(), []
        lines = some.column("value")
        blank, known, rows = _parsed(_unpacked(lines) if plain else lines, variant)
        nth, opened, open_at = place.pass_by(blank, known)
        if not nth.size:
            continue
        starts = np.nonzero(np.append(True, opened[1:] != opened[:-1]))[0]
        made = cut(starts, len(nth), rows, opened, nth, open_at)
        if held and held[0].column("n_open")[0].as_py() == opened[0]:
            held.append(made.slice(0, 1))
            made = made.slice(1)
        if made.num_rows:
            if held:
                done = whole(held)
                yield at, place, done.column("open_at")[0].as_py() != done.column("nth")[0].as_py(), done
            if made.num_rows > 1:
                cut_first = open_at[starts[-made.num_rows]] != nth[starts[-made.num_rows]]
                if cut_first:
                    yield at, place, True, made.slice(0, 1)
                yield at, place, False, made.slice(int(cut_first), made.num_rows - 1 - int(cut_first))
            held = [made.slice(made.num_rows - 1)]
    if at is not None:
        yield at, place, True, whole(held) if held else None


def _summaries(batches: Iterator[pa.RecordBatch], variant: str, plain: bool) -> Iterator[pa.RecordBatch]:
    """One row per file split, with the parts at its borders; ``tokens`` and what follows from them are null in a split without a token."""
    types = [pa.string()] + [pa.int64()] * 7
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    borders, last = [], None

    def row(key: tuple, p: _Place) -> pa.RecordBatch:
        values = [*key, p.gaps, p.first_gap, p.last_gap, *((p.nth, p.opened) if p.nth else (None, None)), p.open_at or None]
        parts = pa.Table.from_batches(borders).combine_chunks().to_batches()[0].to_struct_array() if borders else None
        listed = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts) if borders else pa.nulls(1, _parts_type())
        return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(values, types, strict=True)), listed], names=[*names, "parts"])

    for key, place, at_border, parts in _parts(batches, variant, plain):
        if last is not None and last[1] is not place:
            yield row(*last)
            borders = []
        last = key, place
        if at_border and parts is not None:
            borders.append(parts)
    if last is not None:
        yield row(*last)


def _parts_type() -> pa.DataType:
    return pa.list_(pa.struct([("n_open", pa.int64()), ("nth", pa.int64()), ("open_at", pa.int64()), ("rows", pa.list_(_FIELDS))]))


def _inner_parts(batches: Iterator[pa.RecordBatch], variant: str, plain: bool) -> Iterator[pa.RecordBatch]:
    """The sentences that open and end within a file split, a row each."""
    for key, _, at_border, parts in _parts(batches, variant, plain):
        if not at_border and parts.num_rows:
            place = [pa.array([v], t).take(pa.array(np.zeros(parts.num_rows, np.int64))) for v, t in zip(key, (pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*place, *parts.columns], names=[*BLOCK, *parts.schema.names])


def _conll_parts(spark: SparkSession, path: str, variant: str, plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file, sent_id, pos, rows), twice: sentences within a file split, and parts of those at its borders.

    ``pos`` is the position of the first token. Every file split is numbered as it is read, without a shuffle; one
    summary row per split, made by a first reading, holds the parts at the borders and yields what the splits before it
    contribute. A sentence may span splits.
    """
    if variant not in ("evaluation", "preparation"):
        raise ValueError(f"unknown CoNLL variant {variant!r}")
    lines = file_lines(spark, path, "\n\n" if plain else None).select(*BLOCK, "value")
    blocks = stable(lines.mapInArrow(partial(_summaries, variant=variant, plain=plain), f"{_SUMMARY}, parts {_PARTS}"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        blocks.drop("parts").withColumn("gap0", F.coalesce(F.sum("gaps").over(before), F.lit(0)))
        .filter("tokens is not null")
        .withColumn("last_abs", F.col("gap0") + F.col("last_gap"))
        .withColumn("prev_abs", F.lag("last_abs").over(order))
        .withColumn(
            "first_opens",
            F.coalesce(F.col("prev_abs") != F.col("gap0") + F.col("first_gap"), F.lit(True)),
        )
        .withColumn("token0", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("sent0", F.sum(F.col("first_opens").cast("bigint")).over(upto)
                    + F.coalesce(F.sum("opened").over(before), F.lit(0)) - 1)
        .withColumn(
            "open_abs",
            F.coalesce(
                F.col("token0") + F.col("last_open"),
                F.when(F.col("first_opens"), F.col("token0") + 1),
            ),
        )
        .withColumn(
            "carry_open",
            F.when(F.col("first_opens"), F.col("token0") + 1).otherwise(F.max("open_abs").over(before)),
        )
        .select(*BLOCK, "token0", "sent0", "carry_open")
    )
    rows = F.col("rows")
    if variant == "preparation":
        rows = F.transform(rows, lambda t: F.struct(t["token"].alias("token"), normalize_tag(t["tag"]).alias("tag")))

    def placed(parts: DataFrame) -> DataFrame:
        return parts.join(F.broadcast(carried), BLOCK).select(
            "file",
            (F.col("sent0") + F.col("n_open")).alias("sent_id"),
            (
                F.col("token0")
                + F.col("nth")
                - F.coalesce(F.col("token0") + F.col("open_at"), F.col("carry_open"))
            ).alias("pos"),
            rows.alias("rows"),
        )

    inner = lines.mapInArrow(partial(_inner_parts, variant=variant, plain=plain), f"file string, block bigint, {_FRAGMENT}")
    return placed(inner), placed(blocks.select(*BLOCK, F.inline("parts")))


def read_conll(spark: SparkSession, path: str, variant: str = "evaluation") -> DataFrame:
    """(file, sent_id, pos, token, tag) of CoNLL files of any size."""
    inner, borders = _conll_parts(spark, path, variant)
    parts = inner.unionByName(borders).select("file", "sent_id", F.col("pos").alias("__pos"), F.posexplode("rows").alias("__i", "t"))
    return parts.select("file", "sent_id", (F.col("__pos") + F.col("__i")).alias("pos"), "t.token", "t.tag")


def read_conll_sentences(spark: SparkSession, path: str, variant: str = "evaluation", plain: bool = False) -> DataFrame:
    """(file, sent_id, sentence) of CoNLL files of any size: the rows of ``read_conll``, a sentence each.

    Only parts of sentences at the borders of file splits are shuffled. ``plain`` is for files whose lines end with
    a line feed and whose sentences are parted by one empty line, as ``write_conll`` parts those that have tokens: a row
    is then what lies between two of these, not a line. More empty lines fail the job.
    """
    inner, borders = _conll_parts(spark, path, variant, plain)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "rows")))
    joined = borders.groupBy("file", "sent_id").agg(F.flatten(F.transform(ordered, lambda p: p["rows"])).alias("sentence"))
    return inner.select("file", "sent_id", F.col("rows").alias("sentence")).unionByName(joined)


def conll_record(sentence: Column) -> Column:
    """One sentence as text; a text sink's own line break adds the blank separator line."""
    rows = F.transform(sentence, lambda t: F.concat(t["token"], F.lit("\t"), t["tag"]))
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def write_conll(sentences: DataFrame, path: str, order: list[str]) -> None:
    """One folder per split; each sentence is one row, so nothing is gathered to write it."""
    (
        sentences.select("split", *order, conll_record(F.col("sentence")).alias("value"))
        .sortWithinPartitions("split", *order)
        .select("split", "value")
        .write.partitionBy("split")
        .text(path)
    )
