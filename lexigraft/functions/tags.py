"""BIO tag expressions over one sentence held as an array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, once, positions

# Tag repairs of the released annotation and the accepted prefixes.
TAG_FIXES = {"B-DATe": "B-DATE"}
VALID_PREFIXES = ("B-", "I-")


def normalize_tag(tag: Column) -> Column:
    """Apply the repair table; anything that is not O, B-* or I-* becomes O."""
    fixed = tag
    for wrong, right in TAG_FIXES.items():
        fixed = F.when(tag == wrong, F.lit(right)).otherwise(fixed)
    known = (fixed == "O")
    for prefix in VALID_PREFIXES:
        known = known | F.startswith(fixed, F.lit(prefix))
    return F.when(known, fixed).otherwise(F.lit("O"))


def tag_type(tag: Column) -> Column:
    """Entity type of a B-/I- tag, null for every other tag."""
    inside = F.startswith(tag, F.lit("B-")) | F.startswith(tag, F.lit("I-"))
    return F.when(inside, F.substr(tag, F.lit(3)))


def entity_spans(tags: Column) -> Column:
    """``array<struct<etype,start,end>>`` of a tag array, lenient BIO, end exclusive.

    A position continues the open span only if it is ``I-x`` right after a position of
    type x; every other position is a boundary. A typed boundary opens a span that
    runs to the next boundary, so one pass over the boundaries yields all spans.
    """

    def of_sentence(x: Column) -> Column:
        tag, types = x["tags"], x["types"]

        def continues(i: Column) -> Column:
            same = F.get(types, i - F.lit(1)) == F.get(types, i)
            return F.startswith(F.get(tag, i), F.lit("I-")) & (i > 0) & F.coalesce(same, F.lit(False))

        def from_bounds(bounds: Column) -> Column:
            spans = F.transform(
                bounds,
                lambda b, k: F.struct(
                    F.get(types, b).alias("etype"),
                    b.alias("start"),
                    F.coalesce(F.get(bounds, k + F.lit(1)), F.size(types)).alias("end"),
                ),
            )
            return F.filter(spans, lambda s: s["etype"].isNotNull())

        return let(F.filter(positions(types), lambda i: ~continues(i)), from_bounds)

    return let(
        tags, lambda t: let(F.struct(t.alias("tags"), F.transform(t, tag_type).alias("types")), of_sentence)
    )


def spans_of(sentences: pa.Array, types: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, type) of the spans of a batch of tag arrays, as ``entity_spans`` has them; ``types`` numbers the types."""
    sizes = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    tags = sentences.flatten().dictionary_encode()
    names = tags.dictionary.to_pylist()
    typed = [types.setdefault(t[2:], len(types)) if t[:2] in VALID_PREFIXES else -1 for t in names]
    code = tags.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    kind = np.array([*typed, -1], np.int64)[code]
    inner = np.array([*[t.startswith("I-") for t in names], False], np.bool_)[code]
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    at = np.arange(len(kind))
    goes_on = inner & (at > first) & (kind == np.roll(kind, 1))
    bounds = np.nonzero(~goes_on)[0]
    until = np.minimum(np.append(bounds[1:], len(kind)), np.repeat(ends, sizes)[bounds])
    spans = kind[bounds] >= 0
    bounds, until = bounds[spans], until[spans]
    row = np.repeat(np.arange(len(sizes)), sizes)[bounds]
    return row, bounds - first[bounds], until - first[bounds], kind[bounds]


def span_overlap(predicted: Column, gold: Column) -> Column:
    """``struct<tp,fp,fn>`` of two tag arrays: spans that both have, or only one; a null array has none."""

    @F.arrow_udf("struct<tp:bigint,fp:bigint,fn:bigint>")
    def count(p: pa.Array, g: pa.Array) -> pa.Array:
        types: dict[str, int] = {}
        ours, theirs = spans_of(p, types), spans_of(g, types)
        width = 1 + max(int(x[1].max(initial=0)) for x in (ours, theirs))
        # one span at most starts at a place
        _, i, j = np.intersect1d(ours[0] * width + ours[1], theirs[0] * width + theirs[1], assume_unique=True, return_indices=True)
        both = ours[0][i[(ours[2][i] == theirs[2][j]) & (ours[3][i] == theirs[3][j])]]
        n_p, n_g, tp = (np.bincount(rows, minlength=len(p)) for rows in (ours[0], theirs[0], both))
        return pa.StructArray.from_arrays([pa.array(tp), pa.array(n_p - tp), pa.array(n_g - tp)], ["tp", "fp", "fn"])

    return once(count)(predicted, gold)
