"""Found spans as array<struct<kind, start, end, base>> and the texts and digests made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of each span by start, then kind as listed, then end; comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(order[s["kind"]], F.lit(99)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def by_start(spans: list[tuple[str, int, int, bool]], kinds: list[str]) -> list[tuple[str, int, int, bool]]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
