"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment decides.

Words are lower-cased runs of letters and digits, shingles two words. Templates are grouped by
length into classes whose windows, ``width`` shingles with a step of half as many, are so long that any
place a template can stand lies whole in one. A template of at least ``least`` shingles that a window
contains to ``CONTAINMENT`` has a similarity to the window of at least CONTAINMENT * least / width; the
number of bands, of one minimum each, makes the chance that no band agrees at most ``MISS``. A
retrieved template is verified by counting its shingles in the window. Where another template contains
nearly all of it, such as that of another version, the shingles that tell it from the other have to be
there, every one: a notice has one name.

All is built-in expressions inside the row, so nothing is shuffled. A window that has fewer of the
templates' shingles than the shortest template asks for contains none and is not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINMENT = 0.8
MISS = 1e-6
SHINGLE = 2
#: (fewest, most shingles of a template, shingles of a window)
CLASSES = ((3, 8, 16), (9, 24, 48), (25, 64, 128), (65, 256, 512), (257, 1024, 2048), (1025, 4096, 8192))

# Short forms of public license notices, parts of the usual file headers that are
# all the same in any version of the notice, and SPDX lines with or without -only and -or-later.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-Redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-Attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT-Permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("AGPL-Notice", "GNU Affero General Public License as"),
    ("GPL-Notice", "GNU General Public License as"),
    ("LGPL-Notice", "GNU Lesser General Public License as"),
    ("GNU-Version-2-Notice", "Software Foundation; either version 2 of the License"),
    ("GNU-Version-3-Notice", "Software Foundation, either version 3 of the License"),
    ("SPDX-AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("SPDX-Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("SPDX-BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("SPDX-BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("SPDX-GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("SPDX-GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("SPDX-ISC", "SPDX-License-Identifier: ISC"),
    ("SPDX-LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("SPDX-LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("SPDX-MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX-MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Warranty-As-Is", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("Warranty-GNU", "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
)


def bands_for(least: int, width: int) -> int:
    """So many that a window with CONTAINMENT of a template of ``least`` shingles escapes with at most MISS."""
    similarity = math.ceil(CONTAINMENT * least) / width
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def telling_shingles(shingles: list[int], others: Iterable[list[int]]) -> list[int]:
    """The shingles that tell a template from ``others`` that contain it to ``CONTAINMENT``."""
    own, must = set(shingles), set()
    for other in map(set, others):
        if len(own & other) >= math.ceil(CONTAINMENT * len(own) - 1e-9):
            must |= own - other
    return sorted(must)


def shingle_hashes(text: Column) -> Column:
    """A hash for each pair of consecutive words, in order."""
    hashes = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def pairs(h: Column) -> Column:
        return F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x))

    return F.element_at(F.transform(F.array(hashes), pairs), 1)


def band_minima(shingles: Column, bands: int) -> Column:
    """The least hash under each band's function, hashed with the band's number."""
    seeds = F.sequence(F.lit(1), F.lit(bands))
    return F.transform(seeds, lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k)))))


def _array(values: Iterable[int]) -> Column:
    """A constant long array: one literal, whatever its length."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def scan_licenses(spark: SparkSession, text: Column, templates: Iterable[tuple[str, str]] = TEMPLATES) -> Column:
    """Names of the templates that ``text`` contains, sorted; null and empty texts have none.

    A template whose shingles are too few or too many for ``CLASSES`` is refused.
    """
    rows = spark.createDataFrame(list(templates), "name string, body string")
    table = rows.select("name", F.array_distinct(shingle_hashes(F.col("body"))).alias("shingles")).orderBy("name").collect()
    for name, shingles in table:
        if not any(low <= len(shingles) <= high for low, high, _ in CLASSES):
            raise ValueError(f"template {name} has {len(shingles)} shingles")
    must = {name: telling_shingles(s, [o for n, o in table if n != name]) for name, s in table}
    found = []
    for low, high, width in CLASSES:
        some = [(name, s) for name, s in table if low <= len(s) <= high]
        if some:
            bands = bands_for(low, width)
            minima = rows.filter(F.col("name").isin([n for n, _ in some])).select(
                "name", band_minima(F.array_distinct(shingle_hashes(F.col("body"))), bands).alias("m")
            )
            found.append((low, width, bands, [(n, s, m) for (n, s), m in zip(some, [r["m"] for r in minima.orderBy("name").collect()], strict=True)]))

    def complete(window: Column, shingles: list[int]) -> Column:
        return F.size(F.array_intersect(window, _array(shingles))) == len(shingles) if shingles else F.lit(True)

    def retriever(bands: int, some: list) -> Callable[[Column], Column]:
        """Window -> names of the templates that it retrieves and contains."""

        def of(window: Column) -> Column:
            def verified(minima: Column) -> Column:
                hits = [
                    F.when(
                        F.arrays_overlap(minima, _array(m)) & (F.size(F.array_intersect(window, _array(s))) >= math.ceil(CONTAINMENT * len(s) - 1e-9)) & complete(window, must[name]),
                        F.lit(name),
                    )
                    for name, s, m in some
                ]
                return F.array_compact(F.array(*hits))

            return F.element_at(F.transform(F.array(band_minima(window, bands)), verified), 1)

        return of

    def look(h: Column) -> Column:
        names = []
        for low, width, bands, some in found:
            step = width // 2
            any_of = _array(sorted({x for _, s, _ in some for x in s}))
            starts = F.sequence(F.lit(1), F.greatest(F.size(h) - step, F.lit(1)), F.lit(step))
            windows = F.transform(starts, slicer(h, width))
            touched = F.filter(windows, sharing(any_of, math.ceil(CONTAINMENT * min(len(s) for _, s, _ in some) - 1e-9)))
            names.append(F.flatten(F.transform(touched, retriever(bands, some))))
        return F.sort_array(F.array_distinct(F.flatten(F.array(*names))))

    def slicer(h: Column, width: int) -> Callable[[Column], Column]:
        return lambda start: F.array_distinct(F.slice(h, start, width))

    def sharing(any_of: Column, least: int) -> Callable[[Column], Column]:
        return lambda window: F.size(F.array_intersect(window, any_of)) >= least

    every = _array(sorted({x for _, s in table for x in s}))
    hashes = shingle_hashes(F.coalesce(text.cast("string"), F.lit("")))
    nothing = F.array().cast("array<string>")

    def scan(h: Column) -> Column:
        return F.when(F.arrays_overlap(h, every), look(h)).otherwise(nothing)

    return F.element_at(F.transform(F.array(hashes), scan), 1)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, licenses array<string>) of every row; other columns are not read.

    Null and empty texts have none, repeated rows have the same, the id may be null. A long text is cut
    into windows inside its row.
    """
    return docs.select(id_col, scan_licenses(docs.sparkSession, F.col(text_col), templates).alias("licenses"))
