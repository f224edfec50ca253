"""Near duplicates, quality, licenses, mixing and the pipeline against brute force or SQL."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigraft.llm import components, licenses, mixing, near_dedup, quality, shingles
from lexigraft.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def groups(texts, k, percent=80):
    """id -> (set size, smallest reachable id) by comparing every pair."""
    sets = {i: shingles.shingle_set(t or "", k) for i, t in texts.items()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(n, edits, seed, size=60):
    """Copies of one text with a different number of changed words each."""
    rng = random.Random(seed)
    words = [f"w{seed}x{i}" for i in range(size)]
    return [" ".join(rng.choice("abcdefg") + str(rng.random()) if i in set(rng.sample(range(size), rng.randint(0, edits))) else w for i, w in enumerate(words)) for _ in range(n)]


@pytest.mark.parametrize("k, block", [(2, 1024), (5, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = [*family(60, 9, 1), *family(20, 3, 2), *family(15, 1, 3, 8), "only", "only", "two words", "Two  WORDS", "", None, " \t ", "a b c d", "a b c e"]
    rng = random.Random(4)
    rows = dict(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, k).collect()}
    want = groups(rows, k)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_near_duplicates_of_edge_cases(edge, empty):
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(edge, 2).collect()), key=str)
    by_id = Counter((r[0], r[2], r[3]) for r in got)
    assert len(got) == edge.count() and by_id[(1, 1, True)] == 2 and by_id[(2, 1, False)] == 1 and by_id[(None, None, True)] == 1
    assert all(by_id[(i, i, True)] == 1 for i in (3, 4, 5, 6, 7, 8)) and {r[1] for r in got if r[0] in (3, 4, 5)} == {0}
    assert near_dedup.near_duplicates(empty, 2).count() == 0


def test_signatures_estimate_similarity_and_prints_are_exact():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(3000)]
    a = " ".join(words)
    b = " ".join(w if rng.random() > 0.05 else w + "z" for w in words)
    for k in (2, 5):
        x, y = shingles.shingle_set(a, k), shingles.shingle_set(b, k)
        pa, pb = shingles.fingerprints([a, b], k)
        assert len(pa) == len(x) and len(np.intersect1d(pa, pb)) == len(x & y)
        m = shingles.MinHash(32, 5)
        assert abs((m.signature(pa) == m.signature(pb)).mean() - len(x & y) / len(x | y)) < 0.15
    some = ["", "one", " a  b ", "x" * 5000, "é ü", "\n\n", "a b c d e f"]
    assert [len(p) for p in shingles.fingerprints(some, 3)] == [len(shingles.shingle_set(t, 3)) for t in some]
    assert all((shingles.fingerprints([t], 3)[0] == p).all() for t, p in zip(some, shingles.fingerprints(some, 3), strict=True))


def test_sets_differ_though_a_half_of_their_prints_is_equal(monkeypatch):
    monkeypatch.setattr(shingles, "_BYTE_VALUES", [np.ones(256, np.uint64), shingles._BYTE_VALUES[1]])
    texts = ["aa bb cc aa bb", "bb cc dd", "aa", "bb", "aa bb cc bb", "", "aa bb cc aa bb"]
    for k in (2, 5):
        prints = shingles.fingerprints(texts, k)
        sets = [shingles.shingle_set(t, k) for t in texts]
        assert [len(p) for p in prints] == list(map(len, sets))
        alike = [[shingles.digest(p) == shingles.digest(q) for q in prints] for p in prints]
        assert alike == [[a == b for b in sets] for a in sets]
        assert all((shingles.fingerprints([t], k)[0] == p).all() for t, p in zip(texts, prints, strict=True))


def test_least_matches_follow_the_posterior():
    rng = np.random.default_rng(3)
    for n in (32, 160):
        m = near_dedup.least_matches(n, 80)
        draws = rng.beta(m + 1, n - m + 1, 2_000_000)
        assert (draws >= 0.8).mean() < 1e-4 and near_dedup.least_matches(n, 50) < m < 0.8 * n


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(900, 930)] + [(5000, 5000), (7, 3), (3, 7), (None, 4)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).distinct().collect())
    want = {i: 0 for i in range(61)} | {i: 900 for i in [*range(900, 930), 1000]}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- SQL

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


def same(frame, other):
    cols = sorted(frame.columns)
    rows = lambda f: Counter(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in f[cols].astype(object).values.tolist())
    assert cols == sorted(other.columns) and rows(frame) == rows(other)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_quality_and_licenses_of_edge_cases_equal_sql(spark, edge):
    con = duckdb.connect()
    docs = edge.filter("doc_id is not null and doc_id <> 7").dropDuplicates(["doc_id"])
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("create table documents as select * from frame")
    counted = quality.measure(docs)
    kept = F.when(quality.base_failed(), False).otherwise(quality.cascade(counted, list(quality.RULES)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same(counted.select(*names, quality.base_failed().alias("base_failed"), kept.alias("kept")).toPandas(), con.execute(SQL["op7_quality_rules"]).df())
    found = licenses.find_licenses(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))
    same(found.toPandas(), con.execute(SQL["op10_licenses"]).df())


def test_quality_and_licenses_of_a_long_text(edge):
    text = edge.filter("doc_id = 7").select("text").first()[0]
    words = text.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    got = quality.measure(edge.filter("doc_id = 7").select("text")).first()
    assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(again))
    assert licenses.find_licenses(edge.filter("doc_id = 7")).first()["licenses"] == []


def test_order_of_rules_changes_no_verdict(spark, edge, empty):
    texts = ["plain words of some length make up this first text", "## $$ %% && || << >> a b c", "SHOUTED WORDS IN THIS WHOLE TEXT", "x\nx\nx\nx\nx\nx", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counted = quality.measure(docs)
    order = quality.order_rules(docs)
    assert sorted(order) == sorted(quality.RULES) and quality.order_rules(empty) and quality.measure(empty).count() == 0
    verdicts = [[r[0] for r in counted.select(quality.cascade(counted, o)).collect()] for o in (order, order[::-1], list(quality.RULES))]
    assert verdicts[0] == verdicts[1] == verdicts[2] == [True, False, False, False, True]


def test_licenses_are_found_in_long_texts_and_near_misses_are_not(spark, empty):
    rng = random.Random(8)
    filler = lambda n: " ".join(f"word{rng.randint(0, 500)}" for _ in range(n))
    rows = [(f"{filler(rng.randint(0, 300))} {body.upper()}; {filler(rng.randint(0, 300))}", name) for name, body in licenses.TEMPLATES]
    rows += [("Released under the terms of peace", ""), ("licensed under the", ""), (None, ""), ("", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs).collect()}
    for i, (_, name) in enumerate(rows):
        assert (name in got[i]) if name else got[i] == []
    assert licenses.find_licenses(empty).count() == 0
    for low, _, width in licenses.CLASSES:
        share = np.ceil(licenses.CONTAINMENT * low) / width
        assert (1 - share) ** licenses.bands_for(low, width) <= licenses.MISS
    with pytest.raises(ValueError, match="shingles"):
        licenses.find_licenses(docs, templates=[("short", "one two")])


def test_usual_headers_and_spdx_lines_are_found(spark):
    def header(kind, version):
        return (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
            f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
            "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
            f"FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
        )

    rows = [
        (header(kind, v), [f"{name}-Notice", f"GNU-Version-{v}-Notice", "Warranty-GNU"])
        for name, kind in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License"))
        for v in (2, 3)
    ]
    spdx = {"MIT": "MIT", "ISC": "ISC", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0"}
    spdx |= {f"{x}-{end}": x for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("only", "or-later")}
    rows += [(f"# SPDX-License-Identifier: {line}", [f"SPDX-{name}"]) for line, name in spdx.items()]
    rows += [("# SPDX-License-Identifier: Zlib", []), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING', ["Warranty-As-Is"])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs).collect()}
    for i, (text, names) in enumerate(rows):
        assert got[i] == sorted(names), text


def test_a_notice_has_the_name_of_its_own_version(spark):
    rows = [
        ("x This work is licensed under the GNU General Public License, version 3 or later y", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
        ("Licensed under the BSD 2-Clause License", ["BSD-2-Clause"]), ("Licensed under the BSD 3-Clause License", ["BSD-3-Clause"]),
        ("licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
        ("licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs).collect()}
    assert got == {i: names for i, (_, names) in enumerate(rows)}
    assert licenses.telling_shingles([1, 2, 3, 4, 5], [[1, 2, 3, 4, 9], [1, 2, 7]]) == [5]


def test_bodies_of_many_shingles_are_found(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    bodies = [(f"L{n}", " ".join(rng.choice(words) for _ in range(n))) for n in (120, 500, 1500)]
    cut = lambda body, share: " ".join(w for i, w in enumerate(body.split()) if i < share * len(body.split()))
    noise = " ".join(rng.choice(words) for _ in range(3000))
    rows = [(f"{noise} {body} {noise}", name) for name, body in bodies] + [(f"{noise} {cut(body, 0.9)}", name) for name, body in bodies] + [(f"{noise} {cut(body, 0.5)}", "") for _, body in bodies]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.find_licenses(docs, templates=bodies).collect()}
    assert got == {i: [name] if name else [] for i, (_, name) in enumerate(rows)}


def test_rules_come_in_the_order_of_rejections_per_cost(spark, tmp_path):
    texts = ["- a\n- b\n* c"] * 60 + ["one thing ... \ntwo things…\nthree"] * 30 + ["12 34 56 78 x"] * 30 + ["plain words of some length"] * 100
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    verdict = {r[0] for r in quality.measure(docs).select("text", quality.cascade(docs, list(quality.RULES)).alias("ok")).filter("not ok").distinct().select("text").collect()}
    assert verdict == {texts[0], texts[60], texts[90]}
    order = quality.order_rules(docs)
    counted = quality.measure(docs)
    rejects = {name: counted.filter(rule(F.col("text"))).count() for name, rule in quality.RULES.items()}
    useful = {name for name, n in rejects.items() if n}
    assert {"bullets", "ellipses", "letters"} <= useful < set(quality.RULES) and set(order[: len(useful)]) == useful
    for i in range(20):
        spark.createDataFrame([(f"file {i} row {j}",) for j in range(30)], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    rows = [r[0] for r in quality.sample_rows(table).collect()]
    assert len(rows) == 30 * quality.SAMPLE_FILES and len({r.split()[1] for r in rows}) == quality.SAMPLE_FILES
    assert quality.sample_rows(table.union(table)).count() == 1000


# ---------------------------------------------------------------- mixing

def test_splitting_tree_uses_up_every_quota():
    quotas = np.array([500, 0, 3, 120, 1], np.int64)
    tree = mixing.splitting_tree(quotas, 13)
    by_colour, by_shard = Counter(), Counter()
    for colour, shard, n in tree:
        by_colour[colour] += n
        by_shard[shard] += n
    assert [by_colour[i] for i in range(5)] == quotas.tolist()
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 13
    assert tree == mixing.splitting_tree(quotas, 13) and mixing.splitting_tree(quotas, 1)
    # over many seeds the mean composition is proportional to the quotas
    first = np.mean([sum(n for c, s, n in mixing.splitting_tree(quotas, 13, seed) if (c, s) == (0, 0)) for seed in range(400)])
    assert abs(first - 500 / 13) < 1


def water_level(sizes, weights, most=3):
    """Share by weight, stop what is above, share the excess again, until none is above."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else rest * weights[i] / weight if weight else 0 for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(target) if i not in capped and t > most * sizes[i]}
        if not above:
            return target
        capped |= above


def test_targets_and_mix(spark):
    rng = random.Random(2)
    sizes = {"a": 3, "b": 900, "c": 40, "d": 7, None: 250, "é": 0}
    rows = []
    for source, n in sizes.items():
        left = n
        while left > 0:
            z = min(left, rng.randint(1, 9))
            rows.append((len(rows), " ".join(["w"] * z), source))
            left -= z
    rows += [(len(rows), None, "é"), (len(rows) + 1, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, 5, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "size", "source_size", "target", "copy", "shard", "place")
    got = mixed.collect()
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = dict(zip(order, water_level([sizes[s] for s in order], [5, 2, 1, 5, 2, 1]), strict=True))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert (r["copy"] is None) == (r["shard"] is None) and (r["copy"] is None or 0 <= r["copy"] < 3)
        taken[r["source"]] += r["size"] if r["copy"] is not None else 0
    assert all(abs(taken[s] - want[s]) <= 9 for s in sizes)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and len({r["shard"] for r in got} - {None}) == 5
    again = mixing.mix(docs.repartition(7), 5, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "size", "source_size", "target", "copy", "shard", "place").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_edge_cases_keeps_every_column(edge, empty):
    mixed = mixing.mix(edge, 3)
    assert mixed.select("row_id").distinct().count() == edge.count()
    out = mixing.materialize(edge, mixed, 3)
    assert out.columns == edge.columns and out.filter("text is null or text = ''").count() == 0
    assert mixing.mix(empty, 3).count() == 0 and mixing.materialize(empty, mixing.mix(empty, 3), 3).columns == edge.columns


def test_tasks_split_as_the_whole_tree_does(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_SHARDS", 3)
    quotas = np.array([500, 0, 3, 120, 1], np.int64)
    got = sorted(map(tuple, mixing.deal(spark, quotas, 29).collect()))
    assert got == sorted(mixing.splitting_tree(quotas, 29))


def test_shards_hold_the_blocks_that_the_tree_deals(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 4)), rng.choice("aab")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = 6
    mixed = mixing.mix(docs, shards, carry=["source"]).select("row.source", "size", "target", "shard", "place", "key").collect()
    target = {r["source"]: r["target"] for r in mixed}
    block = int(sum(target.values())) // (mixing.BLOCKS_PER_SHARD * shards)
    quotas = [-(-target[s] // block) for s in "ab"]
    words = Counter()
    for r in mixed:
        if r["shard"] is not None:
            words[r["source"], r["shard"]] += r["size"]
    for colour, shard, n in mixing.splitting_tree(np.array(quotas, np.int64), shards):
        # each block holds its words to within half a document at either end
        size = target["ab"[colour]] / quotas[colour]
        assert abs(words.pop(("ab"[colour], shard)) - n * size) <= 4 * n
    assert not words
    drawn = mixing.materialize(docs, mixing.mix(docs, shards), shards)
    by_part = drawn.groupBy(F.spark_partition_id().alias("shard"), "source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n")).collect()
    want = Counter((r["shard"], r["source"]) for r in mixed)
    want = {k: sum(r["size"] for r in mixed if (r["shard"], r["source"]) == k) for k in want if k[0] is not None}
    assert {(r["shard"], r["source"]): r["n"] for r in by_part} == want


def test_mix_of_repeated_rows_equals_sql_in_any_order(spark, edge, tmp_path):
    rng = random.Random(6)
    odd = [(rng.choice([None, None, 1, 2, 3]), rng.choice([None, "", "a b", "c", "d e f g", "a b"]), rng.choice(["x", None, "y"])) for _ in range(300)]
    rows = edge.select("doc_id", "text", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    found = []
    for name, df in (("one", rows.coalesce(1)), ("many", rows.orderBy(F.rand(3)).repartition(7))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/{name}/documents.parquet/*.parquet'")
        named = lambda frame: frame.assign(doc_id=frame["doc_id"].fillna(-1).astype("int64"))
        got = named(QUERIES["op9_mixing"](spark, f"{tmp_path}/{name}").toPandas())
        same(got, named(con.execute(SQL["op9_mixing"]).df()))
        found.append(Counter(map(str, got.values.tolist())))
    assert found[0] == found[1] and sum(found[0].values()) == rows.count()


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34 !!", "en", "x", 8), (10_002, "", "en", "x", 0), (10_003, None, None, None, None)], docs.schema)
    now = docs.union(extra).persist()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "personal_data", "mixing", "byte_bpe"]
    named = stages["language_id"](spark, now, SF).persist()
    assert {r["doc_id"] for r in named.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    unique = stages["near_duplicates"](spark, named, SF).persist()
    want = groups({r["doc_id"]: r["text"] for r in named.select("doc_id", "text").collect()}, 5)
    assert sorted(r["doc_id"] for r in unique.select("doc_id").collect()) == sorted({v[1] for v in want.values()})
    clean = stages["personal_data"](spark, unique, SF).persist()
    assert clean.count() == unique.count() and clean.filter("text rlike '@mail[0-9]+[.]example'").count() == 0
    assert clean.filter(F.length("text") != F.col("n_chars")).count() == 0
    mixed = stages["mixing"](spark, clean, SF).persist()
    assert mixed.columns == clean.columns == docs.columns and mixed.schema == docs.schema
    total = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(total(mixed) - total(clean)) < 0.1 * total(clean)
    last = stages["byte_bpe"](spark, mixed, SF)
    pairs = Counter((r["doc_id"], r["decoded_sha256"]) for r in last.collect())
    assert pairs == Counter((r[0], r[1]) for r in mixed.select("doc_id", F.sha2(F.col("text").cast("binary"), 256)).collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (2, "g h i j k l", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == ["1", "2", "None"]
