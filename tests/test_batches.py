"""Batch functions against the column expressions they stand for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraft.functions import vectors as V
from lexigraft.functions.arrays import md5_bucket, md5_buckets, numbered_md5_buckets
from lexigraft.functions.tags import entity_spans
from lexigraft.functions.text import char_ngrams
from lexigraft.operators import ner, qa, similarity


def test_buckets_of_words_and_numbers_are_those_of_md5(spark):
    rows = spark.createDataFrame([(0, ["a", "é", "a", None], "x-", 3), (1, [], "y", 0), (2, None, None, 2)], "k int, w array<string>, p string, n int")
    made = rows.select("k", md5_buckets(F.col("w"), "p").alias("w"), numbered_md5_buckets(F.col("p"), F.col("n")).alias("n"), F.col("w").alias("words"))
    got = {r["k"]: r for r in made.collect()}
    one = lambda t: spark.range(1).select(md5_bucket(F.lit(t))).first()[0]
    assert got[0]["w"] == [one("pa"), one("pé"), one("pa"), None] and got[0]["n"] == [one("x-0"), one("x-1"), one("x-2")]
    assert got[1]["w"] == [] and got[1]["n"] == [] and got[2]["w"] is None and got[2]["n"] == [None, None]


def test_span_counts_agree_with_spans_as_sets(spark):
    rng = np.random.default_rng(5)
    names = ["O", "B-A", "I-A", "I-B", "B-B", "B-", "x", None]
    draw = lambda n: [names[i] for i in rng.integers(0, len(names), n)]
    data = [(i, draw(n := int(rng.integers(0, 12))), draw(n)) for i in range(200)] + [(200, None, ["B-A"]), (201, [], [])]
    rows = spark.createDataFrame(data, "k int, p array<string>, g array<string>").repartition(3)
    got = rows.select(ner.span_counts(F.col("p"), F.col("g")).alias("c"), entity_spans(F.col("p")).alias("p"), entity_spans(F.col("g")).alias("g"))
    for r in got.collect():
        p, g = set(map(tuple, r["p"])), set(map(tuple, r["g"]))
        assert tuple(r["c"]) == (len(p & g), len(p - g), len(g - p))


def test_best_spans_searches_a_window_once(spark):
    offsets = [None, {"start": 0, "end": 2}, {"start": 3, "end": 5}, None]
    schema = "id string, window int, feature_offsets array<struct<start:int,end:int>>, s_scores array<double>, e_scores array<double>"
    rows = spark.createDataFrame([("a", 0, offsets, [9.0, 1.0, 2.0, 9.0], [9.0, 5.0, 4.0, 9.0]), ("b", 0, [None], [1.0], [1.0])], schema)
    best = qa.best_spans(rows)
    got = best.collect()
    assert [(r["id"], r["score"], r["a_start"], r["a_end"]) for r in got] == [("a", 6.0, 3, 5)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") <= 2  # starts and ends, once each


def test_search_is_the_same_in_small_steps(monkeypatch):
    rng = np.random.default_rng(3)
    refs, queries = rng.normal(size=(900, 8)), rng.normal(size=(70, 8))
    index = similarity.build_index(refs, [[i] for i in range(900)], block_rows=50)
    whole, products = similarity.search(queries, index, 4)
    monkeypatch.setattr(similarity, "_FOUND", 4 * len(index.blocks) * 3)
    calls = []
    inner = similarity._search_some
    monkeypatch.setattr(similarity, "_search_some", lambda q, *a: calls.append(len(q)) or inner(q, *a))
    parts, made = similarity.search(queries, index, 4)
    assert parts.equals(whole) and made == products and max(calls) == 3


def test_window_labels_bound_their_batches(spark):
    from lexigraft import session

    before = spark.conf.get(session._BYTES_SETTING)
    try:
        spark.conf.set(session._BYTES_SETTING, session._BYTES_DEFAULT)
        session.bounded_batches(spark)
        assert spark.conf.get(session._BYTES_SETTING) == session.BATCH_BYTES
        spark.conf.set(session._BYTES_SETTING, "1048576b")
        session.bounded_batches(spark)
        assert spark.conf.get(session._BYTES_SETTING) == "1048576b"
    finally:
        spark.conf.set(session._BYTES_SETTING, before)


def test_gaussian_rows_by_blocks_are_the_same(spark):
    hashes = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    assert np.array_equal(V.normal_rows(hashes, 48), V.normals(hashes[:, None], V.lanes(48)))
    texts = ["aaaa", "", "banana", "aaaa", "bandana", None] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, word string").coalesce(1)
    got = V.with_gaussian_ngram_mean(rows, char_ngrams(F.col("word")), "m", 6, 0.5, 9).orderBy("i").collect()
    hashed = rows.select("i", F.transform(char_ngrams(F.col("word")), lambda g: F.xxhash64(F.lit(9), g)).alias("h")).orderBy("i").collect()
    for r, x in zip(got, hashed, strict=True):
        if not x["h"]:
            assert r["m"] is None
            continue
        drawn = V.normals(np.array(x["h"], np.int64).view(np.uint64)[:, None], V.lanes(6))
        assert r["m"] == pytest.approx(0.5 * drawn.mean(axis=0))


def test_single_precision_does_not_decide():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 16))
    # references that differ by less than single precision tells apart, and equal ones
    refs = np.repeat(similarity._unit(base + 1e-9 * rng.normal(size=(40, 16))), 2, axis=0)
    refs = np.concatenate([refs, similarity._unit(rng.normal(size=(300, 16)))])
    queries = np.concatenate([base, rng.normal(size=(20, 16))])
    for scale in (1.0, 1e20):  # the second is beyond what is multiplied in single precision
        index = similarity.build_index(refs * scale, [[i] for i in range(len(refs))], 32)
        near, _ = similarity.search(queries, index, 7)
        scores = np.round(similarity._unit(queries) @ (refs * scale).T, 9)
        for q in range(len(queries)):
            best = sorted(range(len(refs)), key=lambda i: (-scores[q, i], i))[:7]
            got = near[near["query"] == q]
            if scale == 1.0:
                assert got["ref_id"].tolist() == best
            assert got["score"].to_numpy() == pytest.approx(scores[q, best])


def test_tables_search_meets_what_shares_a_probed_bucket(monkeypatch):
    rng = np.random.default_rng(6)
    refs, queries = similarity._unit(rng.normal(size=(400, 8))), rng.normal(size=(50, 8))
    tables = similarity.Tables(rng.normal(size=(3, 4, 8)), 2)
    block = similarity._block_of(refs, [[2 * i, 2 * i + 1] for i in range(400)])
    whole = similarity.search_tables(queries, block, tables, 5, 4096)
    buckets, probed = tables.buckets(refs), tables.probed(queries)
    scores = np.round(similarity._unit(queries) @ refs.T, 9)
    for q in range(50):
        met = {i for i in range(400) for t in range(3) if buckets[i, t] in probed[q, t]}
        best = sorted(((-scores[q, i], j) for i in met for j in (2 * i, 2 * i + 1)))[:5]
        got = whole[whole["query"] == q]
        assert [(-s, r) for s, r in zip(got["score"], got["ref_id"], strict=True)] == best
    # what is held at once is bounded and changes nothing
    monkeypatch.setattr(similarity, "_SCORES", 64)
    monkeypatch.setattr(similarity, "_HELD", 10)
    assert similarity.search_tables(queries, block, tables, 5, 3).equals(whole)
    assert max(len(v) for v in tables._slices(queries)) == 1


def test_tables_search_counts_an_id_once():
    rng = np.random.default_rng(8)
    refs, queries = similarity._unit(rng.normal(size=(200, 8))), rng.normal(size=(20, 8))
    ids = [[i // 3, 500 + i] if i % 2 else [i // 3] for i in range(200)]
    tables = similarity.Tables(rng.normal(size=(2, 1, 8)), 2)
    near = similarity.search_tables(queries, similarity._block_of(refs, ids), tables, 6, 50)
    scores = np.round(similarity._unit(queries) @ refs.T, 9)
    for q in range(20):
        top = {}
        for i in range(200):
            for j in ids[i]:
                top[j] = max(top.get(j, -2.0), scores[q, i])
        best = sorted((-s, j) for j, s in top.items())[:6]
        got = near[near["query"] == q]
        assert [(-s, r) for s, r in zip(got["score"], got["ref_id"], strict=True)] == best


def test_approximate_search_sends_no_vector_by_bucket(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    refs = spark.createDataFrame(vectors, "id bigint, vec array<double>")
    queries = refs.withColumnRenamed("id", "query_id")
    one = similarity.top_k_approximate(queries, refs, 4, 8).orderBy("query_id", "rank").collect()
    cut = similarity.top_k_approximate(queries, refs, 4, 8, block_bytes=60 * 12 * 8).orderBy("query_id", "rank").collect()
    assert one == cut and len(one) == 1200


def test_normalise_makes_a_length_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "id int, vec array<double>")
    made = similarity.normalise(rows)
    assert made.orderBy("id").collect()[0]["vec"] == pytest.approx([0.6, 0.8]) and made.orderBy("id").collect()[1]["vec"] is None
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(SQRT(aggregate(" in plan  # not inside the function of a cell
