import random

import pytest
from pyspark.sql import functions as F

from lexigraft.operators import keys, vocab


def test_dense_index_does_not_depend_on_partitions(spark):
    words = [f"w{i % 400:03d}x{i}" for i in range(2000)]
    random.Random(1).shuffle(words)
    for n in (1, 16):
        df = spark.createDataFrame([(w,) for w in words], "w string").repartition(n)
        got = {r["w"]: r["idx"] for r in keys.dense_index(df, [F.col("w")]).collect()}
        assert got == {w: i for i, w in enumerate(sorted(words))}


@pytest.mark.parametrize("n", [0, 1, 5, 9, 10, 101, 1999])
def test_split_sizes_are_exact_and_stable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    labels = []
    for parts in (1, 7):
        split = keys.split_80_10_10(df.repartition(parts), 42, ["k"])
        labels.append({r["k"]: r["split"] for r in split.collect()})
    assert labels[0] == labels[1]
    counts = [list(labels[0].values()).count(s) for s in ("train", "dev", "test")]
    assert counts == [int(0.8 * n), int(0.1 * n), n - int(0.8 * n) - int(0.1 * n)]


def test_seeded_rank_is_a_permutation(spark):
    df = spark.range(500)
    a = {r["id"]: r["rank"] for r in keys.seeded_rank(df, 1, ["id"]).collect()}
    b = {r["id"]: r["rank"] for r in keys.seeded_rank(df.repartition(9), 1, ["id"]).collect()}
    c = {r["id"]: r["rank"] for r in keys.seeded_rank(df, 2, ["id"]).collect()}
    assert sorted(a.values()) == list(range(500)) and a == b and a != c


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_key_holding_a_third_of_the_rows(spark, how):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(9000)] + [(9001, None), (9002, "gone")]
    probe = spark.createDataFrame(rows, "i long, key string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{j}", j) for j in range(0, 50, 2)], "key string, v long")
    got = sorted(((r["i"], r["key"], r["v"]) for r in keys.lookup_join(probe, table, "key", "v", how).collect()), key=str)
    want = sorted(((r["i"], r["key"], r["v"]) for r in probe.join(table, "key", how).collect()), key=str)
    assert got == want


def test_lookup_join_with_a_numeric_key(spark):
    probe = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(4000)], "i long, id long")
    table = spark.createDataFrame([(7, "a"), (8, "b")], "id long, v string")
    got = keys.lookup_join(probe, table, "id", "v").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"a": 2000, "b": 1}


def test_expansion_appends_in_order_and_guards_anchors(spark):
    v = spark.createDataFrame([("b", 0), ("▁cc", 1)], "token string, id long")
    new = spark.createDataFrame([("zz",), ("b",), ("aa",), ("zz",)], "token string")
    got = {r["token"]: (r["id"], r["added"]) for r in vocab.expand_vocabulary(v, new).collect()}
    assert got == {"b": (0, False), "▁cc": (1, False), "aa": (2, True), "zz": (3, True)}
    vectors = spark.createDataFrame([("cc", [1.0]), ("b", [1.0])], "word string, vec array<double>")
    rows = vocab.anchors(v, vectors)
    assert [r["surface"] for r in rows.collect()] == ["cc"]
    with pytest.raises(vocab.TooFewAnchors):
        vocab.require_anchors(rows, 2)
