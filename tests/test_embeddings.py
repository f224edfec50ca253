import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraft.functions import vectors as V
from lexigraft.functions.text import char_ngrams, ngram_rows
from lexigraft.operators import alignment, embeddings as E, ngrams, similarity

VEC = "word string, vec array<float>"
LEX = "word string, morphemes array<string>"


@pytest.fixture(scope="module")
def space(spark):
    return spark.createDataFrame(
        [("ሰላም", [1.0, 0.0, 0.0, 0.0]), ("ኣዊ", [0.0, 1.0, 0.0, 0.0]), ("ኮምፒተር", [0.0, 0.0, 1.0, 0.0])], VEC
    )


def tokens(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "token string")


def test_fallback_chain_stages(spark, space):
    lex = spark.createDataFrame([("ሰላማዊ", ["ሰላም", "ኣዊ"]), ("ቃል", ["የለም"]), ("ደጋ", ["ሰላም", "ሰላም", "ኣዊ", "x"])], LEX)
    toks = tokens(spark, "ሰላማዊ", "ኮምፒተር", "ቃል", "ደጋ")
    rows = {r["token"]: (r["origin"], r["vec"]) for r in E.initial_vectors(toks, lex, space, 4).collect()}
    assert rows["ሰላማዊ"] == ("morpheme", [0.5, 0.5, 0.0, 0.0])
    assert rows["ኮምፒተር"] == ("whole_token", [0.0, 0.0, 1.0, 0.0])
    assert rows["ደጋ"][0] == "morpheme" and np.allclose(rows["ደጋ"][1], [2 / 3, 1 / 3, 0, 0])
    origin, vec = rows["ቃል"]
    assert origin == "char_ngram" and len(vec) == 4 and any(vec)


def test_chain_with_an_ngram_table_projects_only_lexical_vectors(spark, space):
    lex = spark.createDataFrame([("aa", ["ሰላም"])], LEX)
    grams = spark.createDataFrame([("<x>", [4.0] * 4)], "ngram string, vec array<double>")
    w = np.eye(4)[[1, 0, 2, 3]]
    got = E.initial_vectors(tokens(spark, "aa", "x", "yy"), lex, space, 4, w, grams)
    rows = {r["token"]: r["vec"] for r in got.collect()}
    assert rows == {"aa": [0.0, 1.0, 0.0, 0.0], "x": [4.0] * 4, "yy": None}


@pytest.mark.parametrize("dim", [63, 64, 768])
def test_vector_sums_have_equal_bits_however_rows_are_dealt_out(spark, dim):
    rng = np.random.default_rng(dim)
    values = rng.normal(size=(400, dim)) * 10.0 ** rng.integers(-12, 12, size=(400, 1))
    rows = [(int(g), v.tolist(), float(w)) for g, v, w in zip(rng.integers(0, 5, 400), values, rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "g int, vec array<double>, w double")
    for weight in (None, F.col("w")):
        bits = []
        for dealt in (df.coalesce(1), df.orderBy(F.rand(1)).repartition(7), df.orderBy("w").repartition(2)):
            bits.append({r["g"]: (r["n"], np.array(r["sums"]).tobytes()) for r in E.sum_vectors(dealt, ["g"], dim, weight=weight).collect()})
            bits[-1]["all"] = np.array(E.sum_vectors(dealt, [], dim, weight=weight).first()["sums"]).tobytes()
        assert bits[0] == bits[1] == bits[2]
        for g in range(5):
            mine = [(v, w if weight is not None else 1.0) for k, v, w in rows if k == g]
            exact = [math.fsum(w * v[i] for v, w in mine) for i in range(dim)]
            assert bits[0][g][0] == len(mine) and np.allclose(np.frombuffer(bits[0][g][1]), exact, rtol=1e-15, atol=0)


def test_sums_of_odd_values(spark):
    rows = [("a", [1e17, 1.0, float("inf"), 2.0**-100]), ("a", [1.0, -1.0, 1.0, 2.0**-119]), ("a", [-1e17, 2.0, 1.0, 0.0])]
    got = E.sum_vectors(spark.createDataFrame(rows, "k string, vec array<double>"), ["k"], 4).first()["sums"]
    assert got[:2] == [1.0, 2.0] and np.isnan(got[2]) and got[3] == 2.0**-100 + 2.0**-119
    none = spark.createDataFrame([], "k string, vec array<double>")
    assert E.sum_vectors(none, ["k"], 4).count() == 0 and E.sum_vectors(none, [], 4).collect()[0]["sums"] == [0.0] * 4
    assert E.mean_row(none, 4).count() == 0
    two = spark.createDataFrame([(None, 1, [1.0]), (None, 1, [2.0]), ("x", None, [4.0])], "k string, j int, vec array<double>")
    assert {(r["k"], r["j"], r["n"], r["sums"][0]) for r in E.sum_vectors(two, ["k", "j"], 1).collect()} == {(None, 1, 2, 3.0), ("x", None, 1, 4.0)}


def test_a_second_width_is_refused_at_every_entry(spark, space):
    ragged = space.unionByName(spark.createDataFrame([("rag", [1.0, 2.0])], VEC))
    lex = spark.createDataFrame([("t", ["ሰላም", "rag"])], LEX)
    rows = spark.createDataFrame([(0, [1.0] * 4), (1, [1.0] * 3)], "id long, vec array<double>")
    pairs = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0], [1.0])], "x array<double>, y array<double>")
    grams = spark.createDataFrame([("<x>", [1.0])], "ngram string, vec array<double>")
    refs, one = ids(spark, (1, [1.0, 0.0]), (2, [1.0])), spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    entries = [
        lambda: E.morpheme_means(spark.createDataFrame([("t", ["ሰላም", "rag"])], "token string, morphemes array<string>"), ragged, 4),
        lambda: E.lexical_vectors(tokens(spark, "rag"), lex, ragged, 4),
        lambda: E.initial_vectors(tokens(spark, "t"), lex, ragged, 4),
        lambda: E.ngram_means(tokens(spark, "x"), grams, 4),
        lambda: E.mean_row(rows, 4),
        lambda: E.sum_vectors(rows, ["id"], 4),
        lambda: alignment.gram_rows(pairs, 2),
        lambda: similarity.top_k_similar(one, refs, 1, 2),
        lambda: similarity.top_k_similar(one, refs, 1, 2, broadcast_bytes=0),
        lambda: similarity.top_k_similar(refs.withColumnRenamed("id", "query_id"), refs.limit(1), 1, 2),
    ]
    for entry in entries:
        with pytest.raises(Exception, match="IncompatibleDimension"):
            entry().collect()


def test_gaussian_rows_are_pure_functions(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(300)], "t string")
    draw = lambda n: {r["t"]: r["v"] for r in df.repartition(n).select("t", V.gaussian(F.col("t"), 64, 5).alias("v")).collect()}
    a, b = draw(1), draw(9)
    assert a == b
    cells = np.array(list(a.values()))
    assert abs(cells.mean()) < 0.03 and abs(cells.std() - 1) < 0.03
    assert len({tuple(v) for v in a.values()}) == 300


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id long, vec array<float>")
    new = spark.createDataFrame([(1, [5.0]), (2, [6.0])], "id long, vec array<float>")
    assert {r["id"]: r["vec"] for r in E.upsert_rows(old, new).collect()} == {0: [0.0], 1: [5.0], 2: [6.0]}


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, vec array<double>")


def test_drift_penalty(spark):
    zeros, ones = ids(spark, (0, [0.0, 0.0]), (1, [9.0, 9.0])), ids(spark, (0, [1.0, 1.0]))
    pen = lambda lam: E.drift_penalty(zeros, ones, lam).first()["penalty"]
    assert (pen(1.0), pen(2.0), pen(0.0)) == (1.0, 2.0, 0.0)
    assert E.drift_penalty(ones, ones, 1.0).first()["penalty"] == 0.0
    assert E.drift_gradient(zeros, ones, 3.0).first()["grad"] == [-3.0, -3.0]
    with pytest.raises(ValueError):
        pen(-1.0)
    for unset in (None, float("nan")):
        with pytest.raises(E.MissingParameter):
            pen(unset)


def test_frozen_rows(spark):
    a, b = ids(spark, (0, [1.0]), (1, [1.0]), (2, [1.0])), ids(spark, (0, [1.0]), (1, [1.5]), (2, [7.0]))
    assert [(r["id"], r["max_change"]) for r in E.changed_frozen_rows(a, b, 2).collect()] == [(1, 0.5)]


def test_width_and_matrix_guards(spark):
    with pytest.raises(E.IncompatibleDimension, match="300"):
        E.check_dimensions(300, 768)
    with pytest.raises(E.IncompatibleDimension):
        E.vector_width(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], VEC))
    with pytest.raises(E.MissingAlignmentMatrix):
        E.load_matrix(None, 4)
    w = np.random.default_rng(0).normal(size=(3, 3))
    table = alignment.matrix_table(spark, w)
    assert np.allclose(E.load_matrix(table, 3), w, atol=1e-6)
    for dim in (2, 4):
        with pytest.raises(E.IncompatibleDimension):
            E.load_matrix(table, dim)
    assert alignment.is_identity(alignment.matrix_table(spark, np.eye(3))).first()[0]
    assert not alignment.is_identity(table).first()[0]
    assert alignment.describe(3, "x", True) == "W 3x3 from x (frozen, identity)"


def test_procrustes_recovers_a_rotation_and_beats_other_rotations(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    x = rng.normal(size=(200, 6))
    exact = spark.createDataFrame([(a.tolist(), (q @ a).tolist()) for a in x], "x array<double>, y array<double>")
    w = alignment.procrustes(exact.repartition(5), 6, 6)
    assert np.allclose(w, q, atol=1e-8) and alignment.orthogonality_error(w) < 1e-8
    noisy = spark.createDataFrame([(a.tolist(), rng.normal(size=6).tolist()) for a in x], "x array<double>, y array<double>")
    best = alignment.residuals(noisy, alignment.procrustes(noisy, 6, 6)).first()
    for other in (q, np.eye(6)):
        assert best["residual"] <= alignment.residuals(noisy, other).first()["residual"] + 1e-9
    with pytest.raises(E.IncompatibleDimension):
        alignment.procrustes(noisy, 6, 5)


@pytest.mark.parametrize("k", [3, 10, 500])
def test_top_k_equals_brute_force_in_both_layouts(spark, k):
    rng = np.random.default_rng(2)
    refs = rng.normal(size=(130, 8))
    refs[100:] = refs[:30]  # equal vectors must tie by id
    refs /= np.linalg.norm(refs, axis=1, keepdims=True) + 1e-8
    queries = rng.normal(size=(90, 8))
    r = spark.createDataFrame([(i + 1000, v.tolist()) for i, v in enumerate(refs)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vec array<double>")
    unit = queries / (np.linalg.norm(queries, axis=1, keepdims=True) + 1e-8)
    scores = np.round(unit @ refs.T, 9)
    want = {(i, j + 1000, n + 1) for i, row in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(130), -row))[:k])}
    for limit in (1 << 30, 0):
        top = similarity.top_k_similar(q, r, k, 8, broadcast_bytes=limit, block_bytes=40 * 8 * 8)
        assert {(x["query_id"], x["ref_id"], x["rank"]) for x in top.collect()} == want
    w = similarity.weighted_neighbours(q, r, k, 8).groupBy("query_id").agg(F.sum("weight").alias("w")).collect()
    assert np.allclose([x["w"] for x in w], 1.0)


def test_unknown_initializer_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown initializer"):
        E.initialize("nope", E.InitInputs(tokens=None, old_rows=None))


@pytest.mark.parametrize("dim", [2, 64, 127, 129, 768])
def test_vector_sums_treat_nulls_and_weights_alike_at_every_width(spark, dim):
    ones, holed = [1.0] * dim, [None] + [3.0] * (dim - 1)
    rows = spark.createDataFrame(
        [("a", ones, 2.0), ("a", holed, -1.0), ("a", None, 5.0), ("a", ones, None), ("z", ones, 0.0), ("n", None, 1.0)],
        "k string, vec array<double>, w double",
    )
    got = {r["k"]: r for r in E.sum_vectors(rows, ["k"], dim, weight=F.col("w")).collect()}
    assert got["a"]["n"] == 2 and np.allclose(got["a"]["sums"], [2.0] + [-1.0] * (dim - 1))
    assert got["z"]["n"] == 1 and np.allclose(got["z"]["sums"], np.zeros(dim)) and got["n"]["n"] == 0
    means = {r["k"]: r for r in E.mean_vectors(rows, ["k"], dim).collect()}
    assert set(means) == {"a", "z"} and means["a"]["n"] == 3 and np.allclose(means["a"]["vec"], [2 / 3] + [5 / 3] * (dim - 1))


@pytest.mark.parametrize("copies", [1, 1500])
def test_uncovered_morphemes_do_not_count_however_often_they_occur(spark, copies):
    tokens = spark.createDataFrame([(f"t{i}", ["known", "bare", "absent"]) for i in range(copies)], "token string, morphemes array<string>")
    vectors = spark.createDataFrame([("known", [2.0, 4.0]), ("bare", None)], "word string, vec array<double>")
    got = E.morpheme_means(tokens, vectors, 2).select("n", "vec").distinct().collect()
    assert [(r["n"], r["vec"]) for r in got] == [(1, [2.0, 4.0])]


def test_top_k_takes_references_of_any_length(spark):
    refs = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 0.0]), (3, [-9.0, 0.0])], "id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    for limit in (1 << 30, 0):
        assert [r["ref_id"] for r in similarity.top_k_similar(queries, refs, 2, 2, broadcast_bytes=limit).orderBy("rank").collect()] == [1, 2]


def test_cell_std_equals_numpy(spark):
    rows = np.random.default_rng(4).normal(size=(30, 5))
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, vec array<double>")
    got = E.cell_std(table).first()
    assert got["n_cells"] == 150 and np.isclose(got["std"], rows.std(ddof=1))
    assert E.cell_std(table.limit(0)).first()["std"] is None


def clustered(rng, n, dim, centres):
    return centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, dim))


def tables_of(spark, queries, refs):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vec array<double>")
    return q, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)], "id long, vec array<double>")


def test_bounds_skip_blocks_and_change_nothing(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    refs, queries = similarity._unit(clustered(rng, 3000, 16, centres)), clustered(rng, 400, 16, centres)
    index = similarity.build_index(refs, [[i] for i in range(3000)], 100)
    near, made = similarity.search(queries, index, 5)
    scores = np.round(similarity._unit(queries) @ refs.T, 9)
    want = [j for row in scores for j in np.lexsort((np.arange(3000), -row))[:5].tolist()]
    assert near["ref_id"].tolist() == want
    assert made < 0.3 * scores.size
    for unit, block in ((similarity._unit(queries), b) for b in index.blocks):
        at = [b.rows is block.rows for b in index.blocks].index(True)
        assert ((unit @ block.rows.T).max(axis=1) <= unit @ index.centres[at] + index.radii[at] + 1e-12).all()
    q, r = tables_of(spark, queries, refs)
    found = similarity.skipped_share(q, r, 5, 16).first()
    assert found["n_pairs"] == 400 * 3000 and found["skipped"] > 0.5
    for limit in (1 << 30, 0):
        rows = similarity.top_k_similar(q, r, 5, 16, broadcast_bytes=limit, block_bytes=150 * 21 * 8).orderBy("query_id", "rank").collect()
        assert [x["ref_id"] for x in rows] == want


def test_equal_vectors_are_searched_once_and_come_out_for_all(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 8))
    refs, queries = base[rng.integers(0, 20, 500)], base[rng.integers(0, 20, 300)]
    q, r = tables_of(spark, queries, refs)
    q = q.unionByName(spark.createDataFrame([(9999, None)], q.schema))
    _, classes = similarity.vector_classes(q, "query_id", 8)
    assert classes.count() == 20
    scores = np.round(similarity._unit(queries) @ refs.T, 9)
    want = {(i, j, n + 1) for i, row in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(500), -row))[:30])}
    for limit in (1 << 30, 0):
        got = similarity.top_k_similar(q, r, 30, 8, broadcast_bytes=limit, block_bytes=7 * 38 * 8).collect()
        assert {(x["query_id"], x["ref_id"], x["rank"]) for x in got} == want
    assert similarity.top_k_similar(q.limit(0), r, 3, 8).count() == 0 and similarity.top_k_similar(q, r.limit(0), 3, 8).count() == 0


@pytest.mark.parametrize("bucket_rows", [4096, 50])
def test_approximate_neighbours_reach_the_recall(spark, bucket_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 32))
    refs, queries = similarity._unit(clustered(rng, 4000, 32, centres)), clustered(rng, 300, 32, centres)
    q, r = tables_of(spark, queries, refs)
    exact = {(x["query_id"], x["ref_id"]): x["score"] for x in similarity.top_k_similar(q, r, 10, 32).collect()}
    found = {(x["query_id"], x["ref_id"]): x["score"] for x in similarity.top_k_approximate(q, r, 10, 32, bucket_rows=bucket_rows).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[k] == exact[k] for k in exact.keys() & found.keys())
    whole = similarity.top_k_approximate(q, r, 10, 32, tables=1, bits=1, probes=2).collect()
    assert {(x["query_id"], x["ref_id"]) for x in whole} == set(exact)


def test_gram_has_equal_bits_however_rows_are_dealt_out(spark):
    rng = np.random.default_rng(8)
    rows = [((10.0**e * v).tolist(), w.tolist()) for v, w, e in zip(rng.normal(size=(500, 6)), rng.normal(size=(500, 6)), rng.integers(-6, 6, 500), strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    bits = [[(r["row"], np.array(r["vec"]).tobytes()) for r in alignment.gram_rows(d, 6).orderBy("row").collect()] for d in (df.coalesce(1), df.orderBy(F.rand(2)).repartition(9))]
    assert bits[0] == bits[1]
    exact = [[math.fsum(b[i] * a[j] for a, b in rows) for j in range(6)] for i in range(6)]
    assert np.allclose([np.frombuffer(b) for _, b in bits[0]], exact, rtol=1e-12)


def test_functions_may_stand_for_lexicon_and_vector_table(spark):
    """D4, D6 and D12 give equal rows from tables and from functions that say the same."""
    words = {"ab": [1.0, 2.0], "c": [0.5, -1.0], "abc": [3.0, 3.0], "zz": [0.25, 8.0]}
    table = spark.createDataFrame(list(words.items()), VEC)
    lex = spark.createDataFrame([("abc", ["ab", "c"]), ("cab", ["c", "none"]), ("abab", ["ab", "ab"])], LEX)
    toks = tokens(spark, "abc", "cab", "abab", "zz", "none", "x")
    look = F.create_map(*[F.lit(x) for w, v in words.items() for x in (w, v)])
    parts = F.create_map(*[F.lit(x) for w, v in (("abc", ["ab", "c"]), ("cab", ["c", "none"]), ("abab", ["ab", "ab"])) for x in (w, v)])

    def vector(word):
        return F.try_element_at(look, word)

    def segmenter(token):
        return F.try_element_at(parts, token)

    rows = lambda df: sorted(map(str, df.collect()))
    w = np.array([[0.0, 1.0], [2.0, 0.0]])
    want = rows(E.lexical_vectors(toks, lex, table, 2).select("token", "vec", "origin"))
    full = rows(E.initial_vectors(toks, lex, table, 2, w).select("token", "origin", "vec"))
    ids_ = toks.withColumn("id", F.xxhash64("token"))
    old = ids(spark, (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]))
    focus = lambda v: rows(E.initialize("focus", E.InitInputs(tokens=ids_, old_rows=old, aux_rows=old, vectors=v, dim=2, top_k=2)).select("token", "vec"))
    near = focus(table)
    for lexicon, vectors in ((segmenter, table), (lex, vector), (segmenter, vector)):
        assert rows(E.lexical_vectors(toks, lexicon, vectors, 2).select("token", "vec", "origin")) == want
        assert rows(E.initial_vectors(toks, lexicon, vectors, 2, w).select("token", "origin", "vec")) == full
    assert focus(vector) == near
    assert rows(E.whole_token_vectors(toks, vector)) == rows(E.whole_token_vectors(toks, table))

    @F.pandas_udf("array<string>")
    def halves(token):
        return token.map(lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])

    got = {r["token"]: (r["origin"], r["vec"]) for r in E.lexical_vectors(toks, halves, vector, 2).collect()}
    assert got["abab"] == ("morpheme", [1.0, 2.0]) and got["zz"] == ("whole_token", [0.25, 8.0]) and got["x"][0] == "char_ngram"


def test_ngram_vectors_go_once_to_a_block_of_tokens(spark):
    names = [a + b for a in ("stone", "water", "ሰላማዊ", "x😀") for b in ("", "s", "ing", "ings", "ed", "less", "lessly")]
    toks = tokens(spark, *names, *names[:3], None, "", "abcdefghijklmnopqrstuvwxyz")
    rows = ngrams.cut_blocks(toks.coalesce(1), 3, 5, 60).collect()
    grams = lambda t: [f"<{t}>"[i : i + n] for n in (3, 4, 5) for i in range(len(t) + 3 - n)]
    listed = {r["block"]: r["ngrams"] for r in rows if r["ngrams"] is not None}
    members = [r for r in rows if r["places"] is not None]
    assert {r["token"]: r["times"] for r in members} == {n: 1 + (n in names[:3]) for n in names}
    assert [r["token"] for r in rows if r["block"] is None] == ["abcdefghijklmnopqrstuvwxyz"]
    for r in members:
        assert sorted(listed[r["block"]][k] for k in r["places"]) == sorted(grams(r["token"]))
    assert all(len(set(g)) == len(g) <= 60 for g in listed.values())
    # a vector is asked for by blocks, not by each occurrence
    [whole] = ngrams.cut_blocks(toks.coalesce(1), 3, 5, 1000).filter("ngrams is not null").collect()
    assert sorted(whole["ngrams"]) == sorted({g for n in [*names, "abcdefghijklmnopqrstuvwxyz"] for g in grams(n)})


@pytest.mark.parametrize("block_bytes", [64 << 20, 8 * 6 * 50])
def test_ngram_means_are_those_of_all_occurrences(spark, monkeypatch, block_bytes):
    """Equal bits, with repeated, null, empty, broken and very long tokens, n-grams that repeat or lack a vector, odd cells."""
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(12)
    names = ["".join(rng.choice(list("abcሰላ😀"), rng.integers(1, 12))) for _ in range(150)]
    broken = spark.sql("select cast(X'61FF62' as string) as token")
    toks = tokens(spark, *names, *names[:40], *names[:10], None, "", "ab" * 40, "zzzzz").unionByName(broken)
    of_all = [g for g in dict.fromkeys(r["g"] for r in toks.select(F.explode(char_ngrams(F.col("token"))).alias("g")).collect()) if "z" not in g]
    values = rng.normal(size=(len(of_all), 6)) * 10.0 ** rng.integers(-14, 9, size=(len(of_all), 6))
    table = [(g, None if i % 11 == 3 else [None if i % 13 == 4 else float(x) for x in v]) for i, (g, v) in enumerate(zip(of_all, values, strict=True))]
    table += [(g, [1.0, 1e-20, 3.0, float("inf") if i == 5 else 0.5, -1e8, 2.0**-70]) for i, g in enumerate(of_all[:30])] + [(None, [1.0] * 6)]
    probe = toks.select("token", F.explode(char_ngrams(F.col("token"))).alias("ngram"))
    for kind in ("double", "float"):
        vectors = spark.createDataFrame(table, f"ngram string, vec array<{kind}>")
        bits = lambda df: sorted((r["t"], r["n"], np.array(r["vec"]).tobytes()) for r in df.select(F.hex(F.col("token").cast("binary")).alias("t"), "n", "vec").collect())
        got = bits(E.ngram_means(toks, vectors, 6))
        assert got == bits(E.mean_vectors(probe.join(vectors.filter("vec is not null"), "ngram"), ["token"], 6)) and len(got) > 100
    assert E.ngram_means(toks, vectors.limit(0), 6).count() == E.ngram_means(toks.limit(0), vectors, 6).count() == 0


def test_ngram_rows_are_the_elements_of_char_ngrams(spark, monkeypatch):
    toks = tokens(spark, "a", "", None, "ሰላማዊ", "x😀yz", "aaaa", "aaaa")
    for sizes in ((3, 5), (1, 2), (4, 4)):
        want = toks.select(F.explode(char_ngrams(F.col("token"), *sizes)).alias("ngram"))
        assert sorted(ngram_rows(toks, "token", *sizes).collect()) == sorted(want.collect())
        for run in (1 << 20, 48):
            monkeypatch.setattr(ngrams, "_RUN", run)
            assert sorted(ngrams.distinct_ngrams(toks, "token", *sizes).collect()) == sorted(want.distinct().collect())
