"""Queries: vector lookups, the fallback chain, initializers, alignment, drift."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import char_ngrams
from ..operators import alignment, embeddings as E, similarity, vocab
from ..operators.lexicon import parse_lexicon, segment
from ..operators.ngrams import distinct_ngrams
from ..session import scratch_path, stable
from ..sources import records
from . import inputs as I
from .registry import query
from .sql import N, fingerprint, h, sql

DIM = I.DIM


def print_of(df, *keys):
    """Order-sensitive summary of each vector; SQL computes the same from (key, dim, value)."""
    v = F.col("vec")
    return df.select(
        *keys,
        (F.round(V.total(v), 6) + F.lit(0.0)).alias("v_sum"),  # + 0.0 turns -0.0 into 0.0
        (F.round(V.weighted_total(v), 5) + F.lit(0.0)).alias("v_wsum"),
        F.round(V.norm(v), 6).alias("v_norm"),
    )


class Chain(NamedTuple):
    """Inputs of the fallback chain, all derived from one written word table."""

    words: DataFrame
    tokens: DataFrame
    lexicon: DataFrame
    vectors: DataFrame

    @classmethod
    def of(cls, spark, sf):
        w = I.words(spark, sf)
        lex = parse_lexicon(I.lexicon_lines(w, spark, sf), [F.col("line_no")])
        return cls(w, w.select(F.col("word").alias("token")), lex, I.word_vectors(w, spark, sf))

    def segments(self):
        return segment(self.tokens, self.lexicon)


def matrix(spark):
    return E.load_matrix(I.matrix_rows(spark), DIM)


def ngram_vectors(words, spark, sf):
    return I.ngram_table(distinct_ngrams(words, "word"), spark, sf)


@query("A16_vector_table_scan", sql(f"select {fingerprint()}, count(distinct vec_id) as n, min(d)::bigint as first_dim, max(d)::bigint + 1 as width from vecd"))
def _(spark, sf):
    path = scratch_path(spark, "vectors")
    I.embeddings(spark, sf).write.parquet(path)
    t = records.read_vectors(spark, path, DIM).select("vec_id", F.posexplode("vec").alias("d", "x"))
    x = F.col("x").cast("double")
    return t.agg(
        F.round(F.sum(x), 6).alias("v_sum"), F.round(F.sum(x * (F.col("d") + 1)), 5).alias("v_wsum"),
        F.round(F.sqrt(F.sum(x * x)), 6).alias("v_norm"), F.countDistinct("vec_id").alias("n"),
        F.min("d").cast("bigint").alias("first_dim"), (F.max("d") + 1).cast("bigint").alias("width"),
    )


@query("D1_vector_lookup", sql(f"select w.w as token, {fingerprint()} from words w left join wvec v on v.w = w.w left join vecd on vec_id = v.slot group by w.w"))
def _(spark, sf):
    c = Chain.of(spark, sf)
    return print_of(E.whole_token_vectors(c.tokens, c.vectors), "token")


@query(
    "D2_linear_projection",
    sql(f"select id, {fingerprint()} from (select v.vec_id as id, m.i as d, sum(m.x * v.x) as x from vecd v join wmat m on m.j = v.d group by all) group by id"),
)
def _(spark, sf):
    rows = I.embeddings(spark, sf).select(F.col("vec_id").alias("id"), V.apply_matrix(F.col("vec"), matrix(spark)).alias("vec"))
    return print_of(rows, "id")


@query("D3_morpheme_average", sql(f"select w as token, {fingerprint()} from mmean group by w"))
def _(spark, sf):
    c = Chain.of(spark, sf)
    return print_of(E.morpheme_means(c.segments(), c.vectors, DIM), "token")


@query("J2_morpheme_vector_join", sql("select w as token, count(*) as hits from mhit group by w"))
def _(spark, sf):
    c = Chain.of(spark, sf)
    return E.morpheme_means(c.segments(), c.vectors, DIM).select("token", F.col("n").alias("hits"))


@query(
    "D4_token_vector",
    sql(f"select w as token, origin, {fingerprint()} from initv where origin <> 'char_ngram' group by w, origin"),
)
def _(spark, sf):
    c = Chain.of(spark, sf)
    rows = E.lexical_vectors(c.tokens, c.lexicon, c.vectors, DIM)
    return print_of(rows.filter("vec is not null"), "token", "origin")


@query(
    "D5_char_ngram_mean",
    sql(f"""select w as token, {fingerprint()} from (select w, d, avg(x) as x from (select w, {h("'g'||g")} % {N} as slot from gram)
        join vecd on vec_id = slot group by w, d) group by w"""),
)
def _(spark, sf):
    w = I.words(spark, sf)
    tokens = w.select(F.col("word").alias("token"))
    return print_of(E.ngram_means(tokens, ngram_vectors(w, spark, sf), DIM), "token")


@query(
    "D5_gaussian_ngram_invariants",
    sql("select count(*) as n_tokens, (count(*) * 64)::bigint as n_cells, true as centred, true as scaled, true as repeatable from (select distinct w from gram)"),
)
def _(spark, sf):
    grams = char_ngrams(F.col("word"))
    rows = I.words(spark, sf).select("word", F.size(grams).alias("k"))
    for name in ("a", "b"):
        rows = V.with_gaussian_ngram_mean(rows, grams, name, DIM, E.NGRAM_SCALE, I.SEED)
    rows = rows.filter("a is not null")
    # the mean of k vectors has standard deviation 0.02 / sqrt(k) unless n-grams repeat
    cells = rows.select(
        F.col("a").eqNullSafe(F.col("b")).alias("same"),
        F.size("a").alias("d"),
        V.total(F.col("a")).alias("s"),
        (F.pow(V.norm(F.col("a")), 2) * F.col("k")).alias("q"),
    )
    n = F.sum("d")
    return cells.agg(
        F.count("*").alias("n_tokens"),
        n.cast("bigint").alias("n_cells"),
        (F.abs(F.sum("s") / n) < 0.001).alias("centred"),
        (F.abs(F.sqrt(F.sum("q") / n) / E.NGRAM_SCALE - 1) < 0.05).alias("scaled"),
        F.bool_and("same").alias("repeatable"),
    )


@query("D6_fallback_chain", sql(f"select w as token, origin, {fingerprint()} from initv group by w, origin"))
def _(spark, sf):
    c = Chain.of(spark, sf)
    grams = ngram_vectors(c.words, spark, sf)
    rows = E.initial_vectors(c.tokens, c.lexicon, c.vectors, DIM, ngram_vectors=grams)
    return print_of(rows, "token", "origin")


@query(
    "D6_fallback_chain_projected",
    sql("""select w as token, origin, round(sum(x*cs), 5) + 0.0::double as v_sum, round(sum(x*cw), 4) + 0.0::double as v_wsum from initv
        join (select j, sum(x) as cs, sum(x*(i+1)) as cw from wmat group by j) on j = d
        where origin <> 'char_ngram' group by w, origin
        union all select w, origin, null, null from stage where origin = 'char_ngram'"""),
)
def _(spark, sf):
    c = Chain.of(spark, sf)
    rows = E.initial_vectors(c.tokens, c.lexicon, c.vectors, DIM, matrix(spark))
    v, drawn = F.col("vec"), F.col("origin") == "char_ngram"  # drawn vectors have no SQL form
    return rows.select(
        "token", "origin",
        F.when(~drawn, F.round(V.total(v), 5) + F.lit(0.0)).alias("v_sum"),
        F.when(~drawn, F.round(V.weighted_total(v), 4) + F.lit(0.0)).alias("v_wsum"),
    )


@query("C7_lexicon_coverage", sql("select origin, count(*) as n from stage group by origin"))
def _(spark, sf):
    c = Chain.of(spark, sf)
    rows = E.origins(c.tokens, c.lexicon, c.vectors.select("word"))
    return rows.groupBy("origin").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- matrix rows

def _vocab_and_new(spark, sf):
    old = stable(I.old_vocab(spark, sf))
    new = vocab.expand_vocabulary(old, I.requested_tokens(spark, sf)).filter("added").select("token", "id")
    return old, stable(new)


def resized_rows(old, new, spark, sf):
    """Rows of the expanded vocabulary before initialization."""
    return I.model_rows(old, spark, sf).unionByName(
        I.at_slot(new.select("id", "token"), spark, sf, I.h("z", F.col("token"))).select("id", "vec")
    )


def _inputs(spark, sf, vectors=None, **kw):
    old, new = _vocab_and_new(spark, sf)
    vectors = vectors or I.word_vectors(I.words(spark, sf), spark, sf)
    aux = similarity.normalise(old.select("id", "word").join(vectors, "word").select("id", "vec"))
    return E.InitInputs(
        tokens=new, old_rows=I.model_rows(old, spark, sf), current_rows=resized_rows(old, new, spark, sf),
        vectors=vectors, aux_rows=aux, dim=DIM, seed=I.SEED, **kw,
    )


_FRESHV = f"(select id, token, {h(chr(39)+'z'+chr(39)+'||token')} % {N} as slot from fresh)"


@query(
    "D7_row_upsert",
    sql(f"select id, {fingerprint()} from (select id, d, x from mrow join vecd on vec_id = slot union all select id, d, x from {_FRESHV} join vecd on vec_id = (slot + 1) % {N}) group by id"),
)
def _(spark, sf):
    old, new = _vocab_and_new(spark, sf)
    n = I.embeddings(spark, sf).count()
    written = I.at_slot(new.select("id", "token"), spark, sf, (I.h("z", F.col("token")) % n) + 1).select("id", "vec")
    return print_of(E.upsert_rows(resized_rows(old, new, spark, sf), written), "id")


@query("D8_default_initializer", sql(f"select id, token, {fingerprint()} from {_FRESHV} join vecd on vec_id = slot group by id, token"))
def _(spark, sf):
    return print_of(E.initialize("default", _inputs(spark, sf)), "id", "token")


@query(
    "D9_random_initializer",
    sql("select n, n_cells, round(std, 6) as old_std, true as centred, true as scaled from (select count(*) as n from fresh), (select count(*) as n_cells, stddev_samp(x) as std from mrow join vecd on vec_id = slot)"),
)
def _(spark, sf):
    x = _inputs(spark, sf)
    std = E.cell_std(x.old_rows)
    drawn = E.initialize("random", x).select(F.explode("vec").alias("v"))
    made = drawn.agg((F.count("v") / DIM).cast("bigint").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return made.crossJoin(std).select(
        "n", "n_cells", F.round("std", 6).alias("old_std"),
        (F.abs(F.col("m")) < 0.01 * F.col("std")).alias("centred"), (F.abs(F.col("s") / F.col("std") - 1) < 0.01).alias("scaled"),
    )


@query("D10_width_guard", sql("select count(*) as n_rows, min(len(embedding))::bigint as min_width, max(len(embedding))::bigint as max_width, true as square, true as refused from embeddings"))
def _(spark, sf):
    emb = I.embeddings(spark, sf)
    E.check_dimensions(E.vector_width(emb), DIM)
    square = E.load_matrix(I.matrix_rows(spark), DIM).shape == (DIM, DIM)
    try:
        E.load_matrix(I.matrix_rows(spark), DIM + 1)
        refused = False
    except E.IncompatibleDimension:
        refused = True
    return E.width_profile(emb).select("*", F.lit(square).alias("square"), F.lit(refused).alias("refused"))


@query(
    "D11_identity_test",
    sql("""select 'fixed' as name, bool_and(abs(x - (i=j)::int) <= 1e-8 + 1e-5*(i=j)::int) as is_identity from wmat
        union all select 'gram', bool_and(abs(x - (d=e)::int) <= 1e-8 + 1e-5*(d=e)::int) from
          (select a.d, b.d as e, sum(a.x*b.x) as x from vecd a join vecd b on a.vec_id = b.vec_id group by all)
        union all select 'unit', true"""),
)
def _(spark, sf):
    emb = I.embeddings(spark, sf).select(F.col("vec").alias("x"), F.col("vec").alias("y"))
    unit = spark.range(DIM).select(
        F.col("id").cast("int").alias("row"),
        F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda j: F.when(j == F.col("id"), 1.0).otherwise(0.0)).alias("vec"),
    )
    named = [("fixed", I.matrix_rows(spark)), ("gram", alignment.gram_rows(emb, DIM)), ("unit", unit)]
    parts = [alignment.is_identity(m).select(F.lit(n).alias("name"), "is_identity") for n, m in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- similarity initializer

@query(
    "D12_similarity_initializer",
    sql(f"""select q.id, q.token, {fingerprint('coalesce(m.x, mean.x)', 'mean.d')} from newq q cross join meand mean
        left join mixd m on m.qslot = q.slot and m.d = mean.d group by q.id, q.token"""),
)
def _(spark, sf):
    return print_of(E.initialize("focus", _inputs(spark, sf)), "id", "token")


@query("D13_mean_row_fallback", sql("select f.id, round(s, 6) as v_sum from newq f cross join (select sum(x) as s from meand) where f.slot is null"))
def _(spark, sf):
    x = _inputs(spark, sf)
    bare = x.tokens.join(x.vectors.select(F.col("word").alias("token")), "token", "left_anti")
    mean = E.mean_row(x.old_rows, DIM)
    return bare.crossJoin(F.broadcast(mean)).select("id", F.round(V.total(F.col("vec")), 6).alias("v_sum"))


def _top(spark, sf):
    x = _inputs(spark, sf)
    aux = x.tokens.join(x.vectors.withColumnRenamed("word", "token"), "token")
    return similarity.weighted_neighbours(aux.select(F.col("id").alias("query_id"), "vec"), x.aux_rows, 10, DIM)


@query("J9_similarity_top_k", sql("select q.id as query_id, n.id as ref_id, n.score, n.rank from newq q join near n on n.qslot = q.slot"))
def _(spark, sf):
    return _top(spark, sf).select("query_id", "ref_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("J9_similarity_approximate")
def _(spark, sf):
    # found by hyperplane tables: SQL has the exact form only, see J9_similarity_top_k
    x = _inputs(spark, sf)
    aux = x.tokens.join(x.vectors.withColumnRenamed("word", "token"), "token")
    return similarity.top_k_approximate(aux.select(F.col("id").alias("query_id"), "vec"), x.aux_rows, 10, DIM)


@query("W4_top_k_per_token", sql("select q.id as query_id, count(*) as k, round(max(score) - min(score), 8) as spread from newq q join near n on n.qslot = q.slot group by q.id"))
def _(spark, sf):
    spread = F.round(F.max("score") - F.min("score"), 8)
    return _top(spark, sf).groupBy("query_id").agg(F.count("*").alias("k"), spread.alias("spread"))


@query("W5_softmax_weights", sql("select q.id as query_id, round(sum(weight), 9) as total, round(max(weight), 9) as top from newq q join nearw n on n.qslot = q.slot group by q.id"))
def _(spark, sf):
    return _top(spark, sf).groupBy("query_id").agg(F.round(F.sum("weight"), 9).alias("total"), F.round(F.max("weight"), 9).alias("top"))


@query(
    "D14_initializer_comparison",
    sql(f"""select kind, count(*) as n, round(avg(l), 6) as avg_norm, round(avg(dist), 6) as avg_drift from (
        select kind, id, sqrt(sum(x*x)) as l, sqrt(sum((x-z)*(x-z))) as dist from (
          select 'default' as kind, f.id, v.d, v.x, v.x as z from {_FRESHV} f join vecd v on v.vec_id = f.slot
          union all select 'focus', q.id, mean.d, coalesce(m.x, mean.x), v.x from newq q join {_FRESHV} f on f.id = q.id cross join meand mean
            left join mixd m on m.qslot = q.slot and m.d = mean.d join vecd v on v.vec_id = f.slot and v.d = mean.d) group by kind, id)
        group by kind
        union all select 'lexical', count(*), null, null from fresh union all select 'random', count(*), null, null from fresh"""),
)
def _(spark, sf):
    c = Chain.of(spark, sf)
    x = _inputs(spark, sf, c.vectors, lexicon=c.lexicon, matrix=I.matrix_rows(spark))
    rows = E.compare_initializers(["default", "random", "focus", "lexical"], x)
    start = x.current_rows.select("id", F.col("vec").alias("start"))
    per_row = rows.join(start, "id").select(
        "kind", V.norm(F.col("vec")).alias("l"), F.sqrt(V.squared_distance(F.col("vec"), F.col("start"))).alias("dist")
    )
    exact = F.col("kind").isin("default", "focus")  # the other kinds draw, so SQL has only their counts
    return per_row.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(exact, F.col("l"))), 6).alias("avg_norm"),
        F.round(F.avg(F.when(exact, F.col("dist"))), 6).alias("avg_drift"),
    )


# ---------------------------------------------------------------- alignment

def _anchor_pairs(spark, sf):
    old = stable(I.old_vocab(spark, sf))
    found = vocab.anchors(old, I.word_vectors(I.words(spark, sf), spark, sf)).select("id", F.col("vec").alias("x"))
    return found.join(I.model_rows(old, spark, sf).withColumnRenamed("vec", "y"), "id").select("id", "x", "y")


@query(
    "D15_gram_matrix",
    sql("""select a.d::bigint as row, b.d::bigint as col, round(sum(n*a.x*b.x), 4) as x from (select xs, ys, count(*) as n from anchor group by all)
        join vecd a on a.vec_id = ys join vecd b on b.vec_id = xs group by all"""),
)
def _(spark, sf):
    g = alignment.gram_rows(_anchor_pairs(spark, sf), DIM)
    return g.select(F.col("row").cast("bigint").alias("row"), F.posexplode("vec").alias("col", "x")).select(
        "row", F.col("col").cast("bigint").alias("col"), F.round("x", 4).alias("x")
    )


@query("D15_orthogonal_procrustes", sql("select count(*) as anchors, true as orthogonal, true as no_worse_than_identity from anchor"))
def _(spark, sf):
    pairs = stable(_anchor_pairs(spark, sf))
    w = alignment.procrustes(pairs, DIM, DIM)
    return alignment.residuals(pairs, w).select(
        "anchors", F.lit(alignment.orthogonality_error(w) < 1e-8).alias("orthogonal"),
        (F.col("residual") <= F.col("unaligned")).alias("no_worse_than_identity"),
    )


#: A planted rotation: a product of plane rotations by exact fractions, (i, j, cosine, sine) each.
GIVENS = [(k, (k + 7) % DIM, 0.6, 0.8) if k % 2 else (k, (k + 21) % DIM, 5 / 13, -12 / 13) for k in range(0, DIM, 3)]
_STEPS = [f"r0 as (select a.i, b.j, (a.i = b.j)::int::double as x from range({DIM}) a(i), range({DIM}) b(j))"]
for _n, (_i, _j, _c, _s) in enumerate(GIVENS):
    _STEPS.append(
        f"r{_n + 1} as materialized (select t.i, t.j, case t.i when {_i} then {_c!r}::double * t.x - {_s!r}::double * o.x when {_j} then {_s!r}::double * o.x + {_c!r}::double * t.x else t.x end as x "
        f"from r{_n} t left join r{_n} o on o.j = t.j and o.i = case t.i when {_i} then {_j} when {_j} then {_i} end)"
    )
PLANTED = f"with {', '.join(_STEPS)} select i, j, x from r{len(GIVENS)}"


def planted_rotation():
    w = np.eye(DIM)
    for i, j, c, s in GIVENS:
        w[[i, j]] = np.array([[c, -s], [s, c]]) @ w[[i, j]]
    return w


def _planted_pairs(spark, sf, shift=0.0):
    """Every embedding, and where the planted rotation (and a shift of its first cell) takes it."""
    x = F.col("vec").cast("array<double>")
    rows = I.embeddings(spark, sf).select(F.col("vec_id").alias("id"), x.alias("x"), V.apply_matrix(x, planted_rotation()).alias("y"))
    return rows.withColumn("y", F.transform("y", lambda v, i: v + F.when(i == 0, F.lit(shift)).otherwise(0.0)))


@query("D15_planted_rotation", sql(f"select i::bigint as row, j::bigint as col, round(x, 6) + 0.0::double as x from ({PLANTED})"))
def _(spark, sf):
    w = alignment.procrustes(_planted_pairs(spark, sf), DIM, DIM)
    cells = alignment.matrix_table(spark, w).select(F.col("row").cast("bigint").alias("row"), F.posexplode("vec").alias("col", "x"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


_SHIFT = 0.25
_PLANTED_RECORD = f"""select 'en' as language, n as anchor_tokens, 64::bigint as vector_dimension, 64::bigint as model_dimension,
    round(sqrt(n * {_SHIFT * _SHIFT}::double), 4) as residual, round(sqrt(unaligned), 4) as unaligned, round(trace, 6) as trace from
    (select count(*) as n from embeddings),
    (select sum((y.x - v.x) * (y.x - v.x)) as unaligned from vecd v join (select e.vec_id, m.i as d, sum(m.x * e.x) + case m.i when 0 then {_SHIFT}::double else 0 end as x
      from vecd e join ({PLANTED}) m on m.j = e.d group by e.vec_id, m.i) y on y.vec_id = v.vec_id and y.d = v.d),
    (select sum(x) as trace from ({PLANTED}) where i = j)"""


@query("R13_planted_record", sql(_PLANTED_RECORD))
def _(spark, sf):
    # W is that of the exact pairs; the record is of pairs that lie beside it by a known shift
    w = alignment.procrustes(_planted_pairs(spark, sf), DIM, DIM)
    words = I.embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("word"))
    rec = alignment.alignment_record(_planted_pairs(spark, sf, _SHIFT), w, "en", words, path="W_en", seed=I.SEED)
    return rec.select(
        "language", "anchor_tokens", "vector_dimension", "model_dimension", F.round("residual_frobenius", 4).alias("residual"),
        F.round("unaligned_frobenius", 4).alias("unaligned"), F.round(F.lit(float(np.trace(w))), 6).alias("trace"),
    )


_RESIDUALS = """select count(*) as anchors, round(sqrt(sum(r)), 4) as residual, round(sqrt(sum(u)), 4) as unaligned from (
    select id, sum((p.x - y.x)*(p.x - y.x)) as r, sum((x.x - y.x)*(x.x - y.x)) as u from anchor a
    join (select v.vec_id, m.i as d, sum(m.x*v.x) as x from vecd v join wmat m on m.j = v.d group by all) p on p.vec_id = a.xs
    join vecd x on x.vec_id = a.xs and x.d = p.d join vecd y on y.vec_id = a.ys and y.d = p.d group by id)"""


@query("D16_alignment_diagnostics", sql(_RESIDUALS))
def _(spark, sf):
    r = alignment.residuals(_anchor_pairs(spark, sf), matrix(spark))
    return r.select("anchors", F.round("residual", 4).alias("residual"), F.round("unaligned", 4).alias("unaligned"))


@query("R13_alignment_record", sql("select 'en' as language, 'W_en' as path, 42::bigint as seed, '64x64' as shape, count(*) as anchor_tokens, 64::bigint as vector_dimension, 64::bigint as model_dimension, (select count(*) from wvec) as vector_vocab_size, true as aligned, true as orthogonal from anchor"))
def _(spark, sf):
    pairs = stable(_anchor_pairs(spark, sf))
    w = alignment.procrustes(pairs, DIM, DIM)
    rec = alignment.alignment_record(pairs, w, I.OLD_LANG, I.word_vectors(I.words(spark, sf), spark, sf).select("word"), path="W_en", seed=I.SEED)
    return rec.select(
        "language", "path", "seed", F.concat_ws("x", F.col("shape").cast("array<string>")).alias("shape"), "anchor_tokens", "vector_dimension", "model_dimension", "vector_vocab_size",
        (F.col("residual_frobenius") <= F.col("unaligned_frobenius")).alias("aligned"),
        (F.col("orthogonality_max_abs_error") < 1e-8).alias("orthogonal"),
    )


@query("G8_frobenius_and_max_abs", sql("select round(sqrt(sum((y-x)*(y-x))), 6) as frobenius, max(abs(y-x)) as max_abs, round(sqrt(sum(x*x)), 6) as base from snap"))
def _(spark, sf):
    pairs = I.snapshot(spark, sf).join(I.embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("vec").alias("b")), "id")
    gap = F.array_max(F.zip_with("vec", "b", lambda x, y: F.abs(x - y.cast("double"))))
    return pairs.agg(
        F.round(F.sqrt(F.sum(V.squared_distance(F.col("vec"), F.col("b")))), 6).alias("frobenius"),
        F.max(gap).alias("max_abs"), F.round(F.sqrt(F.sum(F.pow(V.norm(F.col("b")), 2))), 6).alias("base"),
    )


# ---------------------------------------------------------------- drift

def _snapshots(spark, sf):
    return I.snapshot(spark, sf), I.embeddings(spark, sf).withColumnRenamed("vec_id", "id")


@query("D17_drift_penalty", sql("select count(*) as n_cells, round(2.0::double * avg((y-x)*(y-x)), 9) as penalty, 0.0::double as off from snap"))
def _(spark, sf):
    now, start = _snapshots(spark, sf)
    on = E.drift_penalty(now, start, 2.0).select("n_cells", F.round("penalty", 9).alias("penalty"))
    return on.crossJoin(E.drift_penalty(now, start, 0.0).select(F.col("penalty").alias("off")))


@query("D18_drift_gradient", sql("select id, round(sum(g), 12) as g_sum, round(max(abs(g)), 12) as g_max from (select id, 4.0::double*(y-x)/(select count(*) from snap) as g from snap) group by id"))
def _(spark, sf):
    now, start = _snapshots(spark, sf)
    g = E.drift_gradient(now, start, 2.0)
    return g.select("id", F.round(V.total(F.col("grad")), 12).alias("g_sum"), F.round(F.array_max(F.transform("grad", F.abs)), 12).alias("g_max"))


@query("J11_new_rows_join_current", sql("select id, round(sum((y-x)*(y-x)), 9) as sq from snap group by id"))
def _(spark, sf):
    now, start = _snapshots(spark, sf)
    pairs = start.select("id", F.col("vec").alias("mu")).join(now, "id")
    return pairs.select("id", F.round(V.squared_distance(F.col("vec"), F.col("mu")), 9).alias("sq"))


@query("D19_frozen_row_audit", sql("select id, max(abs(y-x)) as max_change from snap where id < (select count(distinct id) from snap) // 2 group by id having max(abs(y-x)) > 0"))
def _(spark, sf):
    now, start = _snapshots(spark, sf)
    return E.changed_frozen_rows(start, now, start.count() // 2)


@query("G4_elementwise_mean", sql(f"select lang, count(distinct d)::bigint as dims, {fingerprint()} from (select lang, d, avg(x) as x from (select t.lang, v.slot from tok t join wvec v on v.w = t.w) join vecd on vec_id = slot group by lang, d) group by lang"))
def _(spark, sf):
    # equal words are counted first, so a frequent word is looked up once per language
    counted = I.doc_words(spark, sf).groupBy("lang", "word").agg(F.count("*").alias("c"))
    rows = E.lookup_join(counted, I.word_vectors(I.words(spark, sf), spark, sf), "word", "vec")
    sums = E.sum_vectors(rows, ["lang"], DIM, weight=F.col("c"))
    mean = sums.select("lang", F.transform("sums", lambda s: s / F.col("weight")).alias("vec"))
    return print_of(mean, "lang", F.size("vec").cast("bigint").alias("dims"))


@query("S7_exp_sqrt_abs", sql("select id, round(exp(-sqrt(sum((y-x)*(y-x)))), 9) as e, round(sqrt(max(abs(x))), 9) as r from snap group by id"))
def _(spark, sf):
    now, start = _snapshots(spark, sf)
    pairs = start.select("id", F.col("vec").alias("mu")).join(now, "id")
    big = F.array_max(F.transform("mu", lambda v: F.abs(v.cast("double"))))
    return pairs.select(
        "id", F.round(F.exp(-F.sqrt(V.squared_distance(F.col("vec"), F.col("mu")))), 9).alias("e"), F.round(F.sqrt(big), 9).alias("r")
    )
