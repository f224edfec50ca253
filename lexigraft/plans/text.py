"""Queries: line sources, string scalars, lexicon, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X

from ..functions.tags import normalize_tag
from ..functions.text import tokens
from ..operators import lexicon, ner, vocab
from ..operators.keys import dense_index
from ..session import scratch_path, stable
from ..sources import text as src
from . import inputs as I
from .registry import query
from .sql import sql, words_of


def joined(col, sep: str = " "):
    return F.array_join(col, sep)


# ---------------------------------------------------------------- sources

@query("A1_line_corpus", sql("select doc_id, line_no, line from line"))
def _(spark, sf):
    return I.lines(spark, sf).select("doc_id", "line_no", "line")


@query("A2_token_list", sql("select distinct line as token from line"))
def _(spark, sf):
    raw = I.documents(spark, sf, "text").select(F.explode(F.split("text", "\n")).alias("value"))
    return src.token_list(raw)


@query("A3_lexicon_scan", sql("select word, array_to_string(morphemes,'+') as morphemes, len(morphemes)::bigint as n from lex"))
def _(spark, sf):
    lex = lexicon.parse_lexicon(I.lexicon_lines(I.words(spark, sf), spark, sf), [F.col("line_no")])
    return lex.select("word", joined("morphemes", "+").alias("morphemes"), F.size("morphemes").cast("bigint").alias("n"))


_SENT = """select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as sent_id, count(*) as n,
    md5(string_agg(w, ' ' order by pos)) as tokens, string_agg({tag}, ' ' order by pos) as tags from {src} group by doc_id, line_no"""


def _sentence_rows(df):
    return df.select(
        "doc_id",
        F.col("sent_id").cast("bigint").alias("sent_id"),
        F.size("sentence").cast("bigint").alias("n"),
        F.md5(joined(F.transform("sentence", lambda t: t["token"]))).alias("tokens"),
        joined(ner.tags_of(F.col("sentence"))).alias("tags"),
    )


@query("A4_conll_evaluation_scan", sql(_SENT.format(tag="raw", src="tagged")))
def _(spark, sf):
    return _sentence_rows(src.parse_conll(I.conll_texts(spark, sf), "text", ["doc_id"], "evaluation"))


@query("A5_conll_preparation_scan", sql(_SENT.format(tag="tag", src="gold")))
def _(spark, sf):
    return _sentence_rows(src.parse_conll(I.conll_texts(spark, sf), "text", ["doc_id"], "preparation"))


@query(
    "A6_conll_sink_round_trip",
    sql("""select split, sentence, count(*) as n from (select g.doc_id, g.line_no, l.split,
        md5(string_agg(g.w||chr(9)||g.raw, chr(10) order by g.pos)) as sentence
        from tagged g join lsplit l on l.doc_id = g.doc_id and l.line_no = g.line_no
        group by all) group by all"""),
)
def _(spark, sf):
    from ..operators.keys import split_80_10_10

    path = scratch_path(spark, "conll")
    src.write_conll(split_80_10_10(I.tagged(spark, sf), I.SEED, ["doc_id", "line_no"]), path, ["doc_id", "line_no"])
    back = src.read_conll_sentences(spark, f"{path}/split=*", plain=True)
    rows = F.transform("sentence", lambda t: F.concat(t["token"], F.lit("\t"), t["tag"]))
    sentences = back.select("file", F.md5(joined(rows, "\n")).alias("sentence"))
    split = F.regexp_extract("file", "split=([a-z]+)", 1).alias("split")
    return sentences.groupBy(split, "sentence").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- string scalars

@query("B1_lexicon_line_parse", sql("select line_no, word, array_to_string(morphemes,'+') as morphemes from lexparse"))
def _(spark, sf):
    line = X.strip(F.col("value"))
    return (
        I.lexicon_lines(I.words(spark, sf), spark, sf)
        .filter(X.lexicon_line_is_data(line))
        .withColumn("e", X.lexicon_entry(line))
        .filter("e.word is not null")
        .select("line_no", "e.word", joined("e.morphemes", "+").alias("morphemes"))
    )


@query(
    "B2_last_wins_dictionary",
    sql("select count(*) as words, sum(n_lines)::bigint as lines, count(*) filter (n_lines > 1) as overwritten from lex"),
)
def _(spark, sf):
    line = X.strip(F.col("value"))
    lines = I.lexicon_lines(I.words(spark, sf), spark, sf)
    entries = (
        lines.filter(X.lexicon_line_is_data(line)).withColumn("e", X.lexicon_entry(line))
        .filter("e.word is not null and size(e.morphemes) > 0")
        .groupBy("e.word").agg(F.count("*").alias("n_lines"))
    )
    lex = lexicon.parse_lexicon(lines, [F.col("line_no")])
    return lex.join(entries, "word").agg(
        F.count("*").alias("words"), F.sum("n_lines").alias("lines"), F.count_if(F.col("n_lines") > 1).alias("overwritten")
    )


def segmented(spark, sf):
    w = I.words(spark, sf)
    lex = stable(lexicon.parse_lexicon(I.lexicon_lines(w, spark, sf), [F.col("line_no")]))
    return lexicon.segment(w.select(F.col("word").alias("token")), lex)


@query("B3_segment_lookup", sql("select w as token, array_to_string(morphemes,'+') as morphemes from seg"))
def _(spark, sf):
    return segmented(spark, sf).select("token", joined("morphemes", "+").alias("morphemes"))


@query("J1_lexicon_join_exact_then_lower", sql("select how, count(*) as n, sum(len(morphemes))::bigint as morphemes from seg group by how"))
def _(spark, sf):
    w = I.words(spark, sf)
    lex = stable(lexicon.parse_lexicon(I.lexicon_lines(w, spark, sf), [F.col("line_no")]))
    seg = lexicon.segment(w.select(F.col("word").alias("token")), lex)
    exact = seg.join(lex.select(F.col("word").alias("token"), F.lit(True).alias("hit")), "token", "left")
    how = F.when(F.col("hit"), "exact").when(F.size("morphemes") > 0, "lower").otherwise("none")
    return exact.groupBy(how.alias("how")).agg(F.count("*").alias("n"), F.sum(F.size("morphemes").cast("bigint")).alias("morphemes"))


@query(
    "B4_char_ngrams",
    sql("""select w as token, count(*) as n, md5(string_agg(g, ' ' order by k, i)) as grams from (select w, substr(b, i, k) as g, k, i
        from (select w, '<'||w||'>' as b, k, unnest(range(1, length(w)+4-k)) as i from words, range(3,6) r(k))) group by w"""),
)
def _(spark, sf):
    grams = X.char_ngrams(F.col("word"))
    return I.words(spark, sf).withColumn("g", grams).filter(F.size("g") > 0).select(
        F.col("word").alias("token"), F.size("g").cast("bigint").alias("n"), F.md5(joined("g")).alias("grams")
    )


@query("B5_tag_repair", sql("select raw, tag, count(*) as n from gold group by all"))
def _(spark, sf):
    raw = I.tagged(spark, sf).select(F.explode("sentence.tag").alias("raw"))
    return raw.groupBy("raw", normalize_tag(F.col("raw")).alias("tag")).agg(F.count("*").alias("n"))


def _pieces(spark, sf):
    cells = F.array(
        F.struct(F.lit("q").alias("kind"), F.get("cells", F.lit(4)).alias("cell")),
        F.struct(F.lit("a").alias("kind"), F.get("cells", F.lit(5)).alias("cell")),
    )
    return (
        I.packed_rows(spark, sf).select("conv_id", "turn", F.explode(cells).alias("c"))
        .select("conv_id", "turn", "c.kind", F.posexplode(X.split_packed(F.col("c.cell"))).alias("pos", "piece"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


@query("B6_strip_numbering", sql("select conv_id, turn, kind, unnest(ss) as text, unnest(range(len(ss))) as pos from stripped"))
def _(spark, sf):
    return _pieces(spark, sf).select("conv_id", "turn", "kind", "pos", X.strip_numbering(F.col("piece")).alias("text"))


@query("B7_packed_cell_split", sql("select conv_id, turn, kind, unnest(ps) as piece, unnest(range(len(ps))) as pos from pieces"))
def _(spark, sf):
    return _pieces(spark, sf)


@query("B8_whitespace_tokens", sql("select doc_id, count(*) as n, md5(string_agg(w, ' ' order by pos)) as tokens from tok group by doc_id"))
def _(spark, sf):
    t = tokens(F.col("text"))
    return I.documents(spark, sf, "text").withColumn("t", t).filter(F.size("t") > 0).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), F.md5(joined("t")).alias("tokens")
    )


@query(
    "B9_subword_surface",
    sql("select id, token, surface from (select id, token, case when starts_with(token,'▁') then substr(token,2) else token end as surface from vocab) where length(surface) >= 2"),
)
def _(spark, sf):
    v = I.old_vocab(spark, sf)
    return v.select("id", "token", X.subword_surface(F.col("token")).alias("surface")).filter("surface is not null")


@query("B10_run_name", sql("select event_id, run_name from named"))
def _(spark, sf):
    r = I.runs(spark, sf)
    return r.select("event_id", X.run_name(F.col("system"), F.col("task"), F.col("language"), F.col("seed")).alias("run_name"))


@query("B11_marker_count", sql("select doc_id, ((length(text)-length(replace(text,'the','')))/3)::bigint as n from documents"))
def _(spark, sf):
    return I.documents(spark, sf, "text").select("doc_id", X.count_marker(F.col("text"), "the").alias("n"))


@query(
    "B12_truncate_sequence",
    sql(f"""select doc_id, len(t)::bigint as n, md5(array_to_string(t,' ')) as tokens from (select doc_id, ({words_of('text')})[:256] as t from documents)"""),
)
def _(spark, sf):
    t = X.truncate(tokens(F.col("text")), 256)
    return I.documents(spark, sf, "text").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(joined(t)).alias("tokens"))


@query(
    "B13_short_hash_and_labels",
    sql("select doc_id, substr(sha256(text),1,12) as hash, upper(lang[1])||lower(lang[2:]) as title, upper(source) as label from documents"),
)
def _(spark, sf):
    d = I.documents(spark, sf, "text", "lang", "source")
    return d.select("doc_id", X.short_hash(F.sha2("text", 256)).alias("hash"), F.initcap("lang").alias("title"), F.upper("source").alias("label"))


# ---------------------------------------------------------------- vocabulary

@query("C1_vocabulary_expansion", sql("select token, id, added from expanded"))
def _(spark, sf):
    return vocab.expand_vocabulary(I.old_vocab(spark, sf), I.requested_tokens(spark, sf))


@query("C2_new_token_ids", sql("select r.token, e.id from req r join expanded e on e.token = r.token"))
def _(spark, sf):
    want = I.requested_tokens(spark, sf)
    return vocab.token_ids(vocab.expand_vocabulary(I.old_vocab(spark, sf), want), want)


@query("C3_old_vocabulary_size", sql("select count(*) as n_rows, count(*) filter (added) as n_added, count(*) filter (not added) as old_size from expanded"))
def _(spark, sf):
    return vocab.vocabulary_sizes(vocab.expand_vocabulary(I.old_vocab(spark, sf), I.requested_tokens(spark, sf)))


@query(
    "C4_expansion_report",
    sql("""select r.token, e.id, (select count(*) from req) as requested, (select count(*) from expanded where added) as added
        from req r join expanded e on e.token = r.token order by r.token limit 20"""),
)
def _(spark, sf):
    return vocab.expansion_report(I.old_vocab(spark, sf), I.requested_tokens(spark, sf))


@query("C5_anchor_selection", sql("select a.id, a.token, a.w as surface from anchor a"))
def _(spark, sf):
    return vocab.anchors(I.old_vocab(spark, sf), I.word_vectors(I.words(spark, sf), spark, sf)).select("id", "token", "surface")


@query("C6_minimum_anchor_guard", sql("select count(*) as anchors, true as enough from anchor"))
def _(spark, sf):
    rows = vocab.anchors(I.old_vocab(spark, sf).select("token"), I.word_vectors(I.words(spark, sf), spark, sf).select("word"))
    n = rows.agg(F.count("*").alias("anchors"))
    try:
        vocab.require_anchors(rows, minimum=50)
        enough = True
    except vocab.TooFewAnchors:
        enough = False
    return n.withColumn("enough", F.lit(enough))


@query("C8_label_inventory", sql("select tag as label, row_number() over (order by tag) - 1 as id from (select distinct tag from gold)"))
def _(spark, sf):
    t = I.tagged(spark, sf).select("lang", F.explode("sentence.tag").alias("tag")).withColumn("tag", normalize_tag(F.col("tag")))
    return vocab.label_inventory(t)


@query("J3_new_tokens_in_vocabulary", sql("select r.token, v.id from req r join vocab v on v.token = r.token"))
def _(spark, sf):
    return vocab.token_ids(I.old_vocab(spark, sf), I.requested_tokens(spark, sf))


@query("J4_vocabulary_join_vector_words", sql("select starts_with(a.token,'▁') as marked, count(*) as n from anchor a group by all"))
def _(spark, sf):
    rows = vocab.anchors(I.old_vocab(spark, sf).select("token"), I.word_vectors(I.words(spark, sf), spark, sf).select("word"))
    return rows.groupBy(F.startswith("token", F.lit(X.WORD_START)).alias("marked")).agg(F.count("*").alias("n"))


@query("J12_tokens_not_in_vocabulary", sql("select token from req where token not in (select token from vocab)"))
def _(spark, sf):
    return vocab.missing_tokens(I.old_vocab(spark, sf), I.requested_tokens(spark, sf))


# ---------------------------------------------------------------- order and position

@query("W7_total_order", sql("select w as word, n, row_number() over (order by n desc, w) - 1 as idx from words"))
def _(spark, sf):
    return dense_index(I.words(spark, sf), [F.col("n").desc(), F.col("word")])


@query("W9_top_tokens", sql("select w as word, n from words order by n desc, w limit 20"))
def _(spark, sf):
    return I.words(spark, sf).orderBy(F.col("n").desc(), "word").limit(20)


@query("W11_positional_id", sql("select doc_id, line_no, row_number() over (order by doc_id, line_no) - 1 as idx from line"))
def _(spark, sf):
    return dense_index(I.lines(spark, sf).select("doc_id", "line_no"), [F.col("doc_id"), F.col("line_no")])


# ---------------------------------------------------------------- scalars

@query("S1_round_and_format", sql("select event_id, round(sqrt(value), 4) as r4, round(sqrt(value), 1) as r1, printf('%.2f', value) as f2 from events"))
def _(spark, sf):
    v = F.col("value")
    e = I.table(spark, sf, "events")
    return e.select("event_id", F.round(F.sqrt(v), 4).alias("r4"), F.round(F.sqrt(v), 1).alias("r1"), F.format_string("%.2f", v).alias("f2"))


@query("S2_truncating_fraction", sql("select lang, count(*) as n, floor(0.8::double*count(*))::bigint as n_train, floor(0.1::double*count(*))::bigint as n_dev from line group by lang"))
def _(spark, sf):
    n = F.count("*")
    return I.lines(spark, sf).groupBy("lang").agg(
        n.alias("n"), F.floor(F.lit(0.8) * n).cast("bigint").alias("n_train"), F.floor(F.lit(0.1) * n).cast("bigint").alias("n_dev")
    )


@query(
    "S3_lookup_with_default",
    sql("select d.doc_id, coalesce(l.quality, -1)::bigint as quality from documents d left join labels l on l.doc_id = d.doc_id"),
)
def _(spark, sf):
    lab = I.table(spark, sf, "labels").select("doc_id", "quality")
    return I.table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("bigint"), F.lit(-1)).alias("quality")
    )


@query("S5_json_fields", sql("select event_id, (props->>'k')::bigint as k, '{\"k\":'||(props->>'k')||'}' as json from events"))
def _(spark, sf):
    p = F.from_json("props", "k bigint")
    e = I.table(spark, sf, "events").select("event_id", p.alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("json"))


@query(
    "S8_string_predicates",
    sql("select doc_id, lower(text) = text as is_lower, starts_with(text,'T') as starts, instr(text,'the') - 1 as at, md5(trim(text, ' '||chr(10))) as stripped from documents"),
)
def _(spark, sf):
    t = F.col("text")
    return I.documents(spark, sf, "text").select(
        "doc_id", (F.lower(t) == t).alias("is_lower"), F.startswith(t, F.lit("T")).alias("starts"),
        (F.instr(t, "the") - 1).cast("bigint").alias("at"), F.md5(X.strip(t)).alias("stripped"),
    )


@query(
    "S9_sequence_build",
    sql(f"select doc_id, array_to_string(list_concat(['<s>'], t[2:4], list_transform(range(3), lambda i: '<pad>')),' ') as seq from (select doc_id, {words_of('text')} as t from documents)"),
)
def _(spark, sf):
    t = tokens(F.col("text"))
    seq = F.concat(F.array(F.lit("<s>")), F.slice(t, 2, 3), F.array_repeat(F.lit("<pad>"), 3))
    return I.documents(spark, sf, "text").select("doc_id", joined(seq).alias("seq"))


