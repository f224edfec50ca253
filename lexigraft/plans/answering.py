"""Queries: question-answering inputs, windows, span selection, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import tokens
from ..operators import qa
from ..operators.keys import split_80_10_10
from ..session import scratch_path
from ..sources import squad
from . import inputs as I
from .registry import query
from .sql import h, sql, words_of


def paragraphs(spark, sf):
    """(doc_id, title, context, qas) as parsed back from JSON text."""
    doc = F.from_json("json", squad.DOCUMENT).alias("d")
    parsed = I.squad_json(spark, sf).select("doc_id", doc).select("doc_id", "d.*")
    return squad.paragraphs(parsed, "doc_id")


@query("A7_squad_flatten", sql("""select doc_id, id, question, md5(context) as context, len(answers)::bigint as n, (pos - 1)::bigint as pos, answers[pos]['text'] as text, answers[pos]['start']::bigint as start
    from (select *, unnest(range(1, len(answers) + 1)) as pos from q where answers is not null and length(context) > 0)"""))
def _(spark, sf):
    doc = F.from_json("json", squad.DOCUMENT).alias("d")
    parsed = I.squad_json(spark, sf).select("doc_id", doc).select("doc_id", "d.*")
    rows = squad.flatten_squad(parsed, "doc_id").select("*", F.posexplode("answers").alias("pos", "answer"))
    return rows.select(
        "doc_id", "id", "question", F.md5("context").alias("context"), F.size("answers").cast("bigint").alias("n"),
        F.col("pos").cast("bigint").alias("pos"), F.col("answer.text").alias("text"), F.col("answer.answer_start").cast("bigint").alias("start"),
    )


@query(
    "A8_lenient_paragraph_scan",
    sql("select doc_id, case when doc_id % 2 = 0 then title else 'untitled' end as title, md5(context) as context, 1::bigint as n_qas from q where doc_id % 5 < 3"),
)
def _(spark, sf):
    # doc_id % 5 = 3 gives a bare string, 4 an object without context
    q = F.array(F.struct("id", "question", "answers"))
    good = F.to_json(F.struct("context", q.alias("qas")))
    k = F.col("doc_id") % 5
    bare = F.concat(F.lit('"bare '), "title", F.lit('"'))
    entry = F.when(k < 3, good).when(k == 3, bare).otherwise(F.to_json(F.struct("id")))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"title":"'), "title", F.lit('",'))).otherwise(F.lit(""))
    raw = I.questions(spark, sf).select(
        "doc_id", F.concat(F.lit('{"data":[{'), title, F.lit('"paragraphs":['), entry, F.lit("]}]}")).alias("json")
    )
    rows = squad.lenient_paragraphs(raw, "json", "untitled", "doc_id")
    return rows.select("doc_id", "title", F.md5("context").alias("context"), F.size("qas").cast("bigint").alias("n_qas"))


@query("A9_table_row_triples", sql("select conv_id, turn, pos, md5(context) as context, question, answer from triple"))
def _(spark, sf):
    t = squad.table_row_triples(I.packed_rows(spark, sf), "cells", "conv_id", "turn")
    return t.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.md5("context").alias("context"), "question", "answer")


@query("A9_table_rows_with_header", sql("select conv_id, turn, pos, md5(context) as context, question, answer from triple where turn > 0"))
def _(spark, sf):
    t = squad.table_row_triples(I.packed_rows(spark, sf), "cells", "conv_id", "turn", row_no="turn")
    return t.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.md5("context").alias("context"), "question", "answer")


@query("J10_positional_zip", sql("select q.conv_id, q.turn, least(len(q.ss), len(a.ss))::bigint as pairs from stripped q join stripped a on a.conv_id = q.conv_id and a.turn = q.turn and q.kind = 'q' and a.kind = 'a' where least(len(q.ss), len(a.ss)) > 0"))
def _(spark, sf):
    from ..functions.text import split_packed

    n = lambda i: F.size(split_packed(F.get("cells", F.lit(i))))
    rows = I.packed_rows(spark, sf).select("conv_id", "turn", F.least(n(4), n(5)).cast("bigint").alias("pairs"))
    return rows.filter("pairs > 0")


_ITEMS = """select q.*, r.split from (select *, row_number() over (order by md5('42|'||doc_id)||'|'||doc_id) - 1 as r, count(*) over () as n
    from qclass where class = 'extractive') q, lateral (select case when q.r < floor(q.n*0.8::double) then 'train'
    when q.r < floor(q.n*0.8::double) + floor(q.n*0.1::double) then 'dev' else 'test' end as split) r"""
_VALID_N = "(select id, count(*) filter (ok) as n_ok from qvalid group by id)"


def valid_items(spark, sf):
    """Split articles that keep at least one valid answer."""
    return split_80_10_10(qa.keep_valid(paragraphs(spark, sf)), I.SEED, ["doc_id"])


@query(
    "A10_squad_sink_round_trip",
    sql(f"select i.split, count(*) as questions, sum(v.n_ok)::bigint as answers, sum({h('i.context')})::bigint as content_key from ({_ITEMS}) i join {_VALID_N} v on v.id = i.id group by i.split"),
)
def _(spark, sf):
    path = scratch_path(spark, "squad")
    squad.write_squad(valid_items(spark, sf), path)
    back = spark.read.schema(squad.DOCUMENT + ", split string").json(path)
    flat = squad.flatten_squad(back, "split")
    return flat.groupBy("split").agg(
        F.count("*").alias("questions"), F.sum(F.size("answers").cast("bigint")).alias("answers"), F.sum(I.h(F.col("context"))).alias("content_key")
    )


@query("Q1_locate_answer", sql("""select idx, 'conv-'||idx as id, md5(context) as context, question, answer, strpos(context, answer) - 1 as answer_start
    from (select *, row_number() over (order by conv_id, turn, pos) - 1 as idx from triple)"""))
def _(spark, sf):
    t = squad.table_row_triples(I.packed_rows(spark, sf), "cells", "conv_id", "turn")
    located = qa.to_squad(t, [F.col("conv_id"), F.col("turn"), F.col("pos")], "conversations", "conv")
    return located.select("idx", "id", F.md5("context").alias("context"), "question", "answer", F.col("answer_start").cast("bigint").alias("answer_start"))


@query("G7_conditional_counters", sql("select count(*) filter (strpos(context, answer) > 0) as kept, count(*) filter (strpos(context, answer) = 0) as dropped from triple"))
def _(spark, sf):
    t = squad.table_row_triples(I.packed_rows(spark, sf), "cells", "conv_id", "turn")
    return qa.located_counts(qa.locate_answers(t))


@query("Q2_offset_validation", sql("select id, ans_no - 1 as ans_no, ok from qvalid"))
def _(spark, sf):
    flat = paragraphs(spark, sf).select("context", F.explode("qas").alias("qa"))
    rows = flat.select("context", F.col("qa.id").alias("id"), F.posexplode("qa.answers").alias("ans_no", "a"))
    return rows.select("id", F.col("ans_no").cast("bigint").alias("ans_no"), A.answer_is_valid(F.col("context"), F.col("a")).alias("ok"))


@query("Q3_question_classes", sql("select count(*) filter (class = 'extractive') as extractive, count(*) filter (class = 'abstractive') as abstractive, count(*) filter (class = 'unanswerable') as unanswerable from qclass"))
def _(spark, sf):
    return qa.classify(paragraphs(spark, sf))


@query("A13_question_manifest", sql("select count(*) filter (class = 'extractive') as extractive_qa_pairs, count(*) filter (class = 'abstractive') as abstractive_dropped, count(*) filter (class = 'unanswerable') as unanswerable_dropped from qclass"))
def _(spark, sf):
    return squad.question_manifest(qa.question_classes(paragraphs(spark, sf)), kind="cls")


@query("Q3_kept_paragraphs", sql(f"select c.doc_id, c.title, v.n_ok as answers from qclass c join {_VALID_N} v on v.id = c.id where c.class = 'extractive'"))
def _(spark, sf):
    kept = qa.keep_valid(paragraphs(spark, sf))
    n = F.aggregate("qas", F.lit(0), lambda a, x: a + F.size(x["answers"]))
    return kept.select("doc_id", "title", n.cast("bigint").alias("answers"))


@query("Q11_split_counts", sql(f"select split, count(*) as contexts, count(*) as qa_pairs from ({_ITEMS}) group by split"))
def _(spark, sf):
    return qa.split_counts(valid_items(spark, sf))


@query("Q12_reference_map", sql("select id, array_to_string(list_transform(answers, lambda a: a['text']), '|') as golds from q where answers is not null"))
def _(spark, sf):
    rows = I.questions(spark, sf).filter("answers is not null")
    return rows.select("id", F.array_join(squad.gold_texts(F.col("answers")), "|").alias("golds"))


# ---------------------------------------------------------------- windows

@query("Q5_context_windows", sql("select id, win as \"window\", ql::bigint as q_len, f::bigint as first, count(*) as n, min(s)::bigint as start_char, max(e)::bigint as end_char from wtok group by all"))
def _(spark, sf):
    # a window without tokens has no first and no last one
    w = I.windows(spark, sf).filter("n_tokens > 0")
    return w.select(
        "id", F.col("window").cast("bigint").alias("window"), F.col("q_len").cast("bigint").alias("q_len"), F.col("first").cast("bigint").alias("first"),
        F.size("offsets").cast("bigint").alias("n"), F.get("offsets", F.lit(0))["start"].cast("bigint").alias("start_char"),
        F.element_at("offsets", -1)["end"].cast("bigint").alias("end_char"),
    )


@query("Q6_window_labels", sql("select id, win as \"window\", case when inside then sk + ql + 3 else 0 end::bigint as start_position, case when inside then ek + ql + 3 else 0 end::bigint as end_position from wlabel"))
def _(spark, sf):
    w = qa.label_windows(I.windows(spark, sf))
    return w.select(
        "id", F.col("window").cast("bigint").alias("window"),
        F.col("label.start").cast("bigint").alias("start_position"), F.col("label.end").cast("bigint").alias("end_position"),
    )


@query("Q7_offset_mask", sql("select id, win as \"window\", (ql + wl + 4)::bigint as length, wl::bigint as visible, (ql + 3)::bigint as first_visible from win"))
def _(spark, sf):
    m = qa.masked_offsets(I.windows(spark, sf))
    seen = F.transform("feature_offsets", lambda o: o.isNotNull())
    return m.select(
        "id", F.col("window").cast("bigint").alias("window"), F.size("feature_offsets").cast("bigint").alias("length"),
        F.size(F.filter(seen, lambda x: x)).cast("bigint").alias("visible"), (F.array_position(seen, True) - 1).cast("bigint").alias("first_visible"),
    )


@query("J5_features_by_example", sql("select q.id, count(w.win) as windows, coalesce(sum(w.wl), 0)::bigint as tokens from q left join win w on w.id = q.id group by q.id"))
def _(spark, sf):
    ex = I.questions(spark, sf)
    per = qa.context_windows(ex, I.MAX_LENGTH, I.STRIDE).groupBy("id").agg(
        F.count("*").alias("windows"), F.sum(F.size("offsets").cast("bigint")).alias("tokens")
    )
    return ex.select("id").join(per, "id", "left").select("id", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("W3_n_best_per_window", sql("select id, win as \"window\", string_agg(p::varchar, ' ' order by r) as positions from sbest group by all"))
def _(spark, sf):
    best = A.n_best(F.col("s_scores"), 20)
    pos = F.array_join(F.transform(best, lambda b: b["pos"].cast("string")), " ")
    return I.scored_windows(spark, sf, offsets=False).select("id", F.col("window").cast("bigint").alias("window"), pos.alias("positions"))


@query("J8_start_end_candidates", sql("select id, win as \"window\", sc as score, sp::bigint as start, ep::bigint as \"end\" from wbest"))
def _(spark, sf):
    seen = F.transform("feature_offsets", lambda o: o.isNotNull())
    best = A.best_window_span(F.col("s_scores"), F.col("e_scores"), seen, 20, 64)
    # exploded, so that the filter and the fields below do not search the window again
    found = F.explode(F.array_compact(F.array(best))).alias("b")
    rows = I.scored_windows(spark, sf).select("id", F.col("window").cast("bigint").alias("window"), found)
    return rows.select("id", "window", F.col("b.score").alias("score"), F.col("b.start").cast("bigint").alias("start"), F.col("b.end").cast("bigint").alias("end"))


@query("Q8_best_span", sql("select id, prediction from answer"))
def _(spark, sf):
    return qa.predicted_texts(I.questions(spark, sf), qa.best_spans(I.scored_windows(spark, sf)))


# ---------------------------------------------------------------- scoring

def references(spark, sf):
    return I.questions(spark, sf).filter("answers is not null").select("id", squad.gold_texts(F.col("answers")).alias("golds"))


def predictions(spark, sf):
    return qa.predicted_texts(I.questions(spark, sf), qa.best_spans(I.scored_windows(spark, sf)))


@query("Q9_token_overlap_f1", sql("select id, g_no, round(f1, 9) as f1, em from pairf"))
def _(spark, sf):
    rows = references(spark, sf).join(predictions(spark, sf), "id").select("id", "prediction", F.posexplode("golds").alias("g_no", "gold"))
    p, g = F.col("prediction"), F.col("gold")
    return rows.select("id", F.col("g_no").cast("bigint").alias("g_no"), F.round(A.overlap_f1(p, g), 9).alias("f1"), A.exact_match(p, g).alias("em"))


@query(
    "Q9_whole_text_overlap",
    sql(f"""select a.conv_id, a.turn, case when ov is null then 0.0 else round(2.0*(ov/na::double)*(ov/nb::double)/(ov/na::double + ov/nb::double), 9) end as f1
        from (select conv_id, turn, len({words_of('reply')}) as nb, len({words_of('text')}) as na from (select a.conv_id, a.turn, a.text, b.text as reply
          from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)) a
        left join (select conv_id, turn, sum(least(ca, cb)) as ov from (select a.conv_id, a.turn, a.t, a.c as ca, b.c as cb from
            (select conv_id, turn, t, count(*) as c from (select conv_id, turn, unnest({words_of('text')}) as t from conversations) group by all) a
            join (select conv_id, turn - 1 as turn, t, count(*) as c from (select conv_id, turn, unnest({words_of('text')}) as t from conversations) group by all) b
            on a.conv_id = b.conv_id and a.turn = b.turn and a.t = b.t) group by all) o on o.conv_id = a.conv_id and o.turn = a.turn"""),
)
def _(spark, sf):
    turns = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(A.overlap_f1(F.col("text"), F.col("reply")), 9).alias("f1"))


@query("G6_multiset_intersection", sql("select id, g_no, ov as overlap from pairf"))
def _(spark, sf):
    rows = references(spark, sf).join(predictions(spark, sf), "id").select("id", "prediction", F.posexplode("golds").alias("g_no", "gold"))
    n = A.multiset_overlap(tokens(F.col("prediction")), tokens(F.col("gold")))
    return rows.select("id", F.col("g_no").cast("bigint").alias("g_no"), n.cast("bigint").alias("overlap"))


@query("J6_references_join_predictions", sql("select q.id, a.id is not null as answered, coalesce(a.prediction, '') as prediction from q left join (select * from answer where prediction <> '') a on a.id = q.id where q.answers is not null"))
def _(spark, sf):
    some = predictions(spark, sf).filter("prediction <> ''")
    j = references(spark, sf).join(some.withColumn("hit", F.lit(True)), "id", "left")
    return j.select("id", F.coalesce("hit", F.lit(False)).alias("answered"), F.coalesce("prediction", F.lit("")).alias("prediction"))


@query("Q10_dataset_scores", sql("select count(*) as n, round(100*avg(f1), 7) as f1, round(100*avg(em), 7) as exact_match from qscore"))
def _(spark, sf):
    r = qa.dataset_scores(qa.score_questions(references(spark, sf), predictions(spark, sf)))
    return r.select("n", F.round("f1", 7).alias("f1"), F.round("exact_match", 7).alias("exact_match"))


@query(
    "Q10_scores_against_valid_answers",
    sql("select count(*) as n, round(100*avg(f1), 7) as f1, round(100*avg(em), 7) as exact_match from (select id, case when class = 'extractive' then 1.0 else 0.0 end as f1, case when class = 'extractive' then 1.0 else 0.0 end as em from qclass where answers is not null)"),
)
def _(spark, sf):
    # predicting the text at the stated offset is perfect exactly where the annotation is valid
    rows = I.questions(spark, sf).filter("answers is not null")
    ok = F.col("context").isNotNull() & (A.question_class(F.col("context"), F.col("answers")) == "extractive")
    pred = rows.select("id", F.when(ok, F.get("answers", F.lit(0))["text"]).otherwise(F.lit("\u0001")).alias("prediction"))
    refs = rows.select("id", squad.gold_texts(F.col("answers")).alias("golds"))
    r = qa.dataset_scores(qa.score_questions(refs, pred))
    return r.select("n", F.round("f1", 7).alias("f1"), F.round("exact_match", 7).alias("exact_match"))


@query("S6_zero_denominator", sql("select doc_id, case when len(ws) = 0 then 0.0 else round(len(list_filter(ws, lambda w: starts_with(w,'t')))/len(ws)::double, 9) end as share from (select doc_id, " + words_of("text") + " as ws from documents)"))
def _(spark, sf):
    t = tokens(F.col("text"))
    from ..operators.ner import ratio

    return I.documents(spark, sf, "text").withColumn("t", t).select(
        "doc_id", F.round(ratio(F.size(F.filter("t", lambda w: F.startswith(w, F.lit("t")))), F.size("t")), 9).alias("share")
    )
