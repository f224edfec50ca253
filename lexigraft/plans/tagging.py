"""Queries: entity spans, scoring, label alignment, splits, adaptation corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import entity_spans, normalize_tag, tag_type
from ..functions.text import tokens
from ..operators import corpus, ner
from ..operators.keys import split_80_10_10
from ..session import stable
from . import inputs as I
from .registry import query
from .sql import h, s, sql

KEYS = ["doc_id", "line_no"]


def gold(spark, sf):
    """(doc_id, lang, line_no, sentence) with repaired tags."""
    fixed = F.transform("sentence", lambda t: t.withField("tag", normalize_tag(t["tag"])))
    return I.tagged(spark, sf).withColumn("sentence", fixed)


def gold_tags(spark, sf):
    return I.tagged(spark, sf).select(*KEYS, F.transform("sentence", lambda t: normalize_tag(t["tag"])).alias("tags"))


def predicted_tags(spark, sf):
    return I.predicted_tags(gold(spark, sf), "sentence").select(*KEYS, "tags")


@query("N1_entity_spans", sql('select doc_id, line_no, etype, s::bigint as start, e::bigint as "end" from span where side = \'g\''))
def _(spark, sf):
    rows = ner.spans(gold_tags(spark, sf), "tags", KEYS)
    return rows.select(*KEYS, "etype", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


_COUNTS = """select count(*) filter (p and g) as tp, count(*) filter (p and not g) as fp, count(*) filter (g and not p) as fn from (
    select doc_id, line_no, etype, s, e, bool_or(side = 'p') as p, bool_or(side = 'g') as g from span group by doc_id, line_no, etype, s, e)"""
_PRF = """select tp, fp, fn, round(100*p, 9) as precision, round(100*r, 9) as recall, round(100*2*p*r/(p+r), 9) as f1
    from (select *, tp/(tp+fp)::double as p, tp/(tp+fn)::double as r from ({0}))"""


@query("N2_entity_f1", sql(_PRF.format(_COUNTS)))
def _(spark, sf):
    r = ner.entity_f1(predicted_tags(spark, sf), gold_tags(spark, sf), KEYS)
    return r.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("G3_micro_sums", sql(f"select tp + fp as predicted, tp + fn as gold, tp from ({_COUNTS})"))
def _(spark, sf):
    r = ner.entity_f1(predicted_tags(spark, sf), gold_tags(spark, sf), KEYS)
    return r.select((F.col("tp") + F.col("fp")).alias("predicted"), (F.col("tp") + F.col("fn")).alias("gold"), "tp")


@query(
    "N3_span_set_algebra",
    sql("""select doc_id, line_no, count(*) filter (p and g) as both, count(*) filter (p and not g) as only_predicted, count(*) filter (g and not p) as only_gold
        from (select doc_id, line_no, etype, s, e, bool_or(side = 'p') as p, bool_or(side = 'g') as g from span group by all) group by all"""),
)
def _(spark, sf):
    pairs = predicted_tags(spark, sf).withColumnRenamed("tags", "p").join(gold_tags(spark, sf), KEYS)
    c = pairs.select(*KEYS, ner.span_counts(F.col("p"), F.col("tags")).alias("c"))
    return c.select(
        *KEYS, F.col("c.tp").alias("both"), F.col("c.fp").alias("only_predicted"), F.col("c.fn").alias("only_gold")
    ).filter("both + only_predicted + only_gold > 0")


@query("J7_sentence_pairs", sql("select g.doc_id, g.line_no, count(*) as n, count(*) filter (g.tag = p.tag) as same from gold g join pred p on p.doc_id = g.doc_id and p.line_no = g.line_no and p.pos = g.pos group by all"))
def _(spark, sf):
    pairs = predicted_tags(spark, sf).withColumnRenamed("tags", "p").join(gold_tags(spark, sf), KEYS)
    same = F.size(F.filter(F.zip_with("p", "tags", lambda a, b: a == b), lambda x: x))
    return pairs.select(*KEYS, F.size("tags").cast("bigint").alias("n"), same.cast("bigint").alias("same"))


# Pieces are chunks of four characters; one special piece on either side; 64 pieces at most.
WIDTH, PIECES = 4, 64
_PIECES = f"""select doc_id, line_no, p, case when k = 0 then lab else -100 end as label from (
      select doc_id, line_no, row_number() over (partition by doc_id, line_no order by pos, k) as p, k, lab from (
        select g.doc_id, g.line_no, g.pos, i.id as lab, unnest(range(greatest(cast(ceil(length(g.w)/{WIDTH}.0) as bigint), 1))) as k
        from gold g join (select tag, row_number() over (order by tag) - 1 as id from (select distinct tag from gold)) i on i.tag = g.tag))
    where p <= {PIECES} - 2"""


def _labels(spark, sf):
    from ..operators.vocab import label_inventory

    sentences = gold(spark, sf)
    inventory = label_inventory(sentences.select(F.explode("sentence.tag").alias("tag")))
    # the label set is the tag set of an annotation scheme: one small row
    table = inventory.agg(F.map_from_entries(F.collect_list(F.struct("label", "id"))).alias("ids"))
    return sentences.crossJoin(F.broadcast(table)), inventory


def _aligned(spark, sf):
    sentences, inventory = _labels(spark, sf)
    words = F.transform("sentence", lambda t: t["token"])
    ids = F.transform("sentence", lambda t: F.element_at("ids", t["tag"]).cast("int"))
    rows = sentences.select(*KEYS, ner.piece_word_ids(words, WIDTH, PIECES).alias("word_ids"), ids.alias("label_ids"))
    return rows.withColumn("labels", ner.first_piece_labels(F.col("word_ids"), F.col("label_ids"))), inventory


@query(
    "N4_first_piece_labels",
    sql(f"select doc_id, line_no, '-100 '||string_agg(label::varchar, ' ' order by p)||' -100' as labels from ({_PIECES}) group by all"),
)
def _(spark, sf):
    rows, _inventory = _aligned(spark, sf)
    return rows.select(*KEYS, F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


_SCORE = h("'n'||" + s("doc_id") + "||'-'||" + s("line_no") + "||'-'||" + s("p") + "||'-'||" + s("c"))


@query(
    "N5_prediction_decode",
    sql(f"""select gt.tag as gold, pt.tag as predicted, count(*) as n from (select doc_id, line_no, p, label, arg_max(c, {_SCORE} % 100 * 1000 - c) as best
          from (select *, unnest(range((select count(distinct tag) from gold))) as c from ({_PIECES}) where label <> -100) group by all) b
        join (select tag, row_number() over (order by tag) - 1 as id from (select distinct tag from gold)) gt on gt.id = b.label
        join (select tag, row_number() over (order by tag) - 1 as id from (select distinct tag from gold)) pt on pt.id = b.best group by all"""),
)
def _(spark, sf):
    rows, inventory = _aligned(spark, sf)
    n = inventory.agg(F.count("*").cast("int").alias("n_labels"))
    rows = rows.crossJoin(F.broadcast(n))

    row_key = F.concat_ws("-", F.concat(F.lit("n"), F.col("doc_id").cast("string")), F.col("line_no").cast("string"))
    scored = rows.select("labels", I.piece_scores(row_key, F.col("labels"), F.col("n_labels"), ner.IGNORED).alias("scores"))
    decoded = scored.select(F.explode(ner.decode_predictions(F.col("scores"), F.col("labels"))).alias("d"))
    names = inventory.withColumn("id", F.col("id").cast("int"))
    return (
        decoded.groupBy("d.predicted", "d.gold").agg(F.count("*").alias("n"))
        .join(names.select(F.col("id").alias("gold"), F.col("label").alias("g")), "gold")
        .join(names.select(F.col("id").alias("predicted"), F.col("label").alias("p")), "predicted")
        .select(F.col("g").alias("gold"), F.col("p").alias("predicted"), "n")
    )


@query("N6_sentence_token_counts", sql("select l.split, count(distinct (l.doc_id, l.line_no)) as sentences, count(*) as tokens from lsplit l join ltok t on t.doc_id = l.doc_id and t.line_no = l.line_no group by l.split"))
def _(spark, sf):
    return ner.split_counts(split_80_10_10(gold(spark, sf), I.SEED, KEYS))


@query("N7_entity_type_profile", sql("select etype, count(*) as n from span where side = 'g' group by etype"))
def _(spark, sf):
    return ner.type_profile(gold_tags(spark, sf), "tags")


@query(
    "A13_dataset_manifest",
    sql(f"""select lang as language, 42::bigint as seed, count(*) as sentences, sum(n_tok)::bigint as tokens, count(*) filter (split = 'train') as train,
          count(*) filter (split = 'dev') as dev, count(*) filter (split = 'test') as test, sum({h('line')})::bigint as content_key
        from lsplit join (select doc_id, line_no, count(*) as n_tok from ltok group by all) t using (doc_id, line_no) group by lang"""),
)
def _(spark, sf):
    from ..session import scratch_path
    from ..sources.records import write_manifest

    rows = split_80_10_10(I.lines(spark, sf), I.SEED, KEYS)
    is_split = lambda x: F.count_if(F.col("split") == x).alias(x)
    manifest = rows.groupBy(F.col("lang").alias("language")).agg(
        F.lit(I.SEED).cast("bigint").alias("seed"), F.count("*").alias("sentences"),
        F.sum(F.size(tokens(F.col("line"))).cast("bigint")).alias("tokens"),
        is_split("train"), is_split("dev"), is_split("test"), F.sum(I.h(F.col("line"))).alias("content_key"),
    )
    path = scratch_path(spark, "manifest")
    write_manifest(manifest, path)
    return spark.read.schema(manifest.schema).json(path)


@query(
    "A13_split_manifest",
    sql("""select * from (with r as (select lang, split, sha256(line) as h, n_tok from lsplit join (select doc_id, line_no, count(*) as n_tok from ltok group by all) k using (doc_id, line_no)),
        size as (select lang, split, count(*) as n, sum(n_tok) as t, 4 * (1 + (count(distinct h) > 4096 * 65536::bigint)::int + (count(distinct h) > 4096::hugeint * 65536 * 65536)::int) as depth from r group by all),
        leaf as (select lang, split, depth, h[1:depth] as g, sha256(string_agg(h, '' order by h)) as d from r join size using (lang, split) group by all),
        eight as (select lang, split, g, d from leaf where depth = 8 union all select lang, split, g[1:8], sha256(string_agg(d, '' order by g)) from leaf where depth = 12 group by all),
        four as (select lang, split, g, d from leaf where depth = 4 union all select lang, split, g[1:4], sha256(string_agg(d, '' order by g)) from eight group by all)
        select lang as language, split, any_value(n)::bigint as sentences, any_value(t)::bigint as tokens, sha256(string_agg(d, '' order by g)) as sha256, 42::bigint as seed
        from four join size using (lang, split) group by lang, split)"""),
)
def _(spark, sf):
    from ..sources.records import split_manifest

    rows = split_80_10_10(I.lines(spark, sf), I.SEED, KEYS).withColumnRenamed("lang", "language")
    made = split_manifest(rows, ["language"], "line", F.size(tokens(F.col("line"))), seed=I.SEED)
    parts = made.select("language", "seed", F.explode("files").alias("split", "f"))
    return parts.select("language", "split", "f.sentences", "f.tokens", "f.sha256", "seed")


@query("Q4_seeded_split", sql("select doc_id, line_no, split from lsplit"))
def _(spark, sf):
    return split_80_10_10(I.lines(spark, sf).select(*KEYS), I.SEED, KEYS)


# ---------------------------------------------------------------- window functions of the survey

@query(
    "W1_previous_tag",
    sql("""select doc_id, line_no, count(*) filter (et is not null and (starts_with(tag,'B-') or et is distinct from pt)) as opens
        from (select *, lag(et) over (partition by doc_id, line_no order by pos) as pt from typed where side = 'g') group by all"""),
)
def _(spark, sf):
    def opens(tags):
        types = F.transform(tags, tag_type)
        pairs = F.zip_with(tags, F.slice(F.concat(F.array(F.lit(None).cast("string")), types), 1, F.size(tags)),
                           lambda t, prev: tag_type(t).isNotNull() & (F.startswith(t, F.lit("B-")) | ~tag_type(t).eqNullSafe(prev)))
        return F.size(F.filter(pairs, lambda x: x))

    return gold_tags(spark, sf).select(*KEYS, opens(F.col("tags")).cast("bigint").alias("opens"))


@query("W2_running_span_number", sql("select doc_id, line_no, count(*) as spans, string_agg(s::varchar, ' ' order by s) as starts from span where side = 'g' group by all"))
def _(spark, sf):
    sp = entity_spans(F.col("tags"))
    rows = gold_tags(spark, sf).select(*KEYS, sp.alias("sp"))
    starts = F.array_join(F.transform("sp", lambda x: x["start"].cast("string")), " ")
    return rows.select(*KEYS, F.size("sp").cast("bigint").alias("spans"), starts.alias("starts")).filter("spans > 0")


@query(
    "W10_set_operations",
    sql("""select 'union' as op, count(*) as n from (select w from tok where lang = 'en' union select w from tok where lang <> 'en')
        union all select 'intersect', count(*) from (select w from tok where lang = 'en' intersect select w from tok where lang <> 'en')
        union all select 'except', count(*) from (select w from tok where lang = 'en' except select w from tok where lang <> 'en')"""),
)
def _(spark, sf):
    by_word = stable(
        I.doc_words(spark, sf).groupBy("word").agg(
            F.bool_or(F.col("lang") == I.OLD_LANG).alias("a"), F.bool_or(F.col("lang") != I.OLD_LANG).alias("b")
        )
    )
    a, b = by_word.filter("a").select("word"), by_word.filter("b").select("word")
    named = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in named]
    return parts[0].union(parts[1]).union(parts[2])


# ---------------------------------------------------------------- adaptation corpora

MAX_LEN, BATCH, UNK, PAD = 256, 32, 3, 1
_ENC = f"""select doc_id, line_no, pos, coalesce(v.id + 10, {UNK}) as id from ltok t left join vocab v on v.token = t.w where pos < {MAX_LEN}"""


def _encoded(spark, sf):
    """Ids start at 10: the lower ones are special pieces."""
    v = stable(I.old_vocab(spark, sf).select("token", (F.col("id") + 10).alias("id")))
    return corpus.encode(I.lines(spark, sf), v, UNK, MAX_LEN, KEYS, "line"), v


@query("L1_encode_lines", sql(f"select doc_id, line_no, string_agg(id::varchar, ' ' order by pos) as ids from ({_ENC}) group by all"))
def _(spark, sf):
    rows, _v = _encoded(spark, sf)
    return rows.select(*KEYS, F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("L1_encode_lines_by_join", sql(f"select doc_id, line_no, count(*) as n, sum(id*(pos+1))::bigint as key from ({_ENC}) group by all"))
def _(spark, sf):
    v = stable(I.old_vocab(spark, sf).select("token", (F.col("id") + 10).alias("id")))
    rows = corpus.encode(I.lines(spark, sf), v, UNK, MAX_LEN, KEYS, "line", shipped_bytes=0)
    key = F.aggregate(F.transform("ids", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(*KEYS, F.size("ids").cast("bigint").alias("n"), key.alias("key"))


def _draw(name: str) -> str:
    return h(f"'{name}-42-0-'||doc_id||'-'||line_no||'-'||pos") + " % 10000"


@query(
    "L2_mlm_masking",
    sql(f"""select doc_id, line_no, string_agg(tok::varchar, ' ' order by pos) as input_ids, string_agg((case when chosen then id else -100 end)::varchar, ' ' order by pos) as labels
        from (select *, case when not chosen or fate >= 9000 then id when fate < 8000 then 4 else 10 + word % (nv - 10) end as tok
          from (select *, id >= 10 and {_draw('pick')} < 1500 as chosen, {_draw('fate')} as fate, {_draw('word')} as word, (select count(*) + 10 from vocab) as nv from ({_ENC}))) group by all"""),
)
def _(spark, sf):
    rows, v = _encoded(spark, sf)
    n = v.count() + 10
    m = corpus.masked_copy(rows, KEYS, mask_id=4, vocab_size=n, special_below=10, seed=I.SEED)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return m.select(*KEYS, text("input_ids").alias("input_ids"), text("labels").alias("labels"))


@query("L3_shuffled_batches", sql(f"select doc_id, line_no, (r // {BATCH})::bigint as batch, (r % {BATCH})::bigint as slot from lrank"))
def _(spark, sf):
    return corpus.batches(I.lines(spark, sf).select(*KEYS), KEYS, BATCH, I.SEED)


@query(
    "L4_pad_batches",
    sql(f"""select doc_id, line_no, batch, width, n as real, ids||repeat(' {PAD}', (width - n)::int) as ids from (
        select doc_id, line_no, batch, n, ids, max(n) over (partition by batch) as width from (select l.doc_id, l.line_no, (r // {BATCH})::bigint as batch, e.n, e.ids
          from lrank l join (select doc_id, line_no, count(*) as n, string_agg(id::varchar, ' ' order by pos) as ids from ({_ENC}) group by all) e on e.doc_id = l.doc_id and e.line_no = l.line_no))"""),
)
def _(spark, sf):
    rows, _v = _encoded(spark, sf)
    padded = corpus.pad_batches(corpus.batches(rows, KEYS, BATCH, I.SEED), PAD)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return padded.select(
        *KEYS, "batch", F.size("ids").cast("bigint").alias("width"), real.cast("bigint").alias("real"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"),
    )


@query("L5_epoch_losses", sql("""select strftime(ts, '%Y-%m-%d') as epoch, count(*) as n_batches, round(avg(value), 6) as avg_loss,
    round(arg_max(value*0.9::double, event_id), 9) as last_mlm, round(arg_max(value*0.1::double, event_id), 9) as last_reg from events group by all"""))
def _(spark, sf):
    e = corpus.epoch_losses(I.steps(spark, sf))
    return e.select("epoch", "n_batches", F.round("avg_loss", 6).alias("avg_loss"), F.round("last_mlm", 9).alias("last_mlm"), F.round("last_reg", 9).alias("last_reg"))


@query("W6_argmax", sql("select doc_id, arg_max(line_no, length(line)*100000 - line_no) as line_no, max(length(line)) as n from line group by doc_id"))
def _(spark, sf):
    rows = I.lines(spark, sf).select("doc_id", "line_no", F.length("line").cast("bigint").alias("n"))
    best = F.max_by("line_no", F.struct("n", -F.col("line_no")))
    return rows.groupBy("doc_id").agg(best.alias("line_no"), F.max("n").alias("n"))


