"""Inputs of the registered queries, derived from the driver tables by expressions.

The tables hold prose, vectors and events. Lexicon lines, tags, answers, score arrays
and run records follow from md5 buckets, so SQL can derive the very same rows
(``sql.py``). Nothing here cuts a table or a text short.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import as_arrays, digest_heads, md5_bucket, md5_buckets, numbered_md5_buckets, once
from ..functions.text import run_name, tokens
from ..operators import qa, vocab
from ..session import bounded_batches, spread, stable
from ..sources.text import corpus_lines

DIM = 64        # fixed value: width of the embeddings table
SEED = 42
MAX_LENGTH = 384
STRIDE = 128
OLD_LANG = "en"  # the language whose words form the existing vocabulary


def h(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return md5_bucket(F.concat(*cols))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", *(cols or ("text", "lang"))), "doc_id")


# ---------------------------------------------------------------- words and lines

def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, word)"""
    return documents(spark, sf).select("doc_id", "lang", F.explode(tokens(F.col("text"))).alias("word"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    """(word, n) over all documents, written once: tokens, lexicon and vectors all start here."""
    return stable(doc_words(spark, sf).groupBy("word").agg(F.count("*").alias("n")))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, line_no, line): stripped non-blank lines."""
    raw = documents(spark, sf).select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return corpus_lines(raw, "line").withColumn("line_no", F.col("line_no").cast("bigint"))


def old_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """(token, word, n, id): all words of the old language, most frequent first."""
    old = doc_words(spark, sf).filter(F.col("lang") == OLD_LANG).select("word")
    return vocab.frequency_vocabulary(old, marker_every=3)


def requested_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(token): all words of the other languages."""
    return (
        doc_words(spark, sf).filter(F.col("lang") != OLD_LANG).select(F.col("word").alias("token")).distinct()
    )


# ---------------------------------------------------------------- vectors

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def at_slot(rows: DataFrame, spark: SparkSession, sf: str, bucket: Column) -> DataFrame:
    """Give each row the embedding its bucket points at."""
    emb = embeddings(spark, sf)
    n = emb.count()
    return rows.withColumn("vec_id", bucket % F.lit(n)).join(emb, "vec_id").drop("vec_id")


def word_vectors(all_words: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """(word, vec): the auxiliary space; about one word in ten is not covered."""
    known = all_words.select("word").filter(h("c", F.col("word")) % 10 != 0)
    return at_slot(known, spark, sf, h(F.col("word")))


def model_rows(vocab_rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec): embedding matrix rows of a vocabulary with ``word`` and ``id``."""
    return at_slot(vocab_rows.select("id", "word"), spark, sf, h("r", F.col("word"))).select("id", "vec")


def ngram_table(ngrams: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """(ngram, vec) for every n-gram of a column ``ngram``."""
    return at_slot(ngrams.select("ngram").distinct(), spark, sf, h("g", F.col("ngram")))


def matrix_rows(spark: SparkSession) -> DataFrame:
    """(row, vec): W[i][j] = ((7i + 3j) mod 11 - 5) / 16, exact in binary."""
    return spark.range(DIM).select(
        F.col("id").cast("int").alias("row"),
        F.transform(
            F.sequence(F.lit(0), F.lit(DIM - 1)),
            lambda j: ((F.col("id") * 7 + j * 3) % 11 - 5) / F.lit(16.0),
        ).alias("vec"),
    )


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vec): the embeddings with every seventh row moved by 0.5."""
    moved = F.when(F.col("vec_id") % 7 == 0, 0.5).otherwise(0.0)
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("id"), F.transform("vec", lambda v: v.cast("double") + moved).alias("vec")
    )


# ---------------------------------------------------------------- lexicon

def lexicon_lines(all_words: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """(line_no, value): every row shape, comments, markers, headers and later duplicates."""
    w = F.col("word")
    n = (h("n", w) % 1000).cast("string")
    pre, suf = F.substring(w, 1, 2), F.substr(w, F.length(w) - 1, F.lit(2))
    root = F.substr(w, F.lit(3), F.length(w) - 4)
    shape = h("s", w) % 5
    sp = F.lit(" ")
    first = (
        F.when(shape == 0, F.concat(n, sp, w, sp, pre, F.lit("- "), root, F.lit(" -"), suf))
        .when(shape == 1, F.concat(n, sp, w, F.lit(" - "), root, F.lit(" -"), suf))
        .when(shape == 2, F.concat(w, sp, pre, F.lit("- "), root, F.lit(" -"), suf))
        .when(shape == 3, F.concat(w, sp, pre, sp, root, sp, suf))
        .otherwise(F.concat(n, sp, w, sp, root))
    )
    at = h("l", w) * 10
    row = lambda k, v: F.struct(k.alias("line_no"), v.alias("value"))
    later = F.when(h("d", w) % 20 == 0, row(at + 5, F.concat(w, sp, root, sp, suf)))
    entries = (
        all_words.filter(F.length(w) >= 6)
        .select(F.explode(F.array_compact(F.array(row(at, first), later))).alias("r"))
        .select("r.line_no", "r.value")
    )
    lang = F.col("lang")
    extra = (
        documents(spark, sf, "lang").select("lang").distinct()
        .select(F.explode(F.array(
            F.concat(F.lit("$"), lang, F.lit(":")),
            F.concat(F.lit("# rows of "), lang),
            F.concat(F.lit("no |word|prefix|root "), lang),
            F.lit("  "),
        )).alias("value"))
        .select(F.lit(0).cast("bigint").alias("line_no"), "value")
    )
    return entries.unionByName(extra)


# ---------------------------------------------------------------- tagged sentences

TAGS = ["B-PER", "I-PER", "I-LOC", "BO", "B-DATe", "O", "O", "O", "O", "O"]  # by the last digit of a bucket


def tag_of(b: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TAGS]), (b % 10).cast("int"))


def gold_tag(w: Column) -> Column:
    return tag_of(h(w))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, line_no, sentence): one sentence per line, tags not yet repaired."""
    bounded_batches(spark)
    rows = lines(spark, sf).select("doc_id", "lang", "line_no", tokens(F.col("line")).alias("__words"))
    token = lambda w, b: F.struct(w.alias("token"), tag_of(b).alias("tag"))
    return rows.withColumn("__buckets", md5_buckets(F.col("__words"))).select(
        "doc_id", "lang", "line_no", F.zip_with("__words", "__buckets", token).alias("sentence")
    )


def predicted_tags(rows: DataFrame, sentence: str, name: str = "tags") -> DataFrame:
    """Add the gold tags of a sentence, dropped to O for one token in eight."""
    buckets = md5_buckets(F.transform(sentence, lambda t: t["token"]), "p")
    tag = lambda t, b: F.when(b % 8 == 0, F.lit("O")).otherwise(t["tag"])
    return rows.withColumn("__buckets", buckets).withColumn(name, F.zip_with(sentence, "__buckets", tag)).drop("__buckets")


def piece_scores(row_key: Column, labels: Column, n_labels: Column, ignored: int) -> Column:
    """A score in 0..99 of every label at each counted piece, null at the others."""

    @F.arrow_udf("array<array<bigint>>")
    def draw(keys: pa.Array, labels: pa.Array, counts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False)
        counted = pc.fill_null(pc.not_equal(labels.flatten(), ignored), False).to_numpy(zero_copy_only=False)
        n = counts.to_numpy(zero_copy_only=False)
        names = [b"%d" % c for c in range(int(n.max(initial=0)))]
        digests = []
        at = 0
        for key, size, width in zip(keys.to_pylist(), sizes.tolist(), n.tolist(), strict=True):
            start = hashlib.md5(key.encode() + b"-", usedforsecurity=False)
            for i in np.nonzero(counted[at : at + size])[0].tolist():
                piece = start.copy()
                piece.update(b"%d-" % i)
                for name in names[:width]:
                    m = piece.copy()
                    m.update(name)
                    digests.append(m.digest())
            at += size
        widths = np.where(counted, np.repeat(n, sizes), 0)
        return as_arrays(sizes, labels.is_valid(), as_arrays(widths, pa.array(counted), pa.array(digest_heads(digests) % 100)))

    return once(draw)(row_key, labels, n_labels)


def conll_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): one CoNLL text per document, blank line between sentences."""
    def block(ln: Column) -> Column:
        ws = tokens(ln)
        return F.array_join(F.transform(ws, lambda w: F.concat(w, F.lit("\t"), gold_tag(w))), "\n")

    return documents(spark, sf).select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n"), block), "\n\n").alias("text")
    )


# ---------------------------------------------------------------- questions

def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, doc_id, title, context, question, answers, a_text, a_start, class_no)."""
    doc = F.col("doc_id").cast("string")
    n = F.length("text")
    answer = lambda t, s: F.struct(t.alias("text"), s.cast("int").alias("answer_start"))
    base = documents(spark, sf, "text", "lang", "source").select(
        F.concat(F.lit("q"), doc).alias("id"),
        "doc_id",
        F.col("lang").alias("title"),
        F.col("text").alias("context"),
        F.concat(F.lit("where is "), F.repeat(F.lit("really "), (h("z", doc) % 8).cast("int")), F.col("source")).alias("question"),
        (h("q", doc) % 10).alias("class_no"),
        (h(doc) % F.greatest(n - 20, F.lit(1))).alias("a_start"),
    ).withColumn("a_text", F.substr("context", (F.col("a_start") + 1).cast("int"), F.lit(12)))
    t, s, c = F.col("a_text"), F.col("a_start"), F.col("class_no")
    return base.withColumn(
        "answers",
        F.when(c < 5, F.array(answer(t, s)))
        .when(c == 5, F.array(answer(t, s), answer(F.concat(t, F.lit("~")), s)))
        .when(c == 6, F.array(answer(t, s + 1)))
        .when(c <= 8, F.array(answer(F.concat(t, F.lit("~")), F.lit(-1)))),
    )


def squad_json(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, json): each document's question as nested, flat or bare-list SQuAD JSON."""
    question = F.struct("id", "question", "answers", (F.col("class_no") == 9).alias("is_impossible"))
    para = F.struct("context", F.array(question).alias("qas"))
    flat = F.struct("title", "context", F.array(question).alias("qas"))
    nested = F.struct("title", F.array(para).alias("paragraphs"))
    wrap = lambda a: F.to_json(F.struct(F.lit("1.0").alias("version"), F.array(a).alias("data")))
    kind = F.col("doc_id") % 3
    return questions(spark, sf).select(
        "doc_id",
        F.when(kind == 0, wrap(nested)).when(kind == 1, wrap(flat)).otherwise(F.to_json(nested)).alias("json"),
    )


def packed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, cells): a turn's sentences as questions, the next turn's as answers."""
    def pack(text: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(text, r"\. "),
                lambda s, i: F.concat(
                    (i + 1).cast("string"), F.when((i + 1) % 2 == 0, ") ").otherwise(". "), s
                ),
            ),
            " ",
        )

    turns = table(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(nxt, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.array(
            F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"),
            F.col("reply"), pack(F.col("text")), pack(F.col("reply")),
        ).alias("cells"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    bounded_batches(spark)
    return qa.context_windows(questions(spark, sf), MAX_LENGTH, STRIDE)


def scored_windows(spark: SparkSession, sf: str, offsets: bool = True) -> DataFrame:
    """Windows with md5-made start and end scores per position, and feature_offsets if asked for."""
    feats = qa.masked_offsets(windows(spark, sf))
    kept = ["feature_offsets"] if offsets else []

    def buckets(name: str) -> Column:
        key = F.concat(F.lit(name), F.col("doc_id").cast("string"), F.lit("-"), F.col("window").cast("string"), F.lit("-"))
        return numbered_md5_buckets(key, F.col("q_len") + F.col("n_tokens") + qa.SPECIALS, *kept)

    def scores(name: str) -> Column:
        return F.transform(name, lambda b: (b % 1000) / F.lit(10.0))

    drawn = feats.select("id", "doc_id", "window", *kept, buckets("s").alias("__s"), buckets("e").alias("__e"))
    return drawn.select("id", "doc_id", "window", *kept, scores("__s").alias("s_scores"), scores("__e").alias("e_scores"))


# ---------------------------------------------------------------- run records and step logs

def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run record per event, in the run-record schema plus event_id."""
    e = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    which = F.col("user_id") % 5
    task = pick(["ner", "qa"], e % 2)
    language = pick(["amharic", "tigrinya"], F.floor(e / 2) % 2)
    system = pick(["xlmr", "lapt", "random_lapt", "focus_lapt", "lexical_lapt"], which)
    seed = (e % 5 + 42).cast("int")
    supplied = h("a", e) % 3 != 0
    dm = h("m", e) % 4
    vectors = "map<string,struct<source:string,dimension:int,vocab_size:bigint,sha256:string>>"
    manifest = F.when(
        dm >= 2,
        F.struct(
            F.concat(F.lit("src-"), language).alias("source"),
            F.when(dm == 2, F.lit("random 80/10/10")).alias("split"),
            F.when(dm == 3, F.lit(42)).alias("seed"),
            F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("string").alias("reason"),
        ),
    ).when(
        dm == 1,
        F.struct(
            F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("split"),
            F.lit(None).cast("int").alias("seed"), F.lit("unavailable").alias("status"),
            F.lit("no manifest").alias("reason"),
        ),
    )
    provenance = F.struct(
        F.md5(F.concat(F.lit("commit"), (F.col("user_id") % 3).cast("string"))).alias("commit"),
        F.lit("main").alias("branch"),
        (h("d", e) % 97 == 0).alias("dirty"),
        F.md5(F.concat(F.lit("cfg"), (e % 2).cast("string"))).alias("config_sha256"),
        manifest.alias("dataset_manifest"),
        F.create_map(
            language,
            F.struct(
                F.lit("table").alias("source"), F.lit(64).alias("dimension"),
                (F.col("user_id") + 1000).alias("vocab_size"), F.sha2(language, 256).alias("sha256"),
            ),
        ).cast(vectors).alias("vectors"),
        F.lit("3.13").alias("python"),
        F.create_map(F.lit("numpy"), F.lit("2.0")).alias("packages"),
    )
    score = lambda v: F.struct(
        (v * 0.5).alias("precision"), (v * 2.0).alias("recall"), v.alias("f1"),
        F.lit(None).cast("double").alias("exact_match"),
    )
    name = F.concat(run_name(system, task, language, seed), F.lit("__run"), F.lpad(e.cast("string"), 12, "0"))
    return table(spark, sf, "events").select(
        e,
        name.alias("experiment"), system.alias("system"), task.alias("task"), language.alias("language"),
        seed.alias("seed"), F.lit(1.0).alias("reg_lambda"),
        score(F.col("value") * 0.9).alias("dev"), score(F.col("value")).alias("test"),
        F.when(
            which >= 3,
            F.struct(
                F.lit("externally supplied alignment matrix").alias("kind"),
                F.when(supplied, F.lit("W")).alias("source"),
                supplied.alias("author_supplied"),
                F.lit("unspecified").alias("training_status"),
                F.lit(False).alias("trained_during_this_run"),
            ),
        ).alias("projection"),
        F.when(e % 10 != 0, provenance).alias("provenance"),
        (e % 4).cast("int").alias("unavailable_hyperparameters"),
        F.round(F.col("value") / 7, 1).alias("elapsed_seconds"),
    )


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """(epoch, step, loss, mlm, reg): events as a step log, one epoch per day."""
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("epoch"),
        F.col("event_id").alias("step"),
        v.alias("loss"), (v * 0.9).alias("mlm"), (v * 0.1).alias("reg"),
    )
