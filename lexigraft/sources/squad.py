"""Question-answering inputs and outputs in SQuAD form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_packed, strip_numbering

ANSWER = "struct<text:string,answer_start:int>"
QUESTION = f"struct<id:string,question:string,answers:array<{ANSWER}>,is_impossible:boolean>"
PARAGRAPH = f"struct<title:string,context:string,qas:array<{QUESTION}>>"
ARTICLE = f"struct<title:string,context:string,qas:array<{QUESTION}>,paragraphs:array<{PARAGRAPH}>>"
DOCUMENT = (
    f"version string, data array<{ARTICLE}>, title string, context string, "
    f"qas array<{QUESTION}>, paragraphs array<{PARAGRAPH}>"
)
LOOSE_DOCUMENT = "version string, data array<struct<title:string,paragraphs:array<string>>>"



def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Parsed SQuAD JSON. ``lines=True`` reads one document per line, which scales beyond one file."""
    return spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path)


def articles(documents: DataFrame, *keys: str) -> DataFrame:
    """Articles of ``{data: [...]}`` documents and of bare lists alike."""
    own = F.struct("title", "context", "qas", "paragraphs")
    return documents.select(
        *keys, F.explode(F.coalesce(F.col("data"), F.array(own))).alias("article")
    )


def paragraphs(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, title, context, qas); an article without paragraphs is its own paragraph."""
    itself = F.struct("article.title", "article.context", "article.qas")
    return (
        articles(documents, *keys)
        .select(*keys, "article.title", F.explode(F.coalesce("article.paragraphs", F.array(itself))).alias("p"))
        .select(*keys, "title", "p.context", "p.qas")
    )


def flatten_squad(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, question, context, answers); empty contexts and unanswered questions drop out."""
    return (
        paragraphs(documents, *keys)
        .filter("context is not null and length(context) > 0")
        .select(*keys, "context", F.explode("qas").alias("qa"))
        .filter(F.size("qa.answers") > 0)
        .select(*keys, F.col("qa.id").cast("string").alias("id"), "qa.question", "context", "qa.answers")
    )


def gold_texts(answers: Column) -> Column:
    return F.transform(answers, lambda a: a["text"])


def lenient_paragraphs(raw: DataFrame, json: str, default_title: str, *keys: str) -> DataFrame:
    """(keys, title, context, qas), skipping entries that are no objects or have no context."""
    doc = raw.select(*keys, F.from_json(json, LOOSE_DOCUMENT).alias("doc"))
    return (
        doc.select(*keys, F.explode("doc.data").alias("a"))
        .select(*keys, "a.title", F.explode("a.paragraphs").alias("p"))
        .withColumn("p", F.from_json("p", PARAGRAPH))
        .filter("p.context is not null and length(p.context) > 0")
        .select(
            *keys,
            F.coalesce("title", F.lit(default_title)).alias("title"),
            "p.context",
            F.coalesce("p.qas", F.array().cast(f"array<{QUESTION}>")).alias("qas"),
        )
    )


def table_row_triples(rows: DataFrame, cells: str, *keys: str, compat: bool = False, row_no: str | None = None) -> DataFrame:
    """(keys, pos, context, question, answer) from table rows with packed cells.

    ``row_no`` names the column that numbers the rows of a table from 0; row 0 is its header and is
    skipped. Without it every row is data.

    Needs six cells: context, questions and answers are the fourth to sixth. Questions
    and answers pair by position, the shorter list ends the pairing.
    """
    def unpack(i: int) -> Column:
        return F.transform(split_packed(F.get(cells, F.lit(i)), compat), strip_numbering)

    data = rows if row_no is None else rows.filter(F.col(row_no) > 0)
    return (
        data.filter(F.size(cells) >= 6)
        .select(*keys, F.get(cells, F.lit(3)).alias("context"), unpack(4).alias("qs"), unpack(5).alias("ans"))
        .withColumn("n", F.least(F.size("qs"), F.size("ans")))
        .select(
            *keys,
            "context",
            F.posexplode(F.arrays_zip(F.slice("qs", 1, F.col("n")).alias("q"), F.slice("ans", 1, F.col("n")).alias("a"))).alias("pos", "z"),
        )
        .select(*keys, "pos", "context", F.col("z.q").alias("question"), F.col("z.a").alias("answer"))
        .filter("question <> '' and answer <> '' and context <> ''")
    )


def question_manifest(classed: DataFrame, *keys: str, kind: str = "class") -> DataFrame:
    """(keys, extractive_qa_pairs, abstractive_dropped, unanswerable_dropped) from questions with their class."""
    of = lambda name: F.count_if(F.col(kind) == name)
    return classed.groupBy(*keys).agg(
        of("extractive").alias("extractive_qa_pairs"), of("abstractive").alias("abstractive_dropped"), of("unanswerable").alias("unanswerable_dropped")
    )


def write_squad(items: DataFrame, path: str, version: str = "1.0") -> None:
    """``items(split, title, context, qas)`` as SQuAD JSON below one folder per split.

    Each line is a complete document holding one article: no split is ever gathered.
    """
    docs = items.select("split", F.array(F.struct("title", "context", "qas")).alias("data"))
    docs.select(
        "split", F.to_json(F.struct(F.lit(version).alias("version"), "data")).alias("value")
    ).write.partitionBy("split").text(path)
