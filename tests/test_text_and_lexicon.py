import re

import pytest
from pyspark.sql import functions as F

from lexigraft.functions import text as X
from lexigraft.functions.tags import normalize_tag
from lexigraft.operators import lexicon
from lexigraft.sources import text as src


def values(spark, rows, expr, name="v"):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [r[0] for r in df.select(expr(F.col("s")).alias(name)).collect()]


@pytest.mark.parametrize(
    "line, word, morphemes",
    [
        ("1 ሰላማዊ - ሰላም -ኣዊ", "ሰላማዊ", ["ሰላም", "ኣዊ"]),
        ("2 ኣይናቱን ኣይ- ናቱ -ን", "ኣይናቱን", ["ኣይ", "ናቱ", "ን"]),
        ("ኣይጀመረን ኣይ- ጀመረ -ኣን", "ኣይጀመረን", ["ኣይ", "ጀመረ", "ኣን"]),
        ("ተመለስኩ ተ መለስ ኩ", "ተመለስኩ", ["ተ", "መለስ", "ኩ"]),
        ("7 ab --a-- ዕ-አ - -", "ab", ["a", "ዕ-አ"]),
        ("፩ ab c", "ab", ["c"]),
        ("42", None, []),
    ],
)
def test_lexicon_line_shapes(spark, line, word, morphemes):
    (entry,) = values(spark, [line], X.lexicon_entry)
    assert (entry["word"], entry["morphemes"]) == (word, morphemes)


def test_lexicon_file_skips_markers_and_last_line_wins(spark, tmp_path):
    body = "#note\nn |word|prefix\n1 aa - x -y\n\n$Section:\nbb p q\naa z\naa\nAa big\n"
    (tmp_path / "lex.txt").write_text(body, encoding="utf-8")
    lex = {r["word"]: r["morphemes"] for r in src.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()}
    assert lex == {"aa": ["z"], "bb": ["p", "q"], "Aa": ["big"]}


def test_segment_exact_then_lower_then_empty(spark):
    lex = spark.createDataFrame([("aa", ["a"]), ("Aa", ["b"])], "word string, morphemes array<string>")
    toks = spark.createDataFrame([("aa",), ("Aa",), ("AA",), ("zz",)], "token string")
    got = {r["token"]: r["morphemes"] for r in lexicon.segment(toks, lex).collect()}
    assert got == {"aa": ["a"], "Aa": ["b"], "AA": ["a"], "zz": []}


def test_whitespace_rule_equals_python_split(spark):
    rows = ["a b\x1fc d　e", " \t\n", "", "x፡y​z", "\x85p q "]
    assert values(spark, rows, X.tokens) == [r.split() for r in rows]
    assert values(spark, rows, X.strip) == [r.strip() for r in rows]


def test_digits_equal_python_isdigit(spark):
    rows = ["12", "²", "፩፪", "1a", "½", "٣", "①"]
    assert values(spark, rows, X.all_digits) == [r.isdigit() for r in rows]


def test_char_ngrams(spark):
    (grams,) = values(spark, ["abc"], lambda c: X.char_ngrams(c, 3, 5))
    assert grams == ["<ab", "abc", "bc>", "<abc", "abc>", "<abc>"]
    assert values(spark, ["x", ""], lambda c: X.char_ngrams(c, 3, 5)) == [["<x>"], []]


def test_numbering(spark):
    assert values(spark, ["1. a", "12 ) b ", "c 3."], X.strip_numbering) == ["a", "b", "c 3."]
    cell = ["1. one 2) two 12. twelve"]
    assert values(spark, cell, X.split_packed) == [["1. one ", "2) two ", "12. twelve"]]
    assert values(spark, cell, lambda c: X.split_packed(c, compat=True)) == [["1. one ", "2) two ", "1", "2. twelve"]]


def test_subword_surface_and_markers(spark):
    assert values(spark, ["▁ab", "ab", "▁", "▁a", "a"], X.subword_surface) == ["ab", "ab", None, None, None]
    assert values(spark, ["xaxa", ""], lambda c: X.count_marker(c, "xa")) == [2, 0]


def test_tag_repair(spark):
    assert values(spark, ["B-DATe", "IO", "BO", "I-PER", "O", "B-LO"], normalize_tag) == ["B-DATE", "O", "O", "I-PER", "O", "B-LO"]


def test_token_list_is_sorted_and_distinct(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" b \n\na\nb\n", encoding="utf-8")
    assert [r[0] for r in src.read_tokens(spark, str(tmp_path / "t.txt")).collect()] == ["a", "b"]


def conll_reference(text, variant):
    sentences, current = [], []
    for line in text.split("\n"):
        if not line.strip():
            if current:
                sentences.append(current)
            current = []
            continue
        parts = line.split("\t") if variant == "evaluation" and "\t" in line else line.split()
        if len(parts) >= 2:
            current.append((parts[0], parts[-1]))
    return sentences + ([current] if current else [])


TEXT = "\n\nA\tB-PER\nlone\nb c\tO\n \t\nC x O\n\n\n\nD\tI-LOC\nE O\n\nsingle\n\nF O"


@pytest.mark.parametrize("variant", ["evaluation", "preparation"])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_conll_text_in_a_cell(spark, variant, newline):
    df = spark.createDataFrame([(1, TEXT.replace("\n", newline))], "k int, text string")
    rows = src.parse_conll(df, "text", ["k"], variant).orderBy("sent_id").collect()
    assert [[(t["token"], t["tag"]) for t in r["sentence"]] for r in rows] == conll_reference(TEXT, variant)


def test_conll_file_read_in_many_splits(spark, tmp_path):
    body = "\n".join(
        f"w{i}\t{'B-PER' if i % 5 == 0 else 'O'}" + ("\n" if i % 7 == 3 else "") + ("\n\n" if i % 23 == 0 else "")
        for i in range(800)
    ) + "\n" + "\n" * 300 + "tail O\n"
    (tmp_path / "f.conll").write_text(body, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "1700", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in src.read_conll(spark, str(tmp_path / "f.conll")).collect():
                got.setdefault(r["sent_id"], {})[r["pos"]] = (r["token"], r["tag"])
            sentences = [[s[p] for p in range(len(s))] for _, s in sorted(got.items())]
            assert sentences == conll_reference(body, "evaluation"), size
            assert sorted(got) == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_conll_sentences_over_batches_and_splits(spark, tmp_path):
    body = "".join(f"w{i}\tO\n" + "\n" * (i % 11 == 4) + "\t\t\n" * (i % 97 == 5) for i in range(700)) + "\n \n" * 80 + "end B-PER\n"
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.conll").write_text(body.replace("w", name), encoding="utf-8")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = [spark.conf.get(n) for n in names]
    try:
        for size, batch in (("300", "10000"), ("1700", "7"), ("64m", "16"), ("64m", "10000")):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], batch)
            by_token = {}
            for r in src.read_conll(spark, str(tmp_path / "*")).collect():
                by_token.setdefault((r["file"], r["sent_id"]), {})[r["pos"]] = (r["token"], r["tag"])
            sentences = src.read_conll_sentences(spark, str(tmp_path / "*"))
            got = {(r["file"], r["sent_id"]): [tuple(t) for t in r["sentence"]] for r in sentences.collect()}
            assert got == {k: [s[p] for p in range(len(s))] for k, s in by_token.items()}
            for name in ("a", "b"):
                # a line of tabs alone ends a sentence and is a row of empty fields, which the reference drops
                rows = [[t for t in s if t[0]] for (f, _), s in sorted(got.items()) if f"/{name}/" in f]
                assert [s for s in rows if s] == conll_reference(body.replace("w", name), "evaluation")
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    plan = src.read_conll(spark, str(tmp_path / "*"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\d+, block#\d+", plan)  # lines are numbered where they are read
