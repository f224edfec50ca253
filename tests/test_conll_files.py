"""CoNLL files read in Arrow batches, against the rules for a line and for a text held in a cell."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigraft.functions.tags import normalize_tag
from lexigraft.functions.text import strip
from lexigraft.sources import text as src

LINES = ["", " ", "\t", " \t ", "a", "a\tO", "a\t", "\tO", "a\tx\tB-PER", "b c O", " b  c ", "d I-LOC", "e\x1cB-DATe", "፡ f\tB-DATe", "　", "g h"]


@pytest.mark.parametrize("variant", ["evaluation", "preparation"])
def test_batch_of_lines_follows_the_rule_for_a_line(spark, variant):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "i int, value string").coalesce(1)
    t = src.conll_fields(F.col("value"), variant)
    want = frame.select("i", (F.length(strip(F.col("value"))) == 0).alias("blank"), t.alias("t")).orderBy("i").collect()
    blank, known, rows = src._parsed(pa.array(LINES), variant)
    assert blank.tolist() == [r["blank"] for r in want] and known.tolist() == [r["t"] is not None for r in want]
    raw = [(r["token"], r["tag"]) for r in rows.to_pylist()]
    if variant == "preparation":
        pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "i int, token string, tag string")
        raw = [tuple(r) for r in pairs.orderBy("i").select("token", normalize_tag(F.col("tag"))).collect()]
    assert raw == [tuple(r["t"]) for r in want if r["t"] is not None]


@pytest.mark.parametrize("variant", ["evaluation", "preparation"])
def test_files_of_odd_lines_equal_the_text_in_a_cell(spark, tmp_path, variant):
    odd = [x for x in LINES if x.strip() or "\t" not in x]
    lines = [odd[(i * i + i // 7) % len(odd)] for i in range(400)] + [""] + [f"w{i} B-DATe" for i in range(90)]
    (tmp_path / "f.conll").write_text("\n".join(lines), encoding="utf-8")
    cell = spark.createDataFrame([(1, "\n".join(lines))], "k int, text string")
    want = [r["sentence"] for r in src.parse_conll(cell, "text", ["k"], variant).orderBy("sent_id").collect()]
    settings = {"spark.sql.files.maxPartitionBytes": ("97", "1111", "64m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("3", "10000", "50")}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for values in zip(*settings.values(), strict=True):
            for k, v in zip(settings, values, strict=True):
                spark.conf.set(k, v)
            got = src.read_conll_sentences(spark, str(tmp_path / "f.conll"), variant).orderBy("sent_id").collect()
            assert [r["sentence"] for r in got] == want and [r["sent_id"] for r in got] == list(range(len(want)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sentences_are_read_once_after_the_summaries(spark, tmp_path):
    (tmp_path / "f.conll").write_text("a\tO\n\nb\tO\n", encoding="utf-8")
    plan = src.read_conll_sentences(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1


def test_plain_files_over_the_borders_of_splits(spark, tmp_path):
    odd = [x for x in LINES if x.strip()]
    sentences = ["\n".join(odd[(i + k) % len(odd)] for k in range(1 + i % 4)) + (" \n \nz O" if i % 6 == 0 else "") for i in range(24)]
    (tmp_path / "f.conll").write_text("\n\n".join(sentences) + "\n\n", encoding="utf-8")
    cell = spark.createDataFrame([(1, "\n\n".join(sentences))], "k int, text string")
    want = [r["sentence"] for r in src.parse_conll(cell, "text", ["k"]).orderBy("sent_id").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (13, 64, 9999):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = src.read_conll_sentences(spark, str(tmp_path / "f.conll"), plain=True).orderBy("sent_id").collect()
            assert [r["sentence"] for r in got] == want and [r["sent_id"] for r in got] == list(range(len(want))), size
        (tmp_path / "f.conll").write_text("a\tO\n\n\nb\tO\n\n", encoding="utf-8")
        with pytest.raises(Exception, match="more than one empty line"):
            src.read_conll_sentences(spark, str(tmp_path / "f.conll"), plain=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
