import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexigraft.operators import results as R
from lexigraft.operators.embeddings import MissingAlignmentMatrix, MissingParameter
from lexigraft.sources import records, versions


def run(name, system, seed, f1=0.5, supplied=None, provenance=None, task="ner", **extra):
    r = {"experiment": name, "system": system, "task": task, "language": "tigrinya", "seed": seed, "test": {"f1": f1}, **extra}
    if supplied is not None:
        r["projection"] = {"kind": "external", "author_supplied": supplied, "source": "W" if supplied else None}
    if provenance is not None:
        r["provenance"] = provenance
    return r


def load(spark, tmp_path, *rows):
    (tmp_path / "runs.json").write_text("\n".join(json.dumps(r) for r in rows))
    return records.read_runs(spark, str(tmp_path / "runs.json"))


def table(spark, runs):
    return {r["label"]: r for r in R.results_table(runs, R.systems(spark)).collect()}


def report(spark, runs):
    return "\n".join(r["line"] for r in R.report_lines(runs, R.systems(spark)).orderBy("section", "ord").collect())


def test_fidelity_of_every_case(spark, tmp_path):
    runs = load(
        spark, tmp_path,
        run("a", "xlmr", 42), run("b", "lapt", 42), run("c", "random_lapt", 42),
        run("d", "focus_lapt", 42, supplied=True), run("e", "lexical_lapt", 42, supplied=False),
    )
    rows = table(spark, runs)
    for label in ("XLM-R", "+LAPT", "+Random+LAPT"):
        assert rows[label]["fidelity"].startswith("n/a")
    assert rows["+FOCUS+LAPT"]["fidelity"] == "author-supplied W"
    assert "not faithful" in rows["+Lexical+LAPT"]["fidelity"]
    text = report(spark, runs)
    assert "Not faithful to the published method" in text and "lexical_lapt" in text
    assert "| Alignment matrix W |" in text and "## Tigrinya -- NER" in text


def test_baselines_alone_raise_no_notice(spark, tmp_path):
    text = report(spark, load(spark, tmp_path, run("a", "xlmr", 42), run("b", "lapt", 42)))
    assert "no alignment matrix required" in text and "ot faithful" not in text and "Provenance" not in text


def test_mixed_seeds(spark, tmp_path):
    runs = load(spark, tmp_path, run("a", "lexical_lapt", 42, 1.0, True), run("b", "lexical_lapt", 43, 2.0, False))
    row = table(spark, runs)["+Lexical+LAPT"]
    assert "MIXED" in row["fidelity"] and (row["score"], row["seeds"]) == ("1.50 ± 0.50", 2)


def test_single_run_has_zero_spread_and_absent_systems_are_omitted(spark, tmp_path):
    rows = table(spark, load(spark, tmp_path, run("a", "xlmr", 42, 3.25), run("b", "other", 42)))
    assert {k: v["score"] for k, v in rows.items()} == {"XLM-R": "3.25 ± 0.00"}


def test_provenance_datasets_and_warnings(spark, tmp_path):
    p = lambda commit, manifest=None, dirty=False: {
        "commit": commit, "dirty": dirty, "config_sha256": "c" * 40, "dataset_manifest": manifest,
        "python": "3.13", "packages": {"numpy": "2.0"},
        "fasttext": {"tigrinya": {"dimension": 300, "vocab_size": 156687, "sha256": "f8b1f97f76dd5516"}},
    }
    good = {"source": "s", "split": "random", "seed": 42}
    runs = load(
        spark, tmp_path,
        run("a", "xlmr", 42, provenance=p("1" * 40, good)),
        run("b", "xlmr", 43, provenance=p("2" * 40, {"status": "unavailable"}, True), unavailable_hyperparameters=3),
        run("c", "xlmr", 42, provenance=p("1" * 40), task="qa"),
        run("d", "xlmr", 44),
    )
    status = {r["task"]: (r["status"], r["detail"]) for r in R.dataset_status(runs).collect()}
    assert status["ner"] == ("some", "s -- random (split seed 42) -- **1 of 2 runs had no manifest**")
    assert status["qa"] == ("none", R.NO_MANIFEST)
    rows = {r["field"]: r for r in R.provenance_summary(runs).collect()}
    assert [rows[f]["listed"] for f in ("commit", "seed")] == ["111111111111, 222222222222", "42, 43"]
    assert {(r["dirty"], r["unavailable"], r["page"]) for r in rows.values()} == {(True, 3, 0)}
    assert {r["warning"]: r["detail"] for r in R.warnings(runs).collect()} == {
        "more_than_one_commit": "2", "uncommitted_changes": "", "undocumented_dataset": "tigrinya QA"}
    text = report(spark, runs)
    assert "| Environment | python 3.13, numpy 2.0 |" in text
    assert "| Vectors (tigrinya) | dim 300, vocab 156,687, sha256 `f8b1f97f76dd` |" in text


def test_read_filters_and_partitioned_sink(spark, tmp_path):
    runs = load(spark, tmp_path, run("a", "xlmr", 42), run("b", "xlmr", 42, task="qa"))
    records.write_runs(runs, str(tmp_path / "stored"))
    assert [r["experiment"] for r in records.read_runs(spark, str(tmp_path / "stored"), task="qa").collect()] == ["b"]
    assert records.read_runs(spark, str(tmp_path / "stored"), language="amharic").count() == 0


def test_guards(spark):
    schema = "run_id int, system string, reg_lambda double, alignment_matrix string, has_manifest boolean"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    sys = R.systems(spark)
    R.check_requests(make((1, "xlmr", 0.0, None, True), (2, "lexical_lapt", 1.0, "W", True)), sys)
    R.check_requests(make((1, "xlmr", 0.0, None, False)), sys, require_manifest=False)
    for row, error in [
        ((1, "lexical_lapt", 1.0, None, True), MissingAlignmentMatrix),
        ((1, "lapt", None, None, True), MissingParameter),
        ((1, "lapt", float("nan"), None, True), MissingParameter),
        ((1, "lapt", -1.0, None, True), ValueError),
        ((1, "nope", 1.0, None, True), ValueError),
        ((1, "lapt", 1.0, None, False), ValueError),
    ]:
        with pytest.raises(error):
            R.check_requests(make(row), sys)


def test_grid_has_every_cell_and_skips_finished(spark):
    pairs = spark.createDataFrame([("amharic", "ner"), ("amharic", "qa"), ("tigrinya", "ner"), ("tigrinya", "qa")], "language string, task string")
    seeds = spark.createDataFrame([(s,) for s in R.SEEDS], "seed int")
    grid = R.experiment_grid(R.systems(spark), pairs, seeds)
    assert grid.count() == grid.select("experiment").distinct().count() == 100
    done = spark.createDataFrame([("xlmr__ner__amharic__seed42",)], "experiment string")
    assert R.remaining_cells(grid, done).count() == 99


def test_manifest_upsert_and_vector_check(spark):
    old = spark.createDataFrame([("am", 300), ("ti", 300)], "language string, dimension int")
    new = spark.createDataFrame([("ti", 768), ("xx", 1)], "language string, dimension int")
    assert {r[0]: r[1] for r in records.upsert_manifest(old, new).select("language", "dimension").collect()} == {"am": 300, "ti": 768, "xx": 1}
    v = spark.createDataFrame([("a", [1.0] * 3), ("b", [1.0] * 2), ("b", [1.0] * 3), ("c", None)], "language string, vec array<double>")
    got = {r["language"]: (r["vocab_size"], r["dimension_ok"], r["unusable"]) for r in R.vector_manifest(v, 3).collect()}
    assert got == {"a": (1, True, False), "b": (2, False, True), "c": (0, False, True)}


def test_file_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    row = records.file_checksums(spark, str(tmp_path / "x.bin")).first()
    assert row["sha256"] == hashlib.sha256(b"abc").hexdigest() and row["length"] == 3


def test_report_is_one_ordered_body(spark, tmp_path):
    lines = spark.createDataFrame([("1", 1, "b"), ("0", 0, "a"), ("1", 10, "d"), ("1", 2, "c")], "section string, ord int, line string")
    records.write_report(lines, str(tmp_path / "r"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b", "c", "d"]


def test_metric_stats_use_the_population_formula(spark):
    rows = spark.createDataFrame([("g", 1.0, None), ("g", 2.0, 4.0), ("g", 6.0, None)], "k string, a double, b double")
    got = {r["metric"]: (r["n"], r["mean"], r["std"]) for r in R.metric_stats(rows, ["k"], {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got["a"] == (3, 3.0, pytest.approx((14 / 3) ** 0.5)) and got["b"] == (1, 4.0, 0.0)


def run_record(**more):
    record = {
        "experiment": "e", "system": "s", "task": "ner", "language": "am", "seed": 42, "test": {"f1": 50.0},
        "projection": None, "unavailable_hyperparameters": 2,
        "provenance": {"commit": "c" * 40, "dirty": False, "fasttext": {"am": {"source": "x", "dimension": 300, "vocab_size": 7, "sha256": "d"}},
                       "packages": {"numpy": "2"}, "python": "3.13"},
    }
    return record | more


def test_indented_records_are_read_and_never_become_nulls(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "experiment.json").write_text(json.dumps(run_record(seed=i), indent=2))
    runs = records.read_runs(spark, str(tmp_path), multiline=True)
    got = runs.select("seed", "provenance.commit", F.col("provenance.vectors")["am"]["dimension"].alias("d"), "test.f1").collect()
    assert sorted(tuple(r) for r in got) == [(i, "c" * 40, 300, 50.0) for i in range(3)]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):  # an indented record is no line of JSON
        records.read_runs(spark, str(tmp_path / "r0")).collect()
    (tmp_path / "r0" / "broken.json").write_text('{"experiment": "e", "seed": ')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        records.read_runs(spark, str(tmp_path), multiline=True).collect()


def test_runs_without_a_manifest_say_so(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(run_record()))
    runs = records.read_runs(spark, str(tmp_path))
    m = runs.select(records.with_manifest(runs, F.col("provenance.dataset_manifest"), F.lit("data/am")).alias("m")).first()["m"]
    assert m["status"] == "unavailable" and "data/am" in m["reason"] and m["source"] is None


def test_a_split_checksum_does_not_depend_on_the_layout(spark):
    rows = spark.createDataFrame([("am", "train", f"line {i}") for i in range(50)] + [("am", "dev", "x")], "language string, split string, line string")
    made = [records.split_manifest(rows.repartition(n), ["language"], "line", F.lit(2), seed=1).collect() for n in (1, 5)]
    assert made[0] == made[1]
    files = made[0][0]["files"]
    assert files["train"]["sentences"] == 50 and files["train"]["tokens"] == 100 and files["dev"]["sha256"] != files["train"]["sha256"]
    other = records.split_manifest(rows.filter("line <> 'line 3'"), ["language"], "line", F.lit(2)).first()["files"]
    assert other["train"]["sha256"] != files["train"]["sha256"] and other["dev"] == files["dev"]


def test_split_manifest_of_one_line_many_times(spark):
    """Copies of a line whose digests, joined, pass the limit of a cell."""
    n = 34_000_000
    rows = spark.range(n).select(F.lit("en").alias("language"), F.lit("train").alias("split"), F.lit("same").alias("line"))
    made = records.split_manifest(rows, ["language"], "line", F.lit(2)).first()
    group, block = hashlib.sha256(), hashlib.sha256(b"same").hexdigest().encode() * 10_000
    for _ in range(n // 10_000):
        group.update(block)
    assert (made["sentences"], made["tokens"]) == (n, 2 * n)
    assert made["files"]["train"]["sha256"] == hashlib.sha256(group.hexdigest().encode()).hexdigest()


def test_split_manifest_is_that_of_the_rows_joined(spark):
    lines = ["a", "b", "a", None, "c", "a", None]
    rows = spark.createDataFrame([("en", "dev", x) for x in lines], "language string, split string, line string")
    found = records.split_manifest(rows, ["language"], "line", F.lit(1)).first()["files"]["dev"]
    groups = {}
    for x in lines:
        digest = hashlib.sha256(x.encode()).hexdigest() if x is not None else ""
        groups.setdefault(digest[:4], []).append(digest)
    joined = "".join(hashlib.sha256("".join(sorted(groups[g])).encode()).hexdigest() for g in sorted(groups))
    assert found["sha256"] == hashlib.sha256(joined.encode()).hexdigest() and found["sentences"] == len(lines)


def test_lists_of_any_length_are_complete(spark):
    """100,000 commits, two configurations and five seeds: every one is in the report, page by page."""
    p = F.struct(F.lpad(F.hex("id"), 12, "0").alias("commit"), F.lit(False).alias("dirty"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("config_sha256"))
    kind = spark.createDataFrame([], records.RUN_RECORD)
    kind = kind.withColumn("provenance", F.col("provenance").withField("vectors", F.col("provenance.fasttext")).dropFields("fasttext"))
    made = spark.range(100_000).select(
        F.to_json(F.struct(F.concat(F.lit("e"), F.col("id").cast("string")).alias("experiment"), F.lit("xlmr").alias("system"), F.lit("ner").alias("task"), F.lit("am").alias("language"),
                           (F.col("id") % 5).alias("seed"), F.struct(F.lit(1.0).alias("f1")).alias("test"), p.alias("provenance"))).alias("j"))
    runs = made.select(F.from_json("j", kind.schema).alias("r")).select("r.*")
    lines = [r["line"] for r in R.report_lines(runs, R.systems(spark)).orderBy("section", "ord").collect()]
    at = lines.index("|---|---|", lines.index("## Provenance"))
    pages = lines[at + 1 : at + 1001]
    assert pages[0].startswith("| Commit | `") and all(x.startswith("|  | `") for x in pages[1:])
    assert [c for x in pages for c in x.split("`")[1].split(", ")] == [f"{i:012X}" for i in range(100_000)]
    assert lines[at + 1001 : at + 1003] == ["| Config sha256 | `c0, c1` |", "| Seeds | 0, 1, 2, 3, 4 (5 runs per system) |"]
    rows = R.provenance_summary(runs).filter("field = 'commit'").collect()
    assert len(rows) == 1000 and max(len(r["listed"]) for r in rows) == 100 * 14 - 2


def test_checksum_of_a_file_beyond_a_cell(spark, tmp_path):
    path = tmp_path / "large.bin"
    size = 3 * (1 << 30) + 5
    with open(path, "wb") as f:  # sparse: it takes no room
        f.write(b"head")
        f.truncate(size)
    want, zeros = hashlib.sha256(b"head"), bytes(1 << 20)
    for _ in range((size - 4) >> 20):
        want.update(zeros)
    want.update(zeros[: (size - 4) & ((1 << 20) - 1)])
    row = records.file_checksums(spark, str(path)).first()
    assert (row["length"], row["sha256"]) == (size, want.hexdigest())


def test_a_task_holds_one_range_of_a_file(tmp_path):
    import tracemalloc

    path = tmp_path / "x.bin"
    with open(path, "wb") as f:
        f.truncate(300 << 20)
    tracemalloc.start()
    with records.open_path(f"file:{path}") as file:
        length, _ = records.stream_sha256(file)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert length == 300 << 20 and most < 64 << 20


def test_checksums_of_many_files(spark, tmp_path):
    for i in range(1, 20):
        (tmp_path / f"a file {i}%20é.bin").write_bytes(b"x" * i)
    got = {r["length"]: r["sha256"] for r in records.file_checksums(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(b"x" * i).hexdigest() for i in range(1, 20)}
    assert {r["length"] for r in records.file_checksums(spark, str(tmp_path), range_bytes=3).collect()} == set(range(1, 20))


@pytest.mark.parametrize("most", [1, 0.001])
def test_checksum_tree_of_several_levels(spark, monkeypatch, most):
    monkeypatch.setattr(records, "_LEAF_DIGESTS", most)
    monkeypatch.setattr(records, "_TREE_DIGITS", 1)
    lines = [f"line {i % 400}" for i in range(700)]
    rows = spark.createDataFrame([("en", "dev", x) for x in lines] + [(None, "dev", "alone")], "language string, split string, line string")
    found = {r["language"]: r["files"]["dev"]["sha256"] for r in records.split_manifest(rows, ["language"], "line", F.lit(1)).collect()}

    def root(values):
        different = len(set(values))
        depth = 1 + sum(different > most * 16**level for level in range(1, 4))

        def node(prefix):
            some = [v for v in values if v.startswith(prefix)]
            if len(prefix) == depth:
                return hashlib.sha256("".join(sorted(some)).encode()).hexdigest()
            return hashlib.sha256("".join(node(prefix + c) for c in "0123456789abcdef" if any(v.startswith(prefix + c) for v in some)).encode()).hexdigest()

        return node("")

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == {"en": root([digest(x) for x in lines]), None: root([digest("alone")])}


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(versions.NoVersion):
        versions.read_table(spark, path)
    entries = lambda *rows: spark.createDataFrame(list(rows), "language string, dimension int")
    assert records.write_manifest_entries(entries(("am", 300), ("ti", 300)), path) == 0
    assert records.write_manifest_entries(entries(("ti", 768), ("xx", 1)), path) == 1
    now = lambda: {r["language"]: r["dimension"] for r in versions.read_table(spark, path).collect()}
    assert now() == {"am": 300, "ti": 768, "xx": 1}
    # half of the tasks fail after others have written
    bad = spark.range(0, 8, 1, 8).select(F.col("id").cast("string").alias("language"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.raise_error(F.lit("torn"))).cast("int").alias("dimension"))
    with pytest.raises(Exception, match="torn"):
        records.write_manifest_entries(bad, path)
    assert now() == {"am": 300, "ti": 768, "xx": 1} and versions.commits(spark, path).count() == 2
    assert {r["language"] for r in versions.read_table(spark, path, 0).collect()} == {"am", "ti"}
    # any sink takes part
    lines = spark.createDataFrame([("0", 0, "a")], "section string, ord int, line string")
    assert versions.commit(spark, str(tmp_path / "r"), lambda at: records.write_report(lines, at)) == 0
    assert [r[0] for r in spark.read.text(versions.folder(spark, str(tmp_path / "r"))).collect()] == ["a"]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(1)
    versions.write_table(df, path)
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(spark, path, lambda at: (df.write.parquet(at), versions.write_table(spark.range(5), path)))
    assert versions.read_table(spark, path).count() == 5 and versions.commits(spark, path).count() == 2
