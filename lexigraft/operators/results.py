"""Experiment grids, guards, aggregation over seeds and the results report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import run_name, short_hash
from .embeddings import MissingAlignmentMatrix, MissingParameter
from .keys import dense_index

# The compared systems in report order.
SYSTEMS = [
    # system, description, expand_vocab, lapt, initializer, label
    ("xlmr", "XLM-R baseline, no vocabulary expansion, no adaptation", False, False, None, "XLM-R"),
    ("lapt", "vocabulary expanded, default rows, adapted", True, True, "default", "+LAPT"),
    ("random_lapt", "Gaussian rows at the old scale, adapted", True, True, "random", "+Random+LAPT"),
    ("focus_lapt", "similarity-weighted rows, adapted", True, True, "focus", "+FOCUS+LAPT"),
    ("lexical_lapt", "lexical fallback chain, adapted", True, True, "lexical", "+Lexical+LAPT"),
]
TASKS = ("ner", "qa")
SEEDS = (42, 43, 44, 45, 46)
NEEDS_MATRIX = ("lexical", "focus")

# Fidelity texts of a results row.
NO_MATRIX = "n/a -- no alignment matrix required"
SUPPLIED = "author-supplied W"
MIXED = "**MIXED -- some runs had no author-supplied W**"
NOT_FAITHFUL = "**not faithful -- no author-supplied W**"
NO_MANIFEST = "**manifest unavailable -- splits not traceable**"

RUN_KEY = ["language", "task", "system"]
PAIR_KEY = ["language", "task"]


def systems(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(SYSTEMS)]
    schema = "ord int, system string, description string, expand_vocab boolean, lapt boolean, initializer string, label string"
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- grid and guards

def experiment_grid(system_rows: DataFrame, pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every (system, task, language, seed) cell with its name. All three inputs are small registries."""
    return (
        pairs.crossJoin(system_rows.select("system", "ord"))
        .crossJoin(seeds)
        .withColumn("experiment", run_name(F.col("system"), F.col("task"), F.col("language"), F.col("seed")))
    )


def remaining_cells(grid: DataFrame, finished: DataFrame) -> DataFrame:
    return grid.join(finished.select("experiment").distinct(), "experiment", "left_anti")


def with_system_config(runs: DataFrame, system_rows: DataFrame) -> DataFrame:
    """Registry attributes per run; a missing initializer reads ``default``."""
    cfg = system_rows.select("system", "expand_vocab", "lapt", "initializer")
    return runs.join(cfg, "system", "left").withColumn(
        "initializer", F.coalesce("initializer", F.lit("default"))
    )


def violations(requests: DataFrame, system_rows: DataFrame, require_manifest: bool = True) -> DataFrame:
    """(run_id, rule) for every broken rule of run requests.

    Requests carry run_id, system, reg_lambda, alignment_matrix, has_manifest.
    """
    x = requests.join(system_rows.select("system", "ord", "expand_vocab", "initializer"), "system", "left")
    weight = F.col("reg_lambda")
    unset = weight.isNull() | F.isnan(weight)
    rules: list[tuple[str, Column]] = [
        ("unknown_system", F.col("ord").isNull()),
        ("missing_penalty", unset),
        ("negative_penalty", ~unset & (weight < 0)),
        (
            "missing_matrix",
            F.coalesce(F.col("expand_vocab"), F.lit(False))
            & F.col("initializer").isin(*NEEDS_MATRIX)
            & F.col("alignment_matrix").isNull(),
        ),
    ]
    if require_manifest:
        rules.append(("missing_manifest", ~F.col("has_manifest")))
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules]))
    return x.select("run_id", F.explode(broken).alias("rule"))


_RULE_ERRORS = {"missing_penalty": MissingParameter, "missing_matrix": MissingAlignmentMatrix}


def check_requests(requests: DataFrame, system_rows: DataFrame, require_manifest: bool = True) -> None:
    """Raise on the first broken rule, before anything expensive runs."""
    bad = violations(requests, system_rows, require_manifest).orderBy("run_id", "rule").first()
    if bad:
        raise _RULE_ERRORS.get(bad["rule"], ValueError)(f"run {bad['run_id']}: {bad['rule']}")


# ---------------------------------------------------------------- aggregation over seeds

def metric_stats(runs: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, n, mean, std): population standard deviation, 0 for one run.

    Metrics are unpivoted inside the row; every group is combined on the map side.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in metrics.items()])
    return (
        runs.select(*keys, F.explode(values).alias("m"))
        .select(*keys, "m.metric", "m.value")
        .filter("value is not null")
        .groupBy(*keys, "metric")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def run_values(runs: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The values behind a mean as (keys, value, n_runs): equal values are counted, none dropped.

    Rows instead of one list per group, so a group may be of any size.
    """
    return runs.select(*keys, value.alias("value")).groupBy(*keys, "value").agg(F.count("*").alias("n_runs"))


def fidelity(keys: list[str], runs: DataFrame) -> DataFrame:
    """(keys, fidelity) from the projection objects of a group's runs."""
    has = F.col("projection").isNotNull()
    ok = F.when(has, F.coalesce(F.col("projection.author_supplied"), F.lit(False)))
    return runs.groupBy(*keys).agg(
        F.when(F.count_if(has) == 0, NO_MATRIX)
        .when(F.bool_and(ok), SUPPLIED)
        .when(F.bool_or(ok), MIXED)
        .otherwise(NOT_FAITHFUL)
        .alias("fidelity")
    )


def unfaithful_systems(runs: DataFrame) -> DataFrame:
    """One row: sorted systems with a projection that nobody supplied."""
    bad = runs.filter(
        F.col("projection").isNotNull() & ~F.coalesce(F.col("projection.author_supplied"), F.lit(False))
    )
    return bad.select("system").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("system")), ", ").alias("systems")
    )


def fixed(col: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f", col)


def results_table(runs: DataFrame, system_rows: DataFrame) -> DataFrame:
    """(language, task, ord, label, score, seeds, fidelity): one row per system that has runs."""
    stats = metric_stats(runs, RUN_KEY, {"f1": F.col("test.f1")})
    return (
        stats.join(fidelity(RUN_KEY, runs), RUN_KEY)
        .join(system_rows.select("system", "ord", "label"), "system")
        .select(
            "language",
            "task",
            "ord",
            "label",
            F.concat(fixed(F.col("mean")), F.lit(" ± "), fixed(F.col("std"))).alias("score"),
            F.col("n").alias("seeds"),
            "fidelity",
        )
    )


# ---------------------------------------------------------------- provenance

def documented(manifest: Column) -> Column:
    return manifest.isNotNull() & ~F.coalesce(manifest["status"] == "unavailable", F.lit(False))


def provenance_values(runs: DataFrame) -> DataFrame:
    """(field, value): distinct commits, config hashes and seeds of runs with provenance."""
    with_p = runs.filter("provenance is not null")
    fields = F.array(
        F.struct(F.lit("commit").alias("field"), short_hash(F.col("provenance.commit")).alias("value")),
        F.struct(F.lit("config").alias("field"), short_hash(F.col("provenance.config_sha256")).alias("value")),
        F.struct(F.lit("seed").alias("field"), F.col("seed").cast("string").alias("value")),
    )
    return (
        with_p.select(F.explode(fields).alias("x"))
        .select("x.field", "x.value")
        .filter("value is not null and value <> ''")
        .distinct()
    )


#: Values that stand on one page of a list.
PAGE = 100


def value_pages(values: DataFrame) -> DataFrame:
    """(field, page, listed, n_values): the sorted values of each field, joined page by page.

    Values are numbered by a sort of all, so a field may have any number of them and a page is the
    largest thing that is brought together.
    """
    numbered = dense_index(values.select("field", "value"), [F.col("field"), F.col("value")], "__row")
    fields = numbered.groupBy("field").agg(F.min("__row").alias("__first"), F.count("*").alias("n_values"))
    placed = numbered.join(F.broadcast(fields), "field").withColumn("page", F.floor((F.col("__row") - F.col("__first")) / PAGE))
    return placed.groupBy("field", "page", "n_values").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("listed")).select(
        "field", "page", "listed", "n_values"
    )


def provenance_flags(runs: DataFrame) -> DataFrame:
    """One row: any dirty, largest unavailable count, over runs with provenance."""
    return runs.filter("provenance is not null").agg(
        F.coalesce(F.bool_or("provenance.dirty"), F.lit(False)).alias("dirty"),
        F.coalesce(F.max("unavailable_hyperparameters"), F.lit(0)).alias("unavailable"),
    )


def provenance_summary(runs: DataFrame) -> DataFrame:
    """(field, page, listed, n_values, dirty, unavailable): all commits, configurations and seeds, in pages of ``PAGE``."""
    return value_pages(provenance_values(runs)).crossJoin(F.broadcast(provenance_flags(runs)))


def dataset_status(runs: DataFrame) -> DataFrame:
    """(language, task, n_runs, n_documented, status, detail) over runs with provenance.

    The detail describes the first documented run by experiment name.
    """
    m = F.col("provenance.dataset_manifest")
    doc = documented(m)
    grouped = runs.filter("provenance is not null").groupBy(*PAIR_KEY).agg(
        F.count("*").alias("n_runs"),
        F.count_if(doc).alias("n_documented"),
        F.min_by(F.when(doc, m), F.when(doc, F.col("experiment"))).alias("m"),
    )
    missing = F.col("n_runs") - F.col("n_documented")
    detail = F.concat(
        F.coalesce("m.source", F.lit("unavailable")),
        F.when(F.length("m.split") > 0, F.concat(F.lit(" -- "), "m.split")).otherwise(F.lit("")),
        F.when(F.col("m.seed").isNotNull(), F.concat(F.lit(" (split seed "), F.col("m.seed").cast("string"), F.lit(")"))).otherwise(F.lit("")),
        F.when(
            missing > 0,
            F.concat(F.lit(" -- **"), missing.cast("string"), F.lit(" of "), F.col("n_runs").cast("string"), F.lit(" runs had no manifest**")),
        ).otherwise(F.lit("")),
    )
    return grouped.select(
        *PAIR_KEY,
        "n_runs",
        "n_documented",
        F.when(F.col("n_documented") == 0, "none").when(missing > 0, "some").otherwise("all").alias("status"),
        F.when(F.col("n_documented") == 0, NO_MANIFEST).otherwise(detail).alias("detail"),
    )


def warnings(runs: DataFrame) -> DataFrame:
    """(warning, detail) rows, only those that apply."""
    with_p = runs.filter("provenance is not null")
    commits = with_p.agg(
        F.countDistinct(short_hash(F.col("provenance.commit"))).alias("n"), F.bool_or("provenance.dirty").alias("dirty")
    )
    general = F.array(
        F.when(F.col("n") > 1, F.struct(F.lit("more_than_one_commit").alias("warning"), F.col("n").cast("string").alias("detail"))),
        F.when(F.col("dirty"), F.struct(F.lit("uncommitted_changes").alias("warning"), F.lit("").alias("detail"))),
    )
    first = commits.select(F.explode(F.array_compact(general)).alias("w")).select("w.warning", "w.detail")
    bare = dataset_status(runs).filter("status = 'none'").select(
        F.lit("undocumented_dataset").alias("warning"),
        F.concat_ws(" ", "language", F.upper("task")).alias("detail"),
    )
    return first.unionByName(bare)


def keep_map_keys(col: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(col, lambda k, _v: k.isin(*keys))


def projection_status(runs: DataFrame, identity: Column) -> DataFrame:
    """Run columns plus present, source, is_identity, trainable of the alignment matrix."""
    present = F.col("projection").isNotNull()
    return runs.select(
        "experiment",
        "system",
        present.alias("present"),
        F.col("projection.source").alias("source"),
        F.when(present, identity).alias("is_identity"),
        F.when(present, F.lit(False)).alias("trainable"),
    )


def vector_manifest(vectors: DataFrame, expected_dim: int) -> DataFrame:
    """(language, dimension, vocab_size, expected_dimension, dimension_ok, unusable).

    A language whose table holds no vector, or vectors of several widths, is unusable.
    """
    size = F.size("vec").cast("bigint")
    p = vectors.groupBy("language").agg(
        F.count("vec").alias("vocab_size"), F.min(size).alias("lo"), F.max(size).alias("dimension")
    )
    ok = (F.col("dimension") == expected_dim) & (F.col("lo") == F.col("dimension"))
    return p.select(
        "language",
        "dimension",
        "vocab_size",
        F.lit(expected_dim).cast("bigint").alias("expected_dimension"),
        F.coalesce(ok, F.lit(False)).alias("dimension_ok"),
        ((F.col("vocab_size") == 0) | ~F.coalesce(ok, F.lit(False))).alias("unusable"),
    )


# ---------------------------------------------------------------- report

def report_lines(runs: DataFrame, system_rows: DataFrame) -> DataFrame:
    """(section, ord, line): the results report as ordered text rows."""
    spark = runs.sparkSession
    pair_title = F.concat(F.lit("## "), F.initcap("language"), F.lit(" -- "), F.upper("task"))
    section = F.concat(F.lit("2|"), "language", F.lit("|"), "task")
    table = results_table(runs, system_rows)
    pairs = table.select(*PAIR_KEY).distinct()

    def text(sec: str, start: int, *rows: str) -> DataFrame:
        return spark.createDataFrame([(sec, start + i, r) for i, r in enumerate(rows)], "section string, ord int, line string")

    def block(sec: str, *lines: Column) -> list[Column]:
        """A section name and its numbered lines, ended by a blank one."""
        return [F.lit(sec).alias("section"), F.posexplode(F.array(*lines, F.lit(""))).alias("ord", "line")]

    def cell_row(name: Column, value: Column) -> Column:
        return F.concat(F.lit("| "), name, F.lit(" | "), value, F.lit(" |"))

    head = text("0", 0, "# Results", "", "Mean ± standard deviation of test F1 across seeds.", "")
    notice = unfaithful_systems(runs).filter("systems <> ''").select(
        *block("1|b", F.concat(F.lit("> **Not faithful to the published method.** No author-provided alignment matrix W: "), "systems", F.lit(".")))
    )
    marks = runs.agg(F.max("unavailable_hyperparameters").alias("n")).filter("n > 0").select(
        *block("1|a", F.concat(F.lit("> **Not a replication.** "), F.col("n").cast("string"), F.lit(" hyperparameter(s) are marked unavailable.")))
    )
    titles = pairs.select(
        section.alias("section"),
        F.posexplode(
            F.array(pair_title, F.lit(""), F.lit("| System | F1 | seeds | Alignment matrix W |"), F.lit("|---|---|---|---|"))
        ).alias("ord", "line"),
    ).unionByName(pairs.select(section.alias("section"), F.lit(1_000_000).alias("ord"), F.lit("").alias("line")))
    body = table.select(
        section.alias("section"),
        (F.col("ord") + 10).alias("ord"),
        F.concat(
            F.lit("| "), "label", F.lit(" | "), "score", F.lit(" | "), F.col("seeds").cast("string"), F.lit(" | "), "fidelity", F.lit(" |")
        ).alias("line"),
    )
    env = (
        runs.filter("provenance is not null")
        .agg(F.min_by("provenance", "experiment").alias("p"))
        .filter("p is not null")
    )
    pages = value_pages(provenance_values(runs))
    # the section is there if any commit is known
    known = pages.filter("field = 'commit'").agg(F.count("*").alias("n")).filter("n > 0").select("n")
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    names = {"commit": ("3a", "Commit"), "config": ("3b", "Config sha256"), "seed": ("3c", "Seeds")}
    field = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]), F.col("field"))
    last_page = F.col("page") == F.floor((F.col("n_values") - 1) / PAGE)
    seeds = F.concat("listed", F.when(last_page, F.concat(F.lit(" ("), F.col("n_values").cast("string"), F.lit(" runs per system)"))).otherwise(F.lit("")))
    shown = pages.select(
        field(0).alias("section"),
        F.col("page").cast("int").alias("ord"),
        cell_row(F.when(F.col("page") == 0, field(1)).otherwise(F.lit("")), F.when(F.col("field") == "seed", seeds).otherwise(quoted(F.col("listed")))).alias("line"),
    )
    unnamed = pages.agg(F.count_if(F.col("field") == "config").alias("n")).filter("n = 0").select(
        F.lit("3b").alias("section"), F.lit(0).alias("ord"), F.lit("| Config sha256 | `unavailable` |").alias("line")
    )
    listed = shown.unionByName(unnamed).crossJoin(F.broadcast(known)).select("section", "ord", "line")
    titles_3 = known.select(F.lit("3").alias("section"), F.posexplode(F.array(*map(F.lit, ("## Provenance", "", "| Field | Value |", "|---|---|")))).alias("ord", "line"))
    prov = titles_3.unionByName(listed)
    first = env.select(
        F.lit("3d").alias("section"),
        F.lit(0).alias("ord"),
        cell_row(
            F.lit("Environment"),
            F.concat(
                F.lit("python "),
                F.coalesce("p.python", F.lit("?")),
                F.array_join(F.transform(F.map_entries("p.packages"), lambda e: F.concat(F.lit(", "), e["key"], F.lit(" "), e["value"])), ""),
            ),
        ).alias("line"),
    )
    spaces = env.select(F.explode("p.vectors").alias("lang", "v")).select(
        F.concat(F.lit("3|"), "lang").alias("section"),
        F.lit(0).alias("ord"),
        cell_row(
            F.concat(F.lit("Vectors ("), "lang", F.lit(")")),
            F.concat(
                F.lit("dim "), F.col("v.dimension").cast("string"), F.lit(", vocab "), F.format_number("v.vocab_size", 0),
                F.lit(", sha256 "), quoted(short_hash(F.col("v.sha256"))),
            ),
        ).alias("line"),
    )
    data = dataset_status(runs).select(
        F.concat(F.lit("4|"), "language", F.lit("|"), "task").alias("section"),
        F.lit(0).alias("ord"),
        cell_row(F.concat(F.lit("Dataset ("), "language", F.lit(" "), F.upper("task"), F.lit(")")), F.col("detail")).alias("line"),
    )
    last = provenance_flags(runs).crossJoin(F.broadcast(known)).select(*block("5", cell_row(F.lit("Unavailable hyperparameters"), F.col("unavailable").cast("string"))))
    found = warnings(runs).groupBy("warning").agg(F.array_join(F.array_sort(F.collect_list("detail")), ", ").alias("detail"))
    said = (
        F.when(F.col("warning") == "more_than_one_commit", F.lit("> **More than one commit.** Results of different code stand in one table."))
        .when(F.col("warning") == "uncommitted_changes", F.lit("> **Uncommitted changes.** The code of some runs is not the code of their commit."))
        .otherwise(F.concat(F.lit("> **No dataset manifest for: "), "detail", F.lit(".** These splits cannot be traced to a source, a checksum or a seed.")))
    )
    order = F.array_position(F.array(*map(F.lit, ("more_than_one_commit", "uncommitted_changes", "undocumented_dataset"))), F.col("warning"))
    warn = found.select(
        F.concat(F.lit("6|"), order.cast("string")).alias("section"), F.posexplode(F.array(said, F.lit(""))).alias("ord", "line")
    )
    parts = [head, marks, notice, titles, body, prov, first, spaces, data, last, warn]
    return reduce(DataFrame.unionByName, parts)
