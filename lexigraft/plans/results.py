"""Queries: run records, guards, aggregation over seeds, manifests, the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as R
from ..session import scratch_path
from ..sources import records, versions
from . import inputs as I
from .registry import query
from .sql import sql

SYSTEM_ROWS = ", ".join(
    f"({i}, '{row[0]}', {str(row[2]).lower()}, {str(row[3]).lower()}, "
    f"{'null' if row[4] is None else repr(row[4])}, '{row[5]}')"
    for i, row in enumerate(R.SYSTEMS)
)
SYS = f"(values {SYSTEM_ROWS}) sys(ord, system, expand_vocab, lapt, initializer, label)"


@query("A11_run_record_scan", sql("select language, system, count(*) as n, round(sum(f1), 4) as f1 from run where task = 'ner' group by all"))
def _(spark, sf):
    path = scratch_path(spark, "runs")
    records.write_runs(I.runs(spark, sf).drop("event_id"), path)
    runs = records.read_runs(spark, path, task="ner")
    return runs.groupBy("language", "system").agg(F.count("*").alias("n"), F.round(F.sum("test.f1"), 4).alias("f1"))


@query(
    "A12_run_record_sink",
    sql("""select experiment, system, task, language, seed, f1, has_proj, case when has_prov then commit end as commit,
        case when has_prov then language end as vectors_key, unavailable from named"""),
)
def _(spark, sf):
    path = scratch_path(spark, "runs")
    records.write_runs(I.runs(spark, sf).drop("event_id"), path)
    runs = records.read_runs(spark, path)
    return runs.select(
        "experiment", "system", "task", "language", F.col("seed").cast("bigint").alias("seed"), F.col("test.f1").alias("f1"),
        F.col("projection").isNotNull().alias("has_proj"), F.col("provenance.commit").alias("commit"),
        F.get(F.map_keys("provenance.vectors"), F.lit(0)).alias("vectors_key"),
        F.col("unavailable_hyperparameters").cast("bigint").alias("unavailable"),
    )


_MANIFEST_KEY = "source||'-'||lang"


@query(
    "A14_manifest_upsert",
    sql(f"""with old as (select {_MANIFEST_KEY} as language, count(*) as n, 'scan' as origin from documents group by all),
        new as (select {_MANIFEST_KEY} as language, count(*) as n, 'labels' as origin from documents d join labels l on l.doc_id = d.doc_id where l.toxic = 1 group by all)
        select * from new union all select * from old where language not in (select language from new)"""),
)
def _(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("language"))
    toxic = I.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    profile = lambda d, o: d.groupBy("language").agg(F.count("*").alias("n"), F.lit(o).alias("origin"))
    path = scratch_path(spark, "manifest")
    records.write_manifest_entries(profile(docs, "scan"), path)
    records.write_manifest_entries(profile(docs.join(toxic, "doc_id"), "labels"), path)  # reads and replaces what it is written to
    return versions.read_table(spark, path)


@query("A15_content_checksum", sql("select doc_id, sha256(text) as sha256 from documents"))
def _(spark, sf):
    return I.documents(spark, sf, "text").select("doc_id", records.content_checksum(F.col("text")).alias("sha256"))


# ---------------------------------------------------------------- aggregation over seeds

_KEY = "language, task, system"
_STATS = f"""select {_KEY}, metric, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from (
    select {_KEY}, unnest(['f1','precision','recall']) as metric, unnest([f1, f1*0.5::double, f1*2.0::double]) as v from run) group by all"""
METRICS = {"f1": "test.f1", "precision": "test.precision", "recall": "test.recall"}


@query("G1_mean_and_population_std", sql(_STATS))
def _(spark, sf):
    r = R.metric_stats(I.runs(spark, sf), R.RUN_KEY, {m: F.col(c) for m, c in METRICS.items()})
    return r.select(*R.RUN_KEY, "metric", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("G1_run_values", sql(f"select {_KEY}, f1 as value, count(*) as n_runs from run group by all"))
def _(spark, sf):
    return R.run_values(I.runs(spark, sf), R.RUN_KEY, F.col("test.f1"))


@query("G2_group_runs", sql(f"select {_KEY}, count(*) as n, count(distinct seed) as seeds from run group by all"))
def _(spark, sf):
    return I.runs(spark, sf).groupBy(*R.RUN_KEY).agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"))


@query("G5_set_valued_rollups", sql("""select distinct field, value from (select unnest(['commit','config','seed']) as field,
    unnest([substr(commit,1,12), substr(config,1,12), seed::varchar]) as value from run where has_prov)"""))
def _(spark, sf):
    return R.provenance_values(I.runs(spark, sf))


# ---------------------------------------------------------------- grid, guards, registry

_GRID = f"""select y.system, p.task, p.language, s.seed, y.system||'__'||p.task||'__'||p.language||'__seed'||s.seed as experiment
    from {SYS.replace(' sys(', ' y(')} cross join (select distinct task, language from run) p cross join (select distinct seed from run) s"""


def grid(spark, sf):
    runs = I.runs(spark, sf)
    pairs, seeds = runs.select("language", "task").distinct(), runs.select(F.col("seed").cast("bigint").alias("seed")).distinct()
    return R.experiment_grid(R.systems(spark), pairs, seeds)


@query("R1_experiment_grid", sql(_GRID))
def _(spark, sf):
    return grid(spark, sf).select("system", "task", "language", "seed", "experiment")


@query("R1_remaining_cells", sql(f"select experiment from ({_GRID}) where experiment not in (select run_name from named where f1 >= 50 and has_prov)"))
def _(spark, sf):
    from ..functions.text import run_name

    r = I.runs(spark, sf).filter("test.f1 >= 50 and provenance is not null")
    done = r.select(run_name(F.col("system"), F.col("task"), F.col("language"), F.col("seed")).alias("experiment"))
    return R.remaining_cells(grid(spark, sf), done).select("experiment")


@query("R2_system_config_join", sql(f"select r.event_id, r.system, y.expand_vocab, y.lapt, coalesce(y.initializer, 'default') as initializer from run r left join {SYS.replace(' sys(', ' y(')} on y.system = r.system"))
def _(spark, sf):
    rows = R.with_system_config(I.runs(spark, sf).select("event_id", "system"), R.systems(spark))
    return rows.select("event_id", "system", "expand_vocab", "lapt", "initializer")


def requests(spark, sf):
    """Run requests with every kind of mistake, from the run table."""
    e = F.col("event_id")
    b = I.h("req", e) % 12
    return I.runs(spark, sf).select(
        e.alias("run_id"),
        F.when(b == 0, F.concat(F.col("system"), F.lit("_x"))).otherwise(F.col("system")).alias("system"),
        F.when(b == 1, F.lit(None).cast("double")).when(b == 2, -1.0).when(b == 3, F.lit(float("nan"))).otherwise(1.0).alias("reg_lambda"),
        F.when(b % 2 == 0, "W").alias("alignment_matrix"),
        (b != 5).alias("has_manifest"),
    )


@query(
    "R3_run_guards",
    sql("""select run_id, 'unknown_system' as rule from req3 where b = 0
        union all select run_id, 'missing_penalty' from req3 where b in (1, 3)
        union all select run_id, 'negative_penalty' from req3 where b = 2
        union all select run_id, 'missing_matrix' from req3 where b <> 0 and ord >= 3 and b % 2 = 1
        union all select run_id, 'missing_manifest' from req3 where b = 5"""),
)
def _(spark, sf):
    return R.violations(requests(spark, sf), R.systems(spark))


@query("R4_fidelity", sql("select language, task, system, fidelity from fid"))
def _(spark, sf):
    return R.fidelity(R.RUN_KEY, I.runs(spark, sf))


@query("R5_unfaithful_systems", sql("select string_agg(system, ', ' order by system) as systems from (select distinct system from run where has_proj and not supplied)"))
def _(spark, sf):
    return R.unfaithful_systems(I.runs(spark, sf))


@query("R6_results_table", sql("select language, task, ord::bigint as ord, label, score, seeds, fidelity from rtable"))
def _(spark, sf):
    return R.results_table(I.runs(spark, sf), R.systems(spark)).withColumn("ord", F.col("ord").cast("bigint"))


@query("W8_custom_system_order", sql("select language, task, string_agg(label, ' < ' order by ord) as shown from rtable group by all"))
def _(spark, sf):
    t = R.results_table(I.runs(spark, sf), R.systems(spark))
    order = F.array_sort(F.collect_list(F.struct("ord", "label")))  # at most one row per system
    return t.groupBy("language", "task").agg(F.array_join(F.transform(order, lambda x: x["label"]), " < ").alias("shown"))


_PAGES = f"""select field, page::bigint as page, string_agg(value, ', ' order by value) as listed, any_value(n) as n_values from (
      select field, value, (row_number() over (partition by field order by value) - 1) // {R.PAGE} as page, count(*) over (partition by field) as n from (
        select distinct field, value from (select unnest(['commit','config','seed']) as field, unnest([substr(commit,1,12), substr(config,1,12), seed::varchar]) as value
          from run where has_prov) where value <> '')) group by field, page"""
_FLAGS = "select bool_or(dirty) as dirty, max(unavailable)::bigint as unavailable from run where has_prov"


@query("R7_provenance_summary", sql(f"select field, page, listed, n_values, dirty, unavailable from ({_PAGES}) cross join ({_FLAGS})"))
def _(spark, sf):
    return R.provenance_summary(I.runs(spark, sf)).withColumn("unavailable", F.col("unavailable").cast("bigint"))


@query("R8_dataset_documentation", sql("select language, task, n_runs, n_documented, status, detail from dstatus"))
def _(spark, sf):
    return R.dataset_status(I.runs(spark, sf))


_WARN = """select 'more_than_one_commit' as warning, count(distinct substr(commit,1,12))::varchar as detail from run where has_prov having count(distinct substr(commit,1,12)) > 1
    union all select 'uncommitted_changes', '' from run where has_prov having bool_or(dirty)
    union all select 'undocumented_dataset', language||' '||upper(task) from dstatus where status = 'none'"""


@query("R9_warnings", sql(_WARN))
def _(spark, sf):
    return R.warnings(I.runs(spark, sf))


_MAP = """select event_id, 'dimension=64,source=table,vocab_size='||(user_id + 1000) as kept from run where has_prov"""


@query("R10_manifest_field_selection", sql(_MAP))
def _(spark, sf):
    return _kept_fields(spark, sf, ("source", "dimension", "vocab_size"))


@query("S4_keep_listed_keys", sql("select event_id, 'sha256='||sha256(language) as kept from run where has_prov"))
def _(spark, sf):
    return _kept_fields(spark, sf, ("sha256", "size_bytes"))


def _kept_fields(spark, sf, keys):
    v = F.get(F.map_values("provenance.vectors"), F.lit(0))
    open_map = F.create_map(
        F.lit("source"), v["source"], F.lit("dimension"), v["dimension"].cast("string"),
        F.lit("vocab_size"), v["vocab_size"].cast("string"), F.lit("sha256"), v["sha256"],
    )
    kept = F.array_sort(F.map_entries(R.keep_map_keys(open_map, keys)))
    text = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return I.runs(spark, sf).filter("provenance is not null").select("event_id", text.alias("kept"))


@query("R11_missing_manifest_record", sql("select event_id, case when dm >= 2 then 'available' else 'unavailable' end as status, case when dm >= 2 then null when dm = 1 then 'no manifest' else 'no manifest in data/'||language end as reason from run where has_prov"))
def _(spark, sf):
    runs = I.runs(spark, sf).filter("provenance is not null")
    m = records.with_manifest(runs, F.col("provenance.dataset_manifest"), F.concat(F.lit("data/"), F.col("language")))
    rows = runs.select("event_id", m.alias("m"))
    return rows.select("event_id", F.coalesce("m.status", F.lit("available")).alias("status"), F.col("m.reason").alias("reason"))


@query("R12_vector_manifest_check", sql("""select 'label'||label as language, max(len(embedding))::bigint as dimension, count(*) as vocab_size, 768::bigint as expected_dimension,
    max(len(embedding)) = 768 and min(len(embedding)) = 768 as dimension_ok, not (max(len(embedding)) = 768 and min(len(embedding)) = 768) as unusable from embeddings group by label"""))
def _(spark, sf):
    emb = I.table(spark, sf, "embeddings").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("language"), F.col("embedding").alias("vec"))
    return R.vector_manifest(emb, 768)


@query("D20_projection_status", sql("select experiment, system, has_proj as present, case when has_proj and supplied then 'W' end as source, case when has_proj then 'false' else 'absent' end as is_identity, case when has_proj then 'false' else 'absent' end as trainable from named"))
def _(spark, sf):
    from ..operators.alignment import is_identity

    runs = I.runs(spark, sf)
    one = is_identity(I.matrix_rows(spark))
    status = R.projection_status(runs.crossJoin(F.broadcast(one)), F.col("is_identity"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("absent")).alias(c)
    return status.select("experiment", "system", "present", "source", text("is_identity"), text("trainable"))


_TITLE = "'## '||upper(language[1])||lower(language[2:])||' -- '||upper(task)"
_REPORT = f"""select '0' as section, unnest(range(4)) as ord, unnest(['# Results', '', 'Mean ± standard deviation of test F1 across seeds.', '']) as line
    union all select '1|a', unnest(range(2)), unnest(['> **Not a replication.** '||max(unavailable)||' hyperparameter(s) are marked unavailable.', '']) from run having max(unavailable) > 0
    union all select '1|b', unnest(range(2)), unnest(['> **Not faithful to the published method.** No author-provided alignment matrix W: '||string_agg(distinct system, ', ' order by system)||'.', '']) from run where has_proj and not supplied having count(*) > 0
    union all select '2|'||language||'|'||task, unnest([0, 1, 2, 3, 1000000]), unnest([{_TITLE}, '', '| System | F1 | seeds | Alignment matrix W |', '|---|---|---|---|', '']) from (select distinct language, task from rtable)
    union all select '2|'||language||'|'||task, ord + 10, '| '||label||' | '||score||' | '||seeds||' | '||fidelity||' |' from rtable
    union all select '3', unnest(range(4)), unnest(['## Provenance', '', '| Field | Value |', '|---|---|'])
    union all select case field when 'commit' then '3a' when 'config' then '3b' else '3c' end, page, '| '||case when page > 0 then '' when field = 'commit' then 'Commit' when field = 'config' then 'Config sha256' else 'Seeds' end||' | '
        ||case when field = 'seed' then listed||case when page = (n_values - 1) // {R.PAGE} then ' ('||n_values||' runs per system)' else '' end else '`'||listed||'`' end||' |' from ({_PAGES})
    union all select '3d', 0, '| Environment | python 3.13, numpy 2.0 |'
    union all select '3|'||arg_min(language, experiment), 0, '| Vectors ('||arg_min(language, experiment)||') | dim 64, vocab '||format('{{:,}}', arg_min(user_id, experiment) + 1000)||', sha256 `'||substr(sha256(arg_min(language, experiment)),1,12)||'` |' from named where has_prov
    union all select '4|'||language||'|'||task, 0, '| Dataset ('||language||' '||upper(task)||') | '||detail||' |' from dstatus
    union all select '5', unnest(range(2)), unnest(['| Unavailable hyperparameters | '||unavailable||' |', '']) from ({_FLAGS})
    union all select '6|1', unnest(range(2)), unnest(['> **More than one commit.** Results of different code stand in one table.', '']) from ({_WARN}) where warning = 'more_than_one_commit'
    union all select '6|2', unnest(range(2)), unnest(['> **Uncommitted changes.** The code of some runs is not the code of their commit.', '']) from ({_WARN}) where warning = 'uncommitted_changes'
    union all select '6|3', unnest(range(2)), unnest(['> **No dataset manifest for: '||string_agg(detail, ', ' order by detail)||'.** These splits cannot be traced to a source, a checksum or a seed.', '']) from ({_WARN}) where warning = 'undocumented_dataset' having count(*) > 0"""


@query("A17_results_report", sql(f"select section, ord::bigint as ord, line from ({_REPORT})"))
def _(spark, sf):
    lines = R.report_lines(I.runs(spark, sf), R.systems(spark))
    return lines.withColumn("ord", F.col("ord").cast("bigint"))
