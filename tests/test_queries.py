"""Spark result against SQL result on the smallest driver tables.

By default a cross-section is compared; LEXIGRAFT_ALL_QUERIES=1 compares every query.
"""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexigraft.plans.catalog import REGISTRY

SF = os.environ.get("LEXIGRAFT_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings events pages benchmark labels conversations".split()
CROSS_SECTION = [
    "A3_lexicon_scan", "A6_conll_sink_round_trip", "A9_table_row_triples", "A10_squad_sink_round_trip", "A17_results_report",
    "B3_segment_lookup", "B4_char_ngrams", "C1_vocabulary_expansion", "C7_lexicon_coverage", "D3_morpheme_average",
    "D6_fallback_chain", "D16_alignment_diagnostics", "D17_drift_penalty", "G1_mean_and_population_std", "L2_mlm_masking",
    "N2_entity_f1", "N5_prediction_decode", "Q4_seeded_split", "Q6_window_labels", "Q10_dataset_scores", "R3_run_guards",
    "R8_dataset_documentation",
]
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()
#: Found by random hyperplanes; its recall is tested against the exact form, which has SQL.
WITHOUT_SQL = {"J9_similarity_approximate"}
CHOSEN = sorted(set(REGISTRY) - WITHOUT_SQL) if os.environ.get("LEXIGRAFT_ALL_QUERIES") else CROSS_SECTION

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(float(v)) if isinstance(v, float) else str(v)

    cols = sorted(frame.columns)
    return cols, Counter(tuple(cell(v) for v in r) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = rows_of(QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(duck.execute(SQL[name]).df())


def test_every_query_has_sql_and_survey_coverage():
    assert set(REGISTRY) - set(SQL) == WITHOUT_SQL
    wanted = {f"{g}{i}" for g, n in [("A", 17), ("B", 13), ("C", 8), ("J", 12), ("D", 20), ("N", 7), ("Q", 12), ("L", 5), ("G", 8), ("W", 11), ("R", 13), ("S", 9)] for i in range(1, n + 1)}
    assert wanted <= {q.split("_")[0] for q in QUERIES}


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and df.columns == ["token", "origin", "v_sum", "v_wsum", "v_norm"]
