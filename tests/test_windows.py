"""Context windows and their scores over hand-made documents, against the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexigraft.plans import inputs as I

DOCUMENTS = [
    (1, "a b  c\nd", "en", "src1"), (2, "", "de", "src2"), (3, " \n ", "fr", "src3"), (4, None, "es", "src4"),
    (5, "x y", "en", None), (6, " ".join(f"w{i}" for i in range(900)), "en", "src6"),
]


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("documents"))
    frame = spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string, lang string, source string")
    frame.selectExpr("*", "cast(length(text) as bigint) as n_chars").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def test_windows_of_texts_without_tokens_and_of_null_questions_equal_sql(spark, odd_documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd_documents}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, entry_point.queries()["Q5_context_windows"](spark, odd_documents).collect()))
    assert got == sorted(con.execute(entry_point.oracle_sql()["Q5_context_windows"]).fetchall())
    assert {r[0] for r in got} == {"q1", "q6"} and len(got) > 3


def waiting_for(frame, function):
    """(arguments, columns of the rows that wait) of each step of the plan that calls a Python function of that name."""
    steps, plan = [], [frame._jdf.queryExecution().optimizedPlan()]
    while plan:
        node = plan.pop()
        plan += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "ArrowEvalPython" and f"{function}(" in node.simpleString(1000):
            calls, fields = node.udfs(), node.child().schema().fields()
            steps.append(([calls.apply(i).children().size() for i in range(calls.size())], {f.name(): f.dataType().typeName() for f in fields}))
    return steps


def test_rows_that_wait_for_scores_hold_no_arrays_or_send_them_along(spark, odd_documents):
    [(_, columns)] = waiting_for(entry_point.queries()["W3_n_best_per_window"](spark, odd_documents), "hashed")
    assert columns and "array" not in columns.values()
    [(arguments, columns)] = waiting_for(entry_point.queries()["J8_start_end_candidates"](spark, odd_documents), "hashed")
    assert [k for k, kind in columns.items() if kind == "array"] == ["feature_offsets"] and set(arguments) == {3}


def test_windows_of_odd_texts_have_a_score_for_each_piece(spark, odd_documents):
    rows = I.scored_windows(spark, odd_documents).collect()
    assert {(r["id"], r["window"]) for r in rows} == {(f"q{i}", 0) for i in (1, 2, 3, 4, 6)} | {("q6", w) for w in (1, 2, 3)}
    assert all(len(r["feature_offsets"]) == len(r["s_scores"]) == len(r["e_scores"]) for r in rows)
    slim = I.scored_windows(spark, odd_documents, offsets=False).collect()
    assert {(r["id"], r["window"], *r["s_scores"]) for r in slim} == {(r["id"], r["window"], *r["s_scores"]) for r in rows}
