"""Small cases of what the registered queries of workload.repairs cover at scale."""

from pyspark.sql import functions as F

from plumbline.model import ROW_ID
from plumbline.operators.reference import bad_values
from plumbline.plans import scorecard
from plumbline.skew import join_counted
from plumbline.sources.tables import scrub
from workload.repairs import _run


def test_a_null_count_joins_like_a_small_one(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, r long")
    groups = spark.createDataFrame([("a", None), ("b", 5), ("c", 2_000_000)], "k string, n long")
    assert sorted(r.r for r in join_counted(rows, groups, "k", "n").collect()) == [1, 2, 3, 4]


def test_scores_count_rows_of_issues_without_a_count(spark):
    issues = spark.createDataFrame([("a", "X", "HIGH", None), ("b", "Y", "HIGH", 9_000_000)], "issue_id string, category string, severity string, affected_row_count long")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "issue_id string, row_id long")
    table = scorecard.category_table(issues, rows).collect()
    assert {r.category: r.affected_row_count for r in table} == {"X": 1, "Y": 1}


def test_reference_values_of_other_types(spark):
    df = spark.createDataFrame([(0, 1.0, 7, "x"), (1, 2.5, 8, "y")], f"{ROW_ID} long, d double, i int, s string")
    assert [r.value for r in bad_values(df, "d", {1, 2, None}).collect()] == [2.5]
    assert [r.value for r in bad_values(df, "i", {7.0, "nine", 8.5}).collect()] == [8]
    assert sorted(r.value for r in bad_values(df, "s", set()).collect()) == ["x", "y"]
    assert bad_values(df, "i", set(range(3000))).collect() == []


def test_nested_cells_can_be_cleared_only(spark):
    df = spark.createDataFrame([(0, [1], {"a": 1}, "t"), (1, [2], {"b": 2}, "u")], f"{ROW_ID} long, l array<int>, m map<string,int>, s string")
    rows = spark.createDataFrame([("clear", 0, "target"), ("set", 1, "target"), ("text", 1, "target")], "issue_id string, row_id long, role string")
    issues = [("clear", "CLEAR_VALUE", "l", None, 1, None), ("set", "SET_VALUE", "m", "{}", 1, None), ("text", "SET_VALUE", "s", "v", 1, None)]
    done = _run(df, issues, rows)
    assert sorted(tuple(r) for r in done.table.collect()) == [(0, None, {"a": 1}, "t"), (1, [2], {"b": 2}, "v")]
    assert {r.issue_id: r.success for r in done.results.collect()} == {"clear": True, "set": False, "text": True}
    told = {(r.column, r.after) for r in done.audit_cells.where(F.col("row_id").isNotNull()).collect()}
    assert told == {("l", None), ("s", "v")}


def test_secrets_of_properties_stay_out_of_messages():
    text = scrub("login bob failed for hunter2", "jdbc:x://h/d", {"user": "bob", "password": "hunter2", "fetchsize": "10"})
    assert text == "login *** failed for ***"
