"""Joins of tables that grow with the input pass nothing through the driver, however well the tables compress."""

import pytest
from pyspark.sql import functions as F

from plumbline import skew
from plumbline.model import AMOUNT_PLACEHOLDER, ROW_ID, as_issues
from plumbline.operators import components, merges
from plumbline.plans import cleanse


@pytest.fixture
def plans(monkeypatch):
    """The plans of all intermediate tables, with every group taken for one of many."""
    seen = []
    monkeypatch.setattr(skew, "FEW_GROUPS", -1)

    def spy(module):
        write = module.materialise

        def written(df, name):
            seen.append(plan(df))
            return write(df, name)

        monkeypatch.setattr(module, "materialise", written)

    for module in (cleanse, merges, components):
        spy(module)
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chain(spark, n=40):
    found = spark.range(n).select(F.format_string("m%04d", "id").alias("issue_id"), F.col("id").alias("keep"))
    at = F.struct(F.lit(0).cast("long").alias("seq"), "issue_id")
    order = found.select("issue_id", at.alias("at"), F.col("keep").alias("retain_id"), F.lit(1).cast("long").alias("n"))
    return order, found.select("issue_id", (F.col("keep") + 1).alias("row_id"))


def test_sequential_merges_broadcast_nothing(spark, plans):
    out = merges.effective_merges(*chain(spark))
    assert {r.issue_id: r.ok for r in out.collect()} == {f"m{i:04d}": i % 2 == 0 for i in range(40)}
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_component_merges_broadcast_nothing(spark, plans):
    keepers, gone = merges.merge_components(*chain(spark))
    assert {r.keeper for r in keepers.collect()} == {0}
    assert {r.row_id for r in gone.collect()} == set(range(1, 41))
    assert plans and not any("BroadcastExchange" in p for p in [*plans, plan(keepers), plan(gone)])


def test_fixes_of_many_rows_broadcast_nothing(spark, plans):
    df = spark.range(50).select(F.col("id").alias(ROW_ID), F.concat(F.lit("$"), "id").alias("amount"))
    base = spark.createDataFrame(
        [("fix", "ds", "SET_VALUE", "amount", AMOUNT_PLACEHOLDER, "APPROVED")],
        "issue_id string, dataset_id string, action_type string, target_column string, canonical_value string, status string",
    )
    rows = spark.createDataFrame([("fix", i, "target") for i in range(0, 50, 2)], "issue_id string, row_id long, role string")
    values = spark.createDataFrame([], "issue_id string, column string, value string")
    done = cleanse.execute_approved(df, as_issues(base), rows, values, "ann")
    assert {r[ROW_ID]: r.amount for r in done.table.collect()} == {i: f"{'' if i % 2 == 0 else '$'}{i}" for i in range(50)}
    for frame in (done.table, done.issues, done.audit, done.audit_cells):
        plans.append(plan(frame))
    assert [p for p in plans if "BroadcastExchange" in p] == []


def test_few_groups_of_a_written_table_keep_their_rows_in_place(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = skew.join_counted(rows, sizes, "g", "n", hot_rows=10, written=True)
    assert out.count() == 100 and "SortMergeJoin" not in plan(out)
