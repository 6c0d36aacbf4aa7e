"""REFERENTIAL_INTEGRITY: values that a reference set does not contain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.model import ROW_ID, Category, Findings, Role, Severity, findings, issue_id
from plumbline.operators.cells import fit
from plumbline.operators.completeness import data_columns
from plumbline.operators.samples import sample_values
from plumbline.skew import HOT_ROWS, join_counted

def bad_values(df: DataFrame, column: str, reference: DataFrame | Iterable) -> DataFrame:
    """(value, n, first_row): distinct non-null values outside the reference.

    Values are counted first, so the anti join sees each distinct value once however many
    rows carry it. ``reference`` is a set, or a one-column table of any size.
    """
    values = (
        df.select(F.col(f"`{column}`").alias("value"), F.col(ROW_ID).alias("row_id"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    )
    if not isinstance(reference, DataFrame):
        # As text and cast by Spark: a set of whole numbers serves a column of doubles. What has no
        # form in the column's type equals none of its values.
        known = [(str(v),) for v in reference if v is not None]
        listed = df.sparkSession.createDataFrame(known, "value string")
        reference = listed.select(fit(F.col("value"), df.schema[column].dataType).alias("value"))
    reference = reference.toDF("value").where(F.col("value").isNotNull())
    return values.join(reference, "value", "left_anti")


def check_reference(
    df: DataFrame,
    dataset_id: str,
    reference_sets: dict[str, DataFrame | Iterable],
    hot_rows: int = HOT_ROWS,
) -> Findings | None:
    found = None
    for column, reference in reference_sets.items():
        if column in data_columns(df):
            one = _check_column(df, dataset_id, column, reference, hot_rows)
            found = one if found is None else found.union(one)
    return found


def _check_column(df, dataset_id, column, reference, hot_rows) -> Findings:
    bad = materialise(bad_values(df, column, reference), "bad-values")  # read four times
    key = issue_id(dataset_id, Category.REFERENTIAL_INTEGRITY, column)
    rows = df.select(F.col(f"`{column}`").alias("value"), F.col(ROW_ID).alias("row_id"))
    members = join_counted(rows, bad.select("value", "n"), "value", "n", hot_rows, written=True).select(
        key.alias("issue_id"), "row_id", F.col("value").cast("string").alias("value")
    )
    totals = bad.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).where("kinds > 0")
    shown = bad.orderBy("first_row").limit(10).agg(
        F.array_sort(F.collect_list(F.struct("first_row", F.col("value").cast("string").alias("v")))).alias("shown")
    )
    # Both sides are single rows.
    issue = totals.withColumn("issue_id", key).join(
        F.broadcast(shown.withColumn("issue_id", key)), "issue_id"
    )
    issue = issue.join(F.broadcast(sample_values(members, 10)), "issue_id", "left")
    text = (
        f"'{column}' holds codes nobody has listed: ".replace("%", "%%")
        + "%d cells with [%s%s]. Joins on the list of known codes will miss these rows."
    )
    issues = issue.select(
        "issue_id",
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(Category.REFERENTIAL_INTEGRITY.value).alias("category"),
        F.lit(Severity.HIGH.value).alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.format_string(
            text,
            "n",
            F.array_join(F.transform("shown", lambda s: s["v"]), ", "),
            F.when(F.col("kinds") > 10, ", ...").otherwise(""),
        ).alias("description"),
        F.array(F.lit(column)).alias("affected_columns"),
        F.col("n").alias("affected_row_count"),
        "sample_values",
        F.lit("FLAG_ONLY").alias("action_type"),
        F.lit(column).alias("target_column"),
        F.lit(
            "The right value cannot be inferred. Map each invalid entry to a reference value."
        ).alias("rationale"),
    )
    return findings(issues, members.withColumn("role", F.lit(Role.TARGET.value)))
