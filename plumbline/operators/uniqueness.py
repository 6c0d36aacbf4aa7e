"""UNIQUENESS: rows that are identical in every column, nulls being equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.durable import materialise
from plumbline.model import ROW_ID, Action, Category, Findings, Role, Severity, findings, issue_id
from plumbline.operators.completeness import data_columns
from plumbline.skew import HOT_ROWS, join_counted


def plain_cell(df: DataFrame, column: str) -> Column:
    """The cell as text that is equal exactly for equal values (-0.0 is 0.0, NaN is null)."""
    cell, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        cell = F.when(~F.isnan(cell), cell + F.lit(0.0))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(cell)
    return F.hex(cell) if isinstance(kind, T.BinaryType) else cell.cast("string")


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over an unambiguous encoding of the cells, as 32 bytes.

    Grouping by the digest keeps wide rows out of the shuffle. Null differs from every value.
    """
    parts = []
    for c in columns:
        cell = plain_cell(df, c)
        sized = F.concat(F.length(cell).cast("string"), F.lit(":"), cell)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, row_id) of all rows, and (digest, n, retain_id, first_value) of groups with n > 1.

    ``first_value`` is the first column's value, which all rows of a group share.

    The aggregation combines copies in the map tasks, so a group that holds a third of the
    table sends one row per task.
    """
    columns = columns or data_columns(df)
    digest = row_digest(df, columns).alias("digest")
    first = plain_cell(df, columns[0]).alias("first_value")
    keyed = df.select(digest, F.col(ROW_ID).alias("row_id"), first)
    groups = (
        keyed.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row_id").alias("retain_id"),
            F.min("first_value").alias("first_value"),
        )
        .where("n > 1")
    )
    return keyed.drop("first_value"), groups


def check_uniqueness(
    df: DataFrame,
    dataset_id: str,
    columns: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> Findings:
    columns = columns or data_columns(df)
    rows, groups = duplicate_groups(df, columns)
    groups = materialise(groups, "duplicate-groups")  # read by both results
    key = issue_id(dataset_id, Category.UNIQUENESS, F.lower(F.hex("digest")))
    issues = groups.select(
        key.alias("issue_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(Category.UNIQUENESS.value).alias("category"),
        F.lit(Severity.HIGH.value).alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.format_string(
            "A group of %d rows has equal values in every column; row %d comes first.",
            "n",
            "retain_id",
        ).alias("description"),
        F.array(*[F.lit(c) for c in columns]).alias("affected_columns"),
        F.col("n").alias("affected_row_count"),
        F.array("first_value").alias("sample_values"),
        F.lit(Action.MERGE_ROWS.value).alias("action_type"),
        F.format_string(
            "One of %d equal rows is enough; the fix keeps row %d.",
            "n",
            "retain_id",
        ).alias("rationale"),
    )
    members = join_counted(rows, groups.drop("first_value"), "digest", "n", hot_rows, written=True)
    role = F.when(F.col("row_id") == F.col("retain_id"), Role.RETAIN.value).otherwise(
        Role.RETIRE.value
    )
    return findings(issues, members.select(key.alias("issue_id"), "row_id", role.alias("role")))
