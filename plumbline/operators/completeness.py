"""COMPLETENESS: null or blank cells per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import is_blank
from plumbline.model import ROW_ID, Category, Severity
from plumbline.operators.row_tests import RowTest


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def is_string(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def missing(df: DataFrame, column: str) -> Column:
    """True where the cell is null, or blank in a text column."""
    cell = F.col(f"`{column}`")
    if is_string(df, column):
        return cell.isNull() | is_blank(cell)
    return cell.isNull()


def severity_of_share(n: Column, total: Column) -> Column:
    share = n * 100 / total
    return (
        F.when(share > 50, Severity.CRITICAL.value)
        .when(share > 20, Severity.HIGH.value)
        .when(share > 5, Severity.MEDIUM.value)
        .otherwise(Severity.LOW.value)
    )


def completeness_tests(df: DataFrame, required: list[str] | None = None) -> list[RowTest]:
    columns = data_columns(df) if required is None else required

    def describe(name: str):
        return lambda m: F.format_string(
            f"'{name}' has no value in %d row(s), %.1f%% of all.",
            m["n"],
            m["n"] * 100 / m["total"],
        )

    return [
        RowTest(
            category=Category.COMPLETENESS,
            key=c,
            column=c,
            failing=missing(df, c),
            severity=severity_of_share,
            description=describe(c.replace("%", "%%")),
            rationale="Nothing in the table says what belongs here.",
            samples=10,
        )
        for c in columns
        if c in data_columns(df)
    ]
