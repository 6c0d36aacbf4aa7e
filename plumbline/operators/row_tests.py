"""Checks that look at one row at a time, all evaluated in a single pass.

Completeness, formats, outliers and domain rules reduce to a condition per row. Any number
of them share one aggregation over the scan (counts and extra measures, one output row),
and one map-only pass that lists failing rows. Nothing is shuffled but the final counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import (
    ROW_ID,
    Action,
    Category,
    Findings,
    Role,
    Severity,
    findings,
    issue_id_text,
)
from plumbline.operators.samples import sample_values


@dataclass(frozen=True)
class RowTest:
    category: Category
    key: str  # distinguishes tests of one category
    column: str
    failing: Column  # true on a failing row; null counts as false
    description: Callable[[dict[str, Column]], Column]  # of n, total, samples and extras
    rationale: str
    confidence: float = 1.0
    severity: Severity | Callable[[Column, Column], Column] = Severity.MEDIUM
    action: Action = Action.FLAG_ONLY
    canonical_value: str | None = None
    samples: int = 5
    extras: dict[str, Column] = field(default_factory=dict)  # more aggregates


def failing_rows(df: DataFrame, tests: list[RowTest], dataset_id: str) -> DataFrame:
    """(issue_id, row_id, value) of every failing row, without a shuffle."""
    marks = [
        F.when(
            t.failing,
            F.struct(
                F.lit(issue_id_text(dataset_id, t.category, t.key)).alias("issue_id"),
                F.col(f"`{t.column}`").cast("string").alias("value"),
            ),
        )
        for t in tests
    ]
    hits = df.select(
        F.col(ROW_ID).alias("row_id"), F.explode(F.array_compact(F.array(*marks))).alias("hit")
    )
    return hits.select("hit.issue_id", "row_id", "hit.value")


def failure_counts(df: DataFrame, tests: list[RowTest]) -> DataFrame:
    """One row: the row count, and per test its failing rows and extra measures."""
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(tests):
        aggregates.append(F.count_if(t.failing).alias(f"n{i}"))
        aggregates += [x.alias(f"x{i}_{name}") for name, x in t.extras.items()]
    return df.agg(*aggregates)


def evaluate(df: DataFrame, tests: list[RowTest], dataset_id: str) -> Findings:
    rows = failing_rows(df, tests, dataset_id)
    counted = failure_counts(df, tests).selectExpr("total", _unpivot(tests))
    # The fixed fields of the tests: as many rows as the configuration has tests.
    fixed = df.sparkSession.createDataFrame(
        [
            (
                i,
                issue_id_text(dataset_id, t.category, t.key),
                dataset_id,
                t.category.value,
                None if callable(t.severity) else t.severity.value,
                float(t.confidence),
                [t.column],
                t.samples,
                t.action.value,
                t.column,
                t.canonical_value,
                t.rationale,
            )
            for i, t in enumerate(tests)
        ],
        "test int, issue_id string, dataset_id string, category string, severity string, "
        "confidence double, affected_columns array<string>, k int, action_type string, "
        "target_column string, canonical_value string, rationale string",
    )
    samples = sample_values(rows, max(t.samples for t in tests))
    joined = (
        counted.where("n > 0")
        .join(F.broadcast(fixed), "test")
        .join(F.broadcast(samples), "issue_id", "left")
        .withColumn("sample_values", F.expr("slice(sample_values, 1, k)"))
    )
    issues = joined.withColumns(
        {
            "severity": _severity(tests),
            "description": _description(tests),
            "affected_row_count": F.col("n"),
        }
    )
    return findings(issues, rows.withColumn("role", F.lit(Role.TARGET.value)))


def _unpivot(tests: list[RowTest]) -> str:
    """The one row of counts as one row per test."""
    parts = []
    for i, t in enumerate(tests):
        extras = ", ".join(f"CAST(x{i}_{name} AS DOUBLE)" for name in t.extras)
        parts.append(f"{i}, n{i}, CAST(array({extras}) AS ARRAY<DOUBLE>)")
    return f"stack({len(tests)}, {', '.join(parts)}) AS (test, n, extras)"


def _severity(tests: list[RowTest]) -> Column:
    out = F.col("severity")
    for rule in {t.severity for t in tests if callable(t.severity)}:
        of_rule = [i for i, t in enumerate(tests) if t.severity is rule]
        out = F.when(F.col("test").isin(of_rule), rule(F.col("n"), F.col("total"))).otherwise(out)
    return out


def _description(tests: list[RowTest]) -> Column:
    out = None
    measures = {"n": F.col("n"), "total": F.col("total"), "samples": F.col("sample_values")}
    for i, t in enumerate(tests):
        extras = {name: F.col("extras")[k] for k, name in enumerate(t.extras)}
        text = t.description(measures | extras)
        mine = F.col("test") == i
        out = F.when(mine, text) if out is None else out.when(mine, text)
    return out
