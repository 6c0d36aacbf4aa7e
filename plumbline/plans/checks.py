"""The check runner: chosen categories over one table, one set of findings."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import (
    ISSUE_ROWS,
    ISSUES,
    OUTLIER_SIGMA,
    ROW_ID,
    Category,
    DomainRule,
    Findings,
    Severity,
    findings,
    issue_id,
)
from plumbline.operators.completeness import completeness_tests
from plumbline.operators.consistency import check_consistency
from plumbline.operators.formats import format_tests
from plumbline.operators.fuzzy import check_deduplication
from plumbline.operators.outliers import outlier_tests
from plumbline.operators.reference import check_reference
from plumbline.operators.row_tests import evaluate
from plumbline.operators.rules import rule_tests
from plumbline.operators.uniqueness import check_uniqueness

log = logging.getLogger(__name__)

# Run by default; REFERENTIAL_INTEGRITY joins them when reference sets are given.
DEFAULT_CATEGORIES = (
    Category.COMPLETENESS,
    Category.UNIQUENESS,
    Category.DEDUPLICATION,
    Category.FORMAT_VALIDITY,
    Category.CONSISTENCY,
    Category.OUTLIER,
    Category.DOMAIN_RULE,
)


@dataclass(frozen=True)
class CheckConfig:
    required_columns: list[str] | None = None
    reference_sets: dict[str, DataFrame | Iterable] = field(default_factory=dict)
    consistency_checks: list[tuple[list[str], str]] = field(default_factory=list)
    domain_rules: list[DomainRule] = field(default_factory=list)
    fuzzy_columns: list[str] | None = None
    unique_columns: list[str] | None = None
    date_formats: list[str] | None = None
    outlier_sigma: float = OUTLIER_SIGMA


def resolve_categories(names: list[str] | None, reference_sets: dict) -> list[Category]:
    if names is None:
        extra = [Category.REFERENTIAL_INTEGRITY] if reference_sets else []
        return [*DEFAULT_CATEGORIES, *extra]
    known = {c.value: c for c in Category}
    for name in names:
        if name.upper() not in known:
            log.warning("unknown category %r skipped", name)
    return [known[n.upper()] for n in names if n.upper() in known]


def run_quality_checks(
    df: DataFrame,
    dataset_id: str,
    categories: list[str] | None = None,
    config: CheckConfig | None = None,
) -> Findings:
    """Check ``df`` (which carries a row id column) and return lazy findings.

    All row-wise categories share one scan. A category that cannot be planned is reported
    as one LOW issue and does not stop the others.
    """
    if ROW_ID not in df.columns:
        raise ValueError(f"the table needs a {ROW_ID} column; see plumbline.sources.rowid")
    config = config or CheckConfig()
    row_wise = {
        Category.COMPLETENESS: lambda: completeness_tests(df, config.required_columns),
        Category.FORMAT_VALIDITY: lambda: format_tests(df, config.date_formats),
        Category.OUTLIER: lambda: outlier_tests(df, config.outlier_sigma),
        Category.DOMAIN_RULE: lambda: rule_tests(df, config.domain_rules),
    }
    grouped = {
        Category.UNIQUENESS: lambda: check_uniqueness(df, dataset_id, config.unique_columns),
        Category.DEDUPLICATION: lambda: check_deduplication(df, dataset_id, config.fuzzy_columns),
        Category.CONSISTENCY: lambda: check_consistency(df, dataset_id, config.consistency_checks),
        Category.REFERENTIAL_INTEGRITY: lambda: check_reference(
            df, dataset_id, config.reference_sets
        ),
    }
    tests, parts = [], []
    for category in resolve_categories(categories, config.reference_sets):
        try:
            if category in row_wise:
                planned = row_wise[category]()
                for test in planned:
                    df.select(test.failing).schema  # noqa: B018 - analysis finds bad rules
                tests += planned
            else:
                part = grouped[category]()
                if part is not None:
                    parts.append(part)
        except (PySparkException, ValueError, TypeError) as error:
            log.exception("%s checks failed", category.value)
            parts.append(system_issue(df, dataset_id, category, str(error)))
    if tests:
        parts.insert(0, evaluate(df, tests, dataset_id))
    if not parts:
        spark = df.sparkSession
        return findings(
            spark.createDataFrame([], ISSUES), spark.createDataFrame([], ISSUE_ROWS)
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def system_issue(df: DataFrame, dataset_id: str, category: Category, error: str) -> Findings:
    spark = df.sparkSession
    one = spark.range(1).select(
        issue_id(dataset_id, category, "system").alias("issue_id"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(category.value).alias("category"),
        F.lit(Severity.LOW.value).alias("severity"),
        F.lit(1.0).alias("confidence"),
        F.lit(
            f"{category.value} was not checked; the other categories were. Spark says: {error[:200]}"
        ).alias("description"),
        F.array().cast("array<string>").alias("affected_columns"),
        F.lit(0).cast("long").alias("affected_row_count"),
        F.lit("FLAG_ONLY").alias("action_type"),
        F.lit("The check itself has to be mended.").alias("rationale"),
    )
    return findings(one, spark.createDataFrame([], ISSUE_ROWS))


def report(issues: DataFrame) -> DataFrame:
    """One row of totals per severity."""
    return issues.agg(
        F.count(F.lit(1)).alias("total_count"),
        *[
            F.count_if(F.col("severity") == s.value).alias(f"{s.value.lower()}_count")
            for s in reversed(Severity)
        ],
    )


def report_by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("issues")).orderBy("category")


def summary_text(issues: DataFrame, dataset_id: str) -> str:
    """The report as text; only the totals come to the driver."""
    totals = report(issues).first()
    levels = [(s.value, totals[f"{s.value.lower()}_count"]) for s in reversed(Severity)]
    by_category = report_by_category(issues).collect()  # at most eight rows
    parts = [f"{dataset_id}: {totals.total_count} findings"]
    parts += [f"{name.lower()} {n}" for name, n in levels if n]
    parts += [f"{r.category.lower()} {r.issues}" for r in by_category]
    return "; ".join(parts)
