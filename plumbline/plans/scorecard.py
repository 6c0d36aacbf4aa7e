"""Scorecard, category table and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import Severity, Status
from plumbline.skew import join_counted, with_row_counts

_SERIOUS = ("HIGH", "CRITICAL")


def _row_categories(issues: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """(category, row_id, serious): distinct affected rows per category.

    Rows are counted per issue first, so one that covers a third of the table is joined without
    shuffling its rows.
    """
    kinds = issues.select("issue_id", "category", F.col("severity").isin(*_SERIOUS).alias("serious"))
    kinds = with_row_counts(kinds, issue_rows, "n")
    rows = join_counted(issue_rows.select("issue_id", "row_id"), kinds, "issue_id", "n")
    return rows.groupBy("row_id", "category").agg(F.max("serious").alias("serious"))


def category_table(issues: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Per category: issues, high and critical ones, distinct rows, share of the serious."""
    counts = issues.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity").isin(*_SERIOUS)).alias("high_critical_issues"),
    )
    rows = _row_categories(issues, issue_rows).groupBy("category").agg(
        F.count(F.lit(1)).alias("affected_row_count")
    )
    share = F.col("high_critical_issues") * 100 / F.col("total_issues")
    return (
        counts.join(rows, "category", "left")
        .withColumn("affected_row_count", F.coalesce("affected_row_count", F.lit(0)))
        .withColumn("high_critical_share", share)
        .orderBy(F.desc("total_issues"), "category")
    )


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 95, "Excellent")
        .when(score >= 85, "Good")
        .when(score >= 70, "Needs Attention")
        .otherwise("Critical")
    )


def score_colour(score: Column) -> Column:
    return F.when(score >= 90, "green").when(score >= 70, "amber").otherwise("red")


def interpretation(score: Column, bad: Column, total: Column) -> Column:
    """What the score means for whoever loads the table next."""
    share = bad * 100 / F.greatest(total, F.lit(1))
    rows = F.format_string("%d row(s) (%.0f%%)", bad.cast("long"), share.cast("double"))
    verdict = (
        F.when(score >= 95, F.lit("safe to load"))
        .when(score >= 80, F.concat(F.lit("loadable once someone has looked at "), rows))
        .when(score >= 60, F.concat(F.lit("repair first; serious findings touch "), rows))
        .otherwise(F.concat(F.lit("keep out of other systems; serious findings touch "), rows))
    )
    return F.concat(F.format_string("%.0f of 100 points: ", score), verdict, F.lit("."))


def confidence_band(confidence: Column) -> Column:
    percent = F.floor(confidence * 100)
    return F.when(percent >= 88, "high").when(percent >= 72, "medium").otherwise("low")


def scorecard(issues: DataFrame, issue_rows: DataFrame, total_rows: int | Column) -> DataFrame:
    """One row: share of rows without a HIGH or CRITICAL issue, and all counts.

    Every status counts, so fixing an issue does not move the score of the ingested table.
    """
    total = total_rows if isinstance(total_rows, Column) else F.lit(total_rows).cast("long")
    bad = (
        _row_categories(issues, issue_rows).where("serious").select("row_id").distinct()
        .agg(F.count(F.lit(1)).alias("rows_with_issues"))
    )
    severity = [F.count_if(F.col("severity") == s.value).alias(s.value.lower()) for s in reversed(Severity)]
    status = [F.count_if(F.col("status") == s.value).alias(s.value.lower()) for s in Status]
    counts = issues.agg(F.count(F.lit(1)).alias("total_issues"), *severity, *status)
    one = F.lit(1).alias("_one")
    card = counts.select("*", one).join(F.broadcast(bad.select("*", one)), "_one").drop("_one")
    clean = F.greatest(total - F.col("rows_with_issues"), F.lit(0))
    score = F.when(total > 0, F.round(clean * 100 / total, 1)).otherwise(100.0)
    card = card.withColumns({"total_rows": total, "overall_score": score})
    return card.withColumns(
        {
            "label": score_label(F.col("overall_score")),
            "interpretation": interpretation(
                F.col("overall_score"), F.col("rows_with_issues"), F.col("total_rows")
            ),
        }
    )


# --- audit reports -----------------------------------------------------------------------


def audit_filter(
    audit: DataFrame,
    actions: list[str] | None = None,
    success: bool | None = None,
    actor: str | None = None,
    dataset_id: str | None = None,
    issue_id: str | None = None,
) -> DataFrame:
    out = audit
    if actions:
        out = out.where(F.col("action_type").isin(actions))
    for name, value in (("success", success), ("actor", actor), ("dataset_id", dataset_id), ("issue_id", issue_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def audit_newest_first(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("ts"), "entry_id")


def audit_summary(audit: DataFrame) -> DataFrame:
    """Entries, outcomes, actors; the set of action types has at most nine members."""
    return audit.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.count_distinct("actor").alias("actors"),
        F.array_sort(F.collect_set("action_type")).alias("action_types"),
    )
