"""Review workflow: decisions joined to issues, lists, counts and checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import AUDIT, BULK_APPROVE_THRESHOLD, ROLE_RANKS, Action, Category, Status, conform, plan_time
from plumbline.plans.cleanse import audit_id

_OPEN = (Status.OPEN.value, Status.PENDING_APPROVAL.value)
_SERIOUS = ("HIGH", "CRITICAL")


def role_rank(role: Column) -> Column:
    name = F.lower(F.trim(role))
    out = F.lit(-1)
    for known, rank in ROLE_RANKS.items():
        out = F.when(name == known, rank).otherwise(out)
    return out


def is_actionable() -> Column:
    action = F.col("action_type")
    return action.isNotNull() & (action != Action.FLAG_ONLY.value)


def can_bulk_approve(threshold: float = BULK_APPROVE_THRESHOLD) -> Column:
    """Merges always need a person, whatever their confidence."""
    merges = F.col("category").isin(Category.DEDUPLICATION.value, Category.UNIQUENESS.value)
    return ~merges & (F.col("confidence") >= threshold)


def review(issues: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply decisions; return (issues, outcome per decision, audit entries of rejections).

    ``decisions(issue_id, decision, actor, actor_role, note, decided_at)`` with decision
    APPROVE or REJECT, taking effect in time order. An approval needs an open issue and, for
    HIGH and CRITICAL, a senior analyst; a rejection needs an analyst and may come at any
    time. So per issue the first valid approval before any rejection counts, and the last
    rejection has the final word: two aggregates, no replay.
    """
    known = issues.select("issue_id", "severity", "status", "dataset_id", "action_type", "affected_columns", "affected_row_count")
    # Decisions are made by people, one or a few per issue.
    seen = decisions.join(known, "issue_id", "left")
    need = F.when(F.col("severity").isin(*_SERIOUS), ROLE_RANKS["senior analyst"]).otherwise(
        ROLE_RANKS["analyst"]
    )
    rank = role_rank(F.coalesce("actor_role", F.lit("analyst")))
    approve, reject = F.col("decision") == "APPROVE", F.col("decision") == "REJECT"
    fault = (
        F.when(F.col("severity").isNull(), "unknown issue")
        .when(~(approve | reject), "unknown decision")
        .when(approve & (rank < need), "role too low")
        .when(reject & (rank < ROLE_RANKS["analyst"]), "role too low")
    )
    seen = seen.withColumn("fault", fault)
    at = F.struct("decided_at", "actor")
    valid = F.col("fault").isNull()
    firsts = seen.groupBy("issue_id").agg(
        F.min(F.when(valid & reject, at)).alias("first_reject"),
        F.min(F.when(valid & approve & F.col("status").isin(*_OPEN), at)).alias("first_approve"),
        F.max_by(F.struct("decided_at", "actor", "note"), F.when(valid & reject, at)).alias("last_reject"),
        F.min_by(F.struct("decided_at", "actor", "note"), F.when(valid & approve & F.col("status").isin(*_OPEN), at)).alias("approval"),
    )
    early = F.col("first_reject").isNull() | (F.col("first_approve") < F.col("first_reject"))
    firsts = firsts.withColumn("approved", F.col("first_approve").isNotNull() & early)

    judged = seen.join(firsts.select("issue_id", "first_reject", "first_approve", "approved"), "issue_id")
    late = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(reject, F.lit(None))
        .when(~F.col("approved") | (at != F.col("first_approve")), "issue is not open")
    )
    outcomes = judged.withColumn("fault", late).select(
        "issue_id",
        "decision",
        "actor",
        "decided_at",
        F.col("fault").isNull().alias("accepted"),
        F.col("fault").alias("reason"),
    )

    rejected = F.col("last_reject").isNotNull()
    approved = F.coalesce("approved", F.lit(False))
    ok_note = F.nullif(F.col("approval.note"), F.lit(""))
    updated = issues.join(firsts, "issue_id", "left").withColumns(
        {
            "status": F.when(rejected, Status.REJECTED.value)
            .when(approved, Status.APPROVED.value)
            .otherwise(F.col("status")),
            "approved_by": F.when(approved, F.col("approval.actor")).otherwise(F.col("approved_by")),
            "approved_at": F.when(approved, F.col("approval.decided_at")).otherwise(F.col("approved_at")),
            "rejected_by": F.when(rejected, F.col("last_reject.actor")).otherwise(F.col("rejected_by")),
            "rejected_at": F.when(rejected, F.col("last_reject.decided_at")).otherwise(F.col("rejected_at")),
            "reviewer_note": F.when(rejected, F.coalesce(F.col("last_reject.note"), F.lit("")))
            .when(approved, F.coalesce(ok_note, F.col("reviewer_note")))
            .otherwise(F.col("reviewer_note")),
        }
    )
    rejections = seen.where(valid & reject).select(
        audit_id(F.lit("reject"), F.col("issue_id"), F.col("decided_at").cast("string"), F.col("actor")).alias("entry_id"),
        F.col("decided_at").alias("ts"),
        "dataset_id",
        "issue_id",
        F.coalesce("action_type", F.lit("NONE")).alias("action_type"),
        "actor",
        "actor_role",
        "affected_columns",
        "affected_row_count",
        F.lit(False).alias("success"),
        F.trim(F.concat(F.lit("REJECTED. "), F.coalesce("note", F.lit("")))).alias("notes"),
    )
    return updated.select(*issues.columns), outcomes, conform(rejections, AUDIT)


def bulk_approve(
    issues: DataFrame,
    actor: str,
    actor_role: str,
    threshold: float = BULK_APPROVE_THRESHOLD,
    at: Column | None = None,
) -> DataFrame:
    """Approve every open, eligible issue at once; a senior analyst's right."""
    if ROLE_RANKS.get(actor_role.lower().strip(), -1) < ROLE_RANKS["senior analyst"]:
        raise PermissionError(f"role '{actor_role}' may not approve in bulk")
    hit = F.col("status").isin(*_OPEN) & can_bulk_approve(threshold)
    return issues.withColumns(
        {
            "approved_by": F.when(hit, F.lit(actor)).otherwise(F.col("approved_by")),
            "approved_at": F.when(hit, plan_time() if at is None else at).otherwise(
                F.col("approved_at")
            ),
            "status": F.when(hit, Status.APPROVED.value).otherwise(F.col("status")),
        }
    )


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Issues of a later run replace those with the same id."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("_run")))
    return both.withColumn("_latest", latest).where("_latest = 1").drop("_latest", "_run")


def list_issues(
    issues: DataFrame,
    status: str | None = None,
    category: str | None = None,
    severity: list[str] | None = None,
    threshold: float = BULK_APPROVE_THRESHOLD,
    short: bool = False,
) -> DataFrame:
    out = issues
    if status:
        out = out.where(F.col("status") == status.upper())
    if category:
        out = out.where(F.col("category") == category.upper())
    if severity:
        out = out.where(F.col("severity").isin(severity))
    text = F.col("description")
    if short:
        text = F.when(F.length(text) > 120, F.concat(F.left(text, F.lit(120)), F.lit("..."))).otherwise(text)
    return out.select(
        "issue_id",
        "category",
        "severity",
        "status",
        "confidence",
        text.alias("description"),
        "affected_columns",
        is_actionable().alias("is_actionable"),
        can_bulk_approve(threshold).alias("can_bulk_approve"),
    )


def get_issue(issues: DataFrame, issue_id: str) -> DataFrame:
    return issues.where(F.col("issue_id") == issue_id).withColumn("is_actionable", is_actionable())


def review_counts(issues: DataFrame) -> DataFrame:
    status, severity = F.col("status"), F.col("severity")
    return issues.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(status == s.value).alias(s.value.lower())
            for s in (Status.OPEN, Status.APPROVED, Status.REJECTED, Status.EXECUTED)
        ],
        F.count_if(severity.isin(*_SERIOUS)).alias("critical_high"),
        F.count_if(severity.isin("LOW", "MEDIUM")).alias("low_medium"),
    )


def export_checklist(issues: DataFrame) -> DataFrame:
    status = F.col("status")
    unresolved = status.isin(*_OPEN) & F.col("severity").isin(*_SERIOUS) & is_actionable()
    return issues.agg(
        F.count_if(unresolved).alias("unresolved_serious"),
        F.count_if(status == Status.APPROVED.value).alias("approved_not_executed"),
        F.count_if(status == Status.EXECUTED.value).alias("executed"),
        F.count_if(status == Status.REJECTED.value).alias("rejected"),
    )
