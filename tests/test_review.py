import pytest
from pyspark.sql import functions as F

from plumbline.model import as_issues
from plumbline.plans import review, scorecard

FIELDS = "issue_id string, category string, severity string, status string, confidence double, action_type string, affected_row_count long"
ISSUES = [
    ("a", "DEDUPLICATION", "HIGH", "OPEN", 0.99, "MERGE_ROWS", 2),
    ("b", "FORMAT_VALIDITY", "MEDIUM", "OPEN", 0.97, "SET_VALUE", 1),
    ("c", "FORMAT_VALIDITY", "MEDIUM", "PENDING_APPROVAL", 0.80, "SET_VALUE", 1),
    ("d", "COMPLETENESS", "CRITICAL", "OPEN", 1.0, "FLAG_ONLY", 3),
    ("e", "OUTLIER", "LOW", "EXECUTED", 1.0, "FLAG_ONLY", 1),
]


@pytest.fixture(scope="module")
def issues(spark):
    base = spark.createDataFrame(ISSUES, FIELDS)
    return as_issues(base.withColumn("dataset_id", F.lit("d")).withColumn("description", F.repeat(F.lit("x"), 130)))


def decide(spark, issues, *decisions):
    rows = [(i, d, actor, role, note, t) for t, (i, d, actor, role, note) in enumerate(decisions)]
    table = spark.createDataFrame(rows, "issue_id string, decision string, actor string, actor_role string, note string, t int")
    table = table.withColumn("decided_at", F.timestamp_seconds("t")).drop("t")
    updated, outcomes, audit = review.review(issues, table)
    return (
        {r.issue_id: r for r in updated.collect()},
        [(r.issue_id, r.decision, r.accepted, r.reason) for r in outcomes.orderBy("decided_at").collect()],
        audit.collect(),
    )


def test_roles_and_states(spark, issues):
    state, outcome, audit = decide(
        spark,
        issues,
        ("a", "APPROVE", "ann", "analyst", ""),
        ("a", "APPROVE", "sue", " Senior Analyst ", "fine"),
        ("a", "APPROVE", "adm", "admin", "again"),
        ("b", "APPROVE", "ann", "analyst", ""),
        ("b", "REJECT", "bob", "analyst", "no"),
        ("b", "APPROVE", "sue", "admin", ""),
        ("c", "REJECT", "vic", "viewer", ""),
        ("e", "APPROVE", "ann", "analyst", ""),
        ("zzz", "APPROVE", "ann", "admin", ""),
        ("c", "APPROVE", "ann", None, ""),
    )
    assert (state["a"].status, state["a"].approved_by, state["a"].reviewer_note) == ("APPROVED", "sue", "fine")
    assert (state["b"].status, state["b"].approved_by, state["b"].rejected_by, state["b"].reviewer_note) == ("REJECTED", "ann", "bob", "no")
    assert (state["c"].status, state["c"].approved_by) == ("APPROVED", "ann")
    assert state["d"].status == "OPEN" and state["e"].status == "EXECUTED"
    assert [(i, ok) for i, _, ok, _ in outcome] == [
        ("a", False), ("a", True), ("a", False), ("b", True), ("b", True), ("b", False),
        ("c", False), ("e", False), ("zzz", False), ("c", True),
    ]
    assert {r for *_, ok, r in outcome if not ok} == {"role too low", "issue is not open", "unknown issue"}
    assert [(r.issue_id, r.actor, r.success, r.notes) for r in audit] == [("b", "bob", False, "REJECTED. no")]


def test_bulk_approval(issues):
    state = {r.issue_id: r for r in review.bulk_approve(issues, "sue", "senior analyst").collect()}
    assert {k for k, r in state.items() if r.status == "APPROVED"} == {"b", "d"}
    assert state["b"].approved_by == "sue" and state["b"].approved_at is not None
    with pytest.raises(PermissionError):
        review.bulk_approve(issues, "ann", "analyst")


def test_lists_and_detail(issues):
    assert {r.issue_id for r in review.list_issues(issues, status="open", category="deduplication").collect()} == {"a"}
    row = review.list_issues(issues, severity=["CRITICAL"], short=True).first()
    assert (row.is_actionable, row.can_bulk_approve, len(row.description)) == (False, True, 123)
    assert review.get_issue(issues, "b").first().is_actionable


def test_counts_and_checklist(issues):
    c = review.review_counts(issues).first()
    assert (c.total, c.open, c.executed, c.critical_high, c.low_medium) == (5, 3, 1, 2, 3)
    k = review.export_checklist(issues).first()
    assert tuple(k) == (1, 0, 1, 0)


def test_registry(issues):
    newer = issues.where("issue_id = 'a'").withColumn("status", F.lit("REJECTED"))
    merged = {r.issue_id: r.status for r in review.merge_registry(issues, newer).collect()}
    assert len(merged) == 5 and merged["a"] == "REJECTED" and merged["b"] == "OPEN"


def test_scorecard(spark, issues):
    rows = [("a", 1), ("a", 2), ("d", 2), ("d", 3), ("d", 4), ("b", 9), ("c", 9), ("e", 5)]
    listed = spark.createDataFrame(rows, "issue_id string, row_id long")
    card = scorecard.scorecard(issues, listed, 10).first()
    assert (card.overall_score, card.rows_with_issues, card.label) == (60.0, 4, "Critical")
    assert (card.critical, card.high, card.medium, card.low, card.open, card.pending_approval) == (1, 1, 2, 1, 3, 1)
    assert "4 row(s) (40%)" in card.interpretation
    empty = scorecard.scorecard(issues.limit(0), listed.limit(0), 0).first()
    assert (empty.overall_score, empty.total_issues, empty.open) == (100.0, 0, 0)
    table = [tuple(r) for r in scorecard.category_table(issues, listed).collect()]
    assert table[0] == ("FORMAT_VALIDITY", 2, 0, 1, 0.0)
    assert ("DEDUPLICATION", 1, 1, 2, 100.0) in table


@pytest.mark.parametrize("score,label,colour", [(95.0, "Excellent", "green"), (85.0, "Good", "amber"), (70.0, "Needs Attention", "amber"), (69.9, "Critical", "red")])
def test_labels(spark, score, label, colour):
    row = spark.range(1).select(scorecard.score_label(F.lit(score)), scorecard.score_colour(F.lit(score))).first()
    assert tuple(row) == (label, colour)


def test_audit_reports(spark):
    audit = spark.createDataFrame(
        [("1", "a", "SET_VALUE", "ann", True), ("2", "b", "DROP_ROW", "bob", False), ("3", "b", "SET_VALUE", "ann", True)],
        "entry_id string, issue_id string, action_type string, actor string, success boolean",
    ).withColumn("ts", F.timestamp_seconds(F.col("entry_id").cast("int")))
    s = scorecard.audit_summary(audit).first()
    assert tuple(s) == (3, 2, 1, 2, ["DROP_ROW", "SET_VALUE"])
    assert [r.entry_id for r in scorecard.audit_newest_first(audit).collect()] == ["3", "2", "1"]
    assert scorecard.audit_filter(audit, ["SET_VALUE"], True, "ann", issue_id="b").count() == 1
