"""Spark side of every registered query: name -> function of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.durable import materialise, shared_dir
from plumbline.functions import text
from plumbline.model import (
    ROW_ID,
    Category,
    DatasetMeta,
    DomainRule,
    Findings,
    Severity,
    SignalConfig,
    as_issues,
    issue_id,
)
from plumbline.operators import consistency, entity, fuzzy, outliers, reference, uniqueness
from plumbline.operators.completeness import completeness_tests, severity_of_share
from plumbline.operators.components import connected_components
from plumbline.operators.formats import format_tests, unreadable_date
from plumbline.operators.row_tests import evaluate
from plumbline.operators.rules import rule_tests
from plumbline.operators.samples import first_k
from plumbline.plans import checks, cleanse, resolve, review, scorecard
from plumbline.sources.files import read_csv
from plumbline.sources.profile import profile
from plumbline.sources.rowid import with_row_id
from plumbline.sources.sinks import audit_csv, export_file
from workload import inputs

DATASET = "ds"
INSTANT = "2024-06-01 12:00:00"

SIGNALS = SignalConfig(
    name=("vendor_name",), tax_id=("tax_id",), address=("address",), zip=("zip",), phone=("phone",)
)
EXACT_SIGNALS = SignalConfig(tax_id=("tax_id",), zip=("zip",), phone=("phone",))
CUSTOMER_RULES = [
    DomainRule("c_acctbal", "c_acctbal >= 0", "Balance must not be negative.", Severity.HIGH),
    DomainRule("c_mktsegment", "c_mktsegment <> 'MACHINERY'", "Segment is retired."),
]
CUSTOMER_CHECKS = checks.CheckConfig(
    reference_sets={"c_nationkey": set(range(20))},
    consistency_checks=[(["c_nationkey"], "c_mktsegment")],
    domain_rules=CUSTOMER_RULES,
)
CUSTOMER_CATEGORIES = [
    "COMPLETENESS", "UNIQUENESS", "FORMAT_VALIDITY", "CONSISTENCY", "OUTLIER", "DOMAIN_RULE",
    "REFERENTIAL_INTEGRITY",
]

ISSUE_FIELDS = [
    "issue_id", "category", "severity", "status", "confidence", "affected_row_count",
    "action_type", "target_column", "canonical_value",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """One of the input texts over the tables of ``folder``."""
    for name in inputs.TABLES:
        if f" {name} " in f" {sql} ".replace("\n", " ").replace(")", " ) "):
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def brief(found: Findings) -> DataFrame:
    return found.issues.select(*ISSUE_FIELDS)


def instant():
    return F.lit(INSTANT).cast("timestamp")


# --- profile and row-wise checks ---------------------------------------------------------


def profile_columns(spark, folder):
    out = profile(derived(spark, folder, inputs.BLANK_PARTS))
    return out.select(
        "column", "rows", "nulls", "nullable", "unique_count",
        F.array_join("sample_values", "|").alias("samples"),
    )


def file_roundtrip(spark, folder):
    """Export to CSV in the shared folder and read it back with a schema."""
    df = derived(spark, folder, inputs.ORDER_TEXTS)
    meta = DatasetMeta(file_format="csv")
    done = export_file(df.withColumn("row", F.col(ROW_ID)), meta, shared_dir(spark), f"orders-{meta.dataset_id}.csv")
    back = read_csv(
        spark, done.destination, "total_price string, order_date string, order_priority string, row long"
    )
    return back.withColumnRenamed("row", "row_id")


def row_numbers(spark, folder):
    """Ids of a table without a key: contiguous from zero."""
    lines = with_row_id(table(spark, folder, "lineitem").select("l_orderkey", "l_quantity"))
    return lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ROW_ID).alias("low"),
        F.max(ROW_ID).alias("high"),
        F.count_distinct(ROW_ID).alias("kinds"),
        F.sum("l_orderkey").alias("keys"),
    )


def completeness_labels(spark, folder):
    df = derived(spark, folder, inputs.LABELLED)
    return brief(evaluate(df, completeness_tests(df), DATASET))


def completeness_rows(spark, folder):
    df = derived(spark, folder, inputs.LABELLED)
    return evaluate(df, completeness_tests(df), DATASET).issue_rows


def completeness_blank(spark, folder):
    df = derived(spark, folder, inputs.BLANK_PARTS)
    found = evaluate(df, completeness_tests(df), DATASET)
    return found.issues.select(*ISSUE_FIELDS, F.array_join("sample_values", "|").alias("samples"))


def completeness_required(spark, folder):
    df = derived(spark, folder, inputs.BLANK_PARTS)
    return brief(evaluate(df, completeness_tests(df, ["p_size", "no_such_column"]), DATASET))


def format_validity(spark, folder):
    df = derived(spark, folder, inputs.ORDER_TEXTS)
    return brief(evaluate(df, format_tests(df), DATASET))


def format_amount_rows(spark, folder):
    df = derived(spark, folder, inputs.ORDER_TEXTS)
    cell = F.col("total_price")
    return df.where(text.amount_is_dirty(cell)).select(
        F.col(ROW_ID).alias("row_id"),
        "total_price",
        text.amount_cleaned(cell).alias("cleaned"),
        text.amount_value(cell).alias("amount"),
    )


def format_date_rows(spark, folder):
    df = derived(spark, folder, inputs.ORDER_TEXTS)
    formats = ["yyyy-MM-dd", "MM/dd/yyyy"]
    return df.where(unreadable_date(F.col("order_date"), formats)).select(
        F.col(ROW_ID).alias("row_id"), "order_date"
    )


def outlier_events(spark, folder):
    df = derived(spark, folder, inputs.EVENTS)
    return brief(evaluate(df, outliers.outlier_tests(df), DATASET))


def outlier_rows(spark, folder):
    df = derived(spark, folder, inputs.EVENTS)
    return evaluate(df, outliers.outlier_tests(df), DATASET).issue_rows


def column_moments(spark, folder):
    df = derived(spark, folder, inputs.EVENTS)
    stats = outliers.column_moments(df, ["value"])
    return stats.select(
        F.col("n0").alias("n"), F.round("mean0", 6).alias("mean"), F.round("std0", 6).alias("std")
    )


def domain_rule(spark, folder):
    df = derived(spark, folder, inputs.CUSTOMERS)
    return brief(evaluate(df, rule_tests(df, CUSTOMER_RULES), DATASET))


def domain_rule_fix(spark, folder):
    df = derived(spark, folder, inputs.CUSTOMERS)
    rule = DomainRule("c_acctbal", lambda v: v >= 0, "No debt.", fix_value=0, python=True)
    found = evaluate(df, rule_tests(df, [rule]), DATASET)
    return found.issue_rows.join(
        F.broadcast(found.issues.select("issue_id", "action_type", "canonical_value")), "issue_id"
    )


# --- grouped checks ----------------------------------------------------------------------


def uniqueness_documents(spark, folder):
    df = derived(spark, folder, inputs.TEXTS)
    found = uniqueness.check_uniqueness(df, DATASET)
    return found.issues.select(*ISSUE_FIELDS)


def uniqueness_rows(spark, folder):
    df = derived(spark, folder, inputs.TEXTS)
    return uniqueness.check_uniqueness(df, DATASET).issue_rows


def ref_integrity(spark, folder):
    df = derived(spark, folder, inputs.CUSTOMERS)
    known = table(spark, folder, "nation").where("n_nationkey < 20").select("n_nationkey")
    return brief(reference.check_reference(df, DATASET, {"c_nationkey": known}))


def ref_integrity_rows(spark, folder):
    df = derived(spark, folder, inputs.CUSTOMERS)
    return reference.check_reference(df, DATASET, {"c_nationkey": range(20)}).issue_rows


def ref_orphans(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(ROW_ID, F.col("l_orderkey"))
    known = table(spark, folder, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey")
    bad = reference.bad_values(lines, "l_orderkey", known)
    return bad.select("value", "n")


def consistency_part(spark, folder):
    df = derived(spark, folder, inputs.PARTS)
    return brief(consistency.check_consistency(df, DATASET, [(["p_name"], "p_brand"), (["p_brand", "p_type"], "p_size")]))


def consistency_rows(spark, folder):
    df = derived(spark, folder, inputs.PARTS)
    return consistency.check_consistency(df, DATASET, [(["p_brand", "p_type"], "p_size")]).issue_rows


# --- fuzzy -------------------------------------------------------------------------------


def fuzzy_dedup(spark, folder):
    df = derived(spark, folder, inputs.MIXED_CASE_PARTS)
    found = fuzzy.check_deduplication(df, DATASET, ["p_name"])
    return found.issues.select(
        F.col("sample_values")[0].alias("a"),
        F.col("sample_values")[1].alias("b"),
        "severity",
        "confidence",
        "action_type",
        "canonical_value",
        "affected_row_count",
    )


def fuzzy_exact_norm(spark, folder):
    values = materialise(fuzzy.column_values(derived(spark, folder, inputs.MIXED_CASE_PARTS), "p_name"), "values")
    pairs = fuzzy.fuzzy_pairs(values, 100.0)
    same = text.fold(F.col("a")) == text.fold(F.col("b"))
    return pairs.where(same).select("a", "b", "n_a", "n_b")


def fuzzy_rows(spark, folder):
    found = fuzzy.check_deduplication(derived(spark, folder, inputs.MIXED_CASE_PARTS), DATASET, ["p_name"])
    return found.issue_rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("distinct_rows"))


def canonical_form(spark, folder):
    df = table(spark, folder, "documents")
    return df.select(
        "doc_id", text.canonical_form(F.col("text"), F.col("source")).alias("canonical")
    )


def pair_dedup(spark, folder):
    df = table(spark, folder, "lineitem")
    low, high = F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")
    return df.select(low.alias("low"), high.alias("high")).dropDuplicates()


def topk_samples(spark, folder):
    df = table(spark, folder, "events").select("event_type", "event_id", "value")
    return first_k(df, "event_type", "event_id", 5)


# --- entity resolution -------------------------------------------------------------------


def normalise_signals(spark, folder):
    rows = entity.signal_rows(derived(spark, folder, inputs.VENDORS), SIGNALS)
    return rows.select("row_id", "filled", *SIGNALS.active())


def _profiles(spark, folder, config):
    rows = entity.signal_rows(derived(spark, folder, inputs.VENDORS), config)
    return materialise(entity.profiles_of(rows, config.active()), "profiles")


def er_exact_signals(spark, folder):
    return entity.scored_links(_profiles(spark, folder, EXACT_SIGNALS), EXACT_SIGNALS)


def er_components(spark, folder):
    return connected_components(derived(spark, folder, inputs.CHAINS).where("b IS NOT NULL"))


def er_canonical(spark, folder):
    df = derived(spark, folder, inputs.VENDORS)
    rows = entity.signal_rows(df, SIGNALS)
    members = rows.select("row_id", "filled", (F.col("row_id") % 100_000_000).alias("cluster"))
    elected = resolve.elect(members)
    roles = members.join(elected, "cluster").select(
        "row_id", "cluster", (F.col("row_id") == F.col("retain_id")).alias("is_retained")
    )
    return resolve.canonical_records(df, roles)


def er_elect(spark, folder):
    rows = entity.signal_rows(derived(spark, folder, inputs.VENDORS), SIGNALS)
    return resolve.elect(rows.select("row_id", "filled", (F.col("row_id") % 100_000_000).alias("cluster")))


def er_exact_clusters(spark, folder):
    df = derived(spark, folder, inputs.VENDORS)
    out = resolve.resolve_entities(df, DATASET, EXACT_SIGNALS)
    return out.clusters.select("cluster", "retain_id", "size", "confidence")


def er_exact_counters(spark, folder):
    df = derived(spark, folder, inputs.VENDORS)
    out = resolve.resolve_entities(df, DATASET, EXACT_SIGNALS)
    return out.counters.select(
        F.col("row_pairs").cast("long").alias("row_pairs"),
        F.col("links").cast("long").alias("links"),
        "clusters", "merge_clusters", "review_clusters",
    )


def er_scored(spark, folder):
    rows = entity.signal_rows(derived(spark, folder, inputs.SUPPLIER_VENDORS), SIGNALS)
    return entity.scored_links(materialise(entity.profiles_of(rows, SIGNALS.active()), "profiles"), SIGNALS)


def er_full(spark, folder):
    out = resolve.resolve_entities(derived(spark, folder, inputs.SUPPLIER_VENDORS), DATASET, SIGNALS)
    return out.clusters.select("cluster", "retain_id", "size", "confidence", "evidence_summary")


def er_customers(spark, folder):
    out = resolve.resolve_entities(derived(spark, folder, inputs.VENDORS), DATASET, SIGNALS)
    return out.clusters.select("cluster", "retain_id", "size", "confidence", "evidence_summary")


def er_issues(spark, folder):
    out = resolve.resolve_entities(derived(spark, folder, inputs.VENDORS), DATASET, EXACT_SIGNALS)
    return out.findings.issues.select(
        "issue_id", "category", "severity", "confidence", "affected_row_count", "action_type"
    )


# --- report, review, scorecard -----------------------------------------------------------


def customer_findings(spark, folder) -> Findings:
    df = derived(spark, folder, inputs.CUSTOMERS)
    found = checks.run_quality_checks(df, DATASET, CUSTOMER_CATEGORIES, CUSTOMER_CHECKS)
    return Findings(
        materialise(found.issues, "issues"),
        materialise(found.issue_rows, "issue-rows"),
        found.canonical_values,
    )


def dq_report(spark, folder):
    return checks.report(customer_findings(spark, folder).issues)


def dq_report_categories(spark, folder):
    return checks.report_by_category(customer_findings(spark, folder).issues)


def order_issues(spark, folder) -> DataFrame:
    """One MEDIUM or HIGH issue per order priority and status, for the review queries."""
    orders = table(spark, folder, "orders")
    groups = orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("affected_row_count")
    )
    key = F.concat_ws("|", "o_orderpriority", "o_orderstatus")
    return as_issues(
        groups.select(
            issue_id(DATASET, Category.DOMAIN_RULE, key).alias("issue_id"),
            F.lit(DATASET).alias("dataset_id"),
            F.when(F.col("o_orderstatus") == "P", "DEDUPLICATION").otherwise("DOMAIN_RULE").alias("category"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").otherwise("MEDIUM").alias("severity"),
            F.when(F.col("o_orderpriority") == "5-LOW", "EXECUTED").otherwise("OPEN").alias("status"),
            F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(1.0).alias("confidence"),
            key.alias("description"),
            F.array(F.lit("o_orderpriority")).alias("affected_columns"),
            "affected_row_count",
            F.when(F.col("o_orderstatus") == "O", "FLAG_ONLY").otherwise("SET_VALUE").alias("action_type"),
        )
    )


def order_decisions(spark, folder) -> DataFrame:
    """Decisions derived from orders: the lowest order keys of a group decide, twice."""
    orders = table(spark, folder, "orders")
    groups = orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )
    issue = issue_id(DATASET, Category.DOMAIN_RULE, F.concat_ws("|", "o_orderpriority", "o_orderstatus"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def decision(kind, role, offset, note):
        return groups.select(
            issue.alias("issue_id"),
            kind.alias("decision"),
            F.concat(F.lit("user"), (F.col("low") % 5).cast("string")).alias("actor"),
            role.alias("actor_role"),
            F.lit(note).alias("note"),
            (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("low") % 7 + offset).cast("decimal(18,6)"))).alias("decided_at"),
        )

    first = F.when(F.col("o_orderstatus") == "P", "REJECT").otherwise("APPROVE")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "analyst").otherwise("Senior Analyst")
    second = F.when(F.col("high") % 2 == 0, "REJECT").otherwise("APPROVE")
    return decision(first, role, 0, "first").unionByName(decision(second, F.lit("admin"), 100, "second"))


def review_apply(spark, folder):
    updated, _, _ = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    return updated.select("issue_id", "status", "approved_by", "rejected_by", "reviewer_note")


def review_outcomes(spark, folder):
    _, outcomes, _ = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    return outcomes.select("issue_id", "decision", "actor", "accepted", "reason")


def rejection_audit(spark, folder):
    _, _, audit = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    return audit.select("issue_id", "action_type", "actor", "affected_row_count", "success", "notes")


def bulk_approve(spark, folder):
    out = review.bulk_approve(order_issues(spark, folder), "boss", "senior analyst", 0.95)
    return out.select("issue_id", "status", "approved_by")


def issue_list(spark, folder):
    out = review.list_issues(order_issues(spark, folder), status="open", severity=["HIGH"], short=True)
    return out.drop("affected_columns")


def registry_merge(spark, folder):
    old = order_issues(spark, folder)
    new = old.where("confidence = 1").withColumn("status", F.lit("APPROVED"))
    return review.merge_registry(old, new).select("issue_id", "status", "confidence")


def review_counts(spark, folder):
    updated, _, _ = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    return review.review_counts(updated)


def export_checklist(spark, folder):
    updated, _, _ = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    return review.export_checklist(updated)


def scorecard_customers(spark, folder):
    found = customer_findings(spark, folder)
    total = table(spark, folder, "customer").count()
    return scorecard.scorecard(found.issues, found.issue_rows, total).drop("interpretation")


def category_table(spark, folder):
    found = customer_findings(spark, folder)
    out = scorecard.category_table(found.issues, found.issue_rows)
    return out.withColumn("high_critical_share", F.round("high_critical_share", 4))


# --- cleansing ---------------------------------------------------------------------------


def _one_issue(issue, action, column=None, value=None, n=0, seq=0, dtype=None):
    return (issue, DATASET, action, column, value, "APPROVED", n, seq, dtype)


def _plan(spark, issues):
    schema = (
        "issue_id string, dataset_id string, action_type string, target_column string, "
        "canonical_value string, status string, affected_row_count long, seq long, target_dtype string"
    )
    base = spark.createDataFrame(issues, schema)
    seq = base.select("issue_id", F.col("seq"))
    return as_issues(base).join(F.broadcast(seq), "issue_id")


def _no_values(spark):
    return spark.createDataFrame([], "issue_id string, column string, value string")


def _customer_rows(spark, folder):
    """Rows of the fixes below, by rules on the customer key."""
    keys = table(spark, folder, "customer").select("c_custkey", "c_nationkey")

    def rows(issue, role, condition):
        return keys.where(condition).select(
            F.lit(issue).alias("issue_id"), F.col("c_custkey").alias("row_id"), F.lit(role).alias("role")
        )

    parts = {
        "set1": [rows("set1", "target", "c_custkey % 6 = 0")],
        "set2": [rows("set2", "target", "c_custkey % 9 = 0")],
        "clear": [rows("clear", "target", "c_custkey % 10 = 0")],
        "drop": [rows("drop", "drop", "c_custkey % 25 = 1")],
        "merge1": [rows("merge1", "retain", "c_custkey = 2"), rows("merge1", "retire", "c_custkey % 25 = 3")],
        "merge2": [rows("merge2", "retain", "c_custkey = 3"), rows("merge2", "retire", "c_custkey % 25 = 4")],
        "merge3": [rows("merge3", "retain", "c_custkey = 4"), rows("merge3", "retire", "c_custkey % 25 IN (3, 5)")],
    }
    return parts


CLEANSE_ISSUES = {
    "set1": ("SET_VALUE", "c_acctbal", "$1,500.00"),
    "set2": ("SET_VALUE", "c_mktsegment", "OTHER"),
    "clear": ("CLEAR_VALUE", "c_acctbal", None),
    "drop": ("DROP_ROW", None, None),
    "merge1": ("MERGE_ROWS", "c_name", "Merged One"),
    "merge2": ("MERGE_ROWS", "c_name", "Merged Two"),
    "merge3": ("MERGE_ROWS", "c_name", "Merged Three"),
    "retype": ("RETYPE_COLUMN", "c_nationkey", None),
}


def _cleanse(spark, folder, names) -> cleanse.Cleansed:
    df = derived(spark, folder, inputs.CUSTOMERS)
    parts = _customer_rows(spark, folder)
    issues, rows = [], None
    for seq, name in enumerate(names):
        action, column, value = CLEANSE_ISSUES[name]
        dtype = "str" if name == "retype" else None
        issues.append(_one_issue(name, action, column, value, 1, seq, dtype))
        for part in parts.get(name, []):
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = parts["set1"][0].limit(0)
    return cleanse.execute_approved(
        df, _plan(spark, issues), rows, _no_values(spark), "bob", "analyst", at=instant()
    )


def _clean(*names):
    return lambda spark, folder: _cleanse(spark, folder, names).table.drop(ROW_ID)


EVERYTHING = ("drop", "merge1", "merge2", "merge3", "clear", "set1", "set2", "retype")

cleanse_set_clear = _clean("clear", "set1", "set2")
cleanse_drop = _clean("drop")
cleanse_merge = _clean("merge1", "merge2", "merge3")
cleanse_retype = _clean("retype")
cleanse_bulk = _clean(*EVERYTHING)


def cleanse_results(spark, folder):
    return _cleanse(spark, folder, EVERYTHING).results.select("issue_id", "action_type", "success", "rows_affected")


def cleanse_totals(spark, folder):
    return _cleanse(spark, folder, EVERYTHING).totals


def cleanse_amounts(spark, folder):
    """Findings to fixes end to end: approve the amount issue and apply its computed fix."""
    df = derived(spark, folder, inputs.ORDER_TEXTS)
    found = evaluate(df, format_tests(df), DATASET)
    issues = review.bulk_approve(found.issues, "boss", "admin", 0.9, at=instant())
    out = cleanse.execute_approved(df, issues, found.issue_rows, found.canonical_values, "boss", at=instant())
    return out.table.select(F.col(ROW_ID).alias("row_id"), "total_price", "order_date")


def audit_cells(spark, folder):
    done = _cleanse(spark, folder, ("clear", "set1", "set2", "drop"))
    entries = done.audit.select("entry_id", "issue_id")
    return done.audit_cells.join(entries, "entry_id").select("issue_id", "column", "row_id", "before", "after")


def audit_log(spark, folder):
    done = _cleanse(spark, folder, EVERYTHING)
    log = scorecard.audit_newest_first(audit_csv(done.audit).withColumnRenamed("timestamp", "ts"))
    return log.select("issue_id", "action_type", "actor", "success", "affected_row_count")


def audit_summary(spark, folder):
    _, _, rejections = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    out = scorecard.audit_summary(rejections)
    return out.withColumn("action_types", F.array_join("action_types", ","))


def audit_filter(spark, folder):
    _, _, rejections = review.review(order_issues(spark, folder), order_decisions(spark, folder))
    kept = scorecard.audit_filter(rejections, actions=["SET_VALUE"], success=False)
    return kept.select("issue_id", "action_type", "actor")


def score_labels(spark, folder):
    df = table(spark, folder, "lineitem").select((F.col("l_quantity") * 2).alias("score"), "l_discount")
    return (
        df.groupBy("score")
        .agg(F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("top"))
        .select(
            "score",
            "n",
            scorecard.score_label(F.col("score")).alias("label"),
            scorecard.score_colour(F.col("score")).alias("colour"),
            scorecard.confidence_band(F.col("score") / 100).alias("band"),
            severity_of_share(F.col("score"), F.lit(100)).alias("severity"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        profile_columns, file_roundtrip, row_numbers, completeness_labels, completeness_rows, completeness_blank,
        completeness_required, format_validity, format_amount_rows, format_date_rows,
        outlier_events, outlier_rows, column_moments, domain_rule, domain_rule_fix,
        uniqueness_documents, uniqueness_rows, ref_integrity, ref_integrity_rows, ref_orphans,
        consistency_part, consistency_rows, fuzzy_dedup, fuzzy_exact_norm, fuzzy_rows,
        canonical_form, pair_dedup, topk_samples, normalise_signals, er_exact_signals,
        er_components, er_canonical, er_elect, er_exact_clusters, er_exact_counters, er_full,
        er_scored, er_customers,
        er_issues, dq_report, dq_report_categories, review_apply, review_outcomes,
        rejection_audit, bulk_approve, issue_list, registry_merge, review_counts,
        export_checklist, category_table, cleanse_results, cleanse_totals, cleanse_amounts,
        audit_cells, audit_log, audit_summary, audit_filter, score_labels,
    )
}
QUERIES |= {
    "scorecard": scorecard_customers,
    "cleanse_set_clear": cleanse_set_clear,
    "cleanse_drop": cleanse_drop,
    "cleanse_merge": cleanse_merge,
    "cleanse_retype": cleanse_retype,
    "cleanse_bulk": cleanse_bulk,
}
