"""Vocabulary, table layouts and small driver-side records shared by all operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"


class Category(str, Enum):
    COMPLETENESS = "COMPLETENESS"
    UNIQUENESS = "UNIQUENESS"
    DEDUPLICATION = "DEDUPLICATION"
    FORMAT_VALIDITY = "FORMAT_VALIDITY"
    REFERENTIAL_INTEGRITY = "REFERENTIAL_INTEGRITY"
    CONSISTENCY = "CONSISTENCY"
    OUTLIER = "OUTLIER"
    DOMAIN_RULE = "DOMAIN_RULE"


class Severity(str, Enum):
    LOW = "LOW"
    MEDIUM = "MEDIUM"
    HIGH = "HIGH"
    CRITICAL = "CRITICAL"


class Status(str, Enum):
    OPEN = "OPEN"
    PENDING_APPROVAL = "PENDING_APPROVAL"
    APPROVED = "APPROVED"
    REJECTED = "REJECTED"
    EXECUTED = "EXECUTED"


class Action(str, Enum):
    SET_VALUE = "SET_VALUE"
    CLEAR_VALUE = "CLEAR_VALUE"
    MERGE_ROWS = "MERGE_ROWS"
    DROP_ROW = "DROP_ROW"
    RETYPE_COLUMN = "RETYPE_COLUMN"
    FLAG_ONLY = "FLAG_ONLY"


class Role(str, Enum):
    """What an issue wants with a row. Every listed row counts as affected."""

    TARGET = "target"
    RETAIN = "retain"
    RETIRE = "retire"
    DROP = "drop"


# Thresholds and placeholder that findings must agree on.
FUZZY_HIGH = 88
FUZZY_LOW = 75
OUTLIER_SIGMA = 3.0
OUTLIER_MIN_VALUES = 10
FUZZY_MIN_VALUES = 2
CLUSTER_HIGH = 0.88
CLUSTER_LOW = 0.72
EVIDENCE_CUTOFF = 72
BULK_APPROVE_THRESHOLD = 0.95
AMOUNT_PLACEHOLDER = "<stripped numeric>"
SIGNALS = ("name", "tax_id", "address", "zip", "phone")
SIGNAL_WEIGHTS = {"name": 0.40, "tax_id": 0.30, "address": 0.15, "zip": 0.08, "phone": 0.07}
ROLE_RANKS = {"viewer": 0, "analyst": 1, "senior analyst": 2, "admin": 3}

ISSUES = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("affected_columns", T.ArrayType(T.StringType())),
        T.StructField("affected_row_count", T.LongType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
        T.StructField("action_type", T.StringType()),
        T.StructField("target_column", T.StringType()),
        T.StructField("canonical_value", T.StringType()),
        T.StructField("target_dtype", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("approved_at", T.TimestampType()),
        T.StructField("rejected_by", T.StringType()),
        T.StructField("rejected_at", T.TimestampType()),
        T.StructField("reviewer_note", T.StringType()),
        T.StructField("executed_at", T.TimestampType()),
    ]
)

ISSUE_ROWS = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("role", T.StringType()),
    ]
)

# Dict-shaped proposed values, one row per column (entity merges).
CANONICAL_VALUES = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("issue_id", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("actor_role", T.StringType()),
        T.StructField("affected_columns", T.ArrayType(T.StringType())),
        T.StructField("affected_row_count", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("notes", T.StringType()),
    ]
)

AUDIT_CELLS = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
    ]
)


def plan_time() -> Column:
    """The present as a constant, so that all outputs of one plan carry the same time."""
    return F.lit(datetime.now(timezone.utc))


def conform(df: DataFrame, schema: T.StructType, **given: str) -> DataFrame:
    """Project ``df`` onto ``schema``; columns it lacks become typed nulls.

    ``given`` holds SQL for columns that are null or missing.
    """
    out = []
    for f in schema:
        parts = [f"`{f.name}`"] if f.name in df.columns else []
        parts += [given[f.name]] if f.name in given else []
        value = f"coalesce({', '.join(parts)})" if len(parts) > 1 else (parts or ["NULL"])[0]
        out.append(f"CAST({value} AS {f.dataType.simpleString()}) AS `{f.name}`")
    return df.selectExpr(*out)


def as_issues(df: DataFrame) -> DataFrame:
    """Full-width issues from the columns a check filled in; status starts OPEN."""
    now = datetime.now(timezone.utc).isoformat(sep=" ")
    return conform(
        df, ISSUES, status=f"'{Status.OPEN.value}'", detected_at=f"TIMESTAMP '{now}'"
    )


def issue_id(dataset_id: str, category: Category, *key: Column | str) -> Column:
    """Deterministic id, so reruns, retries and other engines agree."""
    parts = [F.lit(dataset_id), F.lit(category.value)]
    parts += [k if isinstance(k, Column) else F.lit(k) for k in key]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("DQ-"), F.upper(F.substring(digest, 1, 16)))


def issue_id_text(dataset_id: str, category: Category, key: str) -> str:
    """The same id for a key that is known on the driver."""
    digest = hashlib.sha256(f"{dataset_id}|{category.value}|{key}".encode()).hexdigest()
    return f"DQ-{digest[:16].upper()}"


@dataclass(frozen=True)
class Findings:
    """Issues, their rows in long form, and dict-shaped proposed values (all lazy)."""

    issues: DataFrame
    issue_rows: DataFrame
    canonical_values: DataFrame

    def union(self, other: Findings) -> Findings:
        return Findings(
            self.issues.unionByName(other.issues),
            self.issue_rows.unionByName(other.issue_rows),
            self.canonical_values.unionByName(other.canonical_values),
        )


def findings(issues: DataFrame, rows: DataFrame, values: DataFrame | None = None) -> Findings:
    if values is None:
        values = issues.sparkSession.range(0)
    return Findings(as_issues(issues), conform(rows, ISSUE_ROWS), conform(values, CANONICAL_VALUES))


@dataclass(frozen=True)
class DatasetMeta:
    """Provenance of one ingested table. Never holds credentials."""

    source_type: str = "FILE"
    dataset_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    original_filename: str | None = None
    file_format: str | None = None
    db_dialect: str | None = None
    db_host: str | None = None
    db_name: str | None = None
    source_table: str | None = None
    source_query: str | None = None
    row_count: int | None = None
    column_count: int | None = None
    output_filename: str | None = None
    output_table: str | None = None
    export_ready: bool = False

    def exported(self, **changes) -> DatasetMeta:
        return replace(self, export_ready=True, **changes)


@dataclass(frozen=True)
class DomainRule:
    """One business rule on a column.

    ``rule`` is a SQL condition, a function of a Column giving a Column (both stay in the
    JVM), or, with ``python=True``, a plain predicate on one value. True means valid;
    a null or an error counts as a failure, a null value is not tested.
    """

    column: str
    rule: str | Callable
    description: str
    severity: Severity = Severity.MEDIUM
    fix_value: object = None
    python: bool = False


@dataclass(frozen=True)
class SignalConfig:
    """Which columns carry which matching signal, and the signal weights."""

    name: tuple[str, ...] = ()
    tax_id: tuple[str, ...] = ()
    address: tuple[str, ...] = ()
    zip: tuple[str, ...] = ()
    phone: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))

    def columns(self, signal: str) -> tuple[str, ...]:
        return tuple(getattr(self, signal))

    def active(self) -> list[str]:
        return [s for s in SIGNALS if self.columns(s)]

    def present_in(self, columns: list[str]) -> SignalConfig:
        """The same config without columns the table lacks."""
        kept = {s: tuple(c for c in self.columns(s) if c in columns) for s in SIGNALS}
        return SignalConfig(**kept, weights=self.weights)
