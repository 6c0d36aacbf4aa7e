"""Writing clean tables and audit records. Sources are never overwritten."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.model import AUDIT, ROW_ID, DatasetMeta, conform, plan_time
from plumbline.plans.cleanse import audit_id
from plumbline.sources.files import path_exists as _exists
from plumbline.sources.files import timestamp_suffix
from plumbline.sources.publish import interrupted, write_staged
from plumbline.sources.tables import CATALOG, is_safe_identifier, provenance, scrub

AUDIT_CSV_FIELDS = (
    "entry_id",
    "timestamp",
    "issue_id",
    "action_type",
    "actor",
    "success",
    "affected_row_count",
    "notes",
)


@dataclass(frozen=True)
class Exported:
    """Outcome of an export; ``meta`` is marked as exported, ``audit`` is one row."""

    success: bool
    meta: DatasetMeta
    audit: DataFrame
    destination: str = ""
    row_count: int = 0
    summary: str = ""
    error: str | None = None


def _finish(df, meta, mode, actor, destination="", rows=0, summary="", error=None, export_id=None) -> Exported:
    spark = df.sparkSession
    audit = _entry(spark, meta.dataset_id, mode, actor, destination, rows, summary, error, export_id)
    done = meta if error else meta.exported()
    return Exported(error is None, done, audit, destination, rows, summary, error)


def _entry(spark, dataset_id, mode, actor, destination, rows, summary, error, export_id) -> DataFrame:
    """One audit row. With an ``export_id`` it has the same id whoever writes it."""
    notes, now = error or summary, plan_time()
    key = [F.lit(export_id)] if export_id else [F.lit(dataset_id), F.lit(destination), now.cast("string")]
    audit = spark.range(1).select(
        audit_id(F.lit("export"), *key).alias("entry_id"),
        now.alias("ts"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit("EXPORT").alias("issue_id"),
        F.lit(f"EXPORT_{mode}").alias("action_type"),
        F.lit(actor).alias("actor"),
        F.lit("").alias("actor_role"),
        F.array().cast("array<string>").alias("affected_columns"),
        F.lit(rows).cast("long").alias("affected_row_count"),
        F.lit(error is None).alias("success"),
        F.lit(f"{notes} destination={destination}" if destination else notes).alias("notes"),
    )
    return conform(audit, AUDIT)


def _refusal(meta: DatasetMeta, wanted: str) -> str | None:
    if meta.source_type != wanted:
        return (
            f"Dataset {meta.dataset_id} has source_type '{meta.source_type}'; "
            f"this export takes {wanted} sources only."
        )
    if meta.export_ready:
        return f"Dataset {meta.dataset_id} has already been exported. Create a new run to export again."
    return None


def export_file(
    df: DataFrame,
    meta: DatasetMeta,
    output_dir: str,
    filename: str | None = None,
    actor: str = "SYSTEM",
) -> Exported:
    """Write to a new folder of CSV or parquet part files, columns in their order.

    Cells keep their blanks and line breaks; in CSV a null is an empty cell and an empty text a
    quoted one. The write is parallel and staged: the output appears whole, with a manifest, or
    not at all; see :func:`recover_exports` for a process that dies meanwhile.
    """
    error = _refusal(meta, "FILE")
    if error:
        return _finish(df, meta, "FILE", actor, error=error)
    kind = meta.file_format or "csv"
    name = filename or meta.output_filename or f"dataset_{meta.dataset_id}_clean_{timestamp_suffix()}.{kind}"
    parent = output_dir.rstrip("/")
    path = f"{parent}/{name}"
    data = df.drop(ROW_ID)

    def write(staged: str) -> int:
        counted = Observation()
        writer = data.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        if kind == "parquet":
            writer.parquet(staged)
        else:
            keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
            writer.options(header=True, escape='"', **keep).csv(staged)
        return counted.get["rows"]

    try:
        if _exists(df.sparkSession, path):
            return _finish(df, meta, "FILE", actor, error=f"Output file '{path}' already exists.")
        note = {"dataset_id": meta.dataset_id, "actor": actor, "columns": data.columns, "format": kind}
        manifest, error = write_staged(df.sparkSession, parent, name, note, write)
    except PySparkException as failure:
        return _finish(df, meta, "FILE", actor, error=f"Failed to write output file '{path}': {failure}")
    if error:
        return _finish(df, meta, "FILE", actor, error=error, export_id=manifest["export_id"])
    rows = manifest["rows"]
    return _finish(df, meta, "FILE", actor, path, rows, _told(manifest), export_id=manifest["export_id"])


def _told(manifest: dict) -> str:
    size = f"{manifest['rows']:,} rows x {len(manifest['columns'])} columns"
    return f"Exported {size} to '{manifest['name']}' ({manifest['format'].upper()})."


def recover_exports(spark: SparkSession, output_dir: str) -> DataFrame:
    """Audit entries of exports into a folder whose process died, which is then clean.

    One that had been published is entered as the success it was, under the id it would have had;
    any other as a failure, and nothing of it is left. Run while nobody exports there.
    """
    parent = output_dir.rstrip("/")
    entries = spark.createDataFrame([], AUDIT)
    for left in interrupted(spark, parent):
        path, note = f"{parent}/{left.note['name']}", left.note
        told = (path, left.manifest["rows"], _told(left.manifest), None) if left.manifest else (
            "", 0, "", f"Export to '{path}' was interrupted.")
        entries = entries.unionByName(_entry(spark, note["dataset_id"], "FILE", note["actor"], *told, note["export_id"]))
    return entries


def export_table(
    df: DataFrame,
    meta: DatasetMeta,
    connection: str,
    output_table: str | None = None,
    if_exists: str = "fail",
    properties: dict | None = None,
    actor: str = "SYSTEM",
) -> Exported:
    """Write to a new table over JDBC or in the session catalog.

    ``if_exists`` is "fail" or "replace"; appending could corrupt a clean table and is refused.
    """
    error = _refusal(meta, "DATABASE")
    table = output_table or meta.output_table or f"{meta.source_table or 'query'}_clean_{timestamp_suffix()}"
    if error is None and if_exists not in ("fail", "replace"):
        error = f"Invalid if_exists value '{if_exists}'. Only 'fail' and 'replace' are supported."
    if error is None and not is_safe_identifier(table):
        error = f"Invalid output table name '{table}'. Use alphanumeric characters, underscores and dots."
    if error is None and table == meta.source_table:
        error = f"Output table '{table}' is the source table, which is never written."
    if error:
        return _finish(df, meta, "DATABASE", actor, error=error)
    mode = {"fail": "errorifexists", "replace": "overwrite"}[if_exists]
    data = df.drop(ROW_ID)
    try:
        if connection == CATALOG:
            data.write.mode(mode).saveAsTable(table)
            rows = df.sparkSession.table(table).count()
        else:
            writer = data.write.format("jdbc").mode(mode).option("url", connection)
            writer.options(**(properties or {})).option("dbtable", table).save()
            rows = data.count()
    except PySparkException as failure:
        text = f"Database write failed: {scrub(str(failure), connection, properties)}"
        return _finish(df, meta, "DATABASE", actor, error=text)
    origin = provenance(connection)
    place = f"{origin['dialect']}://{origin['host']}"
    summary = f"Exported {rows:,} rows x {len(data.columns)} columns to table '{table}' on {place}."
    return _finish(df, meta, "DATABASE", actor, f"{place}/{origin['database']}.{table}", rows, summary)


def audit_csv(audit: DataFrame) -> DataFrame:
    """The eight fields of an audit export."""
    return audit.withColumnRenamed("ts", "timestamp").select(*AUDIT_CSV_FIELDS)


def write_audit_csv(audit: DataFrame, path: str) -> None:
    audit_csv(audit).write.mode("errorifexists").option("header", True).csv(path)


def record_audit(audit: DataFrame, table: str) -> None:
    """Append the entries that the audit table doesn't have yet, by entry id."""
    spark = audit.sparkSession
    if spark.catalog.tableExists(table):
        audit = audit.join(spark.table(table).select("entry_id"), "entry_id", "left_anti").select(audit.columns)
    append_audit(audit.dropDuplicates(["entry_id"]), table)


def append_audit(audit: DataFrame, table: str) -> None:
    """Append entries to the audit table; nothing ever updates it."""
    audit.write.mode("append").saveAsTable(table)
