"""Reading tables and queries, over JDBC or from the session catalog."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from plumbline.model import ROW_ID, DatasetMeta
from plumbline.sources.files import Ingested, timestamp_suffix, too_many_rows
from plumbline.sources.rowid import fold_nan, with_row_id

CATALOG = "catalog"  # stands for the session catalog in place of a connection


def is_safe_identifier(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9_.]+", name) is not None


def provenance(connection: str) -> dict[str, str]:
    """Dialect, host and database of a connection string, without credentials."""
    if connection == CATALOG:
        return {"dialect": "spark", "host": "catalog", "database": ""}
    try:
        parsed = urlparse(connection.removeprefix("jdbc:"))
        return {
            "dialect": parsed.scheme.split("+")[0] or "unknown",
            "host": parsed.hostname or "unknown",
            "database": parsed.path.lstrip("/"),
        }
    except ValueError:
        return {"dialect": "unknown", "host": "unknown", "database": ""}


def scrub(message: str, connection: str, properties: dict | None = None) -> str:
    """Remove the credentials of a connection string and of JDBC properties from a message."""
    secrets = re.findall(r"(?:password|user)=([^&;]+)", connection)
    try:
        parsed = urlparse(connection.removeprefix("jdbc:"))
        secrets += [s for s in (parsed.password, parsed.username) if s]
    except ValueError:
        pass
    secret_names = re.compile("pass|user|secret|token|key", re.I)
    secrets += [str(v) for k, v in (properties or {}).items() if v and secret_names.search(k)]
    for secret in sorted(secrets, key=len, reverse=True):
        message = message.replace(secret, "***")
    return message


def is_query(text: str) -> bool:
    return text.strip().upper().startswith("SELECT")


def read_options(table_or_query: str, partition: dict | None = None) -> dict[str, str]:
    """JDBC read options. ``partition`` holds partitionColumn, lowerBound, upperBound and
    numPartitions, so that a large table is read by many tasks."""
    if is_query(table_or_query):
        if not partition:
            return {"query": table_or_query}
        options = {"dbtable": f"({table_or_query}) plumbline_query"}
    else:
        options = {"dbtable": table_or_query.strip()}
    for name, value in (partition or {}).items():
        if name not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
            raise ValueError(f"unknown partition option '{name}'")
        options[name] = str(value)
    return options


def _load(spark: SparkSession, connection: str, source: str, partition, properties) -> DataFrame:
    if connection == CATALOG:
        return spark.sql(source) if is_query(source) else spark.table(source.strip())
    reader = spark.read.format("jdbc").option("url", connection)
    return reader.options(**(properties or {}), **read_options(source, partition)).load()


def ingest_table(
    spark: SparkSession,
    connection: str,
    table_or_query: str,
    partition: dict | None = None,
    properties: dict | None = None,
    key: str | None = None,
    max_rows: int | None = None,
) -> Ingested:
    """Read a table by name, or a SELECT as it is. Never writes to the source."""
    query = is_query(table_or_query)
    table = None if query else table_or_query.strip()
    if table is not None and not is_safe_identifier(table):
        return Ingested(
            False,
            error=f"Invalid table name '{table}'. "
            "Use only alphanumeric characters, underscores, and dots.",
        )
    try:
        df = _load(spark, connection, table_or_query, partition, properties)
        problem = too_many_rows(df, table or "query result", max_rows)
        if problem:
            return Ingested(False, error=problem)
        numbered = with_row_id(fold_nan(df), key)
        rows = numbered.count()
    except Exception as failure:  # noqa: BLE001 - drivers raise anything; secrets must not leak
        if not isinstance(failure, (PySparkException, ValueError)) and "Py4J" not in type(failure).__name__:
            raise
        return Ingested(False, error=f"Database read failed: {scrub(str(failure), connection, properties)}")
    origin = provenance(connection)
    output = f"{table or 'query'}_clean_{timestamp_suffix()}"
    meta = DatasetMeta(
        source_type="DATABASE",
        db_dialect=origin["dialect"],
        db_host=origin["host"],
        db_name=origin["database"],
        source_table=table,
        source_query=table_or_query if query else None,
        row_count=rows,
        column_count=len([c for c in numbered.columns if c != ROW_ID]),
        output_table=output,
    )
    what = f"table '{table}'" if table else "custom query"
    summary = (
        f"Ingested {what} from {origin['dialect']}://{origin['host']}/{origin['database']}. "
        f"{rows:,} rows x {meta.column_count} columns. dataset_id: {meta.dataset_id}. "
        f"Output will be written to table '{output}'."
    )
    return Ingested(True, numbered, meta, summary)
