"""Reading delimited text and parquet files."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import ROW_ID, DatasetMeta
from plumbline.sources.rowid import fold_nan, with_row_id

EXTENSIONS = (".csv", ".parquet")

# Texts that mean "missing" in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Ingested:
    """Outcome of a read. On failure ``error`` says why and there is no table."""

    success: bool
    table: DataFrame | None = None
    meta: DatasetMeta | None = None
    summary: str = ""
    error: str | None = None


def timestamp_suffix(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S")


def too_many_rows(df: DataFrame, label: str, max_rows: int | None) -> str | None:
    """Optional guard; looks at no more than ``max_rows + 1`` rows. Off by default."""
    if max_rows is None or df.limit(max_rows + 1).count() <= max_rows:
        return None
    return f"'{label}' has more than the maximum of {max_rows:,} rows. Narrow the input and try again."


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    text_columns: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV with header. Missing-value tokens become null before types are inferred.

    ``schema`` skips inference altogether, as a large input should. ``text_columns`` stay text,
    which keeps the leading zeros of codes. Quoted cells may hold line breaks; where none does,
    ``multi_line=False`` lets Spark split large files.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = raw.columns
    cells = {
        c: F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")) for c in names
    }
    text = raw.select(*[cells[c].alias(c) for c in names])
    if schema is not None:
        wanted = spark.createDataFrame([], schema).schema
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
    return text.select(*[_inferred(text, names, set(text_columns or []))[c].alias(c) for c in names])


def _inferred(text: DataFrame, names: list[str], keep: set[str]) -> dict:
    """Whole numbers, decimals, booleans or text, decided for all columns in one pass."""
    tests = []
    for i, c in enumerate(names):
        cell = F.trim(F.col(f"`{c}`"))
        bad_long = cell.isNotNull() & cell.try_cast("bigint").isNull()
        bad_double = cell.isNotNull() & cell.try_cast("double").isNull()
        bad_bool = cell.isNotNull() & ~F.lower(cell).isin("true", "false")
        tests += [
            F.count(cell).alias(f"n{i}"),
            F.count_if(bad_long).alias(f"l{i}"),
            F.count_if(bad_double).alias(f"d{i}"),
            F.count_if(bad_bool).alias(f"b{i}"),
        ]
    seen = text.agg(*tests).first()
    out = {}
    for i, c in enumerate(names):
        cell = F.col(f"`{c}`")
        out[c] = cell
        if c in keep or not seen[f"n{i}"]:
            continue
        for mark, kind in (("l", "bigint"), ("d", "double"), ("b", "boolean")):
            if not seen[f"{mark}{i}"]:
                out[c] = F.trim(cell).try_cast(kind)
                break
    return out


def ingest_file(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    text_columns: list[str] | None = None,
    key: str | None = None,
    max_rows: int | None = None,
    multi_line: bool = True,
) -> Ingested:
    """Read a file into a table with row ids. Failures are results, not exceptions."""
    name = os.path.basename(path.rstrip("/"))
    stem, extension = os.path.splitext(name)
    if extension.lower() not in EXTENSIONS:
        return Ingested(False, error=f"Unsupported file type '{extension}'. Supported: {EXTENSIONS}")
    try:
        if not path_exists(spark, path):
            return Ingested(False, error=f"File not found: {path}")
        if extension.lower() == ".csv":
            df = read_csv(spark, path, schema, text_columns, multi_line)
        else:
            df = spark.read.parquet(path)
        problem = too_many_rows(df, name, max_rows)
        if problem:
            return Ingested(False, error=problem)
        table = with_row_id(fold_nan(df), key)
        rows = table.count()
    except PySparkException as failure:
        return Ingested(False, error=f"Failed to parse file: {failure}")
    kind = extension.lower().lstrip(".")
    output = f"{stem}_clean_{timestamp_suffix()}.{kind}"
    meta = DatasetMeta(
        source_type="FILE",
        original_filename=name,
        file_format=kind,
        row_count=rows,
        column_count=len([c for c in table.columns if c != ROW_ID]),
        output_filename=output,
    )
    summary = (
        f"Ingested file '{name}'. {rows:,} rows x {meta.column_count} columns. "
        f"dataset_id: {meta.dataset_id}. Output will be written to '{output}'."
    )
    return Ingested(True, table, meta, summary)
