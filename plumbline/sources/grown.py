"""Profiles of a folder that grows: each run reads only the files it has not seen.

A run profiles its new files as one batch: per column the rows, the non-null cells, and a
HyperLogLog sketch of the values. Sketches merge without loss, so the profile of the folder is
the union of its batches and costs no look at old data. Where a file of a batch has changed or is
gone, the files left of that batch are read again, and no others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import ROW_ID
from plumbline.sources.files import path_exists

# Registers of a sketch are 2 ** LOG_REGISTERS.
LOG_REGISTERS = 12
# Standard error of a merged sketch as a share of the true number; small numbers are exact.
RELATIVE_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)

SKETCHES = "batch string, column string, dtype string, rows long, filled long, sketch binary"
FILES = "batch string, retired boolean, path string, length long, modified timestamp"


@dataclass(frozen=True)
class GrownProfile:
    """``columns`` is the profile of the whole folder; ``read`` lists the files this run read."""

    columns: DataFrame
    read: DataFrame


def column_sketches(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, filled, sketch) of every column, in one pass with one output row."""
    fields = [f for f in df.schema if f.name != ROW_ID]
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        cell = F.col(f"`{f.name}`")
        whole = isinstance(f.dataType, (T.IntegerType, T.LongType, T.BinaryType))
        wanted.append(F.count(cell).alias(f"filled{i}"))
        wanted.append(F.hll_sketch_agg(cell if whole else cell.cast("string"), LOG_REGISTERS).alias(f"sketch{i}"))
    cells = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), "rows",
            F.col(f"filled{i}").alias("filled"), F.col(f"sketch{i}").alias("sketch"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*wanted).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def profile_grown(spark: SparkSession, folder: str, store: str, pattern: str = "*.parquet") -> GrownProfile:
    """Profile of all parquet files under ``folder``, from what ``store`` has of earlier runs.

    Columns: column, dtype, rows, nulls, nullable, unique_count. A column that some files lack counts
    as null there; where its type differs between batches, ``dtype`` names all. ``unique_count`` is an
    estimate with ``RELATIVE_ERROR``. A batch counts once its list of files is written, which is
    the last step and one file, so a run that dies leaves the profile as it was. One run per store at a time.
    """
    now = _files(spark, folder, pattern)
    known = _table(spark, f"{store}/files", FILES)
    retired = known.where("retired").select("batch")
    live = known.where("NOT retired").join(retired, "batch", "left_anti")
    same = ["path", "length", "modified"]
    stale = live.join(now, same, "left_anti").select("batch").distinct()
    valid = live.join(stale, "batch", "left_anti")
    batch = uuid.uuid4().hex
    lists = f"{store}/lists/{batch}"
    now.join(valid.select(*same), same, "left_anti").write.parquet(lists)
    fresh = spark.read.schema(now.schema).parquet(lists)
    if fresh.take(1) or stale.take(1):
        paths = [r.path for r in fresh.select("path").toLocalIterator()]  # names only; Spark's reader wants them
        if paths:
            added = column_sketches(spark.read.options(mergeSchema=True, basePath=folder).parquet(*paths))
            added.select(F.lit(batch).alias("batch"), "*").write.parquet(f"{store}/sketches/{batch}")
        entered = fresh.select(F.lit(batch).alias("batch"), F.lit(False).alias("retired"), *same)
        ended = stale.select("batch", F.lit(True).alias("retired"), *[F.lit(None).cast(t).alias(c) for c, t in now.dtypes])
        entered.unionByName(ended).coalesce(1).write.mode("append").parquet(f"{store}/files")
        known = _table(spark, f"{store}/files", FILES)
        live = known.where("NOT retired").join(known.where("retired").select("batch"), "batch", "left_anti")
    # One name per run. Spark takes two reads of one folder for the same, whatever was appended
    # between them; folders per batch keep the profiles of two runs apart in one plan.
    batches = sorted(r.batch for r in live.select("batch").distinct().collect())
    kept = [f"{store}/sketches/{b}" for b in batches]
    sketches = spark.read.schema(SKETCHES).parquet(*kept) if kept else spark.createDataFrame([], SKETCHES)
    return GrownProfile(merged(sketches), fresh)


def merged(sketches: DataFrame) -> DataFrame:
    """The profile of all batches in ``sketches``, one row per column of any of them."""
    total = sketches.groupBy("batch").agg(F.max("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    columns = sketches.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set("dtype")), "|").alias("dtype"),
        F.sum("filled").alias("filled"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_count"),
    )
    # One row meets one row per column.
    nulls = F.col("rows") - F.col("filled")
    return columns.join(F.broadcast(total), F.lit(True)).select(
        "column", "dtype", "rows", nulls.alias("nulls"), (nulls > 0).alias("nullable"), "unique_count"
    )


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, modified) of the files; the contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return found.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
