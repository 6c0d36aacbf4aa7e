"""Helpers that the operators of this package share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.durable import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is.

    ``lower`` changes nothing else where every character is one byte, and is much faster.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, compactly, into the shared folder and return the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/plumbline-{app}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(df: DataFrame, name: str, buckets: int = 0, by: str = "") -> DataFrame:
    """``written``, after which Spark drops the shuffle files of the job at once, not when the driver collects garbage.

    With ``buckets``, it is a table of the session's catalog instead, bucketed by the column ``by``.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        if not buckets:
            return written(df, name)
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).option("compression", "zstd").saveAsTable(table)
        return df.sparkSession.table(table)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def numbered(documents: DataFrame, row: str) -> DataFrame:
    """``documents`` with a unique number in the column ``row``, written once, which fixes it."""
    return written(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name
