"""Stable row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.model import ROW_ID


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add the row id column that all checks and fixes refer to.

    With ``key`` (a unique integer column) the id is the key: nothing is computed, and reruns
    agree. Without one, rows are numbered from 0 in scan order; the table is written first,
    so that a lost executor cannot renumber rows. The numbering itself is two map-only
    passes joined by one small table of row counts per input partition.
    """
    if key is not None:
        return df.select(F.col(f"`{key}`").cast("long").alias(ROW_ID), "*")
    marked = materialise(df.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # One row per input partition, so the running sum is over a small table.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    numbered = marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    within = F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return numbered.select((F.col("_start") + within).alias(ROW_ID), *[f"`{c}`" for c in df.columns])


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN means missing; make it null once, at ingest."""
    changed = {
        f.name: F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`"))
        for f in df.schema
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(changed) if changed else df
