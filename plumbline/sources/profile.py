"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import ROW_ID
from plumbline.operators.samples import first_k

SAMPLE_VALUES = 5


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, nullable, distinct non-null values, first values.

    Counts come from a single pass. Exact distinct counts expand rows once per column, so for
    very wide or long tables ``approximate=True`` uses HyperLogLog sketches instead.
    """
    columns = [f for f in df.schema if f.name != ROW_ID]
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(columns):
        cell = F.col(f"`{f.name}`")
        counts.append(F.count_if(cell.isNull()).alias(f"nulls{i}"))
        distinct = F.approx_count_distinct(cell) if approximate else F.count_distinct(cell)
        counts.append(distinct.alias(f"distinct{i}"))
    stats = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.col("rows"),
                    F.col(f"nulls{i}").alias("nulls"),
                    F.col(f"distinct{i}").alias("unique_count"),
                )
                for i, f in enumerate(columns)
            ]
        )
    )
    numbers = df.agg(*counts).select(stats.alias("s")).select("s.*")
    out = numbers.withColumn("nullable", F.col("nulls") > 0)
    if ROW_ID not in df.columns:
        return out
    # One row per column on the small side.
    return out.join(F.broadcast(first_values(df)), "column", "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>"))
    )


def first_values(df: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """(column, sample_values): the first ``k`` non-null values of every column, by row id."""
    cells = [
        F.when(
            F.col(f"`{c}`").isNotNull(),
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")),
        )
        for c in df.columns
        if c != ROW_ID
    ]
    long = df.select(ROW_ID, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(ROW_ID, "c.*")
    top = first_k(long, "column", ROW_ID, k)
    pairs = F.array_sort(F.collect_list(F.struct(ROW_ID, "value")))  # at most k
    return top.groupBy("column").agg(F.transform(pairs, lambda p: p["value"]).alias("sample_values"))
