"""First-k rows of each issue, for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_k(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The ``k`` lowest rows per key.

    ``row_number() <= k`` lets Spark keep only k rows per key in every map task before
    the shuffle, so a key with a third of all rows costs no more than a small one.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sample_values(rows: DataFrame, k: int) -> DataFrame:
    """(issue_id, row_id, value) -> (issue_id, sample_values): k values in row order."""
    top = first_k(rows, "issue_id", "row_id", k)
    # At most k structs per issue reach this list.
    pairs = F.array_sort(F.collect_list(F.struct("row_id", "value")))
    return top.groupBy("issue_id").agg(
        F.transform(pairs, lambda p: p["value"]).alias("sample_values")
    )
