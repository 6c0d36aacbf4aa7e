"""Joins that hold at any size: of tables that grow with the input, and of rows with their groups,
of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group with this many rows is hot. At most (all rows / HOT_ROWS) groups can be hot,
# so the broadcast side below is bounded: 10**12 rows give at most 10**6 hot groups.
HOT_ROWS = 1_000_000
# So many groups of a written table are broadcast, and their rows stay where they are.
FEW_GROUPS = 10_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast.

    The planner judges by the size of files or shuffles. Ids and repeated texts compress to next
    to nothing there, so millions of rows would pass through the driver and into every executor.
    """
    return df.hint("merge")


def join_counted(
    rows: DataFrame,
    groups: DataFrame,
    on: str,
    count: str,
    hot_rows: int = HOT_ROWS,
    total: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, ``count`` = its row count).

    Rows of hot groups meet a broadcast of the few hot groups and are not shuffled;
    all other groups hold fewer than ``hot_rows`` rows and go through a shuffle join.
    A ``total`` of all rows below ``hot_rows``, or a look at ``groups`` where that is a
    ``written`` table, can show that no group is hot, and then one shuffle join is enough; if it shows that
    the groups are few, all of them are broadcast. A group with a null count is joined like a small one.
    """
    hot = groups.where(F.col(count) >= hot_rows)
    if total is not None and total < hot_rows:
        return rows.join(shuffled(groups), on)
    if written:
        seen = groups.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col(count) >= hot_rows).alias("hot")).first()
        if seen["all"] <= FEW_GROUPS:
            return rows.join(F.broadcast(groups), on)
        if not seen["hot"]:
            return rows.join(shuffled(groups), on)
    cold = groups.where(F.coalesce(F.col(count) < hot_rows, F.lit(True)))
    from_hot = rows.join(F.broadcast(hot), on)
    from_cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(shuffled(cold), on)
    return from_hot.unionByName(from_cold)


def with_row_counts(issues: DataFrame, issue_rows: DataFrame, name: str) -> DataFrame:
    """``issues`` with the number of rows that each really has, whatever it declares."""
    sizes = issue_rows.groupBy("issue_id").agg(F.count(F.lit(1)).alias(name))
    return issues.join(shuffled(sizes), "issue_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
