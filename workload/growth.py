"""Registered query on the profile of a folder that grows; and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.durable import shared_dir
from plumbline.sources.grown import RELATIVE_ERROR, profile_grown
from workload.queries import derived

_LINES = """
SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey END AS l_suppkey,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS flags
FROM lineitem
"""
_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "flags")


def profile_growing(spark, folder):
    """Profiles after even orders, after the odd ones arrive, and after nothing more does.

    ``near`` says that a sketch's estimate is within three standard errors of the exact number.
    """
    lines = derived(spark, folder, _LINES)
    home = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    out = None
    for run, news in ((1, "l_orderkey % 2 = 0"), (2, "l_orderkey % 2 <> 0"), (3, None)):
        if news:
            lines.where(news).write.mode("append").parquet(f"{home}/data")
        got = profile_grown(spark, f"{home}/data", f"{home}/profile")
        seen = lines.where("l_orderkey % 2 = 0") if run == 1 else lines
        exact = seen.agg(*[F.count_distinct(c).alias(c) for c in _COLUMNS])
        exact = exact.unpivot([], list(_COLUMNS), "column", "exact")
        read = got.read.count()
        one = got.columns.join(exact, "column").select(
            F.lit(run).alias("run"), "column", "rows", "nulls", "nullable", F.lit(read > 0).alias("read_files"),
            (F.abs(F.col("unique_count") - F.col("exact")) <= 3 * RELATIVE_ERROR * F.col("exact")).alias("near"),
        )
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"profile_growing": profile_growing}
ORACLES = {
    "profile_growing": f"WITH t AS ({_LINES}) "
    + " UNION ALL ".join(
        f"""SELECT {run} AS run, '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls,
        count(*) > count({c}) AS nullable, {run} < 3 AS read_files, true AS near FROM t WHERE {seen}"""
        for run, seen in ((1, "l_orderkey % 2 = 0"), (2, "true"), (3, "true"))
        for c in _COLUMNS
    )
}
