"""Which row merges take effect when merges overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.operators.components import connected_components
from plumbline.skew import join_counted, shuffled

POLICIES = ("sequential", "components")


def _first_two(steps: DataFrame) -> DataFrame:
    """Per row to keep: the first two open or effective merges that retire it, and the first effective one."""
    live = steps.where("ok IS NULL OR ok")
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy("at"))
    early = live.withColumn("rank", rank).where("rank <= 2")
    two = early.groupBy(F.col("row_id").alias("retain_id")).agg(
        F.min("at").alias("first"),
        F.min_by("issue_id", "at").alias("before"),
        F.min(F.when(F.col("rank") == 2, F.col("at"))).alias("second"),
    )
    goes = live.where("ok").groupBy(F.col("row_id").alias("retain_id")).agg(F.min("at").alias("goes"))
    return two.join(shuffled(goes), "retain_id", "left")


def _follow(state: DataFrame) -> DataFrame:
    """Settle merges that hang on a single earlier one, by pointer doubling.

    ``state`` has ``ok``, and ``before`` where exactly one open earlier merge may retire the row to
    keep: the outcome is the opposite of that merge's. A chain of such merges is halved per round,
    as every merge jumps to what the one it points at points at; ``flip`` keeps count of the
    opposites on the way.
    """
    pointers = state.select("issue_id", "ok", "before", F.col("before").isNotNull().alias("flip"))
    pointers = materialise(pointers, "pointers")
    while True:
        ahead = pointers.select(
            F.col("issue_id").alias("before"), F.col("ok").alias("ok2"), F.col("before").alias("before2"), F.col("flip").alias("flip2")
        )
        met = pointers.where("before IS NOT NULL").join(shuffled(ahead), "before")
        # What is settled or jumps further moves; what points at a merge that must wait stays.
        known = F.when(F.col("ok2").isNotNull(), F.col("ok2") != F.col("flip"))
        on = F.col("ok2").isNull() & F.col("before2").isNotNull()
        moved = met.select(
            "issue_id",
            known.alias("ok"),
            F.when(F.col("ok2").isNotNull(), None).when(on, F.col("before2")).otherwise(F.col("before")).alias("before"),
            F.when(on, F.col("flip") != F.col("flip2")).otherwise(F.col("flip")).alias("flip"),
            (F.col("ok2").isNotNull() | on).alias("moves"),
        )
        moved = materialise(moved, "moved")
        if not moved.where("moves").take(1):
            break
        pointers = pointers.where("before IS NULL").unionByName(moved.drop("moves"))
        pointers = materialise(pointers, "pointers")
    return pointers.select("issue_id", "ok")


def effective_merges(merges: DataFrame, retired: DataFrame) -> DataFrame:
    """(issue_id, ok): outcome of running merges one after the other.

    ``merges(issue_id, at, retain_id, n)`` in the order ``at``, with ``n`` rows to retire each;
    ``retired(issue_id, row_id)``. A merge fails if an earlier effective merge retired the row
    it wants to keep.

    Instead of running them in sequence, every round settles all merges whose row to keep is
    certainly gone (an effective earlier merge retires it) or certainly there (no earlier merge
    that may still be effective does), and then all that hang on one of those through merges
    with a single rival each, however long that chain is: jobs grow with its logarithm. Only
    merges with several open rivals wait for the next round. The first open merge always
    settles, so the loop ends.
    """
    open_rows = merges.select(F.col("retain_id").alias("row_id")).distinct()
    contested = materialise(retired.join(shuffled(open_rows), "row_id", "left_semi"), "contested")
    state = materialise(merges.withColumn("ok", F.lit(None).cast("boolean")), "merge-state")
    while True:
        steps = join_counted(contested, state.select("issue_id", "n", "at", "ok"), "issue_id", "n", written=True)
        seen = state.join(shuffled(_first_two(steps)), "retain_id", "left")
        gone = F.col("goes").isNotNull() & (F.col("goes") < F.col("at"))
        stays = F.col("first").isNull() | (F.col("first") >= F.col("at"))
        settled = F.when(F.col("ok").isNotNull(), F.col("ok")).when(gone, False).when(stays, True)
        single = settled.isNull() & (F.col("second").isNull() | (F.col("second") >= F.col("at")))
        state = seen.select(
            "issue_id", "at", "retain_id", "n", settled.alias("ok"), F.when(single, F.col("before")).alias("before")
        )
        state = materialise(state, "merge-state")
        if state.where("ok IS NULL AND before IS NOT NULL").take(1):
            found = _follow(state).withColumnRenamed("ok", "found")
            state = state.join(shuffled(found), "issue_id").select("issue_id", "at", "retain_id", "n", F.coalesce("ok", "found").alias("ok"))
            state = materialise(state, "merge-state")
        else:
            state = state.drop("before")
        if not state.where("ok IS NULL").take(1):
            return state.select("issue_id", "ok")


def merge_components(merges: DataFrame, retired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure of all merges: (``issue_id, keeper``; ``issue_id, row_id, at`` of rows that go).

    Rows that merges connect are one record, whatever the order. It keeps the row that its first
    merge keeps; every other row goes, with each merge that names it. Arguments as for
    :func:`effective_merges`.
    """
    named = join_counted(
        retired, merges.select("issue_id", "at", F.col("retain_id").alias("keep"), "n"), "issue_id", "n", written=True
    ).drop("n")
    named = materialise(named, "named")
    labels = connected_components(named.select(F.col("keep").alias("a"), F.col("row_id").alias("b")))
    labels = materialise(labels, "components")
    # A merge without rows to retire, or with its own row only, is a component of its own.
    own = merges.join(shuffled(labels), F.col("retain_id") == F.col("node"), "left").select(
        "issue_id", "at", "retain_id", F.coalesce("component", "retain_id").alias("component")
    )
    own = materialise(own, "owned")
    keepers = own.groupBy("component").agg(F.min_by("retain_id", "at").alias("keeper"))
    # The skew join of the adaptive planner splits a component with many merges.
    kept = materialise(own.join(shuffled(keepers), "component").select("issue_id", "at", "retain_id", "keeper"), "kept")
    gone = named.select("issue_id", "row_id").unionByName(kept.select("issue_id", F.col("retain_id").alias("row_id")))
    gone = gone.join(shuffled(kept.select("issue_id", "at", "keeper")), "issue_id").where("row_id <> keeper").select("issue_id", "row_id", "at")
    return kept.select("issue_id", "keeper"), gone
