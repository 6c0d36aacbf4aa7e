"""Entity resolution: links, clusters, canonical records, one issue per cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.model import (
    CLUSTER_HIGH,
    CLUSTER_LOW,
    ISSUE_ROWS,
    ISSUES,
    ROW_ID,
    Action,
    Category,
    Findings,
    Role,
    Severity,
    SignalConfig,
    findings,
    issue_id,
)
from plumbline.functions.text import is_blank
from plumbline.operators.components import connected_components
from plumbline.operators.entity import link_profiles, profiles_of, signal_rows
from plumbline.operators.evidence import cluster_evidence
from plumbline.operators.samples import first_k
from plumbline.operators.tiles import BLOCK_ROWS
from plumbline.skew import join_counted


@dataclass(frozen=True)
class Resolution:
    """members(row_id, cluster, is_retained), clusters(...), findings, one-row counters."""

    members: DataFrame | None
    clusters: DataFrame | None
    findings: Findings
    counters: DataFrame | None
    note: str = ""


def elect(members: DataFrame) -> DataFrame:
    """(cluster, retain_id, size): the fullest row per cluster, the lowest id on a tie."""
    return members.groupBy("cluster").agg(
        F.max_by("row_id", F.struct("filled", -F.col("row_id"))).alias("retain_id"),
        F.count(F.lit(1)).alias("size"),
    )


def canonical_records(df: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, column, value): the retained row, its gaps filled from the other members.

    A gap takes the most frequent non-blank text of the others, the first one in row order
    on a tie. ``members(row_id, cluster, is_retained)``. Columns empty everywhere are left out.
    """
    columns = [c for c in df.columns if c != ROW_ID]
    rows = df.withColumnRenamed(ROW_ID, "row_id").join(members, "row_id")
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ]
    long = rows.select("cluster", "row_id", "is_retained", F.explode(F.array(*cells)).alias("cell"))
    long = long.select("cluster", "row_id", "is_retained", "cell.*").where(
        F.col("value").isNotNull() & ~is_blank(F.col("value"))
    )
    counted = long.groupBy("cluster", "column", "value").agg(
        F.max(F.col("is_retained").cast("int")).alias("own"),
        F.count_if(~F.col("is_retained")).alias("n"),
        F.min(F.when(~F.col("is_retained"), F.col("row_id"))).alias("first"),
    )
    return counted.groupBy("cluster", "column").agg(
        F.max_by("value", F.struct("own", "n", -F.coalesce("first", F.lit(0)))).alias("value")
    )


def resolve_entities(
    df: DataFrame,
    dataset_id: str,
    config: SignalConfig,
    block_rows: int = BLOCK_ROWS,
) -> Resolution:
    config = config.present_in([c for c in df.columns if c != ROW_ID])
    if not config.active():
        spark = df.sparkSession
        none = findings(spark.createDataFrame([], ISSUES), spark.createDataFrame([], ISSUE_ROWS))
        return Resolution(None, None, none, None, "skipped: no configured column is in the table")
    signals = config.active()
    rows = signal_rows(df, config)
    profiles = materialise(profiles_of(rows, signals), "profiles")
    links = materialise(link_profiles(profiles, config, block_rows), "stars")
    labels = connected_components(links.where("a >= 0").select("a", "b"))
    clustered = (
        profiles.join(labels, profiles.rep == labels.node, "left")
        .withColumn("cluster", F.coalesce("component", F.when(F.col("n") > 1, F.col("rep"))))
        .where("cluster IS NOT NULL")
        .drop("node", "component")
    )
    clustered = materialise(clustered, "clustered")
    members = join_counted(
        rows.select("profile", "row_id", "filled"),
        clustered.select("profile", "n", "cluster"),
        "profile",
        "n",
        written=True,
    )
    members = materialise(members.select("row_id", "cluster", "filled", "profile", "n"), "members")
    elected = elect(members)
    roles = join_counted(
        members.select("row_id", "cluster"), elected, "cluster", "size"
    ).select("row_id", "cluster", (F.col("row_id") == F.col("retain_id")).alias("is_retained"))

    copies = members.where("n > 1").select("profile", "row_id")
    second = first_k(copies, "profile", "row_id", 2).groupBy("profile").agg(F.max("row_id").alias("second"))
    marked = materialise(clustered.join(second, "profile", "left"), "marked")
    named = members.select("cluster", "row_id", "profile")
    if "name" in signals:
        named = named.join(clustered.select("profile", "name"), "profile").drop("profile")
    evidence = cluster_evidence(marked, named, config, marked.count(), 5, block_rows)
    # The best inner pair of a cluster is a link; copies are as alike as can be.
    best = links.where("a >= 0").groupBy(F.col("a").alias("rep")).agg(F.max("best").alias("best"))
    scores = marked.select("cluster", "rep", "n").join(best, "rep", "left")
    confidence = scores.groupBy("cluster").agg(
        F.max(F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n") > 1, 1.0).otherwise(0.0))).alias("confidence")
    )

    more = F.when(F.col("kinds") > 5, F.format_string(" (and %d more)", F.col("kinds") - 5)).otherwise("")
    summary = F.when(
        F.size("evidence") > 0, F.concat(F.array_join("evidence", "; "), F.coalesce(more, F.lit("")))
    ).otherwise(F.format_string("Composite similarity: %.0f%%", F.col("confidence") * 100))
    clusters = (
        elected.join(confidence, "cluster")
        .join(evidence, "cluster", "left")
        .withColumn("evidence_summary", summary)
        .withColumn("issue_id", issue_id(dataset_id, Category.DEDUPLICATION, "entity", F.col("cluster").cast("string")))
    )
    clusters = materialise(
        clusters.select("issue_id", "cluster", "retain_id", "size", "confidence", "evidence_summary"),
        "clusters",
    )
    return Resolution(
        roles,
        clusters,
        _cluster_findings(df, dataset_id, clusters, roles),
        _counters(df, profiles, links, clusters),
    )


def _cluster_findings(df, dataset_id, clusters, roles) -> Findings:
    high = F.col("confidence") >= CLUSTER_HIGH
    percent = F.col("confidence") * 100
    issues = clusters.select(
        "issue_id",
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(Category.DEDUPLICATION.value).alias("category"),
        F.when(high, Severity.HIGH.value).otherwise(Severity.MEDIUM.value).alias("severity"),
        "confidence",
        F.format_string(
            "%d records look like one (confidence %.0f%%): %s. Row %d has the most values.",
            "size",
            percent,
            "evidence_summary",
            "retain_id",
        ).alias("description"),
        F.array().cast("array<string>").alias("affected_columns"),
        F.col("size").alias("affected_row_count"),
        F.when(high, Action.MERGE_ROWS.value).otherwise(Action.FLAG_ONLY.value).alias("action_type"),
        F.when(
            high,
            F.format_string(
                f"From {CLUSTER_HIGH * 100:.0f}%% on records merge; at %.0f%% these go into row %d.",
                percent,
                "retain_id",
            ),
        )
        .otherwise(
            F.format_string(
                f"%.0f%% lies between {CLUSTER_LOW * 100:.0f}%% and {CLUSTER_HIGH * 100:.0f}%%: someone has to look.",
                percent,
            )
        )
        .alias("rationale"),
    )
    by_cluster = clusters.select("cluster", "issue_id", "size", high.alias("high"))
    rows = join_counted(roles, by_cluster, "cluster", "size", written=True)
    role = F.when(F.col("is_retained"), Role.RETAIN.value).otherwise(Role.RETIRE.value)
    values = (
        canonical_records(df, roles)
        .join(by_cluster.where("high").select("cluster", "issue_id"), "cluster")
        .select("issue_id", "column", "value")
    )
    return findings(issues, rows.select("issue_id", "row_id", role.alias("role")), values)


def _counters(df, profiles, links, clusters) -> DataFrame:
    """Pairs that an all-pairs run would score, pairs scored, links, clusters by strength."""
    total = df.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
    copies = profiles.agg(F.sum(F.expr("n * (n - 1) / 2D")).alias("copies"))
    found = links.where("a < 0").agg(F.sum("links").alias("links"), F.sum("scored").alias("scored"))
    kinds = clusters.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("confidence") >= CLUSTER_HIGH).alias("merge_clusters"),
    )
    one = F.lit(1).alias("_one")
    out = total.select("*", one)
    for part in (copies, found, kinds):  # four single rows
        out = out.join(F.broadcast(part.select("*", one)), "_one")
    return out.select(
        F.expr("cast(n * (n - 1) / 2 as decimal(38,0))").alias("row_pairs"),
        F.coalesce("scored", F.lit(0)).alias("profile_pairs_scored"),
        (F.coalesce("links", F.lit(0.0)) + F.coalesce("copies", F.lit(0.0))).cast("decimal(38,0)").alias("links"),
        "clusters",
        "merge_clusters",
        (F.col("clusters") - F.col("merge_clusters")).alias("review_clusters"),
    )
