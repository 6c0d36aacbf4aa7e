"""CONSISTENCY: one key must carry one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.model import ROW_ID, Category, Findings, Role, Severity, findings, issue_id
from plumbline.operators.completeness import data_columns
from plumbline.operators.samples import first_k, sample_values
from plumbline.skew import HOT_ROWS, join_counted


def key_parts(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]


def key_text(parts: list[Column]) -> Column:
    """Unambiguous text of a key: every part carries its length."""
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def keyed_rows(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(key, label, row_id, value) of rows whose key has no null part; null values included."""
    parts = key_parts(keys)
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        key_text(parts).alias("key"),
        F.concat_ws(", ", *parts).alias("label"),
        F.col(ROW_ID).alias("row_id"),
        F.col(f"`{value}`").cast("string").alias("value"),
    )


def inconsistent_keys(rows: DataFrame) -> DataFrame:
    """(key, label, n) of keys with more than one distinct non-null value; n counts all their rows.

    The least and the greatest value tell whether there is more than one, so map tasks send
    one small row per key, however many values it has.
    """
    extremes = rows.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return extremes.where("low <> high").select("key", "label", "n")


def check_consistency(
    df: DataFrame,
    dataset_id: str,
    checks: list[tuple[list[str], str]],
    hot_rows: int = HOT_ROWS,
) -> Findings | None:
    found = None
    for keys, value in checks:
        if all(c in data_columns(df) for c in [*keys, value]):
            one = _check_pair(df, dataset_id, list(keys), value, hot_rows)
            found = one if found is None else found.union(one)
    return found


def _check_pair(df, dataset_id, keys, value, hot_rows) -> Findings:
    # One scan finds the keys, a second one lists their rows; both outcomes are written, and what
    # is shown comes from the rows listed. Clean rows leave no shuffle but the first.
    rows = keyed_rows(df, keys, value)
    bad = materialise(inconsistent_keys(rows), "inconsistent-keys")
    listed = join_counted(
        rows.drop("label"), bad.select("key", "n"), "key", "n", hot_rows, written=True
    )
    listed = materialise(listed.select("key", "row_id", "value"), "inconsistent-rows")
    columns = [*keys, value]
    key = issue_id(dataset_id, Category.CONSISTENCY, ",".join(columns), F.col("key"))
    members = listed.select(key.alias("issue_id"), "row_id", "value")
    firsts = listed.where("value IS NOT NULL").groupBy("key", "value").agg(F.min("row_id").alias("first_row"))
    shown = (
        first_k(firsts, "key", "first_row", 10)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("first_row", "value"))).alias("shown"))
        .join(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), "key")
    )
    issues = (
        bad.join(shown, "key")
        .withColumn("issue_id", key)
        .join(sample_values(members, 10), "issue_id", "left")
        .select(
            "issue_id",
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(Category.CONSISTENCY.value).alias("category"),
            F.lit(Severity.HIGH.value).alias("severity"),
            F.lit(1.0).alias("confidence"),
            F.format_string(
                f"Rows of one key disagree on '{value}'; ".replace("%", "%%") + "(%s) maps to %d different values: [%s%s].",
                "label",
                "kinds",
                F.array_join(F.transform("shown", lambda s: s["value"]), ", "),
                F.when(F.col("kinds") > 10, ", ...").otherwise(""),
            ).alias("description"),
            F.array(*[F.lit(c) for c in columns]).alias("affected_columns"),
            F.col("n").alias("affected_row_count"),
            "sample_values",
            F.lit("FLAG_ONLY").alias("action_type"),
            F.lit(value).alias("target_column"),
            F.lit(
                f"Nothing in the table says which '{value}' is meant; pick one by hand."
            ).alias("rationale"),
        )
    )
    return findings(issues, members.withColumn("role", F.lit(Role.TARGET.value)))
