"""DEDUPLICATION in one column: spellings that are at least 75 % alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.functions import similarity, text
from plumbline.model import (
    FUZZY_HIGH,
    FUZZY_LOW,
    FUZZY_MIN_VALUES,
    ROW_ID,
    Action,
    Category,
    Findings,
    Role,
    Severity,
    findings,
    issue_id,
)
from plumbline.operators.completeness import data_columns, is_string
from plumbline.operators.tiles import BLOCK_ROWS, block_count, by_tile, grid_pairs, self_tiles

_ROUNDING = 1e-3  # the bounds use single precision


def column_values(df: DataFrame, column: str) -> DataFrame:
    """(value, norm, n, first_row): the distinct non-null spellings of a column."""
    cell = F.col(f"`{column}`").cast("string")
    return (
        df.select(cell.alias("value"), F.col(ROW_ID).alias("row_id"))
        .where("value IS NOT NULL")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
        .withColumn("norm", text.fold(F.col("value")))
    )


def _score_tile(cutoff: float):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        texts = similarity.Texts(tile["norm"].tolist())
        out = []
        for left, right, triangular in grid_pairs(tile["_side"].to_numpy()):
            common = similarity.common_grid(texts.histogram[left], texts.histogram[right])
            least = np.minimum(texts.least[left][:, None], texts.least[right][None, :])
            bound = similarity.upper_bound(common, least)
            bound = np.minimum(bound, similarity.gram_bound(texts, left, right))
            keep = bound >= cutoff - _ROUNDING
            if triangular:
                keep &= left[:, None] < right[None, :]
            rows, cols = np.nonzero(keep)
            ia, ib = left[rows], right[cols]
            score = similarity.name_score(texts, ia, texts, ib, bound[rows, cols])
            good = score >= cutoff
            out.append(
                pd.DataFrame(
                    {
                        "norm_a": texts.texts[ia[good]],
                        "norm_b": texts.texts[ib[good]],
                        "score": score[good],
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame({"norm_a": [], "norm_b": [], "score": []})

    return run


def similar_texts(
    texts: DataFrame, total: int, cutoff: float = FUZZY_LOW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(norm_a, norm_b, score) for all unordered pairs of distinct texts at ``cutoff`` or above.

    Exact: the character bound only removes pairs that cannot reach the cutoff.
    """
    blocks = block_count(total, texts.sparkSession.sparkContext.defaultParallelism, block_rows)
    tiles = self_tiles(texts.select("norm"), "norm", blocks)
    return by_tile(tiles, blocks * (blocks + 1) // 2).applyInPandas(
        _score_tile(cutoff), "norm_a string, norm_b string, score double"
    )


def fuzzy_pairs(values: DataFrame, cutoff: float = FUZZY_LOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of spellings of one column.

    Every normal form is represented by its last-seen spelling. A spelling is paired with
    the representative of each similar form, including its own; so of three spellings with
    one normal form only the pairs with the last one are reported. The first-seen
    spelling of a pair of representatives comes first.
    """
    norms = values.groupBy("norm").agg(
        F.max_by("value", "first_row").alias("rep"), F.max("first_row").alias("rep_first")
    )
    norms = materialise(norms, "norms")
    similar = similar_texts(norms, norms.count(), cutoff, block_rows)
    own = norms.select(F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"), F.lit(100.0).alias("score"))
    both = similar.unionByName(
        similar.select(F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b"), "score")
    ).unionByName(own)
    a = values.join(norms.withColumnRenamed("norm", "_n"), F.col("norm") == F.col("_n")).select(
        F.col("norm").alias("norm_a"),
        F.col("value").alias("a"),
        F.col("n").alias("n_a"),
        F.col("first_row").alias("first_a"),
        (F.col("value") == F.col("rep")).alias("is_rep"),
    )
    b = values.join(
        norms.select(F.col("rep").alias("value")), "value", "left_semi"
    ).select(
        F.col("norm").alias("norm_b"),
        F.col("value").alias("b"),
        F.col("n").alias("n_b"),
        F.col("first_row").alias("first_b"),
    )
    return (
        both.join(a, "norm_a")
        .join(b, "norm_b")
        .where("a <> b AND (NOT is_rep OR first_a < first_b)")
        .select("a", "b", "score", "n_a", "n_b", "first_a", "first_b")
    )


def fuzzy_columns_of(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_string(df, c)]


def check_deduplication(
    df: DataFrame,
    dataset_id: str,
    columns: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> Findings | None:
    found = None
    for column in fuzzy_columns_of(df) if columns is None else columns:
        if column in data_columns(df):
            one = _check_column(df, dataset_id, column, block_rows)
            if one is not None:
                found = one if found is None else found.union(one)
    return found


def _check_column(df, dataset_id, column, block_rows) -> Findings | None:
    values = materialise(column_values(df, column), "values")
    if len(values.take(FUZZY_MIN_VALUES)) < FUZZY_MIN_VALUES:
        return None
    merge = F.col("score") >= FUZZY_HIGH
    pairs = fuzzy_pairs(values, FUZZY_LOW, block_rows).withColumns(
        {
            "issue_id": issue_id(
                dataset_id,
                Category.DEDUPLICATION,
                column,
                F.concat(F.length("a").cast("string"), F.lit(":"), F.col("a"), F.col("b")),
            ),
            "canonical": text.canonical_form(F.col("a"), F.col("b")),
            "merge": merge,
        }
    )
    pairs = materialise(pairs, "fuzzy-pairs")
    name = column.replace("%", "%%")
    issues = pairs.select(
        "issue_id",
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(Category.DEDUPLICATION.value).alias("category"),
        F.when(F.col("merge"), Severity.HIGH.value)
        .otherwise(Severity.MEDIUM.value)
        .alias("severity"),
        F.round(F.col("score") / 100, 4).alias("confidence"),
        F.format_string(
            f"Two spellings in '{name}' are close: '%s' and '%s' score %.0f; the fuller form is '%s'.",
            "a",
            "b",
            "score",
            "canonical",
        ).alias("description"),
        F.array(F.lit(column)).alias("affected_columns"),
        (F.col("n_a") + F.col("n_b")).alias("affected_row_count"),
        F.array("a", "b").alias("sample_values"),
        F.when(F.col("merge"), Action.MERGE_ROWS.value)
        .otherwise(Action.FLAG_ONLY.value)
        .alias("action_type"),
        F.lit(column).alias("target_column"),
        F.when(F.col("merge"), F.col("canonical")).alias("canonical_value"),
        F.when(
            F.col("merge"),
            F.format_string(
                "A score of %.0f is enough to write both as '%s'.",
                "score",
                "canonical",
            ),
        )
        .otherwise(
            F.format_string(
                f"A score of %.0f is too low to merge unseen (from {FUZZY_HIGH}).",
                "score",
            )
        )
        .alias("rationale"),
    )
    # A spelling may be in many pairs and on many rows; both are part of the result. The
    # skew join of the adaptive planner splits the rows of a hot spelling.
    members = pairs.select(
        "issue_id",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("value"), F.col("first_a").alias("keep"), F.lit(True).alias("is_a")),
                F.struct(F.col("b").alias("value"), F.lit(None).cast("long").alias("keep"), F.lit(False).alias("is_a")),
            )
        ).alias("m"),
        "merge",
    ).select("issue_id", "m.*", "merge")
    rows = df.select(F.col(f"`{column}`").cast("string").alias("value"), F.col(ROW_ID).alias("row_id"))
    role = (
        F.when(F.col("merge") & ~F.col("is_a"), Role.RETIRE.value)
        .when(F.col("merge") & (F.col("row_id") == F.col("keep")), Role.RETAIN.value)
        .otherwise(Role.TARGET.value)
    )
    return findings(issues, rows.join(members, "value").select("issue_id", "row_id", role.alias("role")))
