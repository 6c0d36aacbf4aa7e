"""OUTLIER: values more than sigma sample standard deviations from the column mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import OUTLIER_MIN_VALUES, OUTLIER_SIGMA, Category
from plumbline.operators.completeness import data_columns
from plumbline.operators.row_tests import RowTest


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if isinstance(df.schema[c].dataType, T.NumericType)]


def number(df: DataFrame, column: str) -> Column:
    """The cell as a double, NaN folded to null (one NaN would poison every moment)."""
    cell = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(cell), cell.cast("double"))
    return cell.cast("double")


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with count, mean and sample deviation of every column, in one pass."""
    aggregates = []
    for i, c in enumerate(columns):
        x = number(df, c)
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
        ]
    return df.agg(*aggregates)


def outlier_tests(df: DataFrame, sigma: float = OUTLIER_SIGMA) -> list[RowTest]:
    columns = numeric_columns(df)
    if not columns:
        return []
    # Three numbers per column: the only values that come to the driver.
    stats = column_moments(df, columns).first()
    tests = []
    for i, c in enumerate(columns):
        n, mean, std = stats[f"n{i}"], stats[f"mean{i}"], stats[f"std{i}"]
        if n < OUTLIER_MIN_VALUES or not std:
            continue
        z = F.abs((number(df, c) - F.lit(mean)) / F.lit(std))
        failing = z > sigma
        name = c.replace("%", "%%")
        text = (
            f"%d cells of '{name}' lie over {sigma:.0f} sigma away from {mean:,.2f} "
            f"(sigma {std:,.2f}; the farthest is %.1f sigma off). First ones: %s."
        )
        tests.append(
            RowTest(
                category=Category.OUTLIER,
                key=c,
                column=c,
                failing=F.coalesce(failing, F.lit(False)),
                description=lambda m, text=text: F.format_string(
                    text, m["n"], m["max_z"], F.array_join(F.slice(m["samples"], 1, 5), ", ")
                ),
                rationale="Rare is not wrong: nothing is changed before someone has looked.",
                confidence=0.80,
                samples=10,
                extras={"max_z": F.max(F.when(failing, z))},
            )
        )
    return tests
