"""FORMAT_VALIDITY: noisy amounts and unreadable dates in hinted text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text
from plumbline.model import AMOUNT_PLACEHOLDER, Action, Category
from plumbline.operators.completeness import data_columns, is_string
from plumbline.operators.row_tests import RowTest


@F.pandas_udf(T.BooleanType())
def _parses_as_date(values: pd.Series) -> pd.Series:
    """Free-form date test; each distinct text of the batch is parsed once."""
    from dateutil import parser

    def readable(value: str) -> bool:
        try:
            parser.parse(value, fuzzy=False)
        except Exception:  # noqa: BLE001 - any parser failure means "not a date"
            return False
        return True

    known = {v: readable(v) for v in values.dropna().unique()}
    return values.map(known)


def unreadable_date(value: Column, formats: list[str] | None = None) -> Column:
    """True where a text matches no fixed pattern and does not parse.

    Only texts that miss the patterns reach the parser. With ``formats`` (Spark datetime
    patterns) the parser is Spark's own and the whole test stays in the JVM.
    """
    shaped = text.matches_date_pattern(value)
    rest = F.when(~shaped, value)
    if formats is None:
        parsed = F.coalesce(_parses_as_date(rest), F.lit(False))
    else:
        parsed = F.coalesce(*[F.try_to_timestamp(rest, F.lit(f)) for f in formats]).isNotNull()
    return value.isNotNull() & ~shaped & ~parsed


def format_tests(df: DataFrame, date_formats: list[str] | None = None) -> list[RowTest]:
    tests = []
    for c in data_columns(df):
        if not is_string(df, c):
            continue
        cell, name = F.col(f"`{c}`"), c.replace("%", "%%")
        if text.name_matches(c, text.AMOUNT_NAME_HINTS):
            tests.append(
                RowTest(
                    category=Category.FORMAT_VALIDITY,
                    key=f"{c}|amount",
                    column=c,
                    failing=text.amount_is_dirty(cell),
                    description=lambda m, name=name: F.format_string(
                        f"By its name '{name}' holds amounts; %d row(s) are not written as plain numbers.",
                        m["n"],
                    ),
                    rationale="The fix removes signs and separators around digits; a text without a "
                    "number stays as it is.",
                    confidence=0.90,
                    action=Action.SET_VALUE,
                    canonical_value=AMOUNT_PLACEHOLDER,
                )
            )
        if text.name_matches(c, text.DATE_NAME_HINTS):
            tests.append(
                RowTest(
                    category=Category.FORMAT_VALIDITY,
                    key=f"{c}|date",
                    column=c,
                    failing=unreadable_date(cell, date_formats),
                    description=lambda m, name=name: F.format_string(
                        f"By its name '{name}' holds dates; %d row(s) match no known way to write one.",
                        m["n"],
                    ),
                    rationale="Which number is the day is a guess; someone who knows the source decides.",
                    confidence=0.85,
                )
            )
    return tests
