"""DOMAIN_RULE: caller-supplied conditions on one column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import Action, Category, DomainRule
from plumbline.operators.completeness import data_columns
from plumbline.operators.row_tests import RowTest


def rule_holds(rule: DomainRule) -> Column:
    """The rule as a condition. Null outcomes count as failures, as errors do in Python."""
    cell = F.col(f"`{rule.column}`")
    if not rule.python:
        held = F.expr(rule.rule) if isinstance(rule.rule, str) else rule.rule(cell)
        return F.coalesce(held, F.lit(False))
    predicate = rule.rule

    @F.arrow_udf(T.BooleanType())
    def check(values: pa.Array) -> pa.Array:
        def holds(value) -> bool:
            try:
                return bool(predicate(value))
            except Exception:  # noqa: BLE001 - an error in the rule is a failure of the value
                return False

        return pa.array([v is None or holds(v) for v in values.to_pylist()], pa.bool_())

    return check(cell)


def rule_tests(df: DataFrame, rules: list[DomainRule]) -> list[RowTest]:
    tests = []
    for i, rule in enumerate(rules):
        if rule.column not in data_columns(df):
            continue
        fix = rule.fix_value
        text = (
            f"Rule for '{rule.column}': {rule.description} ".replace("%", "%%")
            + "Broken by %d row(s)."
        )
        tests.append(
            RowTest(
                category=Category.DOMAIN_RULE,
                key=f"{rule.column}|{rule.description}",
                column=rule.column,
                failing=F.col(f"`{rule.column}`").isNotNull() & ~rule_holds(rule),
                description=lambda m, text=text: F.format_string(text, m["n"]),
                rationale=(
                    "The rule says what is wrong, not what is right."
                    if fix is None
                    else f"The rule names its own replacement, {fix!r}."
                ),
                severity=rule.severity,
                action=Action.FLAG_ONLY if fix is None else Action.SET_VALUE,
                canonical_value=None if fix is None else str(fix),
            )
        )
    return tests
