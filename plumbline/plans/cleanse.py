"""Applying approved fixes: all of them in one pass over the table, with an audit trail.

Fixes take effect in a fixed order: retype columns, set values, clear values, merge rows, drop
rows; within an action by ``seq`` (if the issues carry one) and issue id. Instead of one copy of
the table per issue there is one projection for all retypes, one join for all cell changes
(the last writer of a cell wins) and one anti join for all removed rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.durable import materialise
from plumbline.functions.text import amount_cleaned, amount_value
from plumbline.model import (
    AMOUNT_PLACEHOLDER,
    AUDIT,
    AUDIT_CELLS,
    ROW_ID,
    Action,
    Role,
    Status,
    conform,
    plan_time,
)
from plumbline.operators.cells import fit, nested_columns, retype
from plumbline.operators.merges import POLICIES, effective_merges, merge_components
from plumbline.skew import join_counted, shuffled, with_row_counts

_PHASE = {
    Action.RETYPE_COLUMN.value: 1,
    Action.SET_VALUE.value: 2,
    Action.CLEAR_VALUE.value: 3,
    Action.MERGE_ROWS.value: 4,
    Action.DROP_ROW.value: 5,
}


@dataclass(frozen=True)
class Cleansed:
    table: DataFrame
    issues: DataFrame  # with status EXECUTED where the fix took effect
    results: DataFrame  # (issue_id, action_type, success, rows_affected, error)
    totals: DataFrame  # one row: total, succeeded, failed, skipped, all_succeeded
    audit: DataFrame
    audit_cells: DataFrame


def execute_approved(
    df: DataFrame,
    issues: DataFrame,
    issue_rows: DataFrame,
    canonical_values: DataFrame,
    actor: str,
    actor_role: str = "",
    only: list[str] | None = None,
    at: Column | None = None,
    merge_policy: str = "sequential",
) -> Cleansed:
    """Run every approved, actionable issue; others count as skipped.

    With ``only``, just the named issues run, and naming one that is not approved or only a
    flag is a failure that is put on record. ``merge_policy`` says what overlapping merges do:
    ``sequential``, one after the other, where a merge fails whose row to keep is gone; or
    ``components``, where rows that merges connect become one, the row that the first of these
    merges keeps, and later merges write their values there.
    """
    if merge_policy not in POLICIES:
        raise ValueError(f"merge_policy is one of {', '.join(POLICIES)}")
    now = plan_time() if at is None else at
    if "seq" not in issues.columns:
        issues = issues.withColumn("seq", F.lit(0).cast("long"))
    issues = materialise(with_row_counts(issues, issue_rows, "_rows"), "issues")
    chosen = issues if only is None else issues.where(F.col("issue_id").isin(only))
    flag_only = F.coalesce(F.col("action_type"), F.lit("NONE")).isin("NONE", Action.FLAG_ONLY.value)
    approved = F.col("status") == Status.APPROVED.value
    work = chosen.where(approved & ~flag_only)
    refused = chosen.where(~approved | flag_only) if only is not None else None

    typed, retyped, retype_cells = _retype(df, work)
    merging = work.where(F.col("action_type") == Action.MERGE_ROWS.value).select("issue_id")
    misfits = _misfits(typed, canonical_values.join(shuffled(merging), "issue_id", "left_semi"))
    planned = work.where(F.col("action_type") != Action.RETYPE_COLUMN.value).join(shuffled(misfits), "issue_id", "left")
    planned = planned.withColumns(
        {
            "error": F.coalesce(_plan_error(typed), F.col("misfit")),
            "at": F.struct("seq", "issue_id"),
            "phase": _case(F.col("action_type"), _PHASE),
        }
    )
    planned = materialise(planned.drop("misfit"), "planned")
    good = planned.where("error IS NULL")
    roles = join_counted(
        issue_rows,
        good.select("issue_id", "action_type", "phase", "at", F.col("_rows").alias("n")),
        "issue_id",
        "n",
        written=True,
    )
    ids = typed.select(F.col(ROW_ID).alias("row_id"))
    roles = materialise(roles.join(shuffled(ids), "row_id", "left_semi"), "roles")

    merge_state, first_gone = _removals(good, roles, merge_policy)
    flat_values = canonical_values.where(~F.col("column").isin(nested_columns(typed)))
    events = materialise(_cell_events(good, roles, merge_state, flat_values), "events")
    cleaned = _apply(typed, events, first_gone)

    results = _results(planned, retyped, roles, merge_state, first_gone, refused)
    results = materialise(results, "results")
    done = results.where("success").select("issue_id", F.lit(True).alias("_done"))
    written = (
        issues.join(shuffled(done), "issue_id", "left")
        .withColumns(
            {
                "status": F.when(F.col("_done"), Status.EXECUTED.value).otherwise(F.col("status")),
                "executed_at": F.when(F.col("_done"), now).otherwise(F.col("executed_at")),
            }
        )
        .drop("_done", "_rows")
    )
    totals = _totals(issues if only is None else chosen, results)
    audit = _audit(issues, results, actor, actor_role, now)
    cells = _audit_cells(typed, events, first_gone)
    cells = cells.unionByName(retype_cells) if retype_cells is not None else cells
    entries = audit.select("entry_id", "issue_id")
    cells = conform(cells.join(shuffled(entries), "issue_id"), AUDIT_CELLS)
    return Cleansed(cleaned, written, results, totals, audit, cells)


def _case(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


# --- retyping ----------------------------------------------------------------------------


def _retype(df: DataFrame, work: DataFrame):
    """Cast columns as approved. Column-level changes are few, so they are read here."""
    columns = [c for c in df.columns if c != ROW_ID]
    changes = (
        work.where(F.col("action_type") == Action.RETYPE_COLUMN.value)
        .select("seq", "issue_id", "target_column", "target_dtype")
        .orderBy("seq", "issue_id")
        .collect()
    )
    if not changes:
        return df, [], None
    outcome, cells, rows = [], [], df.count()
    for change in changes:
        column, error = change.target_column, None
        if not column or not change.target_dtype:
            error = "RETYPE_COLUMN names no target_column or no target_dtype."
        elif column not in columns:
            error = f"Column '{column}' not found."
        else:
            try:
                new = retype(df, column, change.target_dtype)
            except ValueError as failure:
                error = str(failure)
        if error is None:
            before = df
            df = df.withColumn(column, new)
            cells.append(_retype_cells(before, df, column, new, change.issue_id))
        outcome.append((change.issue_id, Action.RETYPE_COLUMN.value, error is None, 0 if error else rows, error))
    return df, outcome, reduce(DataFrame.unionByName, cells) if cells else None


def _retype_cells(before: DataFrame, after: DataFrame, column: str, retyped: Column, issue: str) -> DataFrame:
    """The types and the first three values before and after."""
    old, new = F.col(f"`{column}`").cast("string"), F.col("_new")
    both = before.withColumn("_new", retyped)
    first = both.orderBy(ROW_ID).limit(3).select(
        F.col(ROW_ID).alias("row_id"), old.alias("before"), new.cast("string").alias("after")
    )
    types = before.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("row_id"),
        F.lit(before.schema[column].dataType.simpleString()).alias("before"),
        F.lit(after.schema[column].dataType.simpleString()).alias("after"),
    )
    return types.unionByName(first).withColumns(
        {"issue_id": F.lit(issue), "column": F.lit(column)}
    )


# --- planning ----------------------------------------------------------------------------


def _plan_error(df: DataFrame) -> Column:
    """Why an issue cannot run, from its own fields and the table's columns."""
    action, column, value = F.col("action_type"), F.col("target_column"), F.col("canonical_value")
    kinds = {f.name: f.dataType for f in df.schema if f.name != ROW_ID}
    fits = _fits(df, column, value)
    given = action.isin(Action.SET_VALUE.value, Action.MERGE_ROWS.value) & column.isNotNull() & value.isNotNull()
    cell_action = action.isin(Action.SET_VALUE.value, Action.CLEAR_VALUE.value)
    return (
        F.when(~action.isin(list(_PHASE)), F.concat(F.lit("No such fix: "), action))
        .when(cell_action & column.isNull(), F.concat(action, F.lit(" names no target_column.")))
        .when(
            cell_action & ~column.isin(list(kinds)),
            F.concat(F.lit("Column '"), column, F.lit("' not found.")),
        )
        .when(
            given & ~fits,
            _misfit_text(column, value),
        )
    )


def _fits(df: DataFrame, column: Column, value: Column) -> Column:
    """Whether a text value fits the column it names; unknown columns take anything."""
    fits = F.lit(True)
    for field in df.schema:
        if field.name != ROW_ID and not isinstance(field.dataType, T.StringType):
            fits = F.when(column == field.name, fit(value, field.dataType).isNotNull()).otherwise(fits)
    return fits | (value == AMOUNT_PLACEHOLDER)


def _misfit_text(column: Column, value: Column) -> Column:
    return F.concat(F.lit("Value '"), value, F.lit("' does not fit column '"), column, F.lit("'."))


def _misfits(df: DataFrame, canonical_values: DataFrame) -> DataFrame:
    """(issue_id, misfit): merges whose record has a value that its column cannot hold.

    Nested columns are left out: a merge keeps the retained row's cell there.
    """
    column, value = F.col("column"), F.col("value")
    odd = canonical_values.where(value.isNotNull() & ~column.isin(nested_columns(df)) & ~_fits(df, column, value))
    return odd.groupBy("issue_id").agg(F.min(_misfit_text(column, value)).alias("misfit"))


def _removals(good: DataFrame, roles: DataFrame, policy: str):
    """Merge outcomes, and per removed row the first action that removed it."""
    merges = good.where(F.col("action_type") == Action.MERGE_ROWS.value)
    keep = roles.where(
        (F.col("action_type") == Action.MERGE_ROWS.value) & (F.col("role") == Role.RETAIN.value)
    ).select("issue_id", F.col("row_id").alias("retain_id"))
    runnable = merges.select(
        "issue_id",
        "at",
        "target_column",
        "canonical_value",
        F.col("_rows").alias("n"),
    ).join(shuffled(keep), "issue_id")
    retired = roles.where((F.col("role") == Role.RETIRE.value) & (F.col("action_type") == Action.MERGE_ROWS.value))
    ordered = materialise(runnable.select("issue_id", "at", "retain_id", "n"), "merge-order")
    phase = F.lit(_PHASE[Action.MERGE_ROWS.value]).alias("phase")
    if policy == "components":
        keepers, gone = merge_components(ordered, retired.select("issue_id", "row_id"))
        state = runnable.drop("retain_id").join(shuffled(keepers), "issue_id").withColumn("ok", F.lit(True))
        state = materialise(state.withColumnRenamed("keeper", "retain_id"), "merges")
        effective = gone.select("row_id", "issue_id", phase, "at")
    else:
        state = effective_merges(ordered, retired.select("issue_id", "row_id"))
        state = materialise(runnable.join(shuffled(state), "issue_id"), "merges")
        effective = join_counted(
            retired.select("row_id", "issue_id", "phase", "at"),
            state.where("ok").select("issue_id", "n"),
            "issue_id",
            "n",
            written=True,
        ).drop("n")
    dropped = roles.where(
        (F.col("action_type") == Action.DROP_ROW.value) & (F.col("role") == Role.DROP.value)
    ).select("row_id", "issue_id", "phase", "at")
    first = (
        effective.unionByName(dropped)
        .groupBy("row_id")
        .agg(F.min(F.struct("phase", "at")).alias("first"))
        .select("row_id", F.col("first.at.issue_id").alias("issue_id"), F.col("first.phase").alias("phase"))
    )
    return state, materialise(first, "removed")


# --- cell changes ------------------------------------------------------------------------


def _cell_events(good, roles, merge_state, canonical_values) -> DataFrame:
    """(row_id, column, phase, at, issue_id, value, strip): every write to a cell, in long form."""
    cell = good.where(F.col("action_type").isin(Action.SET_VALUE.value, Action.CLEAR_VALUE.value))
    plans = cell.select(
        "issue_id",
        F.col("target_column").alias("column"),
        F.when(F.col("action_type") == Action.SET_VALUE.value, F.col("canonical_value")).alias("value"),
        F.col("_rows").alias("n"),
    )
    targets = roles.where(F.col("role") == Role.TARGET.value).select("issue_id", "row_id", "phase", "at")
    direct = join_counted(targets, plans, "issue_id", "n", written=True).drop("n")

    winners = merge_state.where("ok").select("issue_id", "at", "retain_id", "target_column", "canonical_value")
    records = canonical_values.join(shuffled(winners.select("issue_id", "at", "retain_id")), "issue_id")
    scalars = (
        winners.where("target_column IS NOT NULL AND canonical_value IS NOT NULL")
        .join(shuffled(canonical_values.select("issue_id")), "issue_id", "left_anti")
        .select(
            "issue_id",
            F.col("target_column").alias("column"),
            F.col("canonical_value").alias("value"),
            "at",
            "retain_id",
        )
    )
    merged = (
        records.select("issue_id", "column", "value", "at", "retain_id")
        .unionByName(scalars)
        .select(
            "issue_id",
            F.col("retain_id").alias("row_id"),
            F.lit(_PHASE[Action.MERGE_ROWS.value]).alias("phase"),
            "at",
            "column",
            "value",
        )
    )
    strip = F.coalesce(F.col("value") == AMOUNT_PLACEHOLDER, F.lit(False))
    return direct.unionByName(merged).withColumn("strip", strip)


def _new_cell(cell: Column, kind: T.DataType, value: Column, strip: Column) -> Column:
    text = cell.cast("string")
    stripped = F.when(amount_value(text).isNotNull(), amount_cleaned(text)).otherwise(text)
    return F.when(strip, fit(stripped, kind)).otherwise(fit(value, kind))


def _apply(df: DataFrame, events: DataFrame, removed: DataFrame) -> DataFrame:
    """The table with the last write of every cell, without the removed rows.

    Both joins use the row id, so the table is shuffled once at most.
    """
    last = (
        events.repartition("row_id")  # serves both aggregations and the join
        .groupBy("row_id", "column")
        .agg(F.max_by(F.struct("value", "strip"), F.struct("phase", "at")).alias("write"))
        .groupBy(F.col("row_id").alias(ROW_ID))
        # one entry per changed column of one row
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "write"))).alias("_writes"))
    )
    joined = df.join(shuffled(last), ROW_ID, "left").join(
        shuffled(removed.select(F.col("row_id").alias(ROW_ID))), ROW_ID, "left_anti"
    )
    out = []
    for field in df.schema:
        cell = F.col(f"`{field.name}`")
        if field.name != ROW_ID:
            write = F.col("_writes")[field.name]
            new = _new_cell(cell, field.dataType, write["value"], write["strip"])
            cell = F.when(write.isNotNull(), new).otherwise(cell)
        out.append(cell.alias(field.name))
    return joined.select(*out)


# --- results and audit -------------------------------------------------------------------


def _results(planned, retyped, roles, merge_state, removed, refused) -> DataFrame:
    spark = planned.sparkSession
    targets = (
        roles.where(
            (F.col("role") == Role.TARGET.value)
            & F.col("action_type").isin(Action.SET_VALUE.value, Action.CLEAR_VALUE.value)
        )
        .groupBy("issue_id")
        .agg(F.count(F.lit(1)).alias("touched"))
    )
    gone = removed.groupBy("issue_id").agg(F.count(F.lit(1)).alias("gone"))
    merge = F.col("action_type") == Action.MERGE_ROWS.value
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(merge & F.col("retain_id").isNull(), F.lit("retain_row_index not found in the table."))
        .when(
            merge & ~F.col("ok"),
            F.format_string("retain_row_index %d was retired by an earlier merge.", "retain_id"),
        )
    )
    ran = (
        planned.join(shuffled(targets), "issue_id", "left")
        .join(shuffled(gone), "issue_id", "left")
        .join(shuffled(merge_state.select("issue_id", "retain_id", "ok")), "issue_id", "left")
        .select(
            "issue_id",
            "action_type",
            error.alias("error"),
            (
                F.when(merge, 1).otherwise(0)
                + F.coalesce("touched", F.lit(0))
                + F.coalesce("gone", F.lit(0))
            ).alias("rows"),
        )
        .select(
            "issue_id",
            "action_type",
            F.col("error").isNull().alias("success"),
            F.when(F.col("error").isNull(), F.col("rows")).otherwise(0).cast("long").alias("rows_affected"),
            "error",
        )
    )
    ran = ran.unionByName(
        spark.createDataFrame(
            retyped, "issue_id string, action_type string, success boolean, rows_affected long, error string"
        )
    )
    if refused is not None:
        why = F.when(
            F.col("status") != Status.APPROVED.value,
            F.format_string("Issue %s cannot run: status is '%s', expected 'APPROVED'.", "issue_id", "status"),
        ).otherwise(F.format_string("Issue %s is FLAG_ONLY and must be fixed by hand.", "issue_id"))
        ran = ran.unionByName(
            refused.select(
                "issue_id",
                F.coalesce("action_type", F.lit("NONE")).alias("action_type"),
                F.lit(False).alias("success"),
                F.lit(0).cast("long").alias("rows_affected"),
                why.alias("error"),
            )
        )
    return ran


def _totals(issues: DataFrame, results: DataFrame) -> DataFrame:
    marked = issues.select("issue_id").join(shuffled(results.select("issue_id", "success")), "issue_id", "left")
    counts = marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success").isNull()).alias("skipped"),
    )
    return counts.withColumn("all_succeeded", (F.col("failed") == 0) & (F.col("succeeded") > 0))


def audit_id(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("AUD-"), F.upper(F.substring(digest, 1, 16)))


def _audit(issues, results, actor, actor_role, now) -> DataFrame:
    notes = F.when(F.col("success"), F.coalesce("reviewer_note", F.lit(""))).otherwise(F.col("error"))
    entries = results.drop("action_type").join(shuffled(issues), "issue_id").select(
        audit_id(F.lit("execute"), F.col("issue_id"), now.cast("string")).alias("entry_id"),
        now.alias("ts"),
        "dataset_id",
        "issue_id",
        F.coalesce("action_type", F.lit("NONE")).alias("action_type"),
        F.lit(actor).alias("actor"),
        F.lit(actor_role).alias("actor_role"),
        "affected_columns",
        F.col("rows_affected").alias("affected_row_count"),
        "success",
        notes.alias("notes"),
    )
    return conform(entries, AUDIT)


def _audit_cells(df: DataFrame, events: DataFrame, removed: DataFrame) -> DataFrame:
    """(issue_id, column, row_id, before, after) of every cell a successful fix touched."""
    columns = [f for f in df.schema if f.name != ROW_ID]

    def by_column(make) -> Column:
        out = F.lit(None).cast("string")
        for f in columns:
            out = F.when(F.col("column") == f.name, make(f)).otherwise(out)
        return out

    base = df.withColumnRenamed(ROW_ID, "row_id")
    touched = base.join(shuffled(events), "row_id")
    writes = touched.select(
        "row_id",
        "column",
        "phase",
        "at",
        "issue_id",
        by_column(lambda f: F.col(f"`{f.name}`").cast("string")).alias("base"),
        by_column(
            lambda f: _new_cell(F.col(f"`{f.name}`"), f.dataType, F.col("value"), F.col("strip")).cast("string")
        ).alias("after"),
    )
    # The few writers of one cell, in order: each sees what the one before it wrote.
    order = Window.partitionBy("row_id", "column").orderBy("phase", "at")
    first = F.row_number().over(order) == 1
    changed = writes.select(
        "issue_id",
        "column",
        "row_id",
        F.when(first, F.col("base")).otherwise(F.lag("after").over(order)).alias("before"),
        "after",
    )
    # A removed row is recorded as the earlier writes left it.
    last = writes.groupBy("row_id", "column").agg(
        F.max_by(F.struct("after"), F.struct("phase", "at")).alias("last")
    )
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("base"))
        for f in columns
    ]
    gone = (
        base.join(shuffled(removed.select("row_id", "issue_id")), "row_id")
        .select("issue_id", "row_id", F.explode(F.array(*cells)).alias("cell"))
        .select("issue_id", "row_id", "cell.*")
        .join(shuffled(last), ["row_id", "column"], "left")
        .select(
            "issue_id",
            "column",
            "row_id",
            F.when(F.col("last").isNotNull(), F.col("last.after")).otherwise(F.col("base")).alias("before"),
            F.lit(None).cast("string").alias("after"),
        )
    )
    return changed.unionByName(gone)
