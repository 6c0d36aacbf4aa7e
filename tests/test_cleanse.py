import random

import pytest
from pyspark.sql import functions as F

from plumbline import execute_approved
from plumbline.durable import materialise
from plumbline.model import as_issues
from plumbline.operators import merges
from plumbline.operators.merges import effective_merges
from tests.helpers import frame

SCHEMA = "vendor_id string, vendor_name string, amount double, state string, payment_terms string"
ROWS = [
    ("V-001", "Acme Corp.", 1000.0, "IL", "NET30"),
    ("V-002", "ACME Corporation", 500.0, "IL", "NET30"),
    ("V-003", "Globex", 2500.0, "IL", "NET45"),
    ("V-004", "Pendant", 750.0, "NY", None),
    ("V-005", "Initech", 3200.0, "PA", "NET60"),
]


def issue(name, action, column=None, value=None, status="APPROVED", dtype=None, **roles):
    rows = [(name, r, role) for role, ids in roles.items() for r in ids]
    return (name, action, column, value, status, dtype), rows


def run(spark, *issues, values=(), only=None, rows=ROWS, schema=SCHEMA, policy="sequential"):
    df = frame(spark, schema, rows)
    heads = [(*head, len(r), seq) for seq, (head, r) in enumerate(issues)]
    base = spark.createDataFrame(
        heads,
        "issue_id string, action_type string, target_column string, canonical_value string, "
        "status string, target_dtype string, affected_row_count long, seq long",
    ).withColumns({"dataset_id": F.lit("d"), "affected_columns": F.array(F.lit("c"))})
    table = as_issues(base).join(base.select("issue_id", "seq"), "issue_id")
    listed = spark.createDataFrame([r for _, r in issues for r in r], "issue_id string, row_id long, role string")
    records = spark.createDataFrame(list(values), "issue_id string, column string, value string")
    return execute_approved(df, table, listed, records, "bob", "analyst", only, merge_policy=policy)


def cells(done, column):
    return {r._row_id: r[column] for r in done.table.collect()}


def results(done):
    return {r.issue_id: r for r in done.results.collect()}


@pytest.mark.parametrize("status", ["OPEN", "PENDING_APPROVAL", "REJECTED", "EXECUTED"])
def test_gate(spark, status):
    done = run(spark, issue("a", "SET_VALUE", "amount", "1", status, target=[0]), only=["a"])
    assert cells(done, "amount")[0] == 1000.0
    entry = done.audit.collect()
    assert len(entry) == 1 and not entry[0].success and status in entry[0].notes
    assert done.issues.first().status == status


def test_flag_only_never_runs(spark):
    done = run(spark, issue("a", "FLAG_ONLY", target=[0]), only=["a"])
    assert not results(done)["a"].success and "FLAG_ONLY" in results(done)["a"].error


def test_set_coerces_and_skips_unknown_rows(spark):
    done = run(spark, issue("a", "SET_VALUE", "amount", "$1,500.00", target=[0, 77]), issue("b", "SET_VALUE", "state", None, target=[1]))
    assert cells(done, "amount")[0] == 1500.0 and cells(done, "state")[1] is None
    assert results(done)["a"].rows_affected == 1
    assert done.issues.where("status = 'EXECUTED' AND executed_at IS NOT NULL").count() == 2


def test_set_on_no_existing_row_succeeds(spark):
    done = run(spark, issue("a", "SET_VALUE", "amount", "1", target=[99]))
    assert (results(done)["a"].success, results(done)["a"].rows_affected) == (True, 0)


@pytest.mark.parametrize(
    "bad,word",
    [
        (("SET_VALUE", None, "1"), "names no target_column"),
        (("SET_VALUE", "nope", "1"), "not found"),
        (("SET_VALUE", "amount", "abc"), "does not fit"),
        (("EXPLODE", "amount", "1"), "No such fix"),
    ],
)
def test_failures_do_not_stop_the_rest(spark, bad, word):
    action, column, value = bad
    done = run(spark, issue("a", action, column, value, target=[0]), issue("b", "CLEAR_VALUE", "state", target=[0]))
    assert word in results(done)["a"].error and results(done)["b"].success
    assert cells(done, "state")[0] is None and cells(done, "amount")[0] == 1000.0


def test_last_writer_wins_and_clear_follows_set(spark):
    done = run(
        spark,
        issue("c", "CLEAR_VALUE", "amount", target=[1]),
        issue("a", "SET_VALUE", "amount", "1", target=[0, 1]),
        issue("b", "SET_VALUE", "amount", "2", target=[0]),
    )
    assert (cells(done, "amount")[0], cells(done, "amount")[1]) == (2.0, None)
    entry = {r.entry_id: r.issue_id for r in done.audit.collect()}
    log = {(entry[r.entry_id], r.row_id): (r.before, r.after) for r in done.audit_cells.collect()}
    assert log == {("a", 0): ("1000.0", "1.0"), ("b", 0): ("1.0", "2.0"), ("a", 1): ("500.0", "1.0"), ("c", 1): ("1.0", None)}


def test_merge_with_scalar_and_missing_retire_row(spark):
    done = run(spark, issue("a", "MERGE_ROWS", "vendor_name", "Acme", retain=[0], retire=[1, 999]))
    assert sorted(cells(done, "state")) == [0, 2, 3, 4] and cells(done, "vendor_name")[0] == "Acme"
    assert results(done)["a"].rows_affected == 2


def test_merge_with_a_record(spark):
    values = [("a", "vendor_name", "Acme Inc"), ("a", "amount", "7"), ("a", "nope", "x")]
    done = run(spark, issue("a", "MERGE_ROWS", retain=[0], retire=[1, 2, 3]), values=values)
    assert cells(done, "amount") == {0: 7.0, 4: 3200.0} and cells(done, "vendor_name")[0] == "Acme Inc"


def test_merge_needs_its_retain_row(spark):
    done = run(spark, issue("a", "MERGE_ROWS", retain=[999], retire=[0]), issue("b", "MERGE_ROWS", retire=[1]))
    assert all("retain_row_index" in r.error for r in results(done).values())
    assert done.table.count() == 5


def test_chain_of_merges_runs_in_order(spark):
    done = run(
        spark,
        issue("a", "MERGE_ROWS", retain=[0], retire=[1]),
        issue("b", "MERGE_ROWS", retain=[1], retire=[2]),
        issue("c", "MERGE_ROWS", retain=[2], retire=[3]),
        issue("d", "MERGE_ROWS", retain=[3], retire=[4]),
    )
    assert {k: r.success for k, r in results(done).items()} == {"a": True, "b": False, "c": True, "d": False}
    assert sorted(cells(done, "state")) == [0, 2, 4]


def in_sequence(merges):
    """Outcomes of (keep, retired rows) run one after the other."""
    gone, out = set(), []
    for keep, retired in merges:
        out.append(keep not in gone)
        gone |= set(retired) if out[-1] else set()
    return out


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 1), (3, 3)])
def test_overlapping_merges_equal_running_them_in_order(spark, seed, width):
    rng = random.Random(seed)
    plan = [(rng.randrange(25), rng.sample(range(25), rng.randint(0, width))) for _ in range(40)]
    heads = [(f"m{i:02d}", i, keep, len(r)) for i, (keep, r) in enumerate(plan)]
    state = spark.createDataFrame(heads, "issue_id string, at long, retain_id long, n long")
    rows = [(f"m{i:02d}", r) for i, (_, retired) in enumerate(plan) for r in retired]
    retired = spark.createDataFrame(rows, "issue_id string, row_id long")
    got = {r.issue_id: r.ok for r in effective_merges(state, retired).collect()}
    assert [got[f"m{i:02d}"] for i in range(40)] == in_sequence(plan)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(merges, "materialise", lambda df, name: tables.append(name) or materialise(df, name))
    state = spark.range(300).selectExpr("concat('m', id) AS issue_id", "id AS at", "id AS retain_id", "1L AS n")
    retired = spark.range(300).selectExpr("concat('m', id) AS issue_id", "id + 1 AS row_id")
    got = {r.issue_id: r.ok for r in effective_merges(state, retired).collect()}
    assert all(got[f"m{i}"] == (i % 2 == 0) for i in range(300))
    assert len(tables) < 30  # one by one there were 300 rounds


def test_components_of_merges(spark):
    done = run(
        spark,
        issue("a", "MERGE_ROWS", "state", "A", retain=[1], retire=[2]),
        issue("b", "MERGE_ROWS", "state", "B", retain=[2], retire=[0, 999]),
        issue("c", "MERGE_ROWS", "state", "C", retain=[3]),
        issue("d", "MERGE_ROWS", "state", "D", retain=[888], retire=[4]),
        policy="components",
    )
    assert cells(done, "state") == {1: "B", 3: "C", 4: "PA"}
    got = {k: (r.success, r.rows_affected) for k, r in results(done).items()}
    assert got == {"a": (True, 2), "b": (True, 2), "c": (True, 1), "d": (False, 0)}


def test_unknown_policy(spark):
    with pytest.raises(ValueError, match="merge_policy"):
        run(spark, issue("a", "DROP_ROW", drop=[0]), policy="any")


def test_drop_and_its_audit(spark):
    done = run(spark, issue("a", "DROP_ROW", drop=[3, 50]), issue("b", "SET_VALUE", "state", "ZZ", target=[3]))
    assert 3 not in cells(done, "state") and results(done)["a"].rows_affected == 1
    entry = {r.entry_id: r.issue_id for r in done.audit.collect()}
    lost = {r.column: (r.before, r.after) for r in done.audit_cells.collect() if entry[r.entry_id] == "a"}
    assert lost["state"] == ("ZZ", None) and lost["vendor_name"] == ("Pendant", None)


def test_retype_runs_before_set(spark):
    rows = [("100",), ("not_a_number",), ("300",)]
    done = run(
        spark,
        issue("s", "SET_VALUE", "v", "999.0", target=[2]),
        issue("r", "RETYPE_COLUMN", "v", dtype="float64"),
        rows=rows,
        schema="v string",
    )
    assert cells(done, "v") == {0: 100.0, 1: None, 2: 999.0}
    assert results(done)["r"].rows_affected == 3
    entry = {r.entry_id: r.issue_id for r in done.audit.collect()}
    types = [(r.before, r.after) for r in done.audit_cells.collect() if entry[r.entry_id] == "r" and r.row_id is None]
    assert types == [("string", "double")]


@pytest.mark.parametrize(
    "dtype,values,want",
    [
        ("int64", ["1", "2.0", "x"], [1, 2, None]),
        ("int", ["1", "2.5"], [1.0, 2.5]),
        ("string", ["a", None], ["a", None]),
        ("bool", ["true", "no way"], [True, None]),
    ],
)
def test_retype_kinds(spark, dtype, values, want):
    done = run(spark, issue("r", "RETYPE_COLUMN", "v", dtype=dtype), rows=[(v,) for v in values], schema="v string")
    assert list(cells(done, "v").values()) == want


def test_retype_datetime_and_failure(spark):
    done = run(
        spark,
        issue("r", "RETYPE_COLUMN", "v", dtype="datetime64[ns]"),
        issue("x", "RETYPE_COLUMN", "v", dtype="nonsense"),
        issue("y", "RETYPE_COLUMN", "absent", dtype="float"),
        rows=[("2024-01-31",), ("1/31/2024",), ("zzz",)],
        schema="v string",
    )
    assert [str(v) for v in cells(done, "v").values()] == ["2024-01-31 00:00:00"] * 2 + ["None"]
    assert {k: r.success for k, r in results(done).items()} == {"r": True, "x": False, "y": False}


def test_bulk_counts_and_untouched_cells(spark):
    done = run(
        spark,
        issue("a", "SET_VALUE", "state", "XX", target=[0]),
        issue("b", "DROP_ROW", drop=[4]),
        issue("c", "DROP_ROW", status="OPEN", drop=[0]),
        issue("d", "FLAG_ONLY", target=[0]),
        issue("e", "DROP_ROW", status="REJECTED", drop=[0]),
    )
    t = done.totals.first()
    assert (t.total, t.succeeded, t.failed, t.skipped, t.all_succeeded) == (5, 2, 0, 3, True)
    got = {r._row_id: tuple(r)[1:] for r in done.table.collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {k: ROWS[k] for k in (1, 2, 3)}


def test_placeholder_becomes_the_clean_number(spark):
    done = run(
        spark,
        issue("a", "SET_VALUE", "total", "<stripped numeric>", target=[0, 1]),
        rows=[("$1,500.00",), ("n/a",), ("$9",)],
        schema="total string",
    )
    assert cells(done, "total") == {0: "1500.00", 1: "n/a", 2: "$9"}
