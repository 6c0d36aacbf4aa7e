import random

import pytest
from pyspark.sql import functions as F

from plumbline import CheckConfig, DomainRule, Severity, run_quality_checks
from plumbline.functions import text
from plumbline.operators.consistency import check_consistency
from plumbline.operators.fuzzy import check_deduplication, column_values, fuzzy_pairs
from plumbline.operators.reference import check_reference
from plumbline.operators.uniqueness import check_uniqueness
from plumbline.plans.checks import resolve_categories, summary_text
from tests.helpers import VENDOR_SCHEMA, VENDORS, frame, name_score, rows_by_issue


def run(df, category, **config):
    return run_quality_checks(df, "d", [category], CheckConfig(**config))


def affected(found):
    return sorted(r.row_id for r in found.issue_rows.collect())


# --- completeness ------------------------------------------------------------------------


def test_null_and_blank_cells(spark):
    df = frame(spark, "vendor_name string, amount long", [("Acme", 1), (None, 2), ("\t  ", 3)])
    found = run(df, "COMPLETENESS")
    issue = found.issues.collect()
    assert len(issue) == 1
    assert issue[0].affected_columns == ["vendor_name"]
    assert issue[0].severity == "CRITICAL" and issue[0].confidence == 1.0
    assert issue[0].action_type == "FLAG_ONLY" and "66.7%" in issue[0].description
    assert issue[0].sample_values == [None, "\t  "]
    assert affected(found) == [1, 2]


def test_required_columns_only(spark):
    df = frame(spark, "name string, code string", [("a", None), (None, None)])
    found = run(df, "COMPLETENESS", required_columns=["name", "absent"])
    assert [r.target_column for r in found.issues.collect()] == ["name"]


@pytest.mark.parametrize("nulls,severity", [(60, "CRITICAL"), (50, "HIGH"), (20, "MEDIUM"), (5, "LOW"), (1, "LOW")])
def test_severity_by_share(spark, nulls, severity):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.when(F.col("id") >= nulls, "x").alias("v"))
    assert run(df, "COMPLETENESS").issues.first().severity == severity


# --- uniqueness --------------------------------------------------------------------------


def test_duplicate_group(spark):
    rows = [("V-001", "Acme", 100.0), ("V-002", "Globex", 200.0), ("V-001", "Acme", 100.0)]
    found = run(frame(spark, "id string, name string, amount double", rows), "UNIQUENESS")
    issue = found.issues.first()
    assert (issue.severity, issue.action_type, issue.affected_row_count) == ("HIGH", "MERGE_ROWS", 2)
    assert rows_by_issue(found)[issue.issue_id] == {(0, "retain"), (2, "retire")}


def test_nulls_equal_but_not_values(spark):
    rows = [(None, "a:1"), (None, "a:1"), ("a", "1"), ("a:1", None), ("-", "a"), (None, "a")]
    found = run(frame(spark, "x string, y string", rows), "UNIQUENESS")
    assert affected(found) == [0, 1]


def test_zero_and_nan_keys(spark):
    rows = [(0.0,), (-0.0,), (float("nan"),), (None,), (1.0,)]
    assert affected(run(frame(spark, "x double", rows), "UNIQUENESS")) == [0, 1, 2, 3]


def test_hot_groups_take_the_broadcast_path(spark):
    df = spark.range(300).select(F.col("id").alias("_row_id"), F.least(F.col("id"), F.lit(150)).alias("v"))
    plain, hot = check_uniqueness(df, "d"), check_uniqueness(df, "d", hot_rows=10)
    assert rows_by_issue(plain) == rows_by_issue(hot)
    assert len(affected(hot)) == 150


# --- deduplication -----------------------------------------------------------------------


def test_vendor_names(spark):
    found = run(frame(spark, VENDOR_SCHEMA, VENDORS), "DEDUPLICATION", fuzzy_columns=["vendor_name"])
    issue = found.issues.collect()
    assert len(issue) == 1
    assert (issue[0].confidence, issue[0].action_type) == (0.9474, "MERGE_ROWS")
    assert issue[0].canonical_value == "Acme Corporation"
    assert rows_by_issue(found)[issue[0].issue_id] == {(0, "retain"), (1, "retire")}


def test_different_names_do_not_match(spark):
    rows = [("Apple Inc",), ("Microsoft Corporation",), ("Amazon Web Services",)]
    assert run(frame(spark, "vendor_name string", rows), "DEDUPLICATION").issues.count() == 0


def test_review_band_keeps_rows_as_targets(spark):
    found = run(frame(spark, "n string", [("Stark Industries",), ("Vandelay Industries",)]), "DEDUPLICATION")
    issue = found.issues.first()
    assert (issue.confidence, issue.action_type, issue.canonical_value) == (0.8276, "FLAG_ONLY", None)
    assert {r.role for r in found.issue_rows.collect()} == {"target"}


def test_case_variants_pair_with_the_last_one(spark):
    df = frame(spark, "n string", [("Acme",), ("ACME",), ("acme ",), ("Acme",)])
    pairs = fuzzy_pairs(column_values(df, "n")).collect()
    assert {(p.a, p.b) for p in pairs} == {("Acme", "acme "), ("ACME", "acme ")}
    assert {p.score for p in pairs} == {100.0}


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_pairs_equal_brute_force_whatever_the_tiles(spark, block_rows):
    names = [f"{a} {b}" for a in ("north", "south", "east", "eastern") for b in ("supplies", "supply co", "steel", "foods", "food", "metal works")]
    df = frame(spark, "n string", [(n,) for n in names])
    got = {(p.a, p.b): round(p.score, 6) for p in fuzzy_pairs(column_values(df, "n"), block_rows=block_rows).collect()}
    want = {
        (a, b): round(name_score(a, b), 6)
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        if name_score(a, b) >= 75
    }
    assert got == want


def test_dedup_skips_non_text_and_single_values(spark):
    df = frame(spark, "a long, b string", [(1, "x"), (2, "x")])
    assert check_deduplication(df, "d") is None


@pytest.mark.parametrize(
    "a,b,want",
    [("a", "longer string", "Longer String"), ("o'neil", "x", "O'Neil"), (" 3m co ", "x", "3M Co"), ("straße", "x", "Straße"), ("ßa", "x", "Ssa")],
)
def test_canonical_form(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.canonical_form(F.col("a"), F.col("b"))).first()[0] == want


# --- formats -----------------------------------------------------------------------------


def test_amounts(spark):
    df = frame(spark, "ytd_spend string", [("$1,500.00",), ("2000.00",), ("$750.50",), (None,), ("",), ("abc",)])
    found = run(df, "FORMAT_VALIDITY")
    issue = found.issues.first()
    assert affected(found) == [0, 2, 5]
    assert (issue.action_type, issue.confidence, issue.canonical_value) == ("SET_VALUE", 0.9, "<stripped numeric>")


def test_numeric_amounts_and_other_columns_are_left_alone(spark):
    df = frame(spark, "ytd_spend double, vendor_id string", [(1.0, "V-001"), (2.0, "abc")])
    assert run(df, "FORMAT_VALIDITY").issues.count() == 0


def test_dates(spark):
    values = ["2024-01-15", "not-a-date", "Jan 5th 2024 approx", "1/31/2024", "99/99/9999", "May", "", "5 March 2024"]
    found = run(frame(spark, "invoice_date string", [(v,) for v in values]), "FORMAT_VALIDITY")
    assert affected(found) == [1, 2, 6]
    native = run(frame(spark, "invoice_date string", [(v,) for v in values]), "FORMAT_VALIDITY", date_formats=["d MMMM yyyy"])
    assert affected(native) == [1, 2, 5, 6]


# --- reference and consistency -----------------------------------------------------------


@pytest.mark.parametrize("as_table", [False, True])
def test_reference_set(spark, as_table):
    df = frame(spark, "terms string", [("NET30",), ("NET45",), ("X",), (None,), ("X",), ("Y",)])
    known = spark.createDataFrame([("NET30",), ("NET45",), (None,)], "t string") if as_table else {"NET30", "NET45", None}
    found = check_reference(df, "d", {"terms": known, "absent": set()}, hot_rows=2)
    issue = found.issues.first()
    assert affected(found) == [2, 4, 5]
    assert (issue.severity, issue.affected_row_count, issue.sample_values) == ("HIGH", 3, ["X", "X", "Y"])
    assert "[X, Y]" in issue.description


def test_reference_joins_the_defaults_when_given():
    assert "REFERENTIAL_INTEGRITY" not in [c.value for c in resolve_categories(None, {})]
    assert resolve_categories(None, {"a": {1}})[-1].value == "REFERENTIAL_INTEGRITY"
    assert [c.value for c in resolve_categories(["outlier", "nonsense"], {})] == ["OUTLIER"]


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_consistency(spark, hot_rows):
    rows = [("47", "Acme", "IL"), ("47", "ACME", "IL"), ("82", "Globex", "OH"), ("47", None, None), (None, "Z", "IN"), (None, "Y", "IN")]
    df = frame(spark, "tax_id string, vendor_name string, state string", rows)
    found = check_consistency(df, "d", [(["tax_id"], "vendor_name"), (["tax_id"], "state"), (["nope"], "state")], hot_rows)
    issues = found.issues.collect()
    assert len(issues) == 1 and issues[0].affected_row_count == 3
    assert affected(found) == [0, 1, 3]
    assert "(47) maps to 2 different values: [Acme, ACME]" in issues[0].description


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_consistency_against_plain_code(spark, hot_rows):
    """A key with a third of all rows, keys of two parts, null parts and null values."""
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = "hot" if rng.random() < 0.3 else rng.choice(["a", "b", "1:a", "", None])
        b = 1 if a == "hot" else rng.choice([1, 2, 3, None])
        value = f"v{rng.randrange(40)}" if a == "hot" else rng.choice(["x", "x", None, "y"] if b == 1 else ["x", None])
        rows.append((a, b, value))
    want = {}
    for i, (a, b, value) in enumerate(rows):
        if a is not None and b is not None:
            want.setdefault((a, b), []).append((i, value))
    want = {k: v for k, v in want.items() if len({x for _, x in v} - {None}) > 1}
    found = check_consistency(frame(spark, "a string, b int, c string", rows), "d", [(["a", "b"], "c")], hot_rows)
    got = {i: {r for r, _ in v} for i, v in rows_by_issue(found).items()}
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, _ in v) for v in want.values())
    for issue in found.issues.collect():
        (values,) = (v for v in want.values() if {i for i, _ in v} == got[issue.issue_id])
        firsts = list(dict.fromkeys(x for _, x in values if x is not None))
        assert issue.affected_row_count == len(values)
        assert f"{len(firsts)} different values: [{', '.join(firsts[:10])}" in issue.description


# --- outliers and rules ------------------------------------------------------------------


def test_outlier(spark):
    rows = [(100.0,)] * 99 + [(999999.0,), (None,), (float("nan"),)]
    found = run(frame(spark, "ytd_spend double", rows), "OUTLIER")
    assert affected(found) == [99]
    assert found.issues.first().confidence == 0.8


@pytest.mark.parametrize("values", [[25.0] * 100, [100.0, 200.0, 150.0, 300.0, 50000.0]])
def test_constant_or_short_columns_have_no_outliers(spark, values):
    assert run(frame(spark, "amount double", [(v,) for v in values]), "OUTLIER").issues.count() == 0


def test_rules(spark):
    df = frame(spark, "qty int", [(5,), (-3,), (10,), (None,)])
    rules = [
        DomainRule("qty", "qty >= 0", "Not negative.", Severity.HIGH, fix_value=0),
        DomainRule("qty", lambda c: c < 10, "Small."),
        DomainRule("qty", lambda v: 10 / (v - 5) < 100, "May fail.", python=True),
        DomainRule("absent", "true", "Ignored."),
    ]
    found = run(df, "DOMAIN_RULE", domain_rules=rules)
    by = {r.description.split(": ")[1].split(".")[0]: r for r in found.issues.collect()}
    assert (by["Not negative"].severity, by["Not negative"].action_type, by["Not negative"].canonical_value) == ("HIGH", "SET_VALUE", "0")
    assert by["Small"].action_type == "FLAG_ONLY"
    rows = rows_by_issue(found)
    assert {k: {r for r, _ in rows[v.issue_id]} for k, v in by.items()} == {"Not negative": {1}, "Small": {2}, "May fail": {0}}


# --- the runner --------------------------------------------------------------------------


def test_a_broken_category_becomes_a_low_issue(spark):
    df = frame(spark, "a string", [(None,), ("x",)])
    config = CheckConfig(domain_rules=[DomainRule("a", "no_such_function(a)", "Bad.")])
    found = run_quality_checks(df, "d", ["COMPLETENESS", "DOMAIN_RULE"], config)
    by = {r.category: r for r in found.issues.collect()}
    assert by["DOMAIN_RULE"].severity == "LOW" and by["DOMAIN_RULE"].affected_row_count == 0
    assert by["COMPLETENESS"].affected_row_count == 1


def test_summary(spark):
    df = frame(spark, "a string, b string", [(None, "x"), ("x", "x")])
    found = run_quality_checks(df, "d", ["COMPLETENESS", "UNIQUENESS"])
    assert summary_text(found.issues, "d") == "d: 1 findings; high 1; completeness 1"


def test_row_order_does_not_change_findings(spark):
    df = frame(spark, VENDOR_SCHEMA, VENDORS + [(None,) * 9])
    config = CheckConfig(fuzzy_columns=["vendor_name"], consistency_checks=[(["tax_id"], "vendor_name")])
    one = run_quality_checks(df, "d", config=config)
    two = run_quality_checks(df.orderBy(F.rand(1)).repartition(3), "d", config=config)
    assert rows_by_issue(one) == rows_by_issue(two)


def test_no_issue_on_an_empty_plan(spark):
    assert run_quality_checks(frame(spark, "a string", [("x",)]), "d", []).issues.count() == 0
