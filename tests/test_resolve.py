import random

import pytest
from pyspark.sql import functions as F

from plumbline import SignalConfig, resolve_entities
from plumbline.functions import text
from plumbline.operators.components import connected_components
from plumbline.operators.entity import auto_detect, blocking_signal, profiles_of, scored_links, signal_rows
from plumbline.plans.resolve import canonical_records, elect
from tests.helpers import frame, name_score, token_set

SCHEMA = "vendor_name string, tax_id string, address string, zip string, phone string"
CONFIG = SignalConfig(name=("vendor_name",), tax_id=("tax_id",), address=("address",), zip=("zip",), phone=("phone",))


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (text.norm_tax_id, "47 1234567", "471234567"),
        (text.norm_tax_id, "ab-123", "AB123"),
        (text.norm_phone, "+1-312-555-1234", "3125551234"),
        (text.norm_phone, "555-1234", "5551234"),
        (text.norm_zip, "62701-1234", "62701"),
        (text.norm_generic, "  A.B,  c_d ", "a b c_d"),
        (text.norm_name, "Acme Co, Inc.", "acme co"),
        (text.norm_name, "Inc.", ""),
        (text.norm_name, None, ""),
    ],
)
def test_normalisers(spark, fn, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(fn(F.col("v"))).first()[0] == want


def test_auto_detect_takes_the_first_matching_signal():
    found = auto_detect(["vendor_id", "tax_id", "address", "city", "state", "zip", "phone", "foobar", "rating"])
    assert found.name == ("vendor_id",) and found.address == ("address", "city", "state")
    assert found.tax_id == ("tax_id", "rating") and found.zip == ("zip",) and found.phone == ("phone",)
    assert not auto_detect(["foobar", "xyz_code"]).active()


def test_blocking_only_where_it_loses_nothing():
    assert blocking_signal(CONFIG) == "tax_id"
    assert blocking_signal(SignalConfig(name=("a",), zip=("z",))) is None


def brute_force(df, config):
    """Clusters and links by the definitions, over all pairs of rows."""
    signals = config.active()
    rows = sorted(signal_rows(df, config).collect(), key=lambda r: r.row_id)
    links, best = [], {}
    parent = {r.row_id: r.row_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            total = got = 0.0
            for s in signals:
                a, b, w = p[s], q[s], config.weights[s]
                if not a or not b:
                    continue
                total += w
                if s == "name":
                    got += w * name_score(a, b) / 100
                elif s == "address":
                    got += w * token_set(a, b) / 100
                else:
                    got += w * (a == b)
            score = round(got / total, 4) if total else 0.0
            if score >= 0.72:
                links.append((p.row_id, q.row_id, score))
                a, b = sorted((root(p.row_id), root(q.row_id)))
                parent[b] = a
    clusters = {}
    for r in rows:
        clusters.setdefault(root(r.row_id), set()).add(r.row_id)
    for a, b, score in links:
        best[root(a)] = max(best.get(root(a), 0), score)
    return {min(c): (c, best[k]) for k, c in clusters.items() if len(c) > 1}, links


def plain_evidence(df, config, members):
    """The evidence text of every cluster: distinct reasons of all its pairs, in pair order."""
    signals = config.active()
    rows = {r.row_id: r for r in signal_rows(df, config).collect()}
    out = {}
    for cluster, ids in members.items():
        seen, ids = [], sorted(ids)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                for s in signals:
                    x, y = rows[a][s], rows[b][s]
                    if not x or not y:
                        continue
                    raw = name_score(x, y) if s == "name" else token_set(x, y) if s == "address" else 100.0 * (x == y)
                    text = {
                        "name": f"Name similarity {raw:.0f}/100 ('{x}' ~ '{y}')",
                        "address": f"Address similarity {raw:.0f}/100",
                    }.get(s, f"{s.replace('_', ' ').title()} exact match: '{x}'")
                    if raw >= 72 and text not in seen:
                        seen.append(text)
        out[cluster] = "; ".join(seen[:5]) + (f" (and {len(seen) - 5} more)" if len(seen) > 5 else "")
    return out


def random_vendors(seed, size):
    random.seed(seed)
    names = ["acme steel", "acme steel corp", "globex supplies", "globex supply llc", "initech", "wayne enterprises", "wayne enterprise"]
    return [
        (
            random.choice(names) + random.choice(["", " inc", " x", " holdings"]),
            random.choice([None, "", "11", "1-1", "22", "33", "44"]),
            random.choice([None, "1 main st", "1 main street", "99 dock road", "5 hill ave"]),
            random.choice([None, "07001", "07001-12", "62701"]),
            random.choice([None, "312-555-1234", "+1 312 555 1234", "999"]),
        )
        for _ in range(size)
    ]


@pytest.mark.parametrize("seed,block_rows", [(1, 8192), (2, 8), (3, 8192)])
def test_clusters_equal_brute_force(spark, seed, block_rows):
    df = frame(spark, SCHEMA, random_vendors(seed, 70))
    config = CONFIG if seed != 3 else SignalConfig(name=("vendor_name",), address=("address",), zip=("zip",))
    want, links = brute_force(df, config)
    out = resolve_entities(df, "d", config, block_rows)
    members = {}
    for r in out.members.collect():
        members.setdefault(r.cluster, set()).add(r.row_id)
    confidence = {r.cluster: r.confidence for r in out.clusters.collect()}
    assert {k: (members[k], confidence[k]) for k in members} == want
    counters = out.counters.first()
    assert int(counters.links) == len(links)
    assert int(counters.row_pairs) == 70 * 69 // 2
    assert counters.profile_pairs_scored <= counters.row_pairs


@pytest.mark.parametrize("seed,block_rows", [(4, 4), (4, 256), (4, 8192), (5, 7)])
def test_evidence_equals_all_pairs_whatever_the_blocks(spark, seed, block_rows):
    rows = random_vendors(seed, 60)
    df = frame(spark, SCHEMA, rows + rows[::3] + rows[1::5] + rows[:4])  # copies, near and far
    out = resolve_entities(df, "d", CONFIG, block_rows)
    members = {}
    for r in out.members.collect():
        members.setdefault(r.cluster, set()).add(r.row_id)
    got = {r.cluster: r.evidence_summary for r in out.clusters.collect()}
    assert got == plain_evidence(df, CONFIG, members)
    assert any("more)" in text for text in got.values())


def test_evidence_of_both_orders_of_two_names(spark):
    rows = [("acme steel", "1", None, None, None), ("acme steal", "1", None, None, None)] * 2
    out = resolve_entities(frame(spark, SCHEMA, rows), "d", CONFIG)
    assert out.clusters.first().evidence_summary == (
        "Name similarity 90/100 ('acme steel' ~ 'acme steal'); Tax Id exact match: '1'; "
        "Name similarity 100/100 ('acme steel' ~ 'acme steel'); Name similarity 90/100 ('acme steal' ~ 'acme steel'); "
        "Name similarity 100/100 ('acme steal' ~ 'acme steal')"
    )


def test_a_cluster_without_reasons(spark):
    config = SignalConfig(name=("n",), tax_id=("t",), weights={"name": 0.0, "tax_id": 1.0})
    df = frame(spark, "n string, t string", [("", "1"), ("x", "1"), ("y", None)])
    assert resolve_entities(df, "d", config).clusters.first().evidence_summary == "Tax Id exact match: '1'"


def test_scored_links(spark):
    rows = [("Acme Corp.", "47-1", "123 Main St", "62701", None), ("ACME Corporation", "47 1", "123 Main Street", "62701", None)]
    df = frame(spark, SCHEMA, rows)
    profiles = profiles_of(signal_rows(df, CONFIG), CONFIG.active())
    link = scored_links(profiles, CONFIG).first()
    assert (link.a, link.b) == (0, 1) and link.composite > 0.95


def test_a_missing_signal_is_skipped(spark):
    config = SignalConfig(name=("n",), tax_id=("t",), weights={"name": 0.5, "tax_id": 0.5})
    df = frame(spark, "n string, t string", [("Acme Corp", "471234567"), ("Acme Corp", None)])
    cluster = resolve_entities(df, "d", config).clusters.first()
    assert cluster.confidence == 1.0


def test_three_way_cluster_and_issue(spark):
    rows = [
        ("Acme Corp", "471234567", "1 Main St", "62701", None),
        ("ACME Corporation", "47-1234567", "1 Main Street", "62701", None),
        ("Acme", "471234567", None, None, None),
        ("Zeta Dynamics", "999", "7 Far Road", "10001", None),
    ]
    out = resolve_entities(frame(spark, SCHEMA, rows), "d", CONFIG)
    issue = out.findings.issues.first()
    assert (issue.severity, issue.action_type, issue.affected_row_count) == ("HIGH", "MERGE_ROWS", 3)
    roles = {(r.row_id, r.role) for r in out.findings.issue_rows.collect()}
    assert roles == {(0, "retain"), (1, "retire"), (2, "retire")}
    values = {r.column: r.value for r in out.findings.canonical_values.collect()}
    assert values["vendor_name"] == "Acme Corp" and "phone" not in values
    assert "Tax Id exact match: '471234567'" in out.clusters.first().evidence_summary


def test_copies_are_one_cluster(spark):
    rows = [("Acme", "1", None, None, None)] * 5 + [("Other", "2", None, None, None)]
    out = resolve_entities(frame(spark, SCHEMA, rows), "d", CONFIG)
    cluster = out.clusters.first()
    assert (cluster.size, cluster.confidence, cluster.retain_id) == (5, 1.0, 0)
    assert int(out.counters.first().links) == 10


def test_no_usable_column(spark):
    out = resolve_entities(frame(spark, "a string", [("x",)]), "d", CONFIG)
    assert out.note.startswith("skipped") and out.findings.issues.count() == 0


def test_election_and_gap_filling(spark):
    df = frame(spark, "name string, email string", [("A", None), ("A", "x@y.com"), ("A", "z@y.com"), ("A", "x@y.com"), ("A", " ")])
    members = df.selectExpr("_row_id AS row_id", "0L AS cluster", "_row_id = 0 AS is_retained")
    record = {r.column: r.value for r in canonical_records(df, members).collect()}
    assert record == {"name": "A", "email": "x@y.com"}
    full = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (0, 2, 3)], "cluster long, row_id long, filled int")
    assert elect(full).first().retain_id == 1


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_components(spark, hot_rows):
    edges = [(0, 1), (1, 2), (5, 4), (9, 10), (10, 9), (7, 7)] + [(20, 20 + i) for i in range(1, 30)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hot_rows).collect()}
    want = {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 9: 9, 10: 9}
    want |= {20 + i: 20 for i in range(30)} | {i: 100 for i in range(100, 141)}
    assert got == want
