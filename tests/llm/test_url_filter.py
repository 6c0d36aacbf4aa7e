import random
import re

import pytest

from plumbline.llm import url_filter

RULES = "host string, path string, verdict string"
PAGES = "page_id long, url string, HTML string, rule string"


def judge(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h.count("."), h + p, v == "block", v)
        for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[4] if best else default


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], PAGES)
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules), urls[r.page_id]


def urls(n):
    rng = random.Random(5)
    hosts = ["a.org", "b.a.org", "ORG", "xa.org", "c.net", "a.org:80", "É.org", ""]
    return [
        f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/12', '/x'])}{rng.choice(['', '?q=/en/', '#/'])}"
        for _ in range(n)
    ]


ODD = [None, "", "no scheme", "://", "x://a.org", "http://a.org\n/en", "a?u=http://b.a.org/en/1", "http://a.org/\n"]


def test_against_plain_rules(spark):
    rules = [
        ("org", "/", "allow"), ("a.org", "/en/", "block"), ("a.org", "/en/1", "allow"), ("b.a.org", "", "block"),
        ("net", "/x", "block"), (None, "/", "block"), ("a.org", None, "block"),
    ]
    check(spark, urls(300) + ODD, rules)


def test_a_rule_listed_both_ways_blocks(spark):
    check(spark, ["http://a.org/", "http://c.net/"], [("org", "/", "allow"), ("org", "/", "block")])


def test_many_rules_need_several_levels(spark):
    rules = [(f"h{i}.org", "/", "block" if i % 2 else "allow") for i in range(60)]
    check(spark, [f"http://h{i}.org/" for i in range(400)], rules)


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    listed = spark.range(0, 3000, 7).selectExpr("string(id) AS key")
    universe = spark.range(3000).selectExpr("string(id) AS key")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    held = universe.where(cascade.holds(universe.key)).collect()
    assert sorted(int(r.key) for r in held) == list(range(0, 3000, 7))


def test_lists_beyond_the_limit_are_joined(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 1)
    check(spark, urls(100) + ODD, [("org", "/", "allow"), ("a.org", "/en/", "block"), ("a.org", "/en/1", "allow")])


@pytest.mark.parametrize("pages", [[], ["http://a.org/"]])
def test_no_rules_or_no_pages(spark, pages):
    check(spark, pages, [])
    check(spark, [], [("org", "/", "block")])


def test_plans_do_not_grow_with_the_shapes_of_rules(spark):
    """Hundreds of path lengths, some longer than any path; the plan has each filter a few times at most."""
    rules = [("org", "/" + "p" * i, "block" if i % 3 else "allow") for i in range(250)]
    rules += [("a.org", "/" + "p" * i, "allow") for i in range(0, 250, 7)]
    found = [f"http://{h}/{'p' * i}?x" for h in ("org", "a.org", "c.net") for i in (0, 1, 7, 8, 100, 249, 400)]
    check(spark, found + ODD, rules)
    pages = spark.createDataFrame([(1, "http://a.org/", "x", "y")], PAGES)
    sizes = []
    for some in (rules[:2], rules):
        plan = url_filter.judge_urls(pages, spark.createDataFrame(some, RULES))._jdf.queryExecution().analyzed().toString()
        sizes.append(plan.count("xxhash64"))
    assert sizes[1] <= 4 * sizes[0]
