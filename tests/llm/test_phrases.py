import random
import re
from collections import Counter

import pytest

from plumbline.llm import phrases
from tests.llm.brute import LOWER

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


def plain_counts(rows, depth):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, depth + 1):
                f.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def plain_collocations(rows, depth=4, least=30, top=2000, cover=80):
    f = plain_counts(rows, depth)
    total = Counter()
    for (lang, p), n in f.items():
        total[lang] += n if " " not in p else 0
    candidates = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    found = {}
    for (lang, p), a in candidates.items():
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + r), k, left, r))
        longer = (b for (x, q), b in candidates.items() if x == lang and len(q) > len(p) and f" {p} " in f" {q} ")
        if not any(100 * b >= cover * a for b in longer):
            found.setdefault(lang, []).append((min(cuts), a, p))
    out = []
    for lang, own in found.items():
        own.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, c[2], c[3], total[lang], c[0]) for i, (c, a, p) in enumerate(own[:top])]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "É", "zé", "word", "Word", "x\x1cy", "日本", "\x00", "tail'"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ! "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary[: rng.choice([3, 10])]) + rng.choice(marks) for _ in range(rng.choice([0, 2, 30, 90])))
        rows.append((rng.choice(["en", "en", "de", None, "und", "a\tb"]), text))
    return rows + [("en", None), (None, ""), ("fr", " .,\n "), ("en", "one " * 500)]


def check(spark, rows, **options):
    own = {k: v for k, v in options.items() if k in ("depth", "least", "top", "cover")}
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **options).collect())
    assert got == plain_collocations(rows, **own)
    return got


@pytest.mark.parametrize("budget", [None, 5000, 300, 20])
def test_equals_plain_counts_at_every_budget(spark, budget):
    rows = corpus(1)
    options = {} if budget is None else {"budget": budget, "fold_words": 700}
    found, totals = phrases.phrase_counts(frame(spark, rows), least=5, **options)
    want = plain_counts(rows, 4)
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {k: v for k, v in want.items() if v >= 5}
    assert found.where("size <> size(split(phrase, ' '))").count() == 0
    sums = Counter()
    for (lang, p), n in want.items():
        sums[lang] += n if " " not in p else 0
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in sums.items() if v}


def test_phrases_and_ranks(spark):
    assert check(spark, corpus(2))
    assert check(spark, corpus(3), budget=60, fold_words=500, least=4, top=7)


def test_covered_phrases_go(spark):
    rows = [("en", "new york city hall")] * 40 + [("en", "new york")] * 5 + [("en", "city hall")] * 60
    got = check(spark, rows)
    assert [r[2] for r in got] == ["city hall", "new york city hall"]


def test_three_words_at_most(spark):
    check(spark, corpus(4, 40), depth=3, least=3)


def test_no_words(spark):
    check(spark, [])
    check(spark, [("en", None), (None, " . ")])


def test_a_split_prefix_that_ends_its_piece(spark):
    rows = [("en", "go. go on. go on now. go on now then")] * 50
    check(spark, rows, budget=10, least=30)


def test_products_beyond_64_bits():
    assert 2_000_000 * 10**13 > 2**64  # such counts need the decimals of ``collocations``


def test_scores_of_huge_counts(spark, monkeypatch):
    big = 3 * 10**13
    found = spark.createDataFrame(
        [("en", "a", 1, big + 7), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, f long"
    )
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (found, totals))
    row = phrases.collocations(frame(spark, [])).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 7) and row.n == 10**15


def test_fold_counts_overlaps():
    fold = phrases._Fold(2)
    fold.add("en", b"a a a. a")
    rows, counts = fold.suffixes()
    assert rows.tolist() == [[1, 0], [1, 1]] and counts.tolist() == [2, 2]
