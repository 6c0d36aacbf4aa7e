import random

import numpy as np
import pytest

from plumbline.llm import simhash
from tests.llm import brute


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "Ä1"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)]
    rows = []
    for d in range(160):
        w = rng.choice(base).split()
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(x.upper() if rng.random() < 0.05 else x for x in w)))
    return rows + [(200, None), (201, ""), (202, "one"), (203, "ONE  "), (204, "one two"), (205, "x " * 3000)]


def check(spark, rows):
    frame = spark.createDataFrame([(d, t, "f", 1) for d, t in rows], "doc_id long, text string, fingerprint string, n long")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    prints = {d: brute.fingerprint(t) for d, t in rows}
    want = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_against_all_pairs(spark):
    check(spark, texts())


def test_hot_groups_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 3)
    check(spark, texts())


def test_no_documents(spark):
    check(spark, [])


def test_rows_without_an_id_and_stage(spark):
    frame = spark.createDataFrame(
        [(3, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (2, "q r s t u v", "x")],
        "doc_id long, text string, __gone string",
    )
    frame = frame.withColumnRenamed("__gone", "lang")
    kept = simhash.keep_one_of_each(frame).collect()
    assert sorted((r.doc_id or 0, r.lang) for r in kept) == [(0, "z"), (1, "y"), (2, "x")]


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_pairs(radius, monkeypatch):
    monkeypatch.setattr(simhash, "UNITS", 37)
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 300, dtype="u8") * np.uint64(2) + rng.integers(0, 2, 300, dtype="u8")
    for _ in range(200):
        i, j = rng.integers(0, 300, 2)
        flips = rng.choice(64, rng.integers(0, 8), replace=False)
        prints[j] = prints[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype("u8"), initial=np.uint64(0))
    edges = np.array([0, 1, 60, 64, 65, 200, 300])
    ends = np.repeat(edges[1:], np.diff(edges))
    got = sorted((int(a), int(b)) for i, j in simhash.close_pairs(prints, ends, radius) for a, b in zip(i, j, strict=True))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    assert got == [(a, b) for a in range(300) for b in range(a + 1, ends[a]) if near[a, b]]


def test_masks_catch_every_pair_within_the_radius():
    masks = simhash.block_masks(3)
    rng = random.Random(1)
    for _ in range(2000):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not difference & m for m in masks)


def test_stage_keeps_one_row_of_each_group(spark):
    other = "q r s t u v"
    data = [(1, "a b c d"), (1, "a b c d"), (1, other), (2, other), (None, "n o p"), (None, "n o p"), (3, "a b c d")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "n o p"), (1, "a b c d"), (1, other)]


def test_every_row_has_its_own_fingerprint(spark):
    data = [(1, "a b c d"), (1, "q r s t u v"), (None, "a b c d"), (None, "n o p"), (None, "n o p"), (2, "q r s t u v"), (3, "n o p")]
    got = simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    prints = {text: f"{brute.fingerprint(text):016x}" for _, text in data}
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == sorted(
        [(1, prints["a b c d"], 1), (0, prints["a b c d"], 1), (1, prints["q r s t u v"], 1), (2, prints["q r s t u v"], 1)]
        + [(0, prints["n o p"], 3)] * 2 + [(3, prints["n o p"], 3)]
    )


def test_rows_without_any_id(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [None, None]


def test_a_column_named_like_the_row_number_survives(spark):
    docs = spark.createDataFrame([(2, "a b c", "x"), (1, "a b c", "y")], "doc_id long, text string, __row string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "__row"] and [tuple(r) for r in kept.collect()] == [(1, "a b c", "y")]
