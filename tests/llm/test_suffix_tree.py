import random

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import suffix_tree
from plumbline.llm.chunks import pack
from plumbline.llm.common import written_alone
from plumbline.llm.hashing import END, tokens
from tests.llm import brute

SCHEMA = "doc_id long, text string, score double, chunk long"


def rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab,"]
    phrase = ["the", "quick", "brown", "fox", "jumps"]
    out = []
    for d in range(300):
        parts = [x for _ in range(rng.randint(0, 12)) for x in (phrase if rng.random() < 0.4 else [rng.choice(words)])]
        out.append((d, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.05 else x for x in parts)))
    return out + [(None, "the quick new"), (400, None), (401, ""), (402, " \t\x0b\x0c\r"), (3, "again a"), (403, "a\x1fb\xa0c")]


def scored(spark, data):
    frame = spark.createDataFrame([(d, t, 0.0, 1) for d, t in data], SCHEMA)
    return suffix_tree.score(frame).collect()


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_counts_and_base_against_plain_ones(spark):
    data = rows()
    got = order(tuple(r)[:6] for r in scored(spark, data))
    want = order(brute.base_scores(data))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_contexts_help_held_out_texts(spark):
    held = [r for r in scored(spark, rows()) if r.held_out]
    assert len(held) > 20
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


@pytest.mark.parametrize("data", [[], [(1, None)], [(15, "only held out")]])
def test_tiny_inputs(spark, data):
    got = order(tuple(r)[:6] for r in scored(spark, data))
    want = order(brute.base_scores(data))
    assert [g[:5] for g in got] == [w[:5] for w in want]


def test_hashes_follow_the_words(monkeypatch):
    texts = ["A b  a\tbb", "", "b \n a", "É é x" * 9]
    whole = tokens([t.encode() for t in texts])
    monkeypatch.setattr("plumbline.llm.hashing.SLICE", 2)
    cut = tokens([t.encode() for t in texts])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    h = whole[0]
    assert h[0] == h[2] != h[1] and h[4] == END and h[5] == END and h[6] == h[1] and h[7] == h[0]


def test_distributions_sum_to_one():
    """Over all training words and one unknown, after contexts that are states and that are not."""
    sequence = (["a", "b", "c"] * 40 + ["a", "d"] * 15 + ["c", "e"]) * 3
    texts = [" ".join(sequence).encode()]
    hashes, _ = tokens(texts)
    words, counts = np.unique(hashes, return_counts=True)
    told = [(w, int(c)) for w, c in zip(words, counts, strict=True)]
    rows = pd.DataFrame({"row": [0], "doc_id": [2], "text": texts, "chunk": [0]})
    answers = pd.DataFrame({"bucket": [0], "data": [pack(counts.astype("u4"))]})
    pairs = suffix_tree._ask_pairs(1, 2)((0,), rows, answers)
    often = suffix_tree._count_pairs(2)((0,), pairs)
    asked = suffix_tree._ask_contexts(1, 2)((0,), rows, pd.concat([answers, often]))
    found = suffix_tree._count_contexts(2)((0,), asked)
    n, v = len(hashes), len(words)
    tree = suffix_tree.build_tree([(int(k), d) for k, d in zip(found["k"], found["data"], strict=True)], n, v, 2)
    assert sum(len(s) for s in tree.states) > 3 and len(tree.states[1])
    for last in (["a"], ["b", "c"], ["a", "b", "c"], ["c", "a"], ["d"], ["zz"], []):
        context, _ = tokens([" ".join(last).encode()])
        context = context[:-1]
        total = 0.0
        for word, count in [*told, (np.uint64(12345), 0)]:
            line = np.append(context, word)
            known = np.append([dict(told).get(w, 0) for w in context], count)
            total += tree.probabilities(line, np.zeros(len(line), "i8"), known.astype("u4"))[-1]
        assert total == pytest.approx(1), last


def test_contexts_count_alike_in_a_large_corpus(spark):
    """Contexts seen three times help however many tokens train."""
    held = next(d for d in range(100, 200) if suffix_tree.is_held_out(d))
    trained = [d for d in range(200, 400) if not suffix_tree.is_held_out(d)]
    data = [(d, "x " * 400_000) for d in trained[:20]] + [(d, "alpha beta gamma delta") for d in trained[20:23]]
    (got,) = (r for r in scored(spark, [*data, (held, "alpha beta gamma delta")]) if r.held_out)
    assert got.train_tokens > 8_000_000
    assert got.score > got.base_score + 10


def test_buckets_do_not_change_scores(spark, monkeypatch):
    whole = order(map(tuple, scored(spark, rows())))
    monkeypatch.setattr("plumbline.llm.chunks.BUCKET_BYTES", 1500)
    cut = order(map(tuple, scored(spark, rows())))
    assert [r[:5] for r in cut] == [r[:5] for r in whole]
    assert [r[6] for r in cut] == pytest.approx([r[6] for r in whole])


def one_process(data):
    """Score of every (doc_id, text) by the tree of one chunk and bucket."""
    texts = [(t or "").encode() for _, t in data]
    rows = pd.DataFrame({"row": range(len(data)), "doc_id": [d for d, _ in data], "text": texts, "chunk": 0})
    hashes, owner = tokens(texts)
    trained = np.array([not suffix_tree.is_held_out(d) for d, _ in data])[owner]
    words, at = np.unique(hashes, return_inverse=True)
    counts = np.bincount(at, weights=trained).astype("u4")
    answers = pd.DataFrame({"bucket": [0], "data": [pack(counts)]})
    often = suffix_tree._count_pairs(2)((0,), suffix_tree._ask_pairs(1, 2)((0,), rows, answers))
    asked = suffix_tree._ask_contexts(1, 2)((0,), rows, pd.concat([answers, often]))
    found = suffix_tree._count_contexts(2)((0,), asked)
    levels = [(int(k), d) for k, d in zip(found["k"], found["data"], strict=True)]
    tree = suffix_tree.build_tree(levels, int(counts.sum()), int((counts > 0).sum()), 2)
    logs = np.log10(tree.probabilities(hashes, owner, counts[at]))
    return dict(zip((d for d, _ in data), np.bincount(owner, weights=logs).tolist(), strict=True)), asked


def test_chunks_and_buckets_score_as_one_process(spark, monkeypatch):
    """A context takes its share wherever it occurs, also in chunks that hold nothing of what follows it elsewhere."""
    data = [(d, t) for d, t in rows()[:300] if t] + [(500 + d, f"the w{d}x the quick end{d}") for d in range(9)]
    want, _ = one_process(data)
    monkeypatch.setattr("plumbline.llm.chunks.BUCKET_BYTES", 1500)
    frame = spark.createDataFrame([(d, t, 0.0, 1) for d, t in data], SCHEMA).repartition(40, "doc_id")
    got = {r.doc_id: r.score for r in suffix_tree.score(frame).collect()}
    assert got == {d: pytest.approx(x) for d, x in want.items()}


def test_contexts_are_asked_in_few_bytes():
    """Words are named by reference or number; neither shorter contexts nor next words go as hashes with every entry."""
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(2000)]
    data = [(d, " ".join(f"w{i}" for i in rng.choices(range(2000), weights, k=300))) for d in range(300)]
    texts = [t.encode() for _, t in data]
    chunk = pd.DataFrame({"row": range(300), "doc_id": range(300), "text": texts, "chunk": 0})
    counted = suffix_tree._count_words(1, 2)((0,), suffix_tree._ask_words(1)(chunk))
    answers = counted[counted["chunk"] >= 0][["bucket", "chunk", "data"]]
    often = suffix_tree._count_pairs(2)((0,), suffix_tree._ask_pairs(1, 2)((0,), chunk, answers))
    asked = suffix_tree._ask_contexts(1, 2)((0,), chunk, pd.concat([answers, often]))
    assert sum(map(len, often["data"])) < 0.1 * len(tokens(texts)[0])
    assert sum(map(len, asked["data"])) < 3 * len(tokens(texts)[0])


def test_setting_of_shuffles_stays(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    frame = spark.createDataFrame([(1, "a")], "bucket long, data string")
    assert written_alone(frame.repartition(2), "x").collect() == written_alone(frame, "x", 2, "bucket").collect()
    assert spark.conf.get(key, None) == before
