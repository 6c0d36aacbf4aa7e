import random
import zlib

import pytest

from plumbline.llm import toxicity

DOCS = "doc_id long, text string, toxic int, score double"
LABELS = "doc_id long, quality int, toxic int"


def rows(n=600):
    rng = random.Random(8)
    plain = ["".join(rng.choices(["ba", "do", "ki", "le", "mu", "an"], k=rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for d in range(n):
        words = rng.choices(plain, k=rng.randint(1, 60))
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["zorg", "vexpi" + rng.choice(plain)]))
        docs.append((d, rng.choice([" ", ", "]).join(words)))
        if d % 4:
            labels.append((d, 1, int(toxic)))
    return docs, labels, {d: t for d, _, t in labels}


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(d, t, 0, 0.0) for d, t in docs], DOCS),
        spark.createDataFrame(labels, LABELS),
    )


def test_held_out_accuracy(spark):
    docs, labels, truth = rows()
    got = toxicity.score(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = rows(300)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    found = [
        {r.doc_id: r.score for r in toxicity.score(*frames(spark, docs, some)).collect()} for some in (labels, turned)
    ]
    assert found[0] == pytest.approx(found[1])


def test_odd_rows_and_labels(spark):
    docs, labels, _ = rows(300)
    docs += [(1001, None), (1002, ""), (1003, "..."), (None, "zorg"), (1004, "zorg ba " * 5000), (1, "zorg again")]
    labels += [(None, 1, 1), (2, 1, None), (3, 0, 1), (3, 0, 0), (99999, 1, 1)]
    got = toxicity.score(*frames(spark, docs, labels)).collect()
    assert len(got) == len(docs)
    empty = {r.score for r in got if r.doc_id in (1001, 1002, 1003)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert next(r for r in got if r.doc_id is None).held_out is False
    assert next(r for r in got if r.doc_id == 1004).predicted == 1


def test_nothing_to_learn_from(spark):
    docs, labels, _ = rows(40)
    for some in ([], [(d, q, 0) for d, q, _ in labels]):
        got = toxicity.score(*frames(spark, docs, some)).collect()
        assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity.score(*frames(spark, [], labels)).collect() == []


def test_stage_keeps_ordinary_rows(spark):
    docs, labels, _ = rows(300)
    documents, known = frames(spark, docs, labels)
    score = {r.doc_id: r.predicted for r in toxicity.score(documents, known).collect()}
    kept = toxicity.keep_ordinary(documents, known)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, p in score.items() if not p)


def test_probabilities_of_a_context_sum_to_one():
    words = [[b"abc", b"abd", b"b"], [b"abc", b"xyz"]]
    counts = [{}, {}]
    for c, found in zip(counts, words, strict=True):
        for w in found:
            for g in toxicity.grams(w):
                c[g] = c.get(g, 0) + 1
    models = toxicity.ClassModels(*counts)
    for context in (b"\0\0ab", b"\0\0\0\0", b"abcd", b"zzzz"):
        for c in models.classes:
            grams = [context + bytes([b]) for b in range(256)]
            total = sum(c.smoothed(g, models.shared(g[1:])) for g in grams)
            assert total == pytest.approx(1)


def test_new_words_are_no_evidence():
    models = toxicity.ClassModels({b"\0\0\0\0a": 5}, {b"\0\0\0\0a": 5})
    assert toxicity.WordEvidence(models)[b"qqq"] == pytest.approx(0)


def test_stage_judges_rows_and_not_ids(spark):
    docs, labels, _ = rows(300)
    documents, known = frames(spark, docs, labels)
    predicted = {r.doc_id: r.predicted for r in toxicity.score(documents, known).collect()}
    texts = {d[0]: d[1] for d in docs}
    toxic = next(texts[d] for d in sorted(predicted) if predicted[d])
    ordinary = next(texts[d] for d in sorted(predicted) if not predicted[d] and texts[d])
    more, _ = frames(spark, [(None, toxic), (None, ordinary), (9000, toxic), (9000, ordinary)], labels)
    kept = toxicity.keep_ordinary(documents.unionByName(more), known).where("doc_id is null or doc_id = 9000").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, ordinary), (9000, ordinary)]
