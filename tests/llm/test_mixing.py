import hashlib
import random
import re

import pytest

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, copies string, __cell string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "c", "x") for d, t, s in rows], SCHEMA)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, max_epochs=2.0):
    """Round after round, as the definition says."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest = share * sum(sizes.values()) - sum(target.values())
        level = {s: weight[s] * rest / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if level[s] > max_epochs * sizes[s]}
        if not over:
            return target | level
        target |= {s: max_epochs * sizes[s] for s in over}
        free -= over
    return target


def plain_taken(rows, **options):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    targets = plain_targets(sizes, **options)
    cells = {}
    for doc, text, source in rows:
        inner = hashlib.md5((text or "").encode()).hexdigest()
        key = f"{mixing.SEED}:{'' if doc is None else doc}:{inner}"
        cells[doc, text] = int(hashlib.md5(key.encode()).hexdigest()[:3], 16)
    copies = {}
    for source, size in sizes.items():
        whole = int(targets[source] // size) if size else 0
        fraction = (targets[source] - whole * size) / size if size else 0
        own, owed = [(d, t) for d, t, s in rows if s == source], 0.0
        for digits in range(63, 0, -1):
            of_class = [x for x in own if n_words(x[1]).bit_length() == digits]
            if not of_class:
                continue
            total = sum(n_words(t) for _, t in of_class)
            wanted, given, best, at = fraction * total + owed, 0, (abs(fraction * total + owed), 0), 0
            for cell in sorted({cells[x] for x in of_class}):
                given += sum(n_words(x[1]) for x in of_class if cells[x] == cell)
                if abs(given - wanted) < best[0]:
                    best, at = (abs(given - wanted), given), cell + 1
            owed = wanted - best[1]
            for x in of_class:
                copies[x, source] = whole + (cells[x] < at)
    return sizes, targets, copies


def check(spark, rows, **options):
    got = mixing.taken(frame(spark, rows), **options).collect()
    sizes, targets, copies = plain_taken(rows, **options)
    want = sorted(
        (-1 if d is None else d, n_words(t), sizes[s], n_words(t) * copies.get(((d, t), s), 0)) for d, t, s in rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.taken) for r in got) == want
    near = {round(r.target, 6) for r in got}
    assert near == {round(targets[s], 6) for _, _, s in rows}
    return got, sizes, targets, copies


def corpus(seed, n, sources):
    rng = random.Random(seed)
    return [(d, " ".join(["w"] * rng.choice([0, 1, 3, 9, 40, 700])), rng.choice(sources)) for d in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    rows = corpus(seed, 300, ["a", "b", "Z", "é", "\U0001f600", "", None])
    got, sizes, targets, copies = check(spark, rows)
    for source, size in sizes.items():
        took = sum(n_words(t) * copies.get(((d, t), s), 0) for d, t, s in rows if s == source)
        assert abs(took - targets[source]) <= 350  # half of the longest document, where shorter ones can't make up for it
        assert targets[source] <= 2 * size
    assert all(r.taken <= 2 * r.size for r in got)


def test_small_sources_are_clamped_and_their_share_goes_on(spark):
    rows = [(i, "one two three", "big") for i in range(100)] + [(200, "x", "a"), (201, "x y", "c"), (202, "x y z", None)]
    _, sizes, targets, _ = check(spark, rows)
    assert targets["a"] == 2 * sizes["a"] and targets["c"] == 2 * sizes["c"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_sources_without_words(spark):
    check(spark, [(1, None, "a"), (2, "  \t\n", "b"), (None, "", None)])
    check(spark, [(1, None, "a"), (2, "a few words", "b")])


def test_ties_and_repeated_rows(spark):
    rows = [(1, "same text", "a")] * 7 + [(None, "same text", "b")] * 5 + [(None, "other text", "b")] * 2 + [(1, "another", "a")]
    check(spark, rows)


def test_one_very_long_document(spark):
    check(spark, [(0, "long " * 200_000, "a"), (1, "b", "a"), (2, "c d", "b")] + [(i, "e f g", "b") for i in range(3, 40)])


def test_other_weights_and_epochs(spark):
    check(spark, corpus(5, 120, ["a", "b", "c", "d"]), weights=(1, 10), share=2.5, max_epochs=3.0)


def test_no_documents(spark):
    assert mixing.taken(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mix_repeats_whole_rows(spark):
    rows = corpus(9, 80, ["a", "b", None])
    out = mixing.mix(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size", "copies", "__cell"]
    _, _, copies = plain_taken(rows)
    got = sorted((r.doc_id, r.text, r.copies) for r in out.collect())
    want = [(d, t, "c") for d, t, s in rows for _ in range(copies.get(((d, t), s), 0))]
    assert sorted(want) == [g for g in got if g[1]]


def test_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    check(spark, corpus(3, 100, ["a", "b", None]))
