import random

import pytest

from plumbline.llm import suffix_dedup
from tests.llm import brute


def rows():
    rng = random.Random(1)
    passages = ["".join(rng.choices("abcd é", k=rng.randint(40, 200))) for _ in range(20)]
    out = []
    for _ in range(250):
        parts = [
            rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices("xyzw q", k=rng.randint(1, 120)))
            for _ in range(rng.randint(0, 6))
        ]
        out.append((rng.randint(0, 200), "".join(parts)))
    return out + [
        (None, passages[0] * 3), (5, None), (7, ""), (900, "a" * 400), (901, "a" * 300), (902, "ab" * 200),
        (903, "ab" * 100), (3, passages[0] * 3), (904, "x" * 49), (905, "x" * 49), (906, "x" * 50), (907, "x" * 50),
    ]


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def check(spark, data, **options):
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in data], "doc_id long, text string, row long, chunk string")
    got = suffix_dedup.remove_repeats(frame, **options).collect()
    assert order(tuple(r) for r in got) == order(r[:5] for r in brute.removed(data))


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 7, "hot_documents": 5}])
def test_against_plain_search(spark, options):
    check(spark, rows(), **options)


def test_no_documents(spark):
    check(spark, [])


def test_slices_of_long_texts(monkeypatch):
    data = [random.Random(2).choices("ab", k=3000), random.Random(3).choices("ab ", k=700)]
    text = suffix_dedup.ChunkText(["".join(d).encode() for d in data])

    def strings(found):
        return {int(b) + i: int(k) for begin, n, _, key in found for b, m, k in zip(begin, n, key, strict=True) for i in range(m)}

    whole = strings(text.records())
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    assert strings(text.records()) == whole
    assert sorted(whole) == [*range(2951), *range(3000, 3651)]


def test_stage_cuts_texts_only(spark):
    data = rows()
    frame = spark.createDataFrame(
        [(d, t, "en", "s", len(t or "")) for d, t in data], "doc_id long, text string, lang string, row string, n_chars long"
    )
    got = suffix_dedup.without_repeats(frame)
    assert got.columns == frame.columns
    want = [(d, None if t is None else r[5].decode(errors="ignore")) for (d, t), r in zip(data, brute.removed(data), strict=True)]
    found = got.collect()
    assert order((r.doc_id, r.text or "") for r in found) == order((d, t or "") for d, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    assert sum(r.text is None for r in found) == 1
