import hashlib
import random

from plumbline.llm import decontaminate
from tests.llm import brute

DOCS = "doc_id long, text string, item_id long, word string"
ITEMS = "item_id long, text string, doc_id long"


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "w") for d, t in docs], DOCS),
        spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS),
    )


def check(spark, docs, items):
    got = {r.doc_id: r for r in decontaminate.contamination(*frames(spark, docs, items)).collect()}
    want = brute.contamination(docs, items)
    assert set(got) == set(want)
    for doc, (words, hit, found) in want.items():
        r = got[doc]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (words, hit, len(found), digest, hit > 0)


def sample():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ñ1", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "!?"), (33, items[4][1]), (34, "one")]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            item = rng.choice(items)[1] or ""
            words = item.split()
            cut = rng.randint(0, 3)
            parts += words[cut:] if rng.random() < 0.7 else rng.choices(vocabulary, k=8)
        docs.append((d, rng.choice([" ", ", ", "\n--"]).join(w.upper() if rng.random() < 0.1 else w for w in parts)))
    return docs + [(500, None), (501, ""), (502, "..."), (503, "one"), (504, "One, one ONE")], items


def test_against_plain_search(spark):
    check(spark, *sample())


def test_beyond_the_broadcast_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, *sample())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark):
    docs, items = sample()
    check(spark, [], items)
    check(spark, docs[:5], [])
    check(spark, docs[:5], [(1, None)])


def test_repeated_rows_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(12))
    got = decontaminate.contamination(*frames(spark, [(1, text), (1, text), (None, text)], [(7, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 12, 12), (1, 12, 12), (1, 12, 12)]


def test_stage_keeps_the_rest(spark):
    docs, items = sample()
    kept = decontaminate.decontaminate(*frames(spark, docs, items))
    assert kept.columns == ["doc_id", "text", "item_id", "word"]
    want = brute.contamination(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, hit, _) in want.items() if not hit)


def test_stage_judges_rows_and_not_ids(spark):
    bad, clean = " ".join(f"w{i}" for i in range(12)), "nothing of the kind"
    docs = [(1, bad), (1, clean), (None, bad), (None, clean), (None, None)]
    kept = decontaminate.decontaminate(*frames(spark, docs, [(7, bad)])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, clean), (1, clean)]


def test_rows_are_judged_by_their_own_text(spark):
    bad, clean = " ".join(f"w{i}" for i in range(12)), "nothing of the kind"
    docs = [(1, bad), (1, clean), (None, bad), (None, clean), (None, None), (1, clean)]
    got = decontaminate.contamination(*frames(spark, docs, [(7, bad)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in got) == [
        (0, 0, 0, False), (0, 4, 0, False), (0, 12, 12, True), (1, 4, 0, False), (1, 4, 0, False), (1, 12, 12, True),
    ]


def test_a_column_named_like_the_row_number_survives(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "y")], "doc_id long, text string, __row string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == ["doc_id", "text", "__row"] and [tuple(r) for r in kept.collect()] == [(2, "c d", "y")]
