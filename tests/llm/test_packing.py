import random
import zlib

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length long, group string"
ODD = [
    None, "", " ", "  two  blanks ", " lead", "trail ", "a\nb \n c", "tab\tand\x1f space", "it's don't I'LL 's",
    "<|endoftext|> x", "a <|endoftext|>", "x<|endoftext|>y z", "a b <|endoftext|><|endoftext|> c", "<|endoftext| >", "é È ñandú, über-groß!", "日本語 テキスト", "12,345.67 8th", "a b  c", "x_y __z__ ...!?",
    "½ ² Ⅷ ª", "é combining", "\U0001f600 \U0001f600\U0001f600", "''' '\" ''s",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_one_by_one_equal_whole_texts(tokenizer):
    encoder = packing.WordIds(tokenizer_path())
    rng = random.Random(1)
    letters = "ab Zé'ñ.,!\n\t 1- 日"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text.encode()) == np.array(expected(tokenizer, text)[:-1], "<u4").tobytes(), repr(text)


def test_printable_ascii_piece_by_piece(tokenizer):
    encoder = packing.WordIds(tokenizer_path())
    rng = random.Random(4)
    letters = "abZ'sldtrevm019.,!?-_()\"#<|>"
    texts = ["".join(rng.choices(letters + "   é", k=rng.randint(0, 30))) for _ in range(5000)]
    texts += ["it's I'LL don't'd 'tis 're x's's 1's ''s _'s -'d", "a'S b'Re 12ab34 ab12 ..a a.. 9'9"]
    for text in texts:
        assert encoder.encode(text.encode()) == np.array(expected(tokenizer, text)[:-1], "<u4").tobytes(), repr(text)


def test_added_tokens_keep_their_ids(tokenizer):
    assert 50256 in expected(tokenizer, "a <|endoftext|> b")
    encoder = packing.WordIds(tokenizer_path())
    assert np.frombuffer(encoder.encode(b"a <|endoftext|> b"), "<u4").tolist() == expected(tokenizer, "a <|endoftext|> b")[:-1]


def test_a_small_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encoder = packing.WordIds(tokenizer_path())
    text = " ".join(f"word{i % 7}, more" for i in range(50))
    assert encoder.encode(text.encode()) == np.array(expected(tokenizer, text)[:-1], "<u4").tobytes()


def check(spark, tokenizer, rows, capacity, **options):
    frame = spark.createDataFrame([(d, t, 5, "g") for d, t in rows], SCHEMA)
    got = packing.pack(frame, tokenizer_path(), capacity=capacity, **options).collect()
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = []
    for doc, text in rows:
        ids = expected(tokenizer, text)
        at, size = 0, (len(ids) - 1) % capacity + 1
        for piece in range(-(-len(ids) // capacity)):
            own = np.array(ids[at : at + size], "<u4").tobytes()
            want.append((-1 if doc is None else doc, piece, at, size, zlib.crc32(own)))
            at, size = at + size, capacity
    assert left == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


def documents(n):
    rng = random.Random(7)
    return [(d, " ".join(rng.choices(["alpha", "beta,", "Gamma", "x"], k=rng.choice([0, 3, 20, 60, 200])))) for d in range(n)]


def test_every_token_is_packed_once(spark, tokenizer):
    rows = documents(200) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again")]
    sequences, tokens = check(spark, tokenizer, rows, 64)
    assert sequences <= -(-tokens // 64) + 2


def test_leftovers_of_many_groups_meet(spark, tokenizer):
    sequences, tokens = check(spark, tokenizer, documents(300), 128, group_pieces=20)
    assert sequences <= 1.1 * tokens / 128


def test_no_documents(spark, tokenizer):
    assert check(spark, tokenizer, [], 1024) == (0, 0)


def best(lengths, capacity, rooms=()):
    """Fewest sequences, by trying every place for every piece."""
    if not lengths:
        return len(rooms)
    size, rest = lengths[0], lengths[1:]
    found = [best(rest, capacity, (*rooms, capacity - size))]
    for i, room in enumerate(rooms):
        if room >= size and room not in rooms[:i]:
            found.append(best(rest, capacity, (*rooms[:i], room - size, *rooms[i + 1 :])))
    return min(found)


def test_bound_and_packing_surround_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 7))])
        fewest = best(sorted(lengths.tolist(), reverse=True), 20)
        _, _, filled = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= fewest <= len(filled)


def test_bound_sees_more_than_the_volume():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
