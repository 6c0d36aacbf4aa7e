import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from plumbline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, seq long, block string, digest string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "d") for r in rows], SCHEMA).repartition(3)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub(r"[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        if not end:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, edits, output lines) by trying all edits, with up to two insertions in a row."""
    names = {"u": "user", "a": "assistant"}
    may_follow = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}

    @cache
    def rest(i, last, insertions):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def then(cost, edit, line, j, role, left):
            more = rest(j, role, left)
            if more:
                found.append((cost + more[0], edit + more[1], (() if line is None else (line,)) + more[2]))

        for letter in "ua":
            if last in may_follow[letter] and insertions:
                then(2, "I", f"{names[letter]}:", i, letter, insertions - 1)
        if i < len(rows):
            role, text = rows[i]
            then(3, "D", None, i + 1, last, 2)
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                if last in may_follow.get(role[:1], ()):
                    then(more, "K", f"{role}:{text}", i + 1, role[0], 2)
                for letter in "ua":
                    if last in may_follow[letter]:
                        then(2 + more, "R", f"{names[letter]}:{text}", i + 1, letter, 2)
        return min(found, default=None)

    return rest(0, "", 2)


def plain_report(rows, damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        lines = [(r[2], r[3]) for r in own]
        faults = plain_faults(lines)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(lines, lines[1:], strict=False)]
        cost, audit, output = cheapest(tuple(lines), tuple(faults))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(output).encode()).hexdigest(),
        )
    return out


def corpus(seed, convs=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        turns = list(range(rng.randint(1, longest)))
        for t in turns:
            if rng.random() < 0.1:
                continue
            turn = rng.choice([t] * 12 + [None, t + 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t", "", None, "ends . \n", "x\x1c", f"text {conv} {t}."])
            rows.append((conv, turn, role, text))
    return rows


def check(spark, rows, **options):
    got = repair.damage_report(frame(spark, rows), **options).collect()
    want = plain_report(rows, plain_damage(rows))
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("block_rows", [None, 3, 1])
def test_equals_trying_all_edits(spark, block_rows):
    check(spark, corpus(1), block_rows=block_rows)


def test_one_conversation_in_many_blocks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t {t}.", "cut", "Again."])) for t in range(300)]
    one = repair.damage_report(frame(spark, rows)).collect()
    for size in (4, 17):
        assert repair.damage_report(frame(spark, rows), block_rows=size).collect() == one


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "Same.")] * 40 + [(1, 0, "assistant", "Same.")] * 3 + [(2, None, "user", "a")] * 3 + [(3, 5, "system", "S.")]
    check(spark, rows, block_rows=5)


def test_very_long_text(spark):
    check(spark, [(1, 0, "user", "long " * 300_000), (1, 1, "assistant", "Short.")])


def test_no_conversations(spark):
    assert repair.damage_report(frame(spark, [])).collect() == []


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.damage_report(frame(spark, [(lost, 0, "user", "Hi.")])).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", EMPTY)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi."), (1, 3, "bot", "Yes."), (2, 0, "assistant", "A.")]
    got = sorted(tuple(r) for r in repair.repaired(frame(spark, rows)).collect())
    assert got == [
        (1, 1, "K", "system", "S."), (1, 2, "K", "user", "Hi."), (1, 3, "R", "assistant", "Yes."),
        (2, 1, "I", "user", ""), (2, 2, "K", "assistant", "A."),
    ]
    for conv in (1, 2):
        roles = "".join(r[3][0] for r in got if r[0] == conv)
        assert GRAMMAR.fullmatch(roles)
    report = {r.conv_id: r for r in repair.report(frame(spark, rows)).collect()}
    lines = "\n".join(f"{r[3]}:{r[4]}" for r in got if r[0] == 1)
    assert report[1].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_matrices_agree_with_the_vectors():
    rng = random.Random(2)
    for _ in range(50):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 9, 10, 13]) for _ in range(rng.randint(1, 20)))
        v = tuple(rng.randint(0, 9) for _ in range(4))
        v = repair.inserted(v)
        want = v
        for c in reversed(codes):
            want = repair.before(c, want)
        m = repair.matrix(codes)
        assert tuple(min(m[4 * q + p] + v[p] for p in range(4)) for q in range(4)) == want
