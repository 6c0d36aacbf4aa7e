"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation becomes one byte per row: the initial of its role and its faults. The rows are put
in order by a range shuffle of these small records, so one conversation may span many tasks, and
are cut into blocks of the square root of all rows. For each block a min-plus matrix says what it
costs to get from each state of the grammar to each other; chaining the matrices of a
conversation backward gives the state-cost vector at every block end, the outer checkpoints.
Then blocks are independent again: each keeps its backward vectors only at every square root of
its rows, recomputes the stretch between two of them while walking forward, and emits the
ASCII-least tight edits for every state it may be entered in. Chaining these forward selects the
walk that counts. Texts take part only at the end, sorted once by conversation and streamed past
the edits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

# Rows of a block, at least.
BLOCK_ROWS = 4096
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

# States: nothing yet, after s, after u, after a. Where the next u or a leads:
NEXT = (2, 2, 3, 2)
# Initials s, u, a and others; the state that keeping a row leads to, by state and initial, or -1.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
# What completing the grammar costs from each state.
END = (0, 4, 2, 0)
NONE = 1 << 40
LEGAL = {(0, 1), (1, 2), (2, 1)}
MUST_GO, TRUNCATED = 4, 8


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults that depend on ``conv_id:turn``.

    Of twenty residues of a checksum, 0 drops the row, 1 empties its text, 2 removes ``[.!?]``,
    3 repeats the row, and 4 sets the role ``user``. Null ids and turns are one space in the
    checksum; null roles and texts become one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def before(code: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """The state-cost vector before a row, from the one after it."""
    costs = [DELETE + x for x in v]
    if not code & MUST_GO:
        more, initial = CUT_OFF if code & TRUNCATED else 0, code & 3
        for q in range(4):
            kept = KEPT[q][initial]
            if kept >= 0:
                costs[q] = min(costs[q], KEEP + more + v[kept])
            costs[q] = min(costs[q], REROLE + more + v[NEXT[q]])
    return inserted(costs)


def inserted(c: Any) -> tuple[int, ...]:
    """A vector when rows may be inserted first."""
    two, three = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + two), min(c[1], INSERT + two), two, three


def matrix(codes: bytes) -> list[int]:
    """Costs from each state before a block to each state after it, row by row."""
    if not codes:
        return [0 if q == p else NONE for q in range(4) for p in range(4)]
    step = {c: np.array([before(c, tuple(0 if p == q else NONE for p in range(4))) for q in range(4)], "i8").T for c in set(codes)}
    parts = np.stack([step[c] for c in codes])
    while len(parts) > 1:  # min-plus products of neighbours
        odd = parts[-1:] if len(parts) % 2 else parts[:0]
        a, b = parts[: len(parts) // 2 * 2 : 2], parts[1 : len(parts) // 2 * 2 : 2]
        parts = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), NONE), odd])
    return parts[0].ravel().tolist()


def walk(codes: bytes, after: tuple[int, ...], starts: tuple[int, ...], last: bool) -> list[tuple[int, str, int]]:
    """(state after the block, edits, cost) of the least tight walk from each start state.

    ``after`` is the vector behind the block. The last block of a conversation also completes the
    grammar.
    """
    n = len(codes)
    stride = math.isqrt(n) + 1
    marks, v = {n: after}, after
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % stride == 0:
            marks[i] = v
    walks: list[list] = [[q, [], 0] for q in starts]
    for low in range(0, n, stride):
        high = min(low + stride, n)
        ahead = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            ahead.append(before(codes[i], ahead[-1]))
        ahead.reverse()
        for one in walks:
            q, edits, cost = one
            for i in range(low, high):
                code, here, then = codes[i], ahead[i - low], ahead[i - low + 1]
                more, keep = (CUT_OFF if code & TRUNCATED else 0), KEPT[q][code & 3]
                while True:  # edits in ASCII order: D, I, K, R
                    if here[q] == DELETE + then[q]:
                        edits.append("D")
                        cost += DELETE
                    elif here[q] == INSERT + here[NEXT[q]]:
                        edits.append("I")
                        cost += INSERT
                        q = NEXT[q]
                        keep = KEPT[q][code & 3]
                        continue
                    elif keep >= 0 and here[q] == KEEP + more + then[keep]:
                        edits.append("K")
                        cost += KEEP + more
                        q = keep
                    else:
                        edits.append("R")
                        cost += REROLE + more
                        q = NEXT[q]
                    break
            one[0], one[2] = q, cost
    if last:
        for one in walks:
            while one[0] in (1, 2):
                one[0] = NEXT[one[0]]
                one[1].append("I")
                one[2] += INSERT
    return [(q, "".join(edits), cost) for q, edits, cost in walks]


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and what the order and the faults of a row depend on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    same = F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text").cast("binary"), 256)
    return rows.select("*", F.unhex(same).alias("digest"), F.right(bare, F.lit(1)).alias("ending"))


ORDER = ("conv_id", "turn", "role", "digest", "tie")


def _ordered(prepared: DataFrame) -> DataFrame:
    """Small records of all rows, ordered over the whole table by the column ``seq``."""
    rows = written(
        prepared.select("conv_id", "turn", "role", "digest", "ending", F.monotonically_increasing_id().alias("tie")), "records"
    )
    # Copies are joined back on a key that may be hot; the adaptive planner splits its rows.
    place = F.struct("turn", "tie")
    copies = rows.where("ending <> ''").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same"))
    firsts = copies.agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    initial = F.left("role", F.lit(1))
    fault = (
        F.when(F.col("ending") == "", 1)
        .when(F.col("first.tie") != F.col("tie"), 2)
        .when(~F.col("ending").isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    flagged = met.select(
        *ORDER, F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"), fault.alias("fault")
    )
    flagged = written(flagged, "flagged")
    dealt = flagged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "turn", "initial", "fault", F.monotonically_increasing_id().alias("seq"))


BLOCK = (
    "seq long, codes binary, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long"
)


class _Block:
    def __init__(self, conv: Any, seq: int) -> None:
        self.conv, self.seq, self.codes = conv, seq, bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, initial: int, fault: int) -> None:
        self.illegal += bool(self.codes) and (self.initial, initial) not in LEGAL
        self.initial = initial
        self.codes.append(initial | (MUST_GO if fault in (1, 2) else 0) | (TRUNCATED if fault == 3 else 0))
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1

    def row(self, whole: bool) -> tuple:
        codes = bytes(self.codes)
        return (
            self.conv, self.seq, codes, *self.faults[1:], self.illegal, self.first, self.last, self.turns,
            None if whole else matrix(codes),
        )


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _batch(some, schema)
            some = []
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _blocks(ordered: DataFrame, block_rows: int) -> DataFrame:
    """Runs of rows of one conversation. ``matrix`` is null where a run is a whole conversation."""
    conv = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, {BLOCK}, matrix array<long>"
    arrow = _arrow(ordered, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, edge = None, True  # ``edge``: the run may have begun in an earlier partition or block
        for batch in batches:
            for conv, turn, initial, fault, seq in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if block is None:
                    block = _Block(conv, seq)
                elif block.conv != conv:
                    yield block.row(whole=not edge)
                    block, edge = _Block(conv, seq), False
                elif len(block.codes) == block_rows:
                    yield block.row(whole=False)
                    block, edge = _Block(conv, seq), True
                block.add(turn, initial, fault)
        if block is not None:
            yield block.row(whole=False)

    return ordered.mapInArrow(lambda batches: _batches(cut(batches), arrow), schema)


def _arrow(like: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _after(blocks: pd.DataFrame) -> pd.DataFrame:
    """The vector behind every block of one conversation, chained backward."""
    blocks = blocks.sort_values("seq", ignore_index=True)
    v, out = np.array(END, "i8"), []
    for m in reversed(blocks["matrix"].tolist()):
        out.append(v.tolist())
        v = np.minimum((np.asarray(m, "i8").reshape(4, 4) + v).min(axis=1), NONE)
    last = np.arange(len(blocks)) == len(blocks) - 1
    return pd.DataFrame({"conv_id": blocks["conv_id"], "seq": blocks["seq"], "after": out[::-1], "last": last})


def _entered(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which every block of one conversation is entered, chained forward."""
    blocks = blocks.sort_values("seq", ignore_index=True)
    state, out = 0, []
    for ends in blocks["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"conv_id": blocks["conv_id"], "seq": blocks["seq"], "state": np.array(out, "i4")})


def _walked(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the edits and the cost of each."""
    conv = blocks.schema["conv_id"].dataType.simpleString()
    key = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("at"))
    kept = ["conv_id", *(f.split()[0] for f in BLOCK.split(", "))]

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({"conv_id": "of", "seq": "at"})

    # Blocks that are a part of a conversation: as many as partitions, conversations longer than a
    # block, and blocks of these.
    parts = blocks.where("matrix is not null")
    after = parts.select("conv_id", "seq", "matrix").groupBy("conv_id").applyInPandas(
        _after, f"conv_id {conv}, seq long, after array<long>, last boolean"
    )
    parts = parts.drop("matrix").join(named(after), key).drop("of", "at")

    schema = f"conv_id {conv}, {BLOCK}, ends array<int>, audits array<string>, costs array<long>"
    arrow = _arrow(blocks, schema)

    def walks(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                known: dict[bytes, tuple] = {}  # short conversations are often alike
                for batch in batches:
                    columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                    for row in zip(*columns, strict=True):
                        codes = row[2]
                        if whole:
                            found = known.get(codes)
                            if found is None:
                                found = tuple(zip(*walk(codes, END, (0,), True), strict=True))
                                if len(codes) < 64 and len(known) < 100_000:
                                    known[codes] = found
                        else:
                            found = tuple(zip(*walk(codes, tuple(row[-2]), (0, 1, 2, 3), row[-1]), strict=True))
                        yield (*row[: len(kept)], *(list(x) for x in found))

            yield from _batches(rows(), arrow, 500)

        return run

    whole = blocks.where("matrix is null").select(*kept).mapInArrow(walks(True), schema)
    part = written(parts.select(*kept, "after", "last").mapInArrow(walks(False), schema), "walks")
    state = part.select("conv_id", "seq", "ends").groupBy("conv_id").applyInPandas(_entered, f"conv_id {conv}, seq long, state int")
    part = part.join(named(state), key).drop("of", "at")
    found = whole.withColumn("state", F.lit(0)).unionByName(part)
    return found.select(*kept, F.get("audits", "state").alias("audit"), F.get("costs", "state").alias("cost"))


REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
ROWS = "place long, edit string, role string, text string"


class _Conversation:
    """Edits of all blocks first, then texts, one by one."""

    def __init__(self, conv: Any) -> None:
        self.conv, self.audits = conv, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.first = self.last = self.initial = None
        self.audit: str | None = None
        self.at = self.place = 0
        self.due = "user"
        self.hash = hashlib.sha256()

    def block(self, b: dict) -> None:
        for name in self.counts:
            self.counts[name] += b[name]
        if self.initial is not None and (self.initial, b["codes"][0] & 3) not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = b["codes"][-1] & 3
        if b["first_turn"] is not None:
            self.counts["turns"] -= b["first_turn"] == self.last
            self.first, self.last = (b["first_turn"] if self.first is None else self.first), b["last_turn"]
        self.audits.append(b["audit"])

    def _emit(self, edit: str, role: str, text: str) -> tuple:
        self.hash.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode())
        self.place += 1
        self.due = "assistant" if role[:1] == "u" else "user"
        return self.conv, self.place, edit, role, text

    def _inserted(self) -> Iterator[tuple]:
        if self.audit is None:
            self.audit = "".join(self.audits)
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._emit("I", self.due, "")

    def text(self, role: str, text: str) -> Iterator[tuple]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._emit(edit, role if edit == "K" else self.due, text)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()

    def report(self) -> tuple:
        c = self.counts
        gaps = 0 if self.first is None else self.last - self.first + 1 - c["turns"]
        return self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], self.audit, self.hash.hexdigest()


def _repair(conversations: DataFrame, block_rows: int | None, want_rows: bool) -> DataFrame:
    prepared = _prepared(conversations)
    conv = prepared.schema["conv_id"].dataType.simpleString()
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, math.isqrt(conversations.count()))
    blocks = written(_blocks(_ordered(prepared), block_rows), "blocks")
    walked = _walked(blocks)
    block = F.struct(*[c for c in walked.columns if c not in ("conv_id", "seq")])
    texts = prepared.select(
        "conv_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "turn", "role", "digest", "text"
    )
    edits = walked.select("conv_id", F.lit(0).alias("kind"), "seq", block.alias("block"))
    stream = edits.unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "seq", "turn", "role", "digest")
    schema = f"conv_id {conv}, {ROWS if want_rows else REPORT}"
    arrow = _arrow(stream, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        one: _Conversation | None = None
        for batch in batches:
            for conv, kind, role, text, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if one is None or one.conv != conv:
                    if one is not None:
                        rows = one.end()
                        yield from rows if want_rows else [one.report() for _ in [*rows, None][-1:]]
                    one = _Conversation(conv)
                if kind == 0:
                    one.block(b)
                    continue
                for row in one.text(role, text):
                    if want_rows:
                        yield row
        if one is not None:
            rows = one.end()
            yield from rows if want_rows else [one.report() for _ in [*rows, None][-1:]]

    columns = stream.select("conv_id", "kind", "role", "text", "block")
    return columns.mapInArrow(lambda batches: _batches(run(batches), arrow, 1000), schema)


def repaired(conversations: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The repaired rows: conv_id, place (from 1), edit (K, R or I), role, text.

    Rules as in ``report``.
    """
    return _repair(conversations, block_rows, want_rows=True)


def report(conversations: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Faults and the cheapest repair of every conversation: conv_id and ``REPORT``.

    Rows are taken by turn, null first; rows of one turn by role, then by a digest of role and
    text. Null roles and texts are one space; rows without a conv_id are one conversation. The
    first fault of a row counts: blank, then a role and text seen earlier, then an ending other
    than ``.!?``. Edits keep a row (0), set its role to user or assistant (2), delete it (3; blank
    rows and duplicates must go) or insert an empty one (2); rows that stay truncated cost 1. The
    roles that stay begin with ``(s?(ua)+)?``. Of the cheapest repairs the one whose edits, as
    letters K, R, D and I, are least in ASCII is taken. No rows, no conversations. A
    conversation's edits are one value and its texts are hashed in order, so its last step is one
    task, which streams.
    """
    return _repair(conversations, block_rows, want_rows=False)


def damage_report(conversations: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``report`` of the damaged rows, for every conversation there was before the damage.

    One that lost all rows has zeros, no edits, and the digest of nothing.
    """
    found = report(damage(conversations), block_rows)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
