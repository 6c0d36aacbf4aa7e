"""Collocations from depth-truncated suffix trees over vertical partitions of the corpus.

Every suffix of a piece of text, cut after ``DEPTH`` words, belongs to the partition of its
first word. Words that start more suffixes than the memory budget of a partition are replaced by
the longer prefixes that extend them, level by level; the other prefixes are packed into groups
within the budget. One pass over the texts then deals the suffixes to the groups: a task folds
equal suffixes of some millions of words into one entry with a count and sends each group one
packed array. A group orders its suffixes, which is the order of the leaves of its subtree, and
the totals of the leaves below a node are the occurrences of the node's phrase. Groups depend on
nothing but their own suffixes. What follows, the scores of phrases, is DataFrame work on those
phrases that are frequent.
"""

from __future__ import annotations

import itertools
import math
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.chunks import pack, unpack
from plumbline.llm.common import written

DEPTH = 4
LEAST = 30
TOP = 2000
# A longer phrase with this percentage of the occurrences stands for the shorter one.
COVER = 80
SCALE = 2_000_000
# Suffixes of one group, at least; it grows with the root of the corpus, so groups do no more.
BUDGET = 1 << 20
# Words that a task folds at a time.
FOLD_WORDS = 1 << 21
# Prefixes are packed into groups within shards of so many budgets.
SHARD = 8

ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
# No UTF-8 text has this byte.
BREAK = b"\xff"


def words_and_breaks(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with ``BREAK`` between pieces."""
    return text.lower().translate(TABLE).replace(b"\n", b" \xff ").split()


class _Fold:
    """Words of many texts as numbers, and their suffixes as rows of a matrix."""

    def __init__(self, depth: int) -> None:
        self.depth, self.n = depth, 0
        self.parts: list[np.ndarray] = []
        number = itertools.count(1).__next__
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number, {BREAK: 0}))

    def add(self, lang: str, text: bytes) -> None:
        words = words_and_breaks(text)
        own = np.fromiter(map(self.numbers[lang].__getitem__, words), "u4", len(words))
        self.parts += [own, np.zeros(1, "u4")]
        self.n += len(own) + 1

    def words(self) -> np.ndarray:
        """``lang``, a tab, and the word, by number; 0 has none."""
        total = 1 + sum(len(w) - 1 for w in self.numbers.values())
        out = np.empty(total, dtype=object)
        for lang, numbers in self.numbers.items():
            head = lang.encode() + b"\t"
            for word, i in numbers.items():
                if i:
                    out[i] = head + word
        return out

    def suffixes(self, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct suffixes in order, 0 beyond their end; how often each occurs).

        Only those that begin with a word whose entry in ``starts`` is true, if given.
        """
        one = np.concatenate([*self.parts, np.zeros(self.depth, "u4")])
        first = one[: len(one) - self.depth]
        if self.depth == 1:
            counts = np.bincount(first)
            counts[:1] = 0
            rows = np.flatnonzero(counts)
            return rows.astype("u4")[:, None], counts[rows]
        at = np.flatnonzero(first if starts is None else starts[first])
        rows = np.zeros((len(at), self.depth), "u4")
        rows[:, 0] = one[at]
        for j in range(1, self.depth):
            rows[:, j] = np.where(rows[:, j - 1] != 0, one[at + j], 0)
        return folded(rows, None)


def folded(rows: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sum of the counts of each."""
    if not len(rows):
        return rows, np.zeros(0, "i8")
    wide = rows.astype("u8")
    if wide.shape[1] % 2:
        wide = np.column_stack([wide, np.zeros(len(wide), "u8")])
    keys = (wide[:, ::2] << np.uint64(32)) | wide[:, 1::2]  # two numbers a key
    del wide
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0])
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    if counts is None:
        return rows[order[new]], np.diff(new, append=len(rows))
    return rows[order[new]], np.add.reduceat(counts[order], new)


def _folds(batches: Iterator[pa.RecordBatch], depth: int, fold_words: int) -> Iterator[_Fold]:
    fold = _Fold(depth)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            fold.add(lang, text.as_py())
            if fold.n >= fold_words:
                yield fold
                fold = _Fold(depth)
    if fold.n:
        yield fold


def _prefix(words: np.ndarray, row: np.ndarray) -> bytes:
    """``lang``, a tab, and the words of a prefix with blanks between."""
    return b" ".join([words[row[0]], *(words[i].rsplit(b"\t", 1)[1] for i in row[1:])])


def _prefix_counts(texts: DataFrame, length: int, longer_than: set[bytes], fold_words: int) -> DataFrame:
    """(prefix, n) of the prefixes of ``length`` words that extend one of the given ones, or of all words."""

    hot = {lang + b"\t" + p.split(b" ", 1)[0] for lang, p in (p.rsplit(b"\t", 1) for p in longer_than)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold in _folds(batches, length, fold_words):
            words = fold.words()
            if length == 1:
                rows, counts = fold.suffixes()
                prefixes = words[rows[:, 0]].tolist()
            else:
                rows, counts = fold.suffixes(np.array([False, *(w in hot for w in words[1:])]))
                whole = rows[:, -1] != 0
                rows, counts = rows[whole], counts[whole]
                own = [_prefix(words, r) for r in rows]
                keep = [i for i, p in enumerate(own) if p.rsplit(b" ", 1)[0] in longer_than]
                prefixes, counts = [own[i] for i in keep], counts[keep]
            for low in range(0, len(prefixes), 50_000):
                some = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(prefixes[some], pa.binary()), pa.array(counts[some], pa.int64())], names=["prefix", "n"])

    return texts.mapInArrow(count, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


class _Groups:
    """Which group a prefix belongs to. As many entries as there are groups and split prefixes."""

    def __init__(self, bounds: list[Any], split: set[bytes], shards: int) -> None:
        self.split, self.shards = split, shards
        self.firsts: dict[int, list[bytes]] = defaultdict(list)
        self.numbers: dict[int, list[int]] = defaultdict(list)
        for number, b in enumerate(sorted(bounds, key=lambda b: (b.shard, bytes(b.first)))):
            self.firsts[b.shard].append(bytes(b.first))
            self.numbers[b.shard].append(number)
        self.n = len(bounds)

    def of(self, prefix: bytes) -> int:
        shard = zlib.crc32(prefix) % self.shards
        at = bisect_right(self.firsts[shard], prefix) - 1
        return self.numbers[shard][at]

    def route(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and prefix length of every suffix; -1 where a split prefix is the whole suffix."""
        group, length = np.full(len(rows), -1, "i4"), np.ones(len(rows), "u1")
        if not len(rows):
            return group, length
        new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        for low, high in zip(new.tolist(), np.append(new[1:], len(rows)).tolist(), strict=True):
            prefix = words[rows[low, 0]]
            if prefix not in self.split:
                group[low:high] = self.of(prefix)
                continue
            for i in range(low, high):
                row, size = rows[i], 1
                own = prefix
                while own in self.split:
                    if size == rows.shape[1] or not row[size]:
                        own = b""
                        break
                    size += 1
                    own = _prefix(words, row[:size])
                if own:
                    group[i], length[i] = self.of(own), size
        return group, length


def _vertical(texts: DataFrame, depth: int, budget: int | None, fold_words: int) -> tuple[DataFrame, DataFrame, _Groups]:
    """(words and their counts, counts of split prefixes, groups)."""
    level = written(_prefix_counts(texts, 1, set(), fold_words), "words")
    counted, total = level, level.agg(F.sum("n")).first()[0] or 0
    # Group and split prefixes are at most some total / budget, the root of the corpus.
    budget = budget or max(BUDGET, math.isqrt(64 * total))
    loads, splits, split = [], [], set()
    for length in range(1, depth + 1):
        hot = level.where(F.col("n") > budget)
        loads.append(level.where(F.col("n") <= budget))
        found = hot.collect()
        if not found:
            break
        splits.append(hot)
        prefixes = {bytes(r.prefix) for r in found}
        split |= prefixes
        if length < depth:
            level = written(_prefix_counts(texts, length + 1, prefixes, fold_words), "prefixes")
    load = loads[0]
    for more in loads[1:]:
        load = load.unionByName(more)
    known = counted.where("false")
    for more in splits:
        known = known.unionByName(more)
    shards = -(-total // (SHARD * budget)) or 1
    shard = F.pmod(F.crc32("prefix"), F.lit(shards))
    running = Window.partitionBy("shard").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    group = (F.coalesce(F.sum("n").over(running), F.lit(0)) / budget).cast("long")
    bounds = load.withColumn("shard", shard).withColumn("group", group).groupBy("shard", "group").agg(F.min("prefix").alias("first"))
    return counted, known, _Groups(bounds.collect(), split, shards)


def _messages(texts: DataFrame, depth: int, groups: _Groups, fold_words: int) -> DataFrame:
    """One packed array of suffixes for each fold and group."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold in _folds(batches, depth, fold_words):
            words, (rows, counts) = fold.words(), fold.suffixes()
            group, length = groups.route(words, rows)
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(groups.n + 1))
            place, seen = np.zeros(len(words), "u4"), np.zeros(len(words), dtype=bool)
            out: list[tuple[int, bytes]] = []
            for g in range(groups.n):
                own = order[edges[g] : edges[g + 1]]
                if not len(own):
                    continue
                mine = rows[own]
                seen[mine] = True
                seen[0] = False
                used = np.flatnonzero(seen)
                seen[used] = False
                place[used] = np.arange(1, len(used) + 1, dtype="u4")
                small = np.ascontiguousarray(place[mine].T)
                out.append((g, pack(BREAK.join(words[used]), small, counts[own].astype("u4"), length[own])))
                if len(out) == 64:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return texts.mapInArrow(deal, "grp int, message binary")


def _batch(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["grp", "message"])


NODES = "lang string, phrase string, size int, f long"


def _subtree(depth: int, least: int):
    """Nodes with at least ``least`` leaves below them, read off the ordered suffixes of a group."""

    def build(messages: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {b"": 0}
        rows, counts, lengths = [], [], []
        for message in messages["message"]:
            words, small, n, length = unpack(message)
            place = [0, *(numbers.setdefault(w, len(numbers)) for w in words.split(BREAK))]
            rows.append(np.array(place, "u4")[small.T])
            counts.append(n.astype("i8"))
            lengths.append(length)
        own = np.concatenate(rows)
        # The prefix length is the same for all suffixes with a prefix, so it may come last in the order.
        own, n = folded(np.column_stack([own, np.concatenate(lengths).astype("u4")]), np.concatenate(counts))
        own, length = own[:, :-1], own[:, -1]
        words = np.array([*numbers], dtype=object)
        out: dict[str, list] = {"lang": [], "phrase": [], "size": [], "f": []}
        changes = np.ones(len(own), dtype=bool)
        changes[1:] = False
        for size in range(1, depth + 1):
            changes[1:] |= own[1:, size - 1] != own[:-1, size - 1]
            first = np.flatnonzero(changes)
            f = np.add.reduceat(n, first)
            keep = (f >= least) & (own[first, size - 1] != 0) & (length[first] <= size)
            for i, total in zip(first[keep], f[keep].tolist(), strict=True):
                lang, phrase = _prefix(words, own[i, :size]).rsplit(b"\t", 1)
                out["lang"].append(lang.decode())
                out["phrase"].append(phrase.decode())
                out["size"].append(size)
                out["f"].append(total)
        types = {"lang": object, "phrase": object, "size": "i4", "f": "i8"}
        return pd.DataFrame({k: pd.Series(v, dtype=types[k]) for k, v in out.items()})

    return build


def _named(counts: DataFrame) -> DataFrame:
    text = F.col("prefix").cast("string")
    phrase = F.substring_index(text, "\t", -1)
    lang = F.substring(text, F.lit(1), F.length(text) - F.length(phrase) - 1)
    return counts.select(lang.alias("lang"), phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), F.col("n").alias("f"))


def phrase_counts(
    documents: DataFrame, depth: int = DEPTH, least: int = LEAST, budget: int | None = None, fold_words: int = FOLD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, size, f`` of all phrases of up to ``depth`` words with ``f >= least``;
    ``lang, n``: all words of a language).

    A phrase lies within one piece of text; overlapping occurrences count. Null texts have no
    words; rows without a language are ``und``. ``budget`` bounds the suffixes of a group by
    twice its value.
    """
    texts = documents.select(
        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    counted, known, groups = _vertical(texts, depth, budget, fold_words)
    nodes = _messages(texts, depth, groups, fold_words).groupBy("grp").applyInPandas(_subtree(depth, least), NODES)
    found = written(nodes.unionByName(_named(known.where(F.col("n") >= least))), "phrases")
    totals = _named(counted).groupBy("lang").agg(F.sum("f").alias("n"))
    return found, written(totals, "totals")


def _wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    documents: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, cover: int = COVER,
    budget: int | None = None, fold_words: int = FOLD_WORDS,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of two to ``depth`` words with ``a >= least`` occurrences are scored at the cut where
    they are weakest: ``floor(SCALE * a / (l + r))`` with the occurrences of both parts; of equal
    cuts the first counts. Phrases inside a longer one with ``cover`` per cent of their
    occurrences are left out. Order: score and ``a`` descending, then the bytes of the phrase.
    Sums are exact beyond 64 bits. No words, no rows.
    """
    found, totals = phrase_counts(documents, depth, least, budget, fold_words)
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")

    def part(start: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice(words, start, size), " ")

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    f = found.select("lang", "phrase", "f")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(i, n)),
        )
    )
    covers = phrases.where("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = weakest.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * cover)
    )
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("n").cast("long").alias("n"), F.col("cut.score").cast("long").alias("score"),
    )
