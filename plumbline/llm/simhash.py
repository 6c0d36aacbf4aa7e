"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are a DataFrame aggregate. Equal ones are one class. Classes within ``radius`` bits
of each other agree in at least two of ``radius + 2`` bit blocks, so they meet in one of the
tables that group by two blocks. A group is compared vertically: bit ``p`` of 64 fingerprints is
one word, a fingerprint is compared with 64 others by 64 XORs whose results feed carry-save
counters, and words in which every distance is above the radius are abandoned on the way.
Groups larger than ``GROUP_ROWS`` are cut into blocks that meet pairwise in tiles. A task keeps
only a spanning forest of the links it finds, so links of large groups don't multiply.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, lower_ascii, numbered, written
from plumbline.llm.forest import Forest
from plumbline.operators.components import connected_components

SHINGLE = 3
RADIUS = 3
GROUP_ROWS = 4096
# So many rows of a partition have their bit planes in memory at once, and so many words are
# compared in one go.
SLICE_ROWS = 1 << 17
UNITS = 1 << 16


def words(text: Column) -> Column:
    """A-Z lower-cased; then runs without blanks and ASCII control spaces. Null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (long) per doc_id.

    A bit is set if it is set in over half of the shingle hashes; repeated shingles count as often
    as they occur. Texts with fewer than ``size`` words are one shingle; without words, and for
    null, the fingerprint is zero. Rows that repeat a doc_id are read as one text.
    """
    texts = documents.select("doc_id", words(F.col("text")).alias("words"))
    n = F.size("words")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array(F.lit(0)))
    at = texts.select("doc_id", "words", n.alias("n"), F.explode(starts).alias("at"))
    parts = [F.get("words", F.col("at") + i) for i in range(size)]  # null beyond the end
    shingle = F.when(F.col("n") > 0, F.xxhash64(F.concat_ws(" ", *parts)))
    hashed = at.select("doc_id", shingle.alias("h"))
    # Two 32-bit counters in one long.
    pairs = [
        F.sum(F.shiftright("h", i).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{i}") for i in range(32)
    ]
    sums = hashed.groupBy("doc_id").agg(F.count("h").alias("n"), *pairs)
    bits = F.lit(0).cast("long")
    for i in range(32):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", 32)
        for count, place in ((low, i), (high, i + 32)):
            value = F.lit(1 << place if place < 63 else -(1 << 63)).cast("long")
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), value).otherwise(F.lit(0).cast("long")))
    return sums.select("doc_id", bits.alias("fingerprint"))


def block_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each pair of the ``radius + 2`` bit blocks."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit b of word w of plane p is bit p of fingerprint 64 w + b."""
    padded = np.zeros(-(-len(prints) // 64) * 64, dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_pairs(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < ends[i], of fingerprints at most ``radius`` bits apart."""
    planes = _planes(prints)
    rows = np.flatnonzero(ends > np.arange(len(prints)) + 1)
    first, last = rows // 64, (ends[rows] - 1) // 64
    counts = last - first + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for low in range(0, int(offsets[-1]), UNITS):
        unit = np.arange(low, min(low + UNITS, int(offsets[-1])))
        owner = np.searchsorted(offsets, unit, side="right") - 1
        row, word = rows[owner], first[owner] + unit - offsets[owner]
        start = np.clip(row + 1 - 64 * word, 0, 63).astype("u8")
        stop = np.minimum(ends[row] - 64 * word, 64).astype("u8")
        everything = ~np.uint64(0)
        valid = (everything << start) & (everything >> (np.uint64(64) - stop))
        valid[row + 1 - 64 * word > 63] = 0
        query, over = prints[row], np.zeros(len(row), dtype="u8")
        counters = [np.zeros(len(row), dtype="u8") for _ in range(int(radius).bit_length())]
        for p in range(64):
            carry = planes[p][word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
            for k, counter in enumerate(counters):
                carry, counters[k] = counter & carry, counter ^ carry
            over |= carry
            if p >= 7 and p % 8 == 7:
                alive = (~over & valid) != 0
                if not alive.any():
                    row = row[:0]
                    break
                if alive.mean() < 0.75:
                    row, word, valid, query, over = (x[alive] for x in (row, word, valid, query, over))
                    counters = [x[alive] for x in counters]
        if len(row):
            hits = ~over & valid
            bits = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(bits)
            i, j = row[at], 64 * word[at] + bit
            near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
            yield i[near], j[near]


def _forest_of(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links that connect what the groups of a task connect."""
    forest = Forest(rows["rep"].to_numpy())
    keys = rows[["table", "key", "tile"]].to_numpy()
    order = np.lexsort(keys.T[::-1])
    keys, node = keys[order], forest.node[order]
    prints = rows["fingerprint"].to_numpy().view("u8")[order]
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    bounds = np.append(new, len(keys))
    at = 0
    while at < len(bounds) - 1:  # whole groups, SLICE_ROWS rows or one group at a time
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_ROWS, side="right")) - 1)
        low, high = bounds[at], bounds[to]
        ends = np.repeat(bounds[at + 1 : to + 1], np.diff(bounds[at : to + 1])) - low
        for i, j in close_pairs(prints[low:high], ends, radius):
            forest.link(node[low:high][i], node[low:high][j])
        at = to
    return forest.links()


def similar_classes(fingerprint: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint and component for every distinct fingerprint of ``(doc_id, fingerprint)``.

    A component is the smallest doc_id that links of at most ``radius`` bits reach; null where a
    fingerprint has no doc_id.
    """
    classes = written(fingerprint.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    tables = F.inline(
        F.array(*[
            F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key"))
            for t, m in enumerate(signed)
        ])
    )
    rows = classes.where("rep is not null").select("fingerprint", "rep", tables)
    size = rows.groupBy("table", "key").count().where(F.col("count") > GROUP_ROWS)
    size = written(size.withColumn("blocks", F.ceil(F.col("count") / GROUP_ROWS)).drop("count"), "hot-groups")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fingerprint"), blocks)
    dealt = (
        rows.join(size, ["table", "key"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("tile", F.greatest("own", "other") * (1 << 31) + F.least("own", "other"))
        .select(F.col("table").cast("long").alias("table"), "key", "tile", "fingerprint", "rep")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield _forest_of(pd.concat(parts, ignore_index=True), radius)

    links = dealt.repartition("table", "key", "tile").mapInPandas(compare, "a long, b long")
    found = connected_components(links)
    return classes.join(found, F.col("rep") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("component")
    )


def near_duplicates(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits. Rows are
    compared by their own texts, also if they repeat a doc_id or have none; null where nothing
    reachable has one.
    """
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id")).alias("doc_id")
    keyed = fingerprints(documents.select(row, "text"), size)
    prints = written(keyed.select("doc_id.row", "doc_id.doc_id", "fingerprint"), "fingerprints")
    found = similar_classes(prints.select(F.col("row").alias("doc_id"), "fingerprint"), radius)
    lowest = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    classes = written(found.join(lowest, "fingerprint"), "components")
    least = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(least, "component").select(F.col("fingerprint").alias("of"), "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("of")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_of_each(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``documents`` with one row of each component: the first of those with the smallest doc_id.

    Rows are compared, whatever their doc_id. Rows without one are no rivals of rows that have one:
    of the former, one of each component stays too.
    """
    row = free_name(documents, "row")
    rows = numbered(documents, row)
    texts = rows.select(F.col(row).alias("doc_id"), "text")
    prints = written(fingerprints(texts, size), "fingerprints")
    found = prints.join(similar_classes(prints, radius), "fingerprint").select(F.col("doc_id").alias(row), "component")
    found = found.join(rows.select(row, "doc_id"), row)
    first = found.groupBy("component", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", row)).alias("first"))
    gone = found.select(row).join(first.select(f"first.{row}"), row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*documents.columns)
