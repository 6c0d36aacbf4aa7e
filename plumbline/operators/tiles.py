"""Laying out all-pairs comparisons as tiles of bounded size.

Some comparisons have no equality to join on: two names are alike or not, whatever their
keys. The exact answer needs every pair looked at, so the records are cut into blocks by
hash, and a task gets two blocks (Okcan and Riedewald, SIGMOD 2011). A task compares its
blocks with array operations and returns only what qualifies; pairs are never rows of a
Spark plan. Each record travels once per block, and the block size bounds a task's memory.

Records compared within groups (a shared key) are laid out the same way: small groups are
packed together, and a group larger than a block is cut into tiles like everything else.

Where both sides have many blocks, copies of records for every tile would fill the disks. Then each
block is one packed row of a written table, and a Cartesian product of these rows deals out the pairs
of blocks, so a record is written and shuffled twice however many blocks there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.durable import materialise

BLOCK_ROWS = 8192
# A packed block holds so many times the rows of a block that travels by row. Two of them take
# some 3 KB a row in a task that compares vendors.
PACKED = 4
MAX_TILE_TASKS = 50_000
LEFT, RIGHT, BOTH = 0, 1, 2


def block_count(records: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Enough blocks to bound their size and, for smaller inputs, to occupy the cores."""
    by_size = math.ceil(records / block_rows)
    by_cores = min(math.ceil(math.sqrt(2 * parallelism)), math.ceil(records / 256))
    return max(1, by_size, by_cores)


def bucket_rows(records: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Records per bucket of small groups: a block, or less to occupy the cores."""
    return min(block_rows, max(256, records // parallelism + 1))


def _block(identity: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(identity, F.lit("block")), blocks)


def _spread(df: DataFrame, prefix: Column, identity: Column, blocks: Column) -> DataFrame:
    """Send every record to the tiles of its block: (i, j) with i <= j."""
    mine = _block(identity, blocks)
    cut = df.withColumn("_mine", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1))
    )
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = (
        F.when(F.col("_mine") == F.col("_other"), BOTH)
        .when(F.col("_mine") < F.col("_other"), LEFT)
        .otherwise(RIGHT)
    )
    return cut.withColumns(
        {"_tile": F.concat_ws("/", prefix, low.cast("string"), high.cast("string")), "_side": side}
    ).drop("_mine", "_other")


def self_tiles(df: DataFrame, identity: str, blocks: int) -> DataFrame:
    """Tiles in which every unordered pair of records meets exactly once."""
    return _spread(df, F.lit("self"), F.col(identity), F.lit(blocks))


def packed_blocks(
    df: DataFrame, identity: str, group: Column, blocks: Column, count: int, left_out: list[str]
) -> DataFrame:
    """(_group, _block, _rows): the records of a block of a group as one written row.

    ``group`` numbers the groups, ``blocks`` is the number of blocks of the record's group and
    ``count`` that of all. The columns ``left_out`` are not packed.
    """
    cut = df.withColumns({"_group": group, "_block": _block(F.col(identity), blocks)}).drop(*left_out)

    def pack(rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        kept = rows.drop_columns(["_group", "_block"])
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        whole = pa.array([sink.getvalue().to_pybytes()], pa.large_binary())
        return pa.table({"_group": rows["_group"][:1], "_block": rows["_block"][:1], "_rows": whole.cast(pa.binary())})

    dealt = cut.repartition(max(1, min(count, MAX_TILE_TASKS)), "_group", "_block").groupBy("_group", "_block")
    return materialise(dealt.applyInArrow(pack, "_group int, _block long, _rows binary"), "blocks")


def block_pairs(packed: DataFrame, few: int, many: int) -> DataFrame:
    """(_rows, _other): every two of the ``few`` blocks of group 0 once and each with every block of other
    groups, which are ``many``; ``_other`` is null where a block meets itself.

    A Cartesian product neither broadcasts nor copies its sides; a task reads one block of each, as
    long as that makes no more than ``MAX_TILE_TASKS`` tasks.
    """
    left = packed.where("_group = 0").select(F.col("_block").alias("_at"), "_rows")
    right = packed.select("_group", "_block", F.col("_rows").alias("_other"))
    few = max(1, min(few, MAX_TILE_TASKS))
    left = left.repartitionByRange(few, "_at")
    right = right.repartitionByRange(max(1, min(few + many, MAX_TILE_TASKS // few)), "_group", "_block")
    met = left.hint("shuffle_replicate_nl").join(right, F.expr("_group > 0 OR _at <= _block"))
    alone = F.expr("_group = 0 AND _at = _block")
    return met.select("_rows", F.when(~alone, F.col("_other")).alias("_other"))


def key_tiles(
    df: DataFrame, key: str, size: str, identity: str, total: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Tiles in which every pair of records with an equal key meets once.

    ``size`` is the number of records with that key. Keys up to a block share buckets;
    a larger key is cut into blocks of its own.
    """
    buckets = max(1, math.ceil(total / block_rows))
    small = df.where(F.col(size) <= block_rows).withColumns(
        {
            "_tile": F.concat(
                F.lit("bucket/"),
                F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets)).cast("string"),
            ),
            "_side": F.lit(BOTH),
        }
    )
    blocks = F.ceil(F.col(size) / block_rows)
    large = df.where(F.col(size) > block_rows)
    return small.unionByName(
        _spread(large, F.concat(F.lit("key/"), F.col(key)), F.col(identity), blocks)
    )


def by_tile(tiles: DataFrame, count: int):
    """Group by tile, spread over enough partitions that every tile may get its own task.

    A tile is little data and much work. An explicit partition number keeps the adaptive
    planner from merging tiles into few tasks because their bytes are few.
    """
    return tiles.repartition(max(1, min(2 * count, MAX_TILE_TASKS)), "_tile").groupBy("_tile")


# --- inside a task -----------------------------------------------------------------------


def unpacked(pairs):
    """The tiles of ``block_pairs``, from batches of its rows."""

    def read(rows: bytes, side: int) -> pd.DataFrame:
        return pa.ipc.open_stream(rows).read_all().to_pandas().assign(_side=side)

    for batch in pairs:
        for rows, other in zip(batch["_rows"], batch["_other"], strict=True):
            if other is None:
                yield read(rows, BOTH)
            else:
                yield pd.concat([read(rows, LEFT), read(other, RIGHT)], ignore_index=True)


def grid_pairs(sides: np.ndarray, step: int = 128):
    """Row ranges (left rows, right rows, triangular?) that cover the pairs of one tile."""
    if len(sides) and sides[0] == BOTH:
        rows = np.arange(len(sides))
        for start in range(0, len(rows), step):
            yield rows[start : start + step], rows[start:], True
        return
    left, right = np.flatnonzero(sides == LEFT), np.flatnonzero(sides == RIGHT)
    for start in range(0, len(left), step):
        yield left[start : start + step], right, False


def equal_key_pairs(sides: np.ndarray, keys: np.ndarray):
    """Index arrays of the pairs with equal keys in one tile, in moderate batches."""
    if len(sides) and sides[0] != BOTH:  # two blocks of one large key
        left, right = np.flatnonzero(sides == LEFT), np.flatnonzero(sides == RIGHT)
        for start in range(0, len(left), 64):
            some = left[start : start + 64]
            if len(right):
                yield np.repeat(some, len(right)), np.tile(right, len(some))
        return
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    lag, batch, held = 1, [], 0
    while lag < len(order):
        same = np.flatnonzero(ranked[lag:] == ranked[:-lag])
        if not len(same):
            break
        batch.append((order[same], order[same + lag]))
        held += len(same)
        if held > 200_000:
            yield tuple(np.concatenate(part) for part in zip(*batch))
            batch, held = [], 0
        lag += 1
    if batch:
        yield tuple(np.concatenate(part) for part in zip(*batch))
