"""Documents in chunks that ask for what the rest of the corpus knows.

Operators that need corpus-wide counts of very many small things (windows, words) work on chunks
of some two thousand documents. A chunk sends each bucket of the key space one packed array; the
bucket's task answers with one packed array per chunk; the answers meet the chunk again. Chunks
are rows of a table that is bucketed by chunk, so the texts themselves are not shuffled.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stands for a null doc_id, which would turn a group's ids into floating-point numbers.
NO_ID = -(1 << 63)
CHUNK_ROWS = 2048
BUCKET_BYTES = 8 << 20


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(blob)))


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of a sorted array of the same type, which pack better."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def chunked(
    documents: DataFrame, batches: int = 1, chunk_rows: int = CHUNK_ROWS, also: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """(table of batch, chunk, row, doc_id, text in UTF-8; number of buckets for its size).

    Null texts are empty, null ids ``NO_ID``. Columns named in ``also`` are kept. ``row`` is unique. The table is written once, which fixes both.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *also,
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    chunk = F.expr(f"row div {chunk_rows}")
    numbered = numbered.withColumn("chunk", chunk).withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)))
    name = f"chunks_{uuid.uuid4().hex}"
    numbered.write.partitionBy("batch").bucketBy(buckets, "chunk").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), buckets


def packed_chunks(documents: DataFrame, pack_rows: Callable[[pd.DataFrame], bytes], chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """(table of chunk, data; number of buckets for the texts' size), written once.

    ``data`` is what ``pack_rows`` makes of doc_id and text of a chunk's rows, with nulls as in ``chunked``.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)

    def chunks(batches):
        chunk, held = TaskContext.get().partitionId() << 32, pd.DataFrame()
        for rows in batches:
            held = pd.concat([held, rows], ignore_index=True) if len(held) else rows
            while len(held) >= chunk_rows:
                yield pd.DataFrame({"chunk": [chunk], "data": [pack_rows(held[:chunk_rows])]})
                chunk, held = chunk + 1, held[chunk_rows:]
        if len(held):
            yield pd.DataFrame({"chunk": [chunk], "data": [pack_rows(held)]})

    name = f"chunks_{uuid.uuid4().hex}"
    table = texts.mapInPandas(chunks, "chunk long, data binary").write.bucketBy(buckets, "chunk")
    table.option("compression", "none").saveAsTable(name)  # packed already
    return spark.table(name), buckets


def with_null_ids(found: DataFrame) -> DataFrame:
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
