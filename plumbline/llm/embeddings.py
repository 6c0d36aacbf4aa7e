"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and rounded to 8 bits. The product of two rounded vectors is
exact, and what rounding may hide of a pair's cosine is at most the sum of two norms known per
vector. Only pairs whose product plus bound reaches the threshold are computed again in double
precision, so the answer is exact. Equal vectors of a label are compared once. A label's classes
are cut into blocks that meet pairwise in tiles; a tile returns counts per class and a spanning
forest of its links, never the pairs. The work within one label grows with the square of its
distinct vectors, spread over the tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.forest import Forest
from plumbline.operators.components import connected_components

THRESHOLD = 0.93
BLOCK_ROWS = 1024
# Pairs that are computed again at a time.
PAIRS = 1 << 15
# Up to so many dimensions sums of 8-bit products are exact in single precision.
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)
# Room for rounding in the double-precision arithmetic of the bounds.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit rows, scale, norm of the rounded rows, norm of what rounding took)."""
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None]).astype(np.int8)
    back = rounded * scale[:, None]
    return rounded, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with a cosine of at least ``threshold``; i < j where both sides are the
    ``same`` block. Rows are finite and not zero."""
    norms = [np.linalg.norm(x / (m := np.abs(x).max(axis=1, keepdims=True)), axis=1) * m[:, 0] for x in (left, right)]
    units = [left / norms[0][:, None], right / norms[1][:, None]]
    (a, sa, na, ea), (b, sb, _, eb) = quantise(units[0]), quantise(units[1])
    kind = np.float32 if left.shape[1] <= EXACT_DIMENSIONS else np.float64
    # The cosine is at most the rounded product plus |a| |b's error| + |a's error| |b|.
    most = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    most *= sa[:, None]
    most *= sb[None, :]
    most += na[:, None] * eb[None, :]
    most += ea[:, None] + SLACK
    i, j = np.nonzero(most >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    sure = np.zeros(len(i), bool)
    for low in range(0, len(i), PAIRS):
        part = slice(low, low + PAIRS)
        sure[part] = np.einsum("ij,ij->i", units[0][i[part]], units[1][j[part]]) >= threshold
    return i[sure], j[sure]


def _compare(threshold: float):
    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        """Counts (a, null, n) per class and links (a, b, null) of one tile."""
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        sides = [rows[rows["own"] == low], rows[rows["own"] == high]]
        counts = pd.Series(0, index=pd.Index(rows["rep"].unique()), dtype="int64")
        forest = Forest(rows["rep"].to_numpy())
        # Vectors of different lengths never link.
        lengths = [s["embedding"].map(len) for s in sides]
        for size in set(lengths[0]) & set(lengths[1]):
            left, right = (s[n == size] for s, n in zip(sides, lengths, strict=True))
            i, j = tile_links(np.stack(left["embedding"]).astype("f8"), np.stack(right["embedding"]).astype("f8"), threshold, low == high)
            a, b = left["rep"].to_numpy()[i], right["rep"].to_numpy()[j]
            counts = counts.add(pd.Series(right["n"].to_numpy()[j]).groupby(a).sum(), fill_value=0)
            counts = counts.add(pd.Series(left["n"].to_numpy()[i]).groupby(b).sum(), fill_value=0)
            forest.link(np.searchsorted(forest.ids, a), np.searchsorted(forest.ids, b))
        counts = counts[counts > 0]
        found = pd.DataFrame({"a": counts.index, "b": pd.NA, "n": counts.to_numpy()})
        links = forest.links()
        return pd.concat([found, links.assign(n=pd.NA)]).astype({"a": "int64", "b": "Int64", "n": "Int64"})

    return tile


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and their cosine is at least ``threshold``. Rows with a
    null label, id or vector, and vectors that are empty, zero or hold a null or a value that is
    not finite, link with nothing. Repeated rows link with each other like other equal vectors. Rows
    that share a vec_id are vectors of their own: each has its links and its component.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    # A digest stands for the vector when rows are joined back; zeros have one sign.
    bits = F.transform("embedding", lambda x: F.hex((x + 0.0).cast("string").cast("binary")))
    rows = rows.withColumn("usable", usable).withColumn("digest", F.when(F.col("usable"), F.sha2(F.array_join(bits, ","), 256)))
    good = rows.where("usable")
    classes = written(
        good.groupBy("label", "digest").agg(
            F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
        ).withColumn("rep", F.monotonically_increasing_id()),
        "vector-classes",
    )
    size = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    dealt = (
        classes.join(size, "label")
        .withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            "own", "rep", "n", "embedding",
        )
    )
    found = written(
        dealt.groupBy("label", "low", "high").applyInPandas(_compare(threshold), "a long, b long, n long"), "links"
    )
    joined = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    # Classes are numbered for the links; a component goes by the smallest vec_id of its classes.
    members = joined.join(classes.select("rep", "least"), F.col("node") == F.col("rep"))
    smallest = members.groupBy("component").agg(F.min("least").alias("smallest"))
    named = joined.join(smallest, "component").select("node", "smallest")
    of_class = (
        classes.join(counts, F.col("rep") == F.col("a"), "left")
        .join(named, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("l"),
            F.col("digest").alias("d"),
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
            F.coalesce("smallest", "least").alias("component"),
        )
    )
    narrow = rows.select("vec_id", "label", "digest")
    return narrow.join(of_class, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", F.col("vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", F.col("vec_id")), F.lit(True)).alias("kept"),
    )
