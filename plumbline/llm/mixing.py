"""Mixing sources to target weights by capped water-filling.

Every source gets a share of a total in proportion to its weight, but no more than a number of
epochs over its own words. Sources above that are clamped, and what they leave is shared anew by
weight until none is above; a round is one aggregate that returns two numbers. A source's target
is then so many whole repetitions of all its documents and one seeded fraction of them.

The fraction is drawn per size class, the longest documents first. A class is dealt into
``CELLS`` cells by a hash, and cells are taken in order until the class has given its share; what
it gave too much or too little is owed by the next shorter class. So the sum comes within half a
cell of the shortest class, however long single documents are, and no more leaves the documents
than one sum per cell, whose number per source is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
# Three hexadecimal digits of a digest.
CELLS = 4096
# One row per source of at most some 500 bytes.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Runs without blanks and ASCII control spaces. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cell(doc_id: Column, text: Column, seed: str) -> Column:
    """Rows with equal id and text share a cell."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 3), 16, 10).cast("int")


def size_class(size: Column) -> Column:
    """The number of binary digits of a size: 1 to 63."""
    return F.length(F.bin(size))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place from 0 in order of code points, null last, without one task for all."""
    missing = F.col("source").isNull()
    ordered = sources.repartitionByRange(missing, F.col("source")).sortWithinPartitions(missing, "source")
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    parts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("place") - F.shiftleft(part, 33)
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "source", "source_size", (F.col("start") + within).alias("place")
    )


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """``(source, source_size)`` with ``target``.

    The sources, in order of code points and null last, have the given weights in turn. Targets
    are in words; their sum is ``share`` of all sizes, or less if all sources are clamped. Empty
    sources have the target 0.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(
        _ranked(sources).select("source", "source_size", turn.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).alias("cap")),
        "weights",
    )
    totals = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = share * (totals.size or 0)
    rest, weight, clamped = total, totals.weight or 0.0, 0

    def above(rest: float, weight: float) -> Column:
        return F.col("weight") * F.lit(rest) > F.col("cap") * F.lit(weight)

    # Newton's method on a concave piecewise linear function: the level only rises, in few rounds.
    while weight:
        over = above(rest, weight)
        found = ranked.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if found.n == clamped:
            break
        rest, weight, clamped = total - found.cap, found.weight or 0.0, found.n
    target = F.when(above(rest, weight), F.col("cap")).otherwise(F.col("weight") * F.lit(rest) / F.lit(weight)) if weight else F.col("cap")
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _cuts(max_class: int = 64):
    def of_source(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        source_size, target = int(first["source_size"]), float(first["target"])
        whole = int(target // source_size) if source_size else 0
        fraction = (target - whole * source_size) / source_size if source_size else 0.0
        cuts, owed = [0] * max_class, 0.0
        for size, of_class in sorted(rows.groupby("size_class"), reverse=True):
            of_class = of_class.sort_values("cell")
            taken = np.concatenate([[0], np.cumsum(of_class["words"].to_numpy("i8"))])
            wanted = fraction * float(taken[-1]) + owed
            best = int(np.abs(taken - wanted).argmin())
            owed = wanted - float(taken[best])
            cuts[size] = int(of_class["cell"].iloc[best]) if best < len(of_class) else CELLS
        return pd.DataFrame({"source": [first["source"]], "source_size": [source_size], "target": [target], "whole": [whole], "cuts": [cuts]})

    return of_source


def _repetitions(
    sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float
) -> DataFrame:
    """source, source_size, target, whole and cuts (by size class) of every source of ``(source, size, cell)``."""
    sums = sized.groupBy("source", size_class(F.col("size")).alias("size_class"), "cell").agg(F.sum("size").alias("words"))
    sums = written(sums, "cells")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, share, max_epochs).withColumnRenamed("source", "of")
    met = sums.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    schema = "source string, source_size long, target double, whole long, cuts array<int>"
    return written(met.groupBy("source").applyInPandas(_cuts(), schema), "repetitions")


def _with_copies(rows: DataFrame, plan: DataFrame, source: str, size: str, cells: str, copies: str) -> DataFrame:
    """``rows`` with the columns of ``plan`` and, in ``copies``, how often the mix takes a row."""
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    plan = plan.withColumnRenamed("source", copies + "_of")
    extra = F.when(F.col(size) > 0, (F.col(cells) < F.get("cuts", size_class(F.col(size)))).cast("long")).otherwise(F.lit(0))
    return rows.join(plan, F.col(source).eqNullSafe(F.col(copies + "_of"))).withColumn(copies, F.col("whole") + extra)


def taken(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row per row of ``documents``.

    Null texts have the size 0. Rows without a source are a source, the last one. Rows that are
    equal in id and text are taken equally often. No document is taken more often than the
    target's epochs, rounded up, so never beyond ``max_epochs`` if that is whole. Reruns agree,
    as the draw depends on seed, id and text alone.
    """
    sized = documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), cell(F.col("doc_id"), F.col("text"), seed).alias("cell")
    )
    sized = written(sized, "sized")
    plan = _repetitions(sized, weights, share, max_epochs)
    return _with_copies(sized, plan, "source", "size", "cell", "copies").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The rows of the mix: every row of ``documents``, all columns kept, as often as it is taken."""
    names = [free_name(documents, x) for x in ("size", "cell", "copies", "copy")]
    size, own, copies, copy = names
    rows = documents.withColumns({size: word_count(F.col("text")), own: cell(F.col("doc_id"), F.col("text"), seed)})
    plan = _repetitions(rows.select("source", F.col(size).alias("size"), F.col(own).alias("cell")), weights, share, max_epochs)
    kept = [F.col(f"`{c}`") for c in documents.columns]
    plan = plan.drop("source_size", "target")
    clash = free_name(documents, "rows")
    packed = rows.select(F.struct(*kept).alias(clash), F.col("source").alias("of_row"), size, own)
    met = _with_copies(packed, plan, "of_row", size, own, copies)
    repeated = met.where(F.col(copies) > 0).select(clash, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy))
    return repeated.select(f"{clash}.*")
