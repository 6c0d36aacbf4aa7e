"""Why the records of a cluster belong together: the first distinct reasons in pair order.

A reason is a text about two records, the lower row first, and counts once per cluster, at the
smallest pair ``(a, b)`` that shows it. Which rows carry a value decides that pair, so nothing
here looks at pairs of records:

* an exact signal shows a reason at the first two rows with one value;
* a name or an address is compared once per two *distinct* values of a cluster. The pair that
  shows it is the first row of one value and the next row after it of the other. Names are
  quoted in row order, so two names may give a reason in both orders; the second order needs the
  first row of one name behind the first of the other, which a join looks up.

Values of a cluster are compared in tiles, each two values in one of them, so counts add up and
texts don't depend on the size of tiles. A tile returns the first few reasons of a cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.durable import materialise
from plumbline.functions import similarity
from plumbline.model import EVIDENCE_CUTOFF, SignalConfig
from plumbline.operators.tiles import BLOCK_ROWS, BOTH, bucket_rows, by_tile, equal_key_pairs, grid_pairs, key_tiles

EXACT = ("tax_id", "zip", "phone")
FOUND = "cluster long, place int, a long, b long, reason string"
# A cluster of more values is cut: its pairs, not its rows, are the work.
CLUSTER_ROWS = 1024
# Values of a cluster in one tile from which on a grid of bounds comes first.
GRID_ROWS = 64
_TILE = f"{FOUND}, behind string, kinds long"


def value_rows(clustered: DataFrame, signal: str) -> DataFrame:
    """(cluster, value, first, second, last): which rows of a cluster carry a value.

    ``clustered(cluster, rep, second, last, <signals>)`` has one row per profile, with the first,
    second and last row of its copies; ``second`` is null where a value is on one row only.
    """
    having = clustered.where(F.col(signal) != "").select(
        "cluster", F.col(signal).alias("value"), F.explode(F.array_distinct(F.array_compact(F.array("rep", "second")))).alias("row"), "last"
    )
    order = Window.partitionBy("cluster", "value").orderBy("row")
    early = having.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    pairs = early.groupBy("cluster", "value").agg(
        F.min("row").alias("first"), F.min(F.when(F.col("rank") == 2, F.col("row"))).alias("second")
    )
    lasts = having.groupBy("cluster", "value").agg(F.max("last").alias("last"))
    return pairs.join(lasts, ["cluster", "value"])


def _label(signal: str) -> str:
    return signal.replace("_", " ").title()


def _same_value(values: DataFrame, signal: str, place: int) -> DataFrame:
    """Reasons of two rows with one value."""
    if signal in EXACT:
        reason = F.concat(F.lit(f"{_label(signal)} exact match: '"), "value", F.lit("'"))
    elif signal == "name":
        reason = F.concat(F.lit("Name similarity 100/100 ('"), "value", F.lit("' ~ '"), "value", F.lit("')"))
    else:
        reason = F.lit(f"{_label(signal)} similarity 100/100")
    both = values.where("second IS NOT NULL")
    return both.select(
        "cluster", F.lit(place).alias("place"), F.col("first").alias("a"), F.col("second").alias("b"), reason.alias("reason")
    )


def _compare(signal: str, place: int, shown: int):
    """Two distinct values of one cluster at a time; see ``_TILE``."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        texts = similarity.Texts(tile["value"].tolist())
        first, last = (tile[c].to_numpy() for c in ("first", "last"))
        cluster, names = pd.factorize(tile["cluster"])
        parts = []
        for ia, ib, windows, sure in _open_pairs(texts, tile["_side"].to_numpy(), cluster, signal == "name"):
            swap = first[ia] > first[ib]
            ia, ib = np.where(swap, ib, ia), np.where(swap, ia, ib)
            if signal == "name":
                # Of pairs that are sure only the few that are listed get a score.
                raw, open_ = np.full(len(ia), np.nan), np.flatnonzero(~sure)
                some = np.where(windows[open_], 100.0, 0.0)
                raw[open_] = similarity.name_score(texts, ia[open_], texts, ib[open_], some)
            else:
                raw = similarity.token_set_ratio(texts, ia, texts, ib)
            good = sure | (raw >= EVIDENCE_CUTOFF)
            parts.append((ia[good], ib[good], raw[good]))
        out: list[tuple] = []
        if parts:
            ia, ib, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
            say = _say_names if signal == "name" else _say_scores
            order = np.argsort(cluster[ia], kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(cluster[ia[order]])) + 1):
                if len(own):
                    name = int(names[cluster[ia[own[0]]]])
                    out += say(name, place, shown, signal, (ia[own], ib[own], raw[own]), first, last, texts)
        return pd.DataFrame(out, columns=[f.split()[0] for f in _TILE.split(", ")]).astype({"b": "Int64"})

    return run


def _open_pairs(texts: similarity.Texts, sides: np.ndarray, cluster: np.ndarray, names: bool):
    """(ia, ib, windows, sure) of pairs of one cluster that may reach the cutoff, each pair once;
    see ``similarity.near_pairs``."""
    alone = np.ones(len(sides), dtype=bool)
    if len(sides) and sides[0] != BOTH:  # two blocks of one cluster
        groups = [np.arange(len(sides))]
    else:
        order = np.argsort(cluster, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1)
        groups = [g for g in groups if len(g) >= GRID_ROWS]
    for rows in groups:
        alone[rows] = False
        for left, right, triangular in grid_pairs(sides[rows]):
            if triangular:  # rows of the step, then those after it
                yield from _within(texts, rows[left], names)
                right = right[len(left) :]
            if len(right):
                yield similarity.near_pairs(texts, rows[left], rows[right], EVIDENCE_CUTOFF, names)
    few = np.flatnonzero(alone)
    for ia, ib in equal_key_pairs(sides[few], cluster[few]):
        yield few[ia], few[ib], np.ones(len(ia), dtype=bool), np.zeros(len(ia), dtype=bool)


def _within(texts: similarity.Texts, rows: np.ndarray, names: bool):
    found = similarity.near_pairs(texts, rows, rows, EVIDENCE_CUTOFF, names)
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    once = place[found[0]] < place[found[1]]
    yield tuple(x[once] for x in found)


def _say_scores(cluster, place, shown, signal, pairs, first, last, values) -> list[tuple]:
    """One reason per rounded score, at the smallest pair."""
    ia, ib, raw = pairs
    if not len(ia):
        return []
    a, b = first[ia], first[ib]
    scores, at = np.unique(raw, return_inverse=True)
    texts, code = np.unique([f"{_label(signal)} similarity {r:.0f}/100" for r in scores], return_inverse=True)
    code = code[at]
    order = np.lexsort((b, a, code))
    least = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
    return [(cluster, place, int(a[k]), int(b[k]), str(texts[code[k]]), None, 0) for k in least]


def _say_names(cluster, place, shown, signal, pairs, first, last, values) -> list[tuple]:
    """The first reasons, and those that may be as early once their second row is known."""
    ia, ib, raw = pairs
    order = np.lexsort((first[ib], first[ia]))
    ia, ib, raw = ia[order], ib[order], raw[order]

    value = values.texts

    def score(listed: np.ndarray) -> None:
        listed = listed[np.isnan(raw[listed])]
        raw[listed] = similarity.name_score(values, ia[listed], values, ib[listed], np.full(len(listed), 100.0))

    def text(i: int, j: int, r: float) -> str:
        return f"Name similarity {r:.0f}/100 ('{value[i]}' ~ '{value[j]}')"

    score(np.arange(min(shown, len(ia))))
    out = [
        (cluster, place, int(first[i]), int(first[j]), text(i, j, r), None, 0)
        for i, j, r in zip(ia[:shown], ib[:shown], raw[:shown], strict=True)
    ]
    back = last[ia] > first[ib]
    horizon = out[-1][2] if len(out) == shown else np.iinfo(np.int64).max
    early = np.flatnonzero(back & (first[ib] <= horizon))
    score(early)
    for k in early:
        i, j = ia[k], ib[k]
        out.append((cluster, place, int(first[j]), None, text(j, i, raw[k]), value[i], 0))
    return [*out, (cluster, place, -1, None, None, None, len(ia) + int(back.sum()))]


def _compared(values: DataFrame, signal: str, place: int, shown: int, total: int, block_rows: int) -> DataFrame:
    cores = values.sparkSession.sparkContext.defaultParallelism
    bucket = min(bucket_rows(total, cores, block_rows), CLUSTER_ROWS)
    sizes = values.groupBy("cluster").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / bucket)
    large = sizes.where(F.col("_size") > bucket).agg(F.sum(blocks * (blocks + 1) / 2).cast("long")).first()[0]
    sized = values.join(sizes, "cluster").withColumn("cluster_key", F.col("cluster").cast("string"))
    tiles = key_tiles(sized, "cluster_key", "_size", "value", total, bucket)
    tiles = tiles.select("cluster", "value", "first", "last", "_tile", "_side")
    found = by_tile(tiles, total // bucket + 1 + (large or 0)).applyInPandas(_compare(signal, place, shown), _TILE)
    return materialise(found, "compared")  # read more than once


def cluster_evidence(
    clustered: DataFrame, rows: DataFrame, config: SignalConfig, total: int, shown: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(cluster, evidence, kinds): the first ``shown`` reasons of every cluster, out of ``kinds``.

    ``clustered`` as in :func:`value_rows`, ``total`` its number of rows; ``rows(cluster, row_id,
    name)`` has every row. Clusters without a reason are absent. Null and blank signals give none.
    """
    found, counted = [], []
    for place, signal in enumerate(config.active()):
        values = materialise(value_rows(clustered, signal), "values")
        same = _same_value(values, signal, place)
        if signal in EXACT:
            found.append(same)
            counted.append(same.select("cluster", F.lit(1).cast("long").alias("kinds")))
            continue
        pairs = _compared(values, signal, place, shown, total, block_rows)
        resolved = pairs.where("b IS NOT NULL").select("cluster", "place", "a", "b", "reason")
        if signal == "name":
            waiting = pairs.where("behind IS NOT NULL").select("cluster", "place", "a", "reason", "behind")
            later = rows.select(F.col("cluster").alias("of"), "row_id", F.col("name").alias("own"))
            match = (F.col("cluster") == F.col("of")) & (F.col("behind") == F.col("own")) & (F.col("row_id") > F.col("a"))
            back = waiting.join(later, match).groupBy("cluster", "place", "a", "reason").agg(F.min("row_id").alias("b"))
            found += [same, resolved, back.select("cluster", "place", "a", "b", "reason")]
            counted += [same.select("cluster", F.lit(1).cast("long").alias("kinds")), pairs.where("kinds > 0").select("cluster", "kinds")]
        else:
            least = resolved.unionByName(same).groupBy("cluster", "place", "reason").agg(F.min(F.struct("a", "b")).alias("at"))
            found.append(least.select("cluster", "place", "at.a", "at.b", "reason"))
            counted.append(least.select("cluster", F.lit(1).cast("long").alias("kinds")))
    reasons, kinds = found[0], counted[0]
    for more in found[1:]:
        reasons = reasons.unionByName(more)
    for more in counted[1:]:
        kinds = kinds.unionByName(more)
    order = Window.partitionBy("cluster").orderBy("a", "b", "place")
    early = reasons.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    listed = early.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "reason"))).alias("reasons"))
    sums = kinds.groupBy("cluster").agg(F.sum("kinds").alias("kinds"))
    return listed.join(sums, "cluster").select("cluster", F.col("reasons.reason").alias("evidence"), "kinds")
