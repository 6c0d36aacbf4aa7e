"""Record comparison for entity resolution: signals, weighted scores, links."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import similarity, text
from plumbline.model import (
    CLUSTER_LOW,
    ROW_ID,
    SIGNALS,
    SignalConfig,
)
from plumbline.operators.sieve import sifted, tame
from plumbline.operators.tiles import (
    BLOCK_ROWS,
    BOTH,
    LEFT,
    PACKED,
    RIGHT,
    block_count,
    block_pairs,
    bucket_rows,
    by_tile,
    equal_key_pairs,
    key_tiles,
    packed_blocks,
    unpacked,
)
from plumbline.skew import join_counted

EXACT = ("tax_id", "zip", "phone")
# Scores are rounded to four places before they meet the threshold.
REACH = CLUSTER_LOW - 0.00005


def auto_detect(columns: list[str]) -> SignalConfig:
    """Assign each column to the first signal whose hint its name matches."""
    found: dict[str, list[str]] = {s: [] for s in SIGNALS}
    for column in columns:
        for signal, hint in text.SIGNAL_NAME_HINTS.items():
            if text.name_matches(column, hint):
                found[signal].append(column)
                break
    return SignalConfig(**{s: tuple(c) for s, c in found.items()})


def blocking_signal(config: SignalConfig) -> str | None:
    """An exact signal without which no pair can reach the threshold, if there is one.

    Two records that both carry signal s and differ on it score at most 1 - w_s / W, W being
    at most the weight of all active signals. If that is below the threshold, every link
    agrees on s or lacks it on a side, and an equality join on s loses nothing.
    """
    active = config.active()
    total = sum(config.weights.get(s, 0.0) for s in active)
    usable = [s for s in active if s in EXACT and 1 - config.weights.get(s, 0.0) / total < REACH]
    return max(usable, key=lambda s: config.weights[s], default=None)


def filled_cells(columns: list[str]) -> Column:
    """How many cells of the row are neither null nor blank."""
    out = F.lit(0)
    for c in columns:
        cell = F.col(f"`{c}`").cast("string")
        out = out + F.when(cell.isNotNull() & ~text.is_blank(cell), 1).otherwise(0)
    return out


def signal_rows(df: DataFrame, config: SignalConfig) -> DataFrame:
    """(row_id, filled, profile, <signals>): every row with its normalised signals."""
    signals = {
        s: text.norm_signal(s, [F.col(f"`{c}`") for c in config.columns(s)])
        for s in config.active()
    }
    rows = df.select(
        F.col(ROW_ID).alias("row_id"),
        filled_cells([c for c in df.columns if c != ROW_ID]).alias("filled"),
        *[e.alias(s) for s, e in signals.items()],
    )
    sized = [F.concat(F.length(s).cast("string"), F.lit(":"), F.col(s)) for s in signals]
    return rows.withColumn("profile", F.unhex(F.sha2(F.concat(*sized), 256)))


def profiles_of(rows: DataFrame, signals: list[str]) -> DataFrame:
    """Distinct signal combinations: (profile, <signals>, n, rep, last).

    Copies collapse here, before anything is compared. Records without any signal cannot
    link and drop out.
    """
    some = " OR ".join(f"{s} <> ''" for s in signals)
    return (
        rows.where(some)
        .groupBy("profile", *signals)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row_id").alias("rep"),
            F.max("row_id").alias("last"),
        )
    )


# --- scoring inside a task ---------------------------------------------------------------


class Batch:
    """The records of one tile with their signals in comparable form."""

    def __init__(self, tile: pd.DataFrame, config: SignalConfig):
        self.weights = {s: config.weights.get(s, 0.0) for s in config.active()}
        self.present = {s: (tile[s] != "").to_numpy() for s in self.weights}
        self.codes = {s: pd.factorize(tile[s])[0] for s in self.weights}
        self.values = {s: tile[s].to_numpy() for s in self.weights}
        self.texts = {
            s: similarity.Texts(tile[s].tolist()) for s in self.weights if s not in EXACT
        }

    @cached_property
    def tame(self) -> np.ndarray:
        """Records whose texts a sieve can judge."""
        return np.logical_and.reduce([tame(t, self.present[s]) for s, t in self.texts.items()])

    def _known(self, pick_a, pick_b):
        """Weight present on both sides, and the part that exact signals contribute."""
        weight, exact = 0.0, 0.0
        for s, w in self.weights.items():
            both = pick_a(self.present[s]) & pick_b(self.present[s])
            weight = weight + w * both
            if s in EXACT:
                exact = exact + w * (both & (pick_a(self.codes[s]) == pick_b(self.codes[s])))
        return weight, exact

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Grid of pairs whose score could still reach the threshold: 2 where windows of names
        could take it there, 1 where only the rest could."""
        out = np.zeros((len(left), len(right)), dtype=np.uint8)
        bounds = {s: similarity.Bounds(t, left, right) for s, t in self.texts.items()}
        has = {s: self.present[s][right] for s in self.weights}
        codes = {s: self.codes[s][right].astype(np.int32) for s in self.weights if s in EXACT}
        plain: dict[tuple, tuple] = {}
        held: list[tuple] = []
        for k, i in enumerate(left):
            own = tuple(s for s in self.weights if self.present[s][i])
            if own not in plain:
                # What fuzzy scores have to add up to, with room for single precision; nothing
                # reaches it where no signal is on both sides.
                weight = sum((self.weights[s] * has[s] for s in own), np.zeros(len(right)))
                need = np.where(weight > 0, (REACH - 1e-5) * weight, np.inf).astype(np.float32)
                share = {s: (self.weights[s] * has[s] / 100).astype(np.float32) for s in own if s not in EXACT}
                plain[own] = need, share
            need, share = plain[own]
            need = need.copy()
            for s in own:
                if s in EXACT:
                    need -= np.float32(self.weights[s]) * (codes[s] == self.codes[s][i])
                elif s != "name":
                    need -= share[s] * bounds[s].token_sets(k)
            if "name" not in share:
                out[k] = need <= 0
                continue
            point, sets = share["name"], bounds["name"].token_sets(k)
            names = bounds["name"].characters(k)
            np.maximum(names, sets, out=names)
            names *= point
            on = np.flatnonzero(names >= need)
            if len(on):
                need, point = need[on], point[on]
                windows, inner = bounds["name"].windows(k, on)
                out[k, on[point * sets[on] >= need]] = 1
                at = np.flatnonzero(point * windows >= need)
                held.append((np.full(len(at), k), on[at], need[at], point[at], inner[at]))
        if held:
            # Windows at the ends of texts, for all rows of the grid at once.
            row, col, need, point, inner = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = similarity.end_bound(self.texts["name"], left[row], right[col])
            good = point * np.maximum(inner, ends) >= need
            out[row[good], col[good]] = 2
        return out

    def score(self, ia: np.ndarray, ib: np.ndarray, windows: np.ndarray | None = None):
        """Composite scores (rounded to 4 places) and the raw fuzzy scores of given pairs.

        A fuzzy score is worked out only where the composite can still reach the threshold, and
        windows of names only where ``windows`` says that these can take it there.
        """
        weight, total = self._known(lambda x: x[ia], lambda x: x[ib])
        bounds, raw = {}, {}
        for s, t in self.texts.items():
            both = self.present[s][ia] & self.present[s][ib]
            common = similarity.common_pairs(t.histogram, ia, ib)
            bound = similarity.upper_bound(common, np.minimum(t.least[ia], t.least[ib]))
            bounds[s] = np.where(both, bound, 0.0)
        for s in sorted(self.texts):  # address first: it costs less than name
            t, w = self.texts[s], self.weights[s]
            best = total + sum(self.weights[o] * bounds[o] / 100 for o in bounds if o not in raw)
            open_ = (best >= (REACH - 1e-9) * weight) & (bounds[s] > 0)
            rows = np.flatnonzero(open_)
            raw[s] = np.zeros(len(ia))
            if s == "name":
                bound = bounds[s] if windows is None else np.where(windows, bounds[s], 0.0)
                raw[s][rows] = similarity.name_score(t, ia[rows], t, ib[rows], bound[rows])
            else:
                raw[s][rows] = similarity.token_set_ratio(t, ia[rows], t, ib[rows])
            total = total + w * raw[s] / 100
        rough = np.divide(total, weight, out=np.zeros(len(ia)), where=weight > 0)
        composite = np.array([round(c, 4) for c in rough.tolist()])
        return composite, raw


def _stars(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest reachable record per record of a tile, so a task returns stars, not links."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _tile_pairs(tile: pd.DataFrame, batch: Batch, key: str | None):
    """Candidate index pairs of one tile, with what ``Batch.score`` wants to know of their windows;
    grid tiles arrive already bounded."""
    sides = tile["_side"].to_numpy()
    if tile["_tile"].iat[0].split("/", 1)[0] in ("bucket", "key"):
        for ia, ib in equal_key_pairs(sides, pd.factorize(tile[key])[0]):
            yield ia, ib, None
        return
    triangular = bool(len(sides) and sides[0] == BOTH)
    if triangular:
        left = right = np.arange(len(sides))
    else:
        left, right = np.flatnonzero(sides == LEFT), np.flatnonzero(sides == RIGHT)
    plain = batch.tame if batch.weights.get("name", 0) > 0 else np.zeros(len(sides), dtype=bool)
    if plain.any():
        yield from sifted(batch, left[plain[left]], right[plain[right]], triangular, REACH, EXACT)
    wild = left[~plain[left]]
    yield from _near_pairs(batch, wild, right, plain[right] if triangular else None)
    if not triangular:
        yield from _near_pairs(batch, left[plain[left]], right[~plain[right]], None)


def _near_pairs(batch: Batch, left: np.ndarray, right: np.ndarray, always: np.ndarray | None, step: int = 128):
    """Candidates of a grid; where ``always`` is given, those of its other columns lie behind the row."""
    if not len(right):
        return
    for start in range(0, len(left), step):
        some = left[start : start + step]
        keep = batch.near(some, right)
        if always is not None:
            keep *= always[None, :] | (some[:, None] < right[None, :])
        rows, cols = np.nonzero(keep)
        yield some[rows], right[cols], keep[rows, cols] > 1


def _link_tile(config: SignalConfig, key: str | None):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(tile["rep"].to_numpy(), kind="stable")
        tile = tile.iloc[order].reset_index(drop=True)
        batch = Batch(tile, config)
        rep, copies = tile["rep"].to_numpy(), tile["n"].to_numpy().astype(float)
        ends_a, ends_b, links, scored = [], [], 0.0, 0
        best = np.zeros(len(tile))
        for ia, ib, windows in _tile_pairs(tile, batch, key):
            composite, _ = batch.score(ia, ib, windows)
            good = composite >= CLUSTER_LOW
            np.maximum.at(best, ia[good], composite[good])
            np.maximum.at(best, ib[good], composite[good])
            scored += len(ia)
            ends_a.append(ia[good])
            ends_b.append(ib[good])
            links += float((copies[ia[good]] * copies[ib[good]]).sum())
        a = np.concatenate(ends_a) if ends_a else np.array([], dtype=int)
        b = np.concatenate(ends_b) if ends_b else np.array([], dtype=int)
        label = _stars(len(tile), a, b)
        tied = np.flatnonzero(label != np.arange(len(tile)))
        # Of the two ends of a link one is tied at least, so the best link is among these rows.
        out = pd.DataFrame({"a": rep[tied], "b": rep[label[tied]], "links": 0.0, "scored": 0, "best": best[tied]})
        total = pd.DataFrame({"a": [-1], "b": [-1], "links": [links], "scored": [scored], "best": [0.0]})
        return pd.concat([out, total], ignore_index=True)

    return run


def compared(profiles: DataFrame, config: SignalConfig, tile, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What ``tile(config, key)`` returns for tiles in which every pair of profiles that could link
    meets once, ``key`` being the blocking signal."""
    cores = profiles.sparkSession.sparkContext.defaultParallelism
    profiles = profiles.select("rep", "n", *config.active())
    key = blocking_signal(config)
    has = F.lit(False) if key is None else F.col(key) != ""
    sizes = profiles.agg(F.count_if(has).alias("keyed"), F.count_if(~has).alias("bare")).first()
    found = None
    if key is not None:
        keyed = profiles.where(has)
        shared = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
        grouped = join_counted(keyed, shared, key, "_size", total=sizes.keyed)
        bucket = bucket_rows(sizes.keyed, cores, block_rows)
        tiles = key_tiles(grouped, key, "_size", "rep", sizes.keyed, bucket).drop("_size")
        found = by_tile(tiles, sizes.keyed // bucket + 1).applyInPandas(tile(config, key), schema)
    if sizes.bare or key is None:
        few, many = (block_count(n, cores, PACKED * block_rows) if n else 0 for n in (sizes.bare, sizes.keyed))
        # One of two records lacks the blocking signal, so it says nothing about them.
        absent = [] if key is None else [key]
        blocks = F.when(has, F.lit(many)).otherwise(F.lit(few))
        packed = packed_blocks(profiles, "rep", F.when(has, 1).otherwise(0), blocks, few + many, absent)
        run = tile(config, key)

        def grids(batches):
            for met in unpacked(batches):
                yield run(met.assign(_tile="grid", **dict.fromkeys(absent, "")))

        grid = block_pairs(packed, few, many).mapInPandas(grids, schema)
        found = grid if found is None else found.unionByName(grid)
    return found


def link_profiles(profiles: DataFrame, config: SignalConfig, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, links, scored, best): stars that connect linked profiles, each with the best score
    of a link of ``a`` in its tile, and counts with a = -1."""
    return compared(profiles, config, _link_tile, "a long, b long, links double, scored long, best double", block_rows)


# --- scored pairs -----------------------------------------------------------


def _pair_tile(config: SignalConfig, key: str | None):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        batch, rep, n = Batch(tile, config), tile["rep"].to_numpy(), tile["n"].to_numpy()
        out = [pd.DataFrame({c: [] for c in ("a", "b", "n_a", "n_b", "composite")})]
        for ia, ib, windows in _tile_pairs(tile, batch, key):
            composite, _ = batch.score(ia, ib, windows)
            good = np.flatnonzero(composite >= CLUSTER_LOW)
            x, y = ia[good], ib[good]
            first = rep[x] < rep[y]
            x, y = np.where(first, x, y), np.where(first, y, x)
            out.append(
                pd.DataFrame(
                    {"a": rep[x], "b": rep[y], "n_a": n[x], "n_b": n[y], "composite": composite[good]}
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def scored_links(profiles: DataFrame, config: SignalConfig, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, n_a, n_b, composite): all linked pairs of profiles, named by their first rows.

    For inspection and checks. Clustering uses :func:`link_profiles`, whose output does not
    grow with the number of links.
    """
    return compared(profiles, config, _pair_tile, "a long, b long, n_a long, n_b long, composite double", block_rows)
