"""Bounds that decide which pairs are scored: no link lost, little else kept."""

import random

import numpy as np
import pandas as pd
import pytest

from plumbline import SignalConfig
from plumbline.functions import similarity
from plumbline.model import CLUSTER_LOW
from plumbline.operators import entity, evidence


def unlike_vendors(count):
    """Names over few letters that share most of their characters, in another order."""
    rng = random.Random(3)
    rows = []
    for i in range(count):
        name = " ".join("".join(rng.sample("abcdef0123456789", 7)) for _ in range(2))
        bare = i % 3 == 0
        cut = name[2:11] + (" depot north" if i % 2 else "")
        rows.append((i, cut if bare else f"{name} metal works", "" if bare else f"{i} {name[:8]} street", "" if bare else f"t{i}", f"{i % 50:03d}", "" if i % 4 else f"{i % 5}", 1, 2, "self/0/0"))
    return pd.DataFrame(rows, columns=["rep", "name", "address", "tax_id", "phone", "zip", "n", "_side", "_tile"])


def all_scores(batch, ia, ib):
    weight, total = np.zeros(len(ia)), np.zeros(len(ia))
    for s, w in batch.weights.items():
        both = batch.present[s][ia] & batch.present[s][ib]
        if s in entity.EXACT:
            score = 100.0 * (batch.values[s][ia] == batch.values[s][ib])
        else:
            t = batch.texts[s]
            score = similarity.token_set_ratio(t, ia, t, ib)
            if s == "name":
                score = np.maximum(score, similarity.partial_ratio(t.texts[ia], t.texts[ib]))
        weight, total = weight + w * both, total + w * both * score / 100
    return np.array([round(c, 4) for c in np.divide(total, weight, out=np.zeros(len(ia)), where=weight > 0).tolist()])


@pytest.mark.parametrize("more", [[], ["", "語 ü", "a" * 70, "abcdef0 " * 9, "x"]])
def test_grids_keep_every_link_and_little_else(more):
    tile = unlike_vendors(300)
    tile.loc[range(len(more)), "name"] = more
    tile.loc[range(10, 10 + len(more)), "name"] = [m + "z" for m in more]
    batch = entity.Batch(tile, SignalConfig(name=("n",), tax_id=("t",), address=("a",), zip=("z",), phone=("p",)))
    found, scored = {}, 0
    for ia, ib, windows in entity._tile_pairs(tile, batch, None):
        composite, _ = batch.score(ia, ib, windows)
        found |= {(i, j): c for i, j, c in zip(ia.tolist(), ib.tolist(), composite.tolist()) if c >= CLUSTER_LOW}
        scored += len(ia)
    ia, ib = np.triu_indices(len(tile), 1)
    want = {(i, j): c for i, j, c in zip(ia.tolist(), ib.tolist(), all_scores(batch, ia, ib).tolist()) if c >= CLUSTER_LOW}
    assert want and found == want
    assert scored < len(want) + 0.02 * len(ia)


def test_reasons_of_large_clusters_from_grids(monkeypatch):
    values = unlike_vendors(150)["name"].unique()
    tile = pd.DataFrame({"cluster": 7, "value": values, "first": range(len(values)), "last": range(len(values)), "_side": 2})
    tile["last"] += 3 * (tile["first"] % 4 == 0)
    for signal in ("name", "address"):
        monkeypatch.setattr(evidence, "GRID_ROWS", 10_000)
        plain = evidence._compare(signal, 0, 5)(tile)
        monkeypatch.setattr(evidence, "GRID_ROWS", 2)
        grid = evidence._compare(signal, 0, 5)(tile)
        assert len(plain) > 2
        order = ["a", "b", "reason", "behind", "kinds"]
        pd.testing.assert_frame_equal(*(x.sort_values(order, ignore_index=True) for x in (plain, grid)))
