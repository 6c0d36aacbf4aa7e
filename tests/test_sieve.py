"""Grids of records: every two meet once, copies of records don't fill the disk, no link is lost."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import SignalConfig
from plumbline.functions import similarity
from plumbline.model import CLUSTER_LOW
from plumbline.operators import entity, sieve, tiles
from tests.test_bounds import all_scores

CONFIG = SignalConfig(name=("n",), tax_id=("t",), address=("a",), zip=("z",), phone=("p",))


def records(count, seed):
    """Names and addresses with some letters changed, over few zips, phones and streets; a few odd ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        if i % 3 and rows:
            name, address = rng.choice(rows)[1:3]
            name = "".join(c if rng.random() > 0.15 else rng.choice("abcdef0123") for c in name).strip()
            address = address if rng.random() > 0.5 else f"{rng.randrange(9)}{address[1:]}"
        else:
            name = " ".join("".join(rng.choices("abcdef0123", k=rng.randrange(4, 9))) for _ in range(2))
            address = f"{rng.randrange(900)} {''.join(rng.choices('abcdef', k=6))} {rng.choice(['street', 'road'])}"
        if i % 50 == 7:
            name = rng.choice(["", "x", "語 ü co", "a" * 70, "aa " * 9 + "b", name + " holding" * 12])
        if i % 40 == 9:
            address = rng.choice(["", "1 a", "po box " + "9" * 80, " ".join("abcdefghijklm")])
        rows.append((i, name.strip(), address, "", f"{rng.randrange(4)}" if i % 5 else "", f"{rng.randrange(9)}" if i % 2 else ""))
    return pd.DataFrame(rows, columns=["rep", "name", "address", "tax_id", "zip", "phone"]).assign(n=1, _tile="grid")


@pytest.mark.parametrize("two_sides", [False, True])
@pytest.mark.parametrize("columns", [["name", "address", "zip", "phone"], ["name"], ["name", "phone"], ["address", "name"]])
def test_a_sieve_loses_no_link(monkeypatch, two_sides, columns):
    monkeypatch.setattr(sieve, "STEP", 130)
    monkeypatch.setattr(sieve, "HELD", 500)
    tile = records(400, 5)
    tile["_side"] = np.where(tile["rep"] % 4 == 1, tiles.LEFT, tiles.RIGHT) if two_sides else tiles.BOTH
    batch = entity.Batch(tile, SignalConfig(**{c: (c,) for c in columns}))
    found = []
    for ia, ib, windows in entity._tile_pairs(tile, batch, None):
        composite, _ = batch.score(ia, ib, windows)
        found += [(min(i, j), max(i, j), c) for i, j, c in zip(ia.tolist(), ib.tolist(), composite.tolist()) if c >= CLUSTER_LOW]
    ia, ib = np.triu_indices(len(tile), 1)
    if two_sides:
        across = (ia % 4 == 1) != (ib % 4 == 1)
        ia, ib = ia[across], ib[across]
    want = [(i, j, c) for i, j, c in zip(ia.tolist(), ib.tolist(), all_scores(batch, ia, ib).tolist()) if c >= CLUSTER_LOW]
    assert len(want) > 20 and sorted(found) == sorted(want)


def test_bounds_by_order_and_bits():
    texts = similarity.Texts([*records(150, 7)["name"], *records(150, 8)["address"]])
    ia, ib = np.triu_indices(len(texts), 1)
    score = similarity.token_set_ratio(texts, ia, texts, ib)
    assert (similarity.set_bound(texts, ia, ib) >= score - 1e-9).all()
    bits, lost = texts.sketch
    common = similarity.common_pairs(texts.histogram, ia, ib)
    assert (np.bitwise_count(bits[ia] & bits[ib]) + np.minimum(lost[ia], lost[ib]) >= common).all()


def test_every_two_records_meet_once(spark):
    df = spark.range(60).select(F.col("id").alias("rep"), (F.col("id") % 3).alias("kind"))
    one, few, many = F.col("kind") > 0, 3, 4
    packed = tiles.packed_blocks(df, "rep", F.when(one, 1).otherwise(0), F.when(one, F.lit(many)).otherwise(F.lit(few)), few + many, ["kind"])
    met = []
    for tile in tiles.unpacked([tiles.block_pairs(packed, few, many).toPandas()]):
        rep, side = tile["rep"].tolist(), tile["_side"].tolist()
        met += [tuple(sorted((a, b))) for i, (a, s) in enumerate(zip(rep, side)) for b, t in list(zip(rep, side))[i + 1 :] if s == tiles.BOTH or s != t]
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if not (a % 3 and b % 3)]
    assert sorted(met) == want


def test_grids_copy_and_broadcast_nothing(spark):
    rows = spark.range(200).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), F.format_string("name %d", "id").alias("name"))
    links = entity.link_profiles(rows, SignalConfig(name=("name",)), block_rows=4)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert "Generate" not in plan and "BroadcastExchange" not in plan
