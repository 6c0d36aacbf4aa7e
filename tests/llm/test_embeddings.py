import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import embeddings
from plumbline.llm.oracles import OP9
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, n long"


def rows(dimensions=8, n=150):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, dimensions))
    out = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dimensions) * rng.choice([0, 0.1, 0.25, 1])
        out.append((i, (v * rng.choice([1, 3])).astype("f4").tolist(), int(rng.integers(3))))
    odd = [None, [], [0.0] * dimensions, [float("nan")] + [1.0] * (dimensions - 1), [float("inf")] * dimensions, [None, 1.0], [1.0, 1.0], [2.0, 2.0]]
    out += [(n + i, v, 1) for i, v in enumerate(odd)]
    return out + [(n + 50, out[0][1], None), (n + 51, out[0][1], None), (n + 52, [-x for x in out[0][1]], out[0][2])]


def check(spark, data, **options):
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame, **options).collect()}
    links = brute.cosine_links(data, options.get("threshold", 0.93))
    parts = brute.components(links, lambda a, b: b in links[a])
    assert got == {i: (len(links[i]), parts[i], parts[i] == i) for i in links}


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_against_all_pairs(spark, block_rows):
    check(spark, rows(), block_rows=block_rows)


def test_sql_against_all_pairs():
    """The SQL that the query has to equal, on vectors that link; the given tables have few links."""
    data = rows()
    duck = duckdb.connect()
    ids, vectors, labels = zip(*data, strict=True)
    duck.register("embeddings", pa.table({
        "vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())
    }))
    got = {i: (n, c, k) for i, n, c, k in duck.execute(OP9).fetchall()}
    links = brute.cosine_links(data, 0.93)
    parts = brute.components(links, lambda a, b: b in links[a])
    assert sum(map(len, links.values())) > 100
    assert got == {i: (len(links[i]), parts[i], parts[i] == i) for i in links}


def test_lower_threshold(spark):
    check(spark, rows(16, 80), threshold=0.5, block_rows=20)


def test_no_vectors(spark):
    check(spark, [])


def test_repeated_rows_link(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, 0)] * 2 + [(None, [1.0, 0.0], 1, 0, 0)], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.kept) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    """Also across labels: links and components are not pooled by id."""
    east, north, west = [1.0, 0.0], [0.0, 1.0], [-1.0, 0.1]
    data = [(5, east, 1), (5, north, 1), (5, east, 2), (7, [2.0, 0.0], 1), (3, [0.0, 3.1], 1), (8, [1.0, 0.05], 2), (5, west, 2)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(3, 1, 3, True), (5, 0, 5, True), (5, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rounded, scale, norm, error = embeddings.quantise(x)
    product = (rounded.astype("i8") @ rounded.astype("i8").T) * scale[:, None] * scale[None, :]
    bound = norm[:, None] * error[None, :] + error[:, None] + embeddings.SLACK
    assert (np.abs(x @ x.T - product) <= bound).all()


@pytest.mark.parametrize("dimensions", [3, 64, 1500])
def test_tiles_are_exact(dimensions):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, dimensions))
    left = np.repeat(base, 20, axis=0) + rng.normal(size=(100, dimensions)) * 0.28
    i, j = embeddings.tile_links(left, left, 0.93, True)
    unit = left / np.linalg.norm(left, axis=1)[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    assert sorted(zip(i, j, strict=True)) == sorted(zip(a, b, strict=True))
