import numpy as np
import pytest
from helpers import CLASHES, table
from pyspark.sql import functions as F

from heddle.llm import vectors


def brute(ids, rows):
    x = np.array(rows, np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        low = np.where(near, label[None, :], len(x)).min(axis=1, initial=len(x))
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    return {i: (int(n), ids[k]) for i, n, k in zip(ids, near.sum(axis=1), label, strict=True)}


@pytest.fixture
def clustered():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((120, 24))
    x = np.repeat(base, 8, axis=0) + rng.standard_normal((960, 24)) * 0.22
    x[5] = x[4]
    x[6] = 3 * x[4]
    return x


def as_rows(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_recall_against_brute_force(spark, clustered):
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(clustered)], "vec_id long, embedding array<double>")
    got, expected = as_rows(vectors.near_vectors(df)), brute(list(range(len(clustered))), clustered)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert 0.9 * there <= found <= there
    assert all(got[k][0] <= expected[k][0] for k in got)


def test_blocks_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(16) + rng.standard_normal((150, 16)) * 0.02
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    rows = [[float(np.float32(v)) for v in r] for r in x]
    assert as_rows(vectors.near_vectors(df)) == brute(list(range(150)), rows)


def test_whole_table(spark, small):
    df = table(spark, small, "embeddings").withColumns({c: F.lit("clash") for c in CLASHES})
    rows = df.orderBy("vec_id").collect()
    assert as_rows(vectors.near_vectors(df)) == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out.collect()))
    assert got == sorted([*((k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 10)), (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (0, 0, 0, True)])
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_parameters_follow_the_number_of_vectors():
    sizes = [vectors.parameters(n, 0.9, 0.92) for n in (10, 1000, 100_000, 10**9)]
    assert sizes == sorted(sizes)
    assert vectors.collision(0.1) > vectors.collision(1.0) > vectors.collision(2.0)


def test_components_of_any_magnitude(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [5e-324, 1e-323]), (4, [1.0, 2.0]), (5, [1e308, -1e308])]
    got = as_rows(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_signs_of_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    hasher = vectors.Hasher(32, 3, 2)
    differ = lambda x, y: np.bitwise_count((hasher.sketch(x) ^ hasher.sketch(y)).view(np.uint64)).sum(axis=1)
    most = vectors.most_signs(0.9)
    assert differ(a, b).max() <= most and (differ(a, np.roll(a, 1, axis=0)) <= most).mean() < 0.05
