"""Nearest vectors against brute force."""

import numpy as np
import pytest

from tessera.llm import vectors as V


def truth(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((-r.cosine, r.neighbour))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("bucket_rows", [4096, 60])
def test_recall(spark, bucket_rows):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(300, 16)), centre[rng.integers(0, 40, 500)] + 0.3 * rng.normal(size=(500, 16))]).astype(np.float32).astype(float)
    ids = np.arange(800) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<float>")
    got, want = found(V.nearest_rows(df, 16, 5, bucket_rows=bucket_rows)), truth(ids, x, 5)
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit / (5 * 800) >= (0.97 if bucket_rows > 100 else 0.9) and all(len(v) == 5 for v in got.values())


def test_copies_ties_and_bad_vectors(spark):
    e = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    rows = [(i, [0.5, 0.5, 0.0, 0.0]) for i in range(10, 30)] + [(1, e(0)), (2, e(1)), (3, None), (4, [1.0]), (5, [0.0] * 4), (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0]), (8, [None, 1.0, 1.0, 1.0]), (None, e(2))]
    got = found(V.nearest_rows(spark.createDataFrame(rows, "id long, v array<float>"), 4, 5, tables=12))
    assert set(got) == {1, 2, *range(10, 30)}
    assert got[10] == [11, 12, 13, 14, 15] and got[29] == [10, 11, 12, 13, 14] and got[12] == [10, 11, 13, 14, 15]
    assert got[1] == [10, 11, 12, 13, 14]
    none = spark.createDataFrame([], "id long, v array<float>")
    assert V.nearest_rows(none, 4, 5).count() == 0
    assert V.nearest_rows(spark.createDataFrame([(1, e(0))], "id long, v array<float>"), 4, 5).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(V.hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(V.hadamard(V.hadamard(x)), x, atol=1e-5)


def test_dense_cluster_meets_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    x = (base + 1e-3 * rng.normal(size=(200, 16))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got, want = found(V.nearest_rows(df, 16, 5, bucket_rows=16)), truth(np.arange(200), x, 5)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * 1000


def test_split_buckets_lose_no_neighbour(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    whole, split = (found(V.nearest_rows(df, 16, 5, tables=4, bucket_rows=n)) for n in (10_000, 20))
    assert split == whole
