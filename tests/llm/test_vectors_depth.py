"""Concatenated rotations: their number, and recall where they are in use."""

import numpy as np
import pytest

from tessera.llm import vectors as V


def test_depth_follows_from_the_number_of_rows():
    cells = 1
    assert V.depths(0, 64) == V.depths(4000, 64) == []
    for n in (70_000, 400_000, 4_000_000, 10**9, 10**12):
        deeper = V.depths(n, 64)
        cells = 128 * np.prod([2 * p for p, _ in deeper], dtype=float)
        assert V.CELL_ROWS <= n / cells < 4 * V.CELL_ROWS and all(m <= 2 * p for p, m in deeper)


@pytest.mark.parametrize("cell_rows", [10_000, 2])
def test_recall_with_cells(spark, cell_rows):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 16))
    x = (centre[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, 3000, 50) for j in np.lexsort((np.arange(3000), -s[i]))[:5]}
    assert len(V.depths(3000, 16, cell_rows)) == (0 if cell_rows > 100 else 1)
    got = {(r.id, r.neighbour) for r in V.nearest_rows(df, 16, 5, cell_rows=cell_rows).where("id % 50 = 0").collect()}
    assert len(got & want) / len(want) >= 0.93
