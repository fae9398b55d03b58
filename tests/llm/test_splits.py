"""Splits that keep ties together."""

import random
from collections import Counter

import pytest

from tessera.llm import splits as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b long")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("train", 8000), ("validation", 1000), ("test", 1000)], "split_name string, target_bp int")


def test_ties_stay_together_and_shares_hold(spark, targets):
    rng, rows = random.Random(1), []
    for i in range(3000):
        d = rng.randrange(400)
        rows.append((i, f"d{d}", i if rng.random() < 0.97 else d % 50))
    got = {r.id: r for r in S.assign_splits(frame(spark, rows), targets).collect()}
    assert len(got) == 3000
    for key in (1, 2):
        seen = {}
        for r in rows:
            assert seen.setdefault(r[key], got[r[0]].split_name) == got[r[0]].split_name
    n = Counter(r.split_name for r in got.values())
    biggest = Counter(r.component for r in got.values()).most_common(1)[0][1]
    assert abs(n["train"] / 3000 - 0.8) < max(0.05, biggest / 3000) and n["test"] and n["validation"]


def test_hot_component_goes_to_the_largest_split(spark, targets):
    rows = [(i, "hot", i) for i in range(1000)] + [(1000 + i, f"d{i}", 5000 + i) for i in range(2000)]
    n = Counter(r.split_name for r in S.assign_splits(frame(spark, rows), targets).collect())
    assert abs(n["train"] - 2400) < 30 and abs(n["test"] - 300) < 30


def test_nulls(spark, targets):
    rows = [(1, "a", 1), (2, "b", 1), (3, None, 1), (4, None, 9), (5, None, 9), (6, None, None), (7, None, None), (8, "c", None), (9, "a", 2)]
    comp = {r.id: r.component for r in S.component_rows(frame(spark, rows)).collect()}
    assert comp[1] == comp[2] == comp[3] == comp[9] and comp[4] == comp[5] and len({comp[i] for i in (1, 4, 6, 7, 8)}) == 5
    assert S.assign_splits(frame(spark, []), targets).count() == 0
    assert S.assign_splits(frame(spark, rows), targets).count() == 9


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"d{rng.randrange(40)}", rng.randrange(200)) for i in range(230)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b in rows:
        parent[root(a)] = root(b)
    groups = {}
    for a in {r[1] for r in rows}:
        groups.setdefault(root(a), set()).add(a)
    got = {}
    for r in S.tied_entities(frame(spark, rows)).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
