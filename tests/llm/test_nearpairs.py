"""Near pairs against all pairs by brute force, with frequent and rare words, copies and hot groups."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import nearpairs as N
from tessera.llm.components import components


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<string>")


def corpus(seed, n, common, rare):
    rng, sets = random.Random(seed), {}
    for i in range(n):
        if i and rng.random() < 0.5:
            s = set(sets[rng.randrange(i)])
            for _ in range(rng.randrange(4)):
                if s and rng.random() < 0.5:
                    s.discard(rng.choice(sorted(s)))
                else:
                    s.add(f"r{rng.randrange(rare)}")
        else:
            s = {f"c{rng.randrange(common)}" for _ in range(rng.randrange(0, 16))} | {f"r{rng.randrange(rare)}" for _ in range(rng.randrange(4))}
        sets[i] = s
    return sets


@pytest.mark.parametrize("seed, common, rare, posting", [(1, 30, 5000, 50), (2, 12, 40, 5), (3, 25, 300, 2), (4, 40, 10_000, 50)])
def test_all_pairs_found(spark, seed, common, rare, posting):
    sets = corpus(seed, 300, common, rare)
    for t in (0.7, 0.8):
        links = N.similar_classes(N.text_classes(table(spark, sets)), t, posting)
        reps = {}
        for i in sorted(sets):
            reps.setdefault(frozenset(sets[i]), i)
        got = [(r.a, r.b) for r in links.collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute({i: sets[i] for i in reps.values()}, t)


def test_pairs_with_copies(spark):
    sets = corpus(9, 120, 20, 400)
    hot = max(sets.values(), key=len)
    for i in range(1000, 1040):
        sets[i] = set(hot)
    want = brute(sets, 0.7)
    assert {tuple(r) for r in N.near_pairs(table(spark, sets), 0.7).collect()} == want
    # beyond the limit copies hang on their smallest id, and every row stays linked to all it is similar to through it
    few = [tuple(r) for r in N.near_pairs(table(spark, sets), 0.7, expand=8).collect()]
    assert len(few) == len(set(few)) and set(few) <= want
    root = {}
    for i in sorted(sets):
        root[i] = next((j for j in sorted(sets) if sets[j] == sets[i]), i)
    assert {(root[a], root[b]) for a, b in few if root[a] != root[b]} == {(root[a], root[b]) for a, b in want if root[a] != root[b]} or {frozenset((root[a], root[b])) for a, b in few} == {frozenset((root[a], root[b])) for a, b in want}


def test_groups(spark):
    sets = {1: set("abcdefghij"), 2: set("abcdefghik"), 3: set("abcdefghlk"), 4: set("xyz"), 5: set("xyz"), 6: set()}
    got = {r.record_id: (r.group_id, r.copies, r.links) for r in N.near_groups(table(spark, sets), 0.8).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 2), 3: (1, 1, 1), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 1, 0)}


def test_words_and_empties(spark):
    df = spark.createDataFrame([("Ab, ab_C é2", None), (None, None), ("", "x" * 10)], "q string, e string")
    assert [r[0] for r in df.select(N.words(F.col("q"), F.col("e"))).collect()] == [["ab", "c", "é2"], [], ["x" * 10]]
    assert N.near_pairs(table(spark, {}), 0.7).count() == 0
    assert N.near_pairs(table(spark, {1: set(), 2: set()}), 0.7).count() == 0


def test_sketch_never_exceeds_the_difference(spark):
    rng = random.Random(1)
    sets = [[rng.getrandbits(63) - 2**62 for _ in range(rng.randrange(60))] for _ in range(40)]
    sk = [r.s for r in spark.createDataFrame([(s,) for s in sets], "t array<bigint>").select(N.parity_sketch(F.col("t")).alias("s")).collect()]
    for a in range(40):
        for b in range(40):
            h = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(sk[a], sk[b]))
            assert h <= len(set(sets[a]) ^ set(sets[b]))
    assert len({tuple(s) for s in sk}) > 30


@pytest.mark.parametrize("small", [0, 5, 10_000])
def test_components(spark, small):
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3), (100, 101)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[root(a)] = root(b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long"), small).collect()}
    assert set(got) == set(parent)
    pairs = Counter((got[x], root(x)) for x in parent)
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert components(spark.createDataFrame([], "src string, dst string"), small).count() == 0
