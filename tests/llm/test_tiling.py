"""Greedy string tiling against the plain definition, and on repetitive texts."""

import random
import time

import numpy as np
import pytest

from tessera.llm.tiling import chain, tiles


def longest_free(d, t, used_d, used_t):
    best = 0
    for p in range(len(d)):
        for q in range(len(t)):
            k = 0
            while p + k < len(d) and q + k < len(t) and d[p + k] == t[q + k] and not used_d[p + k] and not used_t[q + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_every_tile_is_a_longest_match(seed):
    rng = random.Random(seed)
    d, t = ([rng.randrange(3 + seed % 4) for _ in range(rng.randrange(1, 60))] for _ in range(2))
    used_d, used_t = [False] * len(d), [False] * len(t)
    found = tiles(np.array(d), np.array(t), 2)
    for p, q, k in found:
        assert k == longest_free(d, t, used_d, used_t) and d[p : p + k] == t[q : q + k]
        assert not any(used_d[p : p + k]) and not any(used_t[q : q + k])
        used_d[p : p + k] = used_t[q : q + k] = [True] * k
    assert longest_free(d, t, used_d, used_t) < 2


def test_repetitive_texts_take_linear_time():
    began = time.perf_counter()
    assert tiles(np.zeros(200_000, np.int64), np.zeros(100_000, np.int64), 5) == [(0, 0, 100_000)]
    a = np.tile([0, 0, 0, 1], 20_000)
    assert sum(k for _, _, k in tiles(a, np.zeros(60_000, np.int64), 3)) <= 60_000
    assert time.perf_counter() - began < 20


def test_chain_keeps_order():
    assert chain([]) == [] and chain([(5, 0, 4), (0, 7, 3), (10, 10, 2)]) == [(5, 0, 4), (10, 10, 2)]


def test_empty():
    none = np.zeros(0, np.int64)
    assert tiles(none, np.ones(3), 1) == tiles(np.ones(3), none, 1) == []
