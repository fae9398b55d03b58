"""Leaked passages against brute force over windows, reordered passages, and both ways of finding seeds."""

import random

import numpy as np
import pytest

from tessera.llm import leaks as L


def corpus():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(8, 40)))) for k in range(25)]
    docs = []
    for d in range(200):
        t = rng.choices(vocab, k=rng.randrange(0, 80))
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            n = rng.randrange(5, len(w) + 1)
            at = rng.randrange(0, len(w) - n + 1)
            k = rng.randrange(0, len(t) + 1)
            t = t[:k] + w[at : at + n] + t[k:]
        docs.append((d, ("*, " if d % 2 else "\n> ").join(x.upper() if d % 5 == 0 else x for x in t)))
    return docs, items


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = L.words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, s in items:
            v = L.words(s)
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("limit", [L.BROADCAST_WORDS, 0])
def test_runs_equal_brute_force(spark, limit):
    docs, items = corpus()
    docs += [(900, None), (901, ""), (902, "short one")]
    got = L.leaked(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items + [(99, None), (98, "a b")], "id long, text string"), limit).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.longest_run >= L.RUN_WORDS} == brute([d for d in docs if d[1]], items, L.RUN_WORDS)


def test_reordered_passage_is_caught():
    w = [f"x{i}" for i in range(40)]
    item = L.Items([(1, " ".join(w))])
    moved = " ".join(w[30:40] + ["z"] + w[20:30] + ["z"] + w[10:20] + ["z"] + w[:10])
    assert item.leaks(moved) == [(1, 10, 40, 1.0)]
    assert item.leaks(" ".join(w[:8] + ["z"] + w[20:28])) == [] and item.leaks(" ".join(w[3:15])) == [(1, 12, 12, 0.3)]


def test_tiles_do_not_overlap():
    rng = np.random.default_rng(0)
    for _ in range(50):
        d, t = rng.integers(0, 4, 60), rng.integers(0, 4, 30)
        used_d, used_t, last = set(), set(), 10**9
        for p, q, k in L.tiles(d, t, 3):
            assert k <= last and list(d[p : p + k]) == list(t[q : q + k])
            assert not used_d & set(range(p, p + k)) and not used_t & set(range(q, q + k))
            used_d |= set(range(p, p + k))
            used_t |= set(range(q, q + k))
            last = k


def test_empty(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert L.leaked(none, none).count() == 0
    assert L.leaked(spark.createDataFrame([(1, "a b c")], "id long, text string"), none).count() == 0
