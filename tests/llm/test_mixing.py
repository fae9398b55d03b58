"""Mixtures: shares, caps, order of sources, token counts."""

import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import mixing as M

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def sizes(spark):
    rng, rows = random.Random(3), []
    for s, n in (("big", 3000), ("mid", 900), ("tiny", 40)):
        rows += [(len(rows) + i, s, rng.randrange(50, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, source string, tokens long")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 5000, 1), ("mid", 3000, 2), ("tiny", 1500, 3), ("none", 500, 9)], "source string, target_bp int, max_repeats int")


def test_budget(sizes, targets):
    got = {r.source: r for r in M.budget(sizes, targets).collect()}
    assert {s for s, r in got.items() if r.short} == {"tiny", "none"}
    assert got["none"].own_tokens == 0 and got["big"].all_tokens == sum(r.own_tokens for r in got.values())


def test_mixture(sizes, targets):
    rows = M.mixture(sizes, targets, block_tokens=2000).collect()
    all_tokens = sum(r.tokens for r in sizes.collect())
    by, uses = defaultdict(int), Counter()
    for r in rows:
        by[r.source] += r.tokens
        uses[r.id] += 1
    cap = {"big": 1, "mid": 2, "tiny": 3}
    source = {r.id: r.source for r in sizes.collect()}
    assert all(n <= cap[source[i]] for i, n in uses.items())
    assert abs(by["big"] / all_tokens - 0.5) < 0.02 and abs(by["mid"] / all_tokens - 0.3) < 0.02
    own = sum(r.tokens for r in sizes.collect() if r.source == "tiny")
    assert by["tiny"] == pytest.approx(3 * own, rel=0.01) and max(r.repeat for r in rows if r.source == "tiny") == 3
    slots = {r.slot: r.source for r in rows}
    assert len(slots) == len({(r.slot, r.source) for r in rows})
    head = Counter(s for k, s in slots.items() if k < 100)
    assert abs(head["big"] - 50) <= 2 and abs(head["mid"] - 30) <= 2


def test_shares(sizes, targets):
    got = {r.source: r for r in M.shares(sizes, targets).collect()}
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1, abs=1e-4) and got["none"].mixed_tokens == 0


def test_schedule_equals_counting(spark):
    rows = sorted(M.schedule([("a", 6000), ("b", 3500), ("c", 500)], spark.range(5000)).collect())
    seen = Counter()
    for r in rows:
        assert r.turn == seen[r.source]
        seen[r.source] += 1
    assert abs(seen["a"] - 3000) < 5 and abs(seen["b"] - 1750) < 5 and abs(seen["c"] - 250) < 5


def test_token_counts_and_empties(spark, targets):
    rows = [(1, "Hello world, hello.", " Web "), (2, None, "web"), (3, "", "web"), (4, "x" * 100_000, "web"), (5, "lost", None), (6, "lost", "  "), (7, "你好", "WEB")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.id: (r.source, r.tokens) for r in M.sized(df).collect()}
    assert set(got) == {1, 2, 3, 4, 7} and got[1] == ("web", 5) and got[2][1] == got[3][1] == 0 and got[4][1] > 1000
    empty = M.sized(df.limit(0))
    assert M.mixture(empty, targets).count() == 0 and M.budget(empty, targets).count() == 4
