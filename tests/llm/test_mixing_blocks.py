"""Blocks without gaps, long documents in pieces, unmet targets from the schedule."""

import random

import pytest

from tessera.llm import mixing as M

pytest.importorskip("tiktoken")


def test_no_block_is_empty_and_long_documents_are_cut(spark):
    rng, rows = random.Random(4), [(0, "s", 50_000), (1, "s", 1000), (2, "t", 999)]
    rows += [(i, "s", rng.randrange(1, 900)) for i in range(10, 300)]
    held = M.blocks(spark.createDataFrame(rows, "id long, source string, tokens long"), block_tokens=1000).collect()
    size = {}
    for r in held:
        size[r.source, r.block] = size.get((r.source, r.block), 0) + r.tokens
    assert sum(size.values()) == sum(r[2] for r in rows)
    last = max(b for s, b in size if s == "s")
    assert {b for s, b in size if s == "s"} == set(range(last + 1)) and max(size.values()) < 2000
    assert sorted(r.piece for r in held if r.id == 0) == list(range(50)) and all(r.tokens <= 1000 for r in held)


def test_unmet_equals_the_comparison_of_tokens(spark):
    rng = random.Random(5)
    for case in range(4):
        rows = [(i, rng.choice("abcd"), rng.randrange(1, 400)) for i in range(rng.choice([3, 40, 2000]))]
        sizes = spark.createDataFrame(rows, "id long, source string, tokens long")
        targets = spark.createDataFrame([(s, b, m) for s, b, m in (("a", 4000, 1), ("b", 3000, 1), ("c", 2000, 1), ("d", 900, 1), ("none", 100, 9))], "source string, target_bp int, max_repeats int")
        want = {r.source for r in M.budget(sizes, targets).where("short").collect()}
        assert {r.source for r in M.unmet(sizes, targets, block_tokens=200).collect()} == want
    assert M.unmet(sizes.limit(0), targets).count() == 0 and M.unmet(sizes, targets.limit(0)).count() == 0
