"""Controlled rounding and samples by quota."""

from collections import Counter
from fractions import Fraction
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quotas as Q


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz")), st.fractions(0, 20, max_denominator=50), min_size=1))
def test_rounding_keeps_every_margin(table):
    got = Q.controlled_rounding(table)
    assert set(got) == set(table)
    between = lambda n, x: floor(x) <= n <= ceil(x)
    assert all(between(got[k], table[k]) for k in table)
    for axis in (0, 1):
        for v in {k[axis] for k in table}:
            assert between(sum(n for k, n in got.items() if k[axis] == v), sum(q for k, q in table.items() if k[axis] == v))
    assert between(sum(got.values()), sum(table.values()))


def frames(spark):
    rows, n = [], 0
    for db, diff, k in (("a", "simple", 300), ("a", "hard", 40), ("b", "simple", 60), ("b", "hard", 3)):
        for i in range(k):
            n += 1
            rows += [(n, n, f" {db.upper()} ", diff), (n + 10_000, n, db, diff.title())]
    rows += [(90_000, 1, None, "simple"), (90_001, None, "a", "simple"), (90_002, 5, "zzz", "simple"), (90_003, 5, "a", None)]
    targets = [("a", "simple", 5000, 2), ("a", "hard", 1000, 2), ("b", "simple", 2500, 2), ("b", "hard", 1000, 2), ("c", "hard", 500, 1)]
    return spark.createDataFrame(rows, "id long, question long, db_id string, difficulty string"), spark.createDataFrame(targets, "db_id string, difficulty string, target_bp int, min_rows int")


def test_sample_has_its_quotas(spark):
    rows, targets = frames(spark)
    rep = {(r.db_id, r.difficulty): r for r in Q.report(rows, targets).collect()}
    size = (300 + 40 + 60 + 3) // 5
    assert rep["a", "simple"].available == 300 and rep["b", "hard"].missing == size * 1000 // 10000 - 3 and rep["c", "hard"].missing == size * 500 // 10000
    got = Q.sample(rows, targets).collect()
    assert Counter((r.db_id, r.difficulty) for r in got) == Counter({k: r.taken for k, r in rep.items() if r.taken})
    assert len({r.question for r in got}) == len(got) and all(r.id <= 10_000 for r in got)
    assert Counter(Q.sample(rows, targets).collect()) == Counter(got)
    assert Counter(Q.sample(rows, targets, seed=2).collect()) != Counter(got)


def test_empty(spark):
    rows, targets = frames(spark)
    assert all(r.available == 0 and r.taken == 0 for r in Q.report(rows.limit(0), targets).collect())
    assert Q.sample(rows.limit(0), targets).count() == 0 and Q.report(rows, targets.limit(0)).count() == 0
