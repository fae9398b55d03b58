"""Quotas between minimums and holdings, shortfalls by flow."""

from fractions import Fraction
from math import ceil, floor

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quotas as Q

CELL = st.tuples(st.sampled_from("abcd"), st.sampled_from("xyz"))
VALUE = st.tuples(st.fractions(0, 20, max_denominator=50), st.integers(0, 6), st.integers(0, 40))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(CELL, VALUE, min_size=1))
def test_bounds_total_and_margins(table):
    share, least, held = ({k: v[i] for k, v in table.items()} for i in range(3))
    got = Q.bounded(share, least, held)
    low = {k: min(least[k], held[k]) for k in table}
    assert all(low[k] <= got[k] <= held[k] for k in table)
    total = min(sum(share.values()), sum(held[k] if share[k] else low[k] for k in table))
    assert sum(got.values()) == max(total, sum(low.values()))
    whole = Q.controlled_rounding(got)
    assert all(low[k] <= whole[k] <= held[k] for k in table)
    for axis in (0, 1):
        for v in {k[axis] for k in table}:
            part = sum((q for k, q in got.items() if k[axis] == v), Fraction(0))
            assert floor(part) <= sum(n for k, n in whole.items() if k[axis] == v) <= ceil(part)
    free = [k for k in table if low[k] < got[k] < held[k]]
    assert len({got[k] / share[k] for k in free}) <= 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(CELL, st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1))
def test_shortfall_is_what_cannot_be_sent(table):
    need, held = ({k: v[i] for k, v in table.items()} for i in range(2))
    assert Q.shortfalls(need, held) == {k: max(0, need[k] - held[k]) for k in table}


def test_sample_adds_up(spark):
    rows = [(i, i, "ab"[i % 2], "xy"[i % 3 == 0]) for i in range(1000)]
    targets = [("a", "x", 9000, 1), ("a", "y", 500, 1), ("b", "x", 499, 1), ("b", "y", 1, 9)]
    df = spark.createDataFrame(rows, "id long, question long, db_id string, difficulty string")
    t = spark.createDataFrame(targets, "db_id string, difficulty string, target_bp int, min_rows int")
    rep = {(r.db_id, r.difficulty): r for r in Q.report(df, t).collect()}
    assert sum(r.quota for r in rep.values()) == 200 and rep["b", "y"].quota == 9 and all(r.quota <= r.available for r in rep.values())
    assert Q.sample(df, t).count() == 200
