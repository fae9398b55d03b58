"""Formatting variants against a brute-force grouping."""

import random
from collections import defaultdict

import pytest

from tessera.llm import variants as V

BASE = "SELECT T1.a, COUNT(*) FROM t AS T1 WHERE T1.x = 'Ab  c' AND T1.n > 1.50 ORDER BY T1.a DESC"
SAME = [
    BASE.lower().replace("'ab  c'", "'Ab  c'"),
    BASE.replace(" ", " \n\t\xa0") .replace("'Ab \n\t\xa0 \n\t\xa0c'", "'Ab  c'"),
    "select count ( * ) , [t1].[a] from `t` as \"T1\" where t1 . x='Ab  c'and t1.n>1.50 order by t1.a desc ;;",
    BASE + ";",
]
OTHER = [
    BASE.replace("Ab  c", "ab  c"), BASE.replace("Ab  c", "Ab c"), BASE.replace("1.50", "1.5"), BASE.replace(">", ">="), BASE.replace("DESC", ""),
    BASE.replace("T1.x = 'Ab  c' AND T1.n > 1.50", "T1.n > 1.50 AND T1.x = 'Ab  c'"), BASE.replace("SELECT", "SELECT DISTINCT"), BASE.replace("COUNT", "SUM"),
]


@pytest.mark.parametrize("text", SAME)
def test_same(text):
    assert V.canonical_sql(text) == V.canonical_sql(BASE)


@pytest.mark.parametrize("text", OTHER)
def test_other(text):
    assert V.canonical_sql(text) != V.canonical_sql(BASE)


def test_only_the_outermost_list_is_sorted():
    c = V.canonical_sql
    assert c("SELECT b, (SELECT y, x FROM u), a FROM t") == c("SELECT a, b, (SELECT y, x FROM u) FROM t")
    assert c("SELECT a FROM (SELECT y, x FROM u)") != c("SELECT a FROM (SELECT x, y FROM u)")
    assert c("WITH q AS (SELECT y, x FROM u) SELECT b, a FROM q") == c("WITH q AS (SELECT y, x FROM u) SELECT a, b FROM q")
    assert c("SELECT IIF(a, b, c), d FROM t") != c("SELECT IIF(b, a, c), d FROM t")
    assert c("SELECT a, 'x, y', b FROM t") == c("SELECT b, a, 'x, y' FROM t")
    assert c("SELECT DISTINCT b, a FROM t") == c("SELECT DISTINCT a, b FROM t")
    assert c("a b") != c("ab") and c("") == "" and c("'open") != c("'Open")


def test_copies_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(600):
        rows.append((i, rng.choice([*SAME, *OTHER, BASE, "", "  \xa0", None, ";"]), rng.choice(["d", " D ", "e", None])))
    rows += [(1000 + i, BASE, "hot") for i in range(400)]
    df = V.usable(spark.createDataFrame(rows, "record_id long, sql string, db_id string"), "record_id", "sql", "db_id")
    groups = defaultdict(list)
    for i, s, d in rows:
        if s is not None and d is not None and s.strip():
            groups[d.strip().lower(), V.canonical_sql(s)].append(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {tuple(r) for r in V.variant_copies(df).collect()} == want
    assert {(r.keep_id, r.copies) for r in V.variant_groups(df).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "record_id long, sql string, db_id string")
    assert V.variant_copies(V.usable(none, "record_id", "sql", "db_id")).count() == 0
    long = "SELECT " + ", ".join(f"c{i}" for i in range(60_000)) + " FROM t"
    back = "select " + ", ".join(f"c{i}" for i in reversed(range(60_000))) + " from t"
    df = spark.createDataFrame([(1, long, "d", 5), (2, back, "d", 6)], "record_id long, sql string, db_id string, id int")
    assert [tuple(r) for r in V.variant_copies(V.usable(df, "record_id", "sql", "db_id")).collect()] == [(1, 2)]
