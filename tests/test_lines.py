"""Line loading: the columnar path against the strict scanner, and odd inputs."""

import random

import pyarrow as pa
import pytest

from tessera.sources.lines import bisect, diagnose, parse_block, parse_lines

NAMES = frozenset(["lab", "Deck"])
GOOD = "SELECT a FROM t WHERE x = 'y'\tlab"
CASES = {
    GOOD: None,
    " with q as (select 1) select * from q \r\t lab \r": None,
    "SELECT 'a\tb' FROM t\tlab": None,
    'SELECT "it\'s" FROM t\tlab': None,
    "SELECT 'it''s' FROM `a\tb`\tDeck": None,
    "SELECT 'open FROM t\tlab": "broken_quoting",
    'SELECT "open FROM t\tlab': "broken_quoting",
    "SELECT `open FROM t\tlab": "broken_quoting",
    "SELECT 1": "column_count",
    "": "column_count",
    "SELECT 1\tlab\tmore": "column_count",
    "SELECT 1\t\tlab": "column_count",
    "SELECT 1\t'lab\tx'": "invalid_value",
    "SELECTED 1\tlab": "invalid_value",
    "DELETE FROM t\tlab": "invalid_value",
    "\tlab": "invalid_value",
    "SELECT 1\tLAB": "invalid_value",
    "SELECT 1\t": "invalid_value",
    "SELECT 1 \x07\tlab": "invalid_value",
    "SELECT 1 �\tlab": "invalid_value",
    "SELECT 1\n\tlab": "invalid_value",
    "SELECT*FROM t\tlab": None,
    "Select\xa01\tlab": None,
}


@pytest.mark.parametrize("line", list(CASES))
def test_reason(line):
    assert diagnose(line, NAMES)[0] == CASES[line]


def test_null_line():
    assert diagnose(None, NAMES) == ("column_count", None, None)


def test_blocks_agree_with_the_scanner():
    rng = random.Random(5)
    lines = [rng.choice([*CASES, None]) if rng.random() < 0.15 else GOOD.replace("y", f"v{i}") for i in range(3000)]
    for size in (1, 7, 512, 3000):
        for lo in range(0, 3000, size):
            part = lines[lo : lo + size]
            got = {}
            for b in parse_block(pa.array(range(lo, lo + len(part))), pa.array(part, pa.string()), NAMES, pa.array(sorted(NAMES))):
                for r in b.to_pylist():
                    got[r["line_id"]] = (r["reason"], r["sql"], r["db_id"])
            assert got == {lo + i: diagnose(t, NAMES) for i, t in enumerate(part)}


def test_whole_table(spark):
    rows = [(i, t, "x") for i, t in enumerate([*CASES, None, GOOD, GOOD, "SELECT " + "a, " * 50_000 + "b FROM t\tlab"])]
    df = spark.createDataFrame(rows, "line_id long, line_text string, reason string")
    got = {r.line_id: r.reason for r in parse_lines(df, spark.createDataFrame([(n,) for n in NAMES], "db_id string")).collect()}
    assert got == {i: diagnose(t, NAMES)[0] for i, t, _ in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "line_id long, line_text string")
    names = spark.createDataFrame([], "db_id string")
    assert parse_lines(none, names).count() == 0
    one = spark.createDataFrame([(1, GOOD)], "line_id long, line_text string")
    assert parse_lines(one, names).collect()[0].reason == "invalid_value"


def test_sound_lines_take_the_columnar_path():
    rng, tally = random.Random(6), [0, 0]
    lines = [rng.choice(["SELECT 'open\tlab", "SELECT 1", "DROP t\tlab"]) if rng.random() < 0.08 else rng.choice([GOOD, 'SELECT "a b" FROM `t`\tDeck', "with q as (select 'it''s') select * from q\tlab"]) for _ in range(5000)]
    parse_block(pa.array(range(5000)), pa.array(lines), NAMES, pa.array(sorted(NAMES)), tally)
    assert tally[0] == sum(diagnose(t, NAMES)[0] is None for t in lines) and sum(tally) == 5000


def test_bisection():
    rng = random.Random(7)
    for n in (0, 1, 2, 100):
        marks = [rng.random() < 0.9 for _ in range(n)]
        runs, bad = bisect(pa.array(marks, pa.bool_()))
        assert sorted([i for lo, hi in runs for i in range(lo, hi)] + bad) == list(range(n)) and bad == [i for i in range(n) if not marks[i]]
