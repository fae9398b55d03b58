"""Readers and sinks."""

import datetime as dt
import json
import sqlite3

import pytest

from tessera.sources import readers, sinks


def test_questions_and_corpus(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(json.dumps([{"question_id": i, "db_id": "d", "question": f"q{i}\nx", "SQL": "SELECT 1"} for i in range(5)]), encoding="utf-8")
    assert [r.question_id for r in readers.questions(spark, str(p), 3).collect()] == [0, 1, 2]
    c = tmp_path / "c.sql"
    c.write_text("SELECT 'a\tb' FROM t\tlab\n\nno tab\nSELECT 2\t x \n", encoding="utf-8")
    assert [tuple(r) for r in readers.query_corpus(spark, str(c)).collect()] == [("SELECT 'a\tb' FROM t", "lab"), ("SELECT 2", "x")]


def test_json_lines_skip_bad_ones(spark, tmp_path):
    p = str(tmp_path / "h.jsonl")
    sinks.append_json_line(p, {"run_tag": "a", "n": 1})
    with open(p, "a", encoding="utf-8") as f:
        f.write("\n{bad\n")
    sinks.append_json_line(p, {"run_tag": "b"})
    assert sorted(r.run_tag for r in readers.json_lines(spark, p, "run_tag string, n int").collect()) == ["a", "b"]


def test_atomic_json_and_tables(spark, tmp_path):
    p = str(tmp_path / "x" / "r.json")
    sinks.write_json(p, {"a": "é"})
    assert json.load(open(p, encoding="utf-8")) == {"a": "é"} and not (tmp_path / "x" / "r.json.tmp").exists()
    t = str(tmp_path / "t")
    for n in (3, 4):
        sinks.write_table(spark.range(n), t)
        assert spark.read.parquet(t).count() == n


def test_naming(tmp_path):
    base, now = str(tmp_path / "r.json"), dt.datetime(2024, 5, 6, 7, 8, 9)
    assert sinks.result_path(base, "timestamp", "my run!", now).endswith("r_my_run_20240506_070809.json")
    assert sinks.result_path(base, "overwrite") == base
    open(str(tmp_path / "r_001.json"), "w").close()
    assert sinks.result_path(base, "increment").endswith("r_002.json") and sinks.summary_path(base).endswith("r.summary.json")
    with pytest.raises(ValueError):
        sinks.result_path(base, "other")


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "d.sqlite")
    with sqlite3.connect(p) as con:
        con.execute('CREATE TABLE "my t" (id INTEGER PRIMARY KEY, name TEXT UNIQUE, v REAL, mixed INTEGER, other INTEGER REFERENCES o(id))')
        con.execute("CREATE TABLE o (id INTEGER)")
        con.executemany('INSERT INTO "my t" VALUES (?, ?, ?, ?, ?)', [(i, f"n{i}", i / 2, "x" if i == 7 else i, None) for i in range(1, 51)])
    assert readers.sqlite_tables(p) == ["my t", "o"]
    c = readers.sqlite_constraints(p)
    assert c.primary == {"my t": ("id",)} and c.unique == {"my t": ("name",)} and c.foreign == (("my t", "other", "o", "id"),)
    df = readers.sqlite_table(spark, p, "my t", chunk=20)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "v": "double", "mixed": "string", "other": "bigint"}
    rows = sorted(df.collect())
    assert len(rows) == 50 and tuple(rows[6]) == (7, "n7", 3.5, "x", None)
    assert readers.sqlite_table(spark, p, "o").count() == 0
    assert readers.ddl(df, "my t") == 'CREATE TABLE "my t" ("id" INTEGER, "name" TEXT, "v" REAL, "mixed" TEXT, "other" INTEGER)'
