"""Sources: question files, query corpora, histories, SQLite databases, and what is known of tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "question_id long, db_id string, question string, evidence string, SQL string, difficulty string"


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON array of questions, in file order (ord from 0); ``limit`` keeps the first ones."""
    df = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())
    return df if limit is None else df.orderBy("ord").limit(limit)


def query_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(sql, db_id) of text lines, parted at the last tab; lines without a tab are left out."""
    t = spark.read.text(path)
    return t.select(F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 1).alias("sql"), F.trim(F.regexp_extract("value", r"^(.*)\t([^\t]*)$", 2)).alias("db_id")).where("sql <> ''")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and unreadable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ddl(df: DataFrame, name: str) -> str:
    """A CREATE TABLE text of a DataFrame's schema."""
    from tessera.operators.profile import declared_type

    quote = lambda n: '"' + n.replace('"', '""') + '"'
    return f"CREATE TABLE {quote(name)} (" + ", ".join(f"{quote(c)} {declared_type(t)}" for c, t in df.dtypes) + ")"


def sqlite_tables(path: str) -> list[str]:
    """Names of the tables of a SQLite database, without its own."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]


def sqlite_constraints(path: str):
    """Declared primary, unique and foreign keys of a SQLite database."""
    from tessera.operators.profile import Constraints

    primary, unique, foreign = {}, {}, []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for t in sqlite_tables(path):
            q = '"' + t.replace('"', '""') + '"'
            pk = [(r[5], r[1]) for r in con.execute(f"PRAGMA table_info({q})") if r[5]]
            if pk:
                primary[t] = tuple(c for _, c in sorted(pk))
            for r in con.execute(f"PRAGMA index_list({q})").fetchall():
                name = '"' + r[1].replace('"', '""') + '"'
                cols = [x[2] for x in con.execute(f"PRAGMA index_info({name})")]
                if r[2] and len(cols) == 1 and cols[0] is not None:
                    unique[t] = tuple(dict.fromkeys((*unique.get(t, ()), cols[0])))
            foreign += [(t, r[3], r[2], r[4] or "") for r in con.execute(f"PRAGMA foreign_key_list({q})")]
    return Constraints(primary, unique, tuple(foreign))


def _scan(path: str, table: str, kinds: list[tuple[str, str]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    q = '"' + table.replace('"', '""') + '"'
    number = {"bigint": int, "double": float}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for pdf in batches:
            for lo, hi in zip(pdf["lo"], pdf["hi"]):
                # null bounds: a table without row ids, read as a whole
                rows = con.execute(f"SELECT * FROM {q}") if pd.isna(lo) else con.execute(f"SELECT * FROM {q} WHERE rowid BETWEEN ? AND ?", (int(lo), int(hi)))
                while part := rows.fetchmany(20_000):
                    cols = {}
                    for i, (c, k) in enumerate(kinds):
                        f = number.get(k, str)
                        cols[c] = pd.Series([None if r[i] is None else f(r[i]) if not isinstance(r[i], bytes) else r[i].decode("utf-8", "replace") for r in part], dtype=object)
                    yield pd.DataFrame(cols)


def sqlite_table(spark: SparkSession, path: str, table: str, chunk: int = 1_000_000) -> DataFrame:
    """A table of a SQLite file that all executors can read, scanned in parallel by ranges of row ids.

    Columns follow the affinity of their declared type; a column in which a text stands where a number is declared is
    read as text, since its values have types of their own.  Tables without row ids are read in one range by their order.
    """
    q = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        declared = [(r[1], (r[2] or "").upper()) for r in con.execute(f"PRAGMA table_info({q})")]
        # one scan says which columns hold values that their declared type does not promise
        ask = ", ".join(f"max(typeof({c}) IN ('text', 'blob')), max(typeof({c}) = 'real')" for c in ('"' + n.replace('"', '""') + '"' for n, _ in declared))
        seen = con.execute(f"SELECT {ask} FROM {q}").fetchone()
        kinds = []
        for i, (name, t) in enumerate(declared):
            kind = "bigint" if "INT" in t else "double" if any(x in t for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"
            texts, reals = seen[2 * i : 2 * i + 2]
            kinds.append((name, "string" if texts else "double" if kind == "bigint" and reals else kind))
        try:
            top = con.execute(f"SELECT min(rowid), max(rowid) FROM {q}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids
            top = (None, None) if con.execute(f"SELECT 1 FROM {q} LIMIT 1").fetchone() is None else (None, 0)
    if top[0] is None:
        ranges = [] if top[1] is None else [(None, None)]
    else:
        ranges = [(lo, min(lo + chunk - 1, top[1])) for lo in range(top[0], top[1] + 1, chunk)]
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds)
    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(ranges, "lo long, hi long").repartition(len(ranges), "lo").mapInPandas(partial(_scan, path, table, kinds), schema)
