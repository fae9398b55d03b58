"""Runs queries of the dialect on a set of registered tables."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect.parse import SqlError, parse
from tessera.dialect.write import Writer, kind_of

_CALLS = itertools.count()
AS_OF = dt.datetime(2024, 1, 1)


def translate(sql: str, tables: Callable[[str], list[tuple[str, str]] | None] = lambda _: None, as_of: dt.datetime = AS_OF) -> str:
    """Spark SQL of a query; ``tables`` names the columns (name, kind) of a table, None leaves its kinds unknown."""
    return Writer(tables, as_of).query(parse(sql))[0]


class Dialect:
    """A database: named DataFrames that queries of the dialect can read.

    The clock is pinned to ``as_of``, so that results repeat.  Only queries are accepted.  Numbers overflow, divide by zero and
    fail to parse as NULL or as the dialect's conversions say, whatever ANSI mode the session has.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], as_of: dt.datetime = AS_OF):
        self.spark, self.as_of = spark, as_of
        self.frames = {n.lower(): df for n, df in tables.items()}

    def columns(self, table: str) -> list[tuple[str, str]] | None:
        df = self.frames.get(table.lower())
        return None if df is None else [(c, kind_of(t)) for c, t in df.dtypes]

    def translate(self, sql: str) -> str:
        return translate(sql, self.columns, self.as_of)

    def sql(self, sql: str) -> DataFrame:
        """The result of a query.  Its tables are views under names of this call alone, only while the query is analysed, so
        that databases with equal table names and queries in other threads do not meet."""
        tag, used = f"tessera_{next(_CALLS)}_", {}

        def view(name: str) -> str:
            if name.lower() in self.frames:
                used[name.lower()] = tag + name.lower()
                return used[name.lower()]
            raise SqlError(f"no such table: {name}")

        text = Writer(self.columns, self.as_of, view).query(parse(sql))[0]
        try:
            for name, at in used.items():
                self.frames[name].createOrReplaceTempView(at)
            return self.spark.sql(text)
        finally:
            for at in used.values():
                self.spark.catalog.dropTempView(at)
