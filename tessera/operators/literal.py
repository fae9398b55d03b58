"""Literal index: which columns hold a value, and which of these values a question names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.cluster import cut

PER_COLUMN, LEAST_CHARS = 1000, 4


def text_columns(df: DataFrame) -> list[str]:
    """Columns of text types."""
    return [c for c, t in df.dtypes if t == "string" or t.startswith(("char", "varchar"))]


def literal_index(tables: Mapping[str, DataFrame], per_column: int | None = PER_COLUMN) -> DataFrame:
    """(value, columns): trimmed values and the sorted ``table.column`` names that hold them.

    Of each column the first ``per_column`` distinct values in text order are indexed: the size of the index is the feature;
    None indexes all of them, for linking.
    Nulls and blanks are left out.  The group limit runs before the shuffle, so a huge column sends few values.
    """
    parts = []
    for name, df in tables.items():
        cols = text_columns(df)
        if cols:
            cells = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("column"), F.trim(F.col(f"`{c}`")).alias("value")) for c in cols])
            parts.append(df.select(F.inline(cells)).where("value <> ''"))
    if not parts:
        raise ValueError("no table has a text column")
    distinct = reduce(DataFrame.union, parts).distinct()
    kept = distinct
    if per_column is not None:
        kept = distinct.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("r") <= per_column)
    return kept.groupBy("value").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def grams(text, n=LEAST_CHARS):
    """Distinct n-character pieces of a lower-cased text."""
    t = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def literal_links(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(id, column): columns of the values that occur in a question, whatever their case; values of under four characters are noise.

    ``questions`` has (id, question).  A value that occurs shares its first four characters with the question, and its first
    8, 16 or 32 as far as it is that long.  Questions meet the few distinct beginnings first, then by an equi-join the values
    of the longest one, so many values of one beginning (``Customer#...``) meet no question that has only that beginning.
    """
    low = F.lower("value")
    n = F.when(F.length(low) >= 32, 32).when(F.length(low) >= 16, 16).when(F.length(low) >= 8, 8).otherwise(LEAST_CHARS)
    lit = index.where(F.length("value") >= LEAST_CHARS).select(low.alias("low"), n.alias("n"), low.substr(F.lit(1), n).alias("head"), "columns")
    # the beginnings are written once: where they are few the optimiser knows and broadcasts them, else pieces travel without texts
    starts = cut(lit.select(F.substring("head", 1, LEAST_CHARS).alias("g"), "n").distinct())
    q = questions.where("question is not null").select("id", F.lower("question").alias("q"))
    met = q.select("id", F.explode(grams(F.col("q"))).alias("g")).join(starts, "g").groupBy("id", "n").agg(F.collect_set("g").alias("gs"))  # bounded by the text
    near = met.join(q, "id").select("id", "q", F.explode(F.filter(grams(F.col("q"), F.col("n")), lambda x: F.array_contains("gs", F.substring(x, 1, LEAST_CHARS)))).alias("head"))
    hit = near.join(lit, "head").where(F.contains("q", "low"))
    return hit.select("id", F.explode("columns").alias("column")).distinct()


def union_links(literal: DataFrame, vector: DataFrame) -> DataFrame:
    """Columns that either way of linking found."""
    return literal.select("id", "column").union(vector.select("id", "column")).distinct()
