"""Queries over table metadata and the catalog of described columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, profile
from tessera.plans.cluster import cut, table
from tessera.queries.profiling import COLUMNS, CONSTRAINTS, TABLES, frames
from tessera.sources.readers import ddl


def table_list(spark: SparkSession, d: str) -> DataFrame:
    """Tables and their declared columns."""
    rows = [(t, i, c, profile.declared_type(k)) for t, df in frames(spark, d).items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "tbl string, ord int, col string, declared string")


def table_ddl(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, ddl(df, t)) for t, df in frames(spark, d).items()], "tbl string, ddl string")


def constraints(spark: SparkSession, d: str) -> DataFrame:
    rows = [("primary", t, c, "", "") for t, cs in CONSTRAINTS.primary.items() for c in cs] + [("unique", t, c, "", "") for t, cs in CONSTRAINTS.unique.items() for c in cs] + [("foreign", *f) for f in CONSTRAINTS.foreign]
    return spark.createDataFrame(rows, "kind string, tbl string, col string, ref_table string, ref_column string")


def keys_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether the declared single keys are unique in the tables: rows, values and distinct values of each."""
    out = None
    for t, c in [(t, c) for m in (CONSTRAINTS.primary, CONSTRAINTS.unique) for t, cs in m.items() for c in cs]:
        one = table(spark, d, t).agg(F.count("*").alias("n"), F.count(c).alias("filled"), F.count_distinct(c).alias("different")).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "n", "filled", "different", (F.col("n") == F.col("different")).cast("int").alias("holds"))
        out = one if out is None else out.union(one)
    return out


def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Rule-based descriptions of all columns."""
    return catalog.describe(cut(profile.profile(frames(spark, d), CONSTRAINTS)))


def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return catalog.describe_tables(profile.counts(profile.value_counts(frames(spark, d))), CONSTRAINTS)


def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


def column_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of 300 values of a column, by the order of their keys' MD5 (sampling is the feature)."""
    c = table(spark, d, "customer").where("c_name is not null")
    return c.orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey").limit(300).select("c_custkey", "c_name")


QUERIES = {f.__name__: f for f in (table_list, table_ddl, constraints, keys_hold, catalog_columns, catalog_tables, full_scan, column_sample)}

_PK = {t: ", ".join(c) for t, c in CONSTRAINTS.primary.items()}
_FK = {f[0]: f"{f[1]} -> {f[2]}.{f[3]}" for f in CONSTRAINTS.foreign}
SQL = {
    "table_list": " UNION ALL ".join(f"SELECT '{t}' tbl, {i} ord, '{c.split()[0]}' col, '{c.split()[1]}' declared" for t in TABLES for i, c in enumerate(COLUMNS[t].split(", "))),
    "catalog_tables": " UNION ALL ".join(
        f"SELECT '{t}' tbl, '{t}: ' || count(*) || ' rows, {len(COLUMNS[t].split(', '))} columns, {'key ' + _PK[t] if t in _PK else 'no declared key'}' table_summary, '{_FK.get(t, 'no known joins')}' join_hints FROM {t}" for t in TABLES
    ),
    "table_ddl": "SELECT table_name tbl, 'CREATE TABLE \"' || table_name || '\" (' || string_agg('\"' || column_name || '\" ' || CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'BOOLEAN') THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' "
    "WHEN data_type LIKE 'DECIMAL%' THEN 'DECIMAL' WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME' WHEN data_type = 'DATE' THEN 'DATE' ELSE 'TEXT' END, ', ' ORDER BY ordinal_position) || ')' ddl "
    f"FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) GROUP BY table_name",
    "keys_hold": " UNION ALL ".join(f"SELECT '{t}' tbl, '{c}' col, count(*) n, count({c}) filled, count(DISTINCT {c}) different, CAST(count(*) = count(DISTINCT {c}) AS INT) holds FROM {t}" for m in (CONSTRAINTS.primary, CONSTRAINTS.unique) for t, cs in m.items() for c in cs),
    "full_scan": "SELECT * FROM customer",
    "column_sample": "SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 300",
}
