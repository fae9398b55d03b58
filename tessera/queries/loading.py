"""Queries of problem 4: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.cluster import table
from tessera.sources.lines import parse_lines


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "dev_lines"), table(spark, d, "db_list"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is not null").select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is null").select("line_id", "sql", "db_id")


_PIECE = r"""'[^']*'|"[^"]*"|`[^`]*`"""
_CTE = rf"""
with l as (select line_id, line_text t from dev_lines),
f as (select line_id, t,
  regexp_full_match(t, $r$(?s)(?:[^'"`]|{_PIECE})*$r$) closed,
  len(regexp_replace(t, $r$(?s){_PIECE}$r$, '', 'g')) - len(replace(regexp_replace(t, $r$(?s){_PIECE}$r$, '', 'g'), chr(9), '')) tabs,
  regexp_extract(t, $r$(?s)^((?:[^\t'"`]|{_PIECE})*)\t(.*)$$r$, 1) s0,
  regexp_extract(t, $r$(?s)^((?:[^\t'"`]|{_PIECE})*)\t(.*)$$r$, 2) d0 from l),
g as (select line_id, trim(s0, ' ' || chr(13)) sql, trim(d0, ' ' || chr(13)) db_id,
  case when t is null then 'column_count' when not closed then 'broken_quoting' when tabs <> 1 then 'column_count'
    when not regexp_matches(trim(s0, ' ' || chr(13)), $r$^(?i)(select|with)([^A-Za-z0-9_]|$)$r$)
      or trim(d0, ' ' || chr(13)) not in (select db_id from db_list)
      or regexp_matches(t, $r$[\x00-\x08\x0a-\x0c\x0e-\x1f\x{{FFFD}}]$r$) then 'invalid_value' end reason from f)
"""

QUERIES = {"p4_found": p4_found, "p4_loaded": p4_loaded}
SQL = {
    "p4_found": _CTE + "select line_id, reason from g where reason is not null",
    "p4_loaded": _CTE + "select line_id, sql, db_id from g where reason is null",
}
