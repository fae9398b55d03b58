"""Text functions over answers and queries, as column expressions where the engine has them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How fenced answers and the tables of a query are recognised.
SQL_BLOCK = r"(?is)```sql\n(.*?)\n```"
ANY_BLOCK = r"(?is)```(.*?)```"
TABLE_AFTER = r"(?i)\b(?:from|join|update|into)\s+[`\"]?([A-Za-z_][A-Za-z0-9_]*)[`\"]?"


def one_line(c: Column) -> Column:
    """Questions compare with runs of white space as one blank, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def extract_sql(c: Column) -> Column:
    """The query of an answer: its last sql-marked block, else its last fenced block, else the text on one line."""
    marked = F.regexp_extract_all(c, F.lit(SQL_BLOCK), F.lit(1))
    fenced = F.regexp_extract_all(c, F.lit(ANY_BLOCK), F.lit(1))
    last = lambda a: F.regexp_replace(F.element_at(a, -1), r"^\s+|\s+$", "")
    bare = F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    return F.when(F.size(marked) > 0, last(marked)).when(F.size(fenced) > 0, last(fenced)).otherwise(bare)


def referenced_tables(c: Column) -> Column:
    """Tables named after FROM, JOIN, UPDATE or INTO, in order, each once; null, empty and failed answers name none."""
    found = F.regexp_extract_all(c, F.lit(TABLE_AFTER), F.lit(1))
    return F.when(c.isNull() | (c == "") | (c == "ERROR"), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def json_object(text: str | None) -> dict | None:
    """The JSON object of a model's answer: the whole text, a fenced block, or from the first to the last brace."""
    tries = [text or ""]
    if m := re.search(r"```(?:json)?\s*(\{.*\})\s*```", text or "", re.S | re.I):
        tries.append(m.group(1))
    lo, hi = (text or "").find("{"), (text or "").rfind("}")
    if 0 <= lo < hi:
        tries.append(text[lo : hi + 1])
    for t in tries:
        try:
            found = json.loads(t.strip())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def json_object_udf(s: pd.Series) -> pd.Series:
    """As ``json_object``, written compactly with sorted keys; null where there is none."""
    return s.map(lambda t: None if (o := json_object(t)) is None else json.dumps(o, sort_keys=True, ensure_ascii=False, separators=(",", ":")), na_action="ignore")
