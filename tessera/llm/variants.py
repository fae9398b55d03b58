"""Problem 1: records that differ only in formatting.

Byte-identical rows collapse first (with counts), only the distinct survivors are canonicalised, and these are grouped
again on their whole canonical text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.cluster import cut

#: One token: quoted text, an opening/closing bracket, a comma, a word, a blank run, an identifier mark or semicolon, or a sign.
TOKEN = re.compile(r"('(?:[^']|'')*(?:'|\Z))|([(),])|([^\W]+)|([\s​⁠﻿]+)|([`\"\[\];])|(.)", re.S)


def canonical_sql(text: str) -> str:
    """The text without blanks, letter case, semicolons and identifier marks outside single quotes, its outermost SELECT list sorted.

    Tokens keep a separator between neighbouring words, so that ``a b`` and ``ab`` differ while ``a=b`` and ``a = b`` agree.
    An unclosed single quote runs to the end of the text.
    """
    tokens: list[str] = []
    for m in TOKEN.finditer(text):
        kind = m.lastindex
        if kind == 1 or kind == 2:
            tokens.append(m.group())
        elif kind == 3 or kind == 6:
            tokens.append(m.group().lower())
    # outermost SELECT: the first at the least depth
    depth, best, at = 0, None, -1
    for i, t in enumerate(tokens):
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif t == "select" and (best is None or depth < best):
            best, at = depth, i
            if depth <= 0:
                break
    if at >= 0:
        lo = at + 1
        while lo < len(tokens) and tokens[lo] in ("distinct", "all"):
            lo += 1
        depth, items, start, hi = 0, [], lo, len(tokens)
        for i in range(lo, len(tokens)):
            t = tokens[i]
            if t == "(":
                depth += 1
            elif t == ")":
                depth -= 1
                if depth < 0:
                    hi = i
                    break
            elif depth == 0 and t == ",":
                items.append(tokens[start:i])
                start = i + 1
            elif depth == 0 and t in ("from", "union", "except", "intersect"):
                hi = i
                break
        items.append(tokens[start:hi])
        if len(items) > 1:
            items.sort()
            flat: list[str] = []
            for k, item in enumerate(items):
                if k:
                    flat.append(",")
                flat += item
            tokens = tokens[:lo] + flat + tokens[hi:]
    out, was_word = [], False
    for t in tokens:
        word = t[0].isalnum() or t[0] == "_"
        if word and was_word:
            out.append(" ")
        out.append(t)
        was_word = word
    return "".join(out)


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_sql, na_action="ignore")


def name_key(c: Column) -> Column:
    """Database names compare trimmed and lower-cased."""
    return F.lower(F.trim(c))


def usable(df: DataFrame, id_col: str, sql_col: str, db_col: str) -> DataFrame:
    """(id, sql, db) of the rows that take part: no null id, db or SQL, and SQL not blank (white space of any kind)."""
    blank = r"^[\s\p{Z}​⁠﻿\u0085]*$"
    return (
        df.select(F.col(id_col).alias("id"), F.col(sql_col).alias("sql"), name_key(F.col(db_col)).alias("db"))
        .where("id is not null and sql is not null and db is not null")
        .where(~F.col("sql").rlike(blank))
    )


def digest(*cols: Column) -> Column:
    """SHA-256 of the whole texts, 32 bytes."""
    return F.unhex(F.sha2(F.concat_ws("\u0000", *cols), 256))


def survivors(rows: DataFrame) -> DataFrame:
    """Distinct raw rows with their count and first id; partial aggregation before the shuffle takes hot texts."""
    return rows.groupBy("db", "sql").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def variant_groups(rows: DataFrame) -> DataFrame:
    """One record per query: keep_id, db, canonical text, number of copies and of spellings.

    Null id/db/SQL and blank SQL take no part (see ``usable``); an empty table gives no groups; repeated ids count as rows.
    """
    canon = survivors(rows).withColumn("canonical", canonical_udf("sql"))
    return (
        canon.groupBy("db", "canonical")
        .agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"), F.count("*").alias("spellings"))
        .select("keep_id", "db", "canonical", "copies", "spellings")
    )


def variant_copies(rows: DataFrame) -> DataFrame:
    """(keep_id, copy_id): every row that is a copy, with the smallest id of its group.

    Groups are formed on the whole canonical text.  The table of the survivors, with their canonical text, is written once;
    partial aggregation precedes the only shuffle of canonical texts.  After that SHA-256 digests lead spellings to their
    group and rows to their spelling, both by shuffle; a hot group is split by adaptive skew joins, as neither join feeds an
    ordered operator.
    """
    canon = cut(survivors(rows).withColumn("canonical", canonical_udf("sql")).select(digest(F.col("db"), F.col("sql")).alias("raw"), "db", "canonical", "n", "first_id"))
    groups = canon.groupBy("db", "canonical").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies")).where("copies > 1")
    spelling = canon.select("raw", digest(F.col("db"), F.col("canonical")).alias("canon")).join(groups.select(digest(F.col("db"), F.col("canonical")).alias("canon"), "keep_id"), "canon").select("raw", "keep_id")
    members = rows.select("id", digest(F.col("db"), F.col("sql")).alias("raw"))
    return members.join(spelling, "raw").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
