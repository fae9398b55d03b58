"""Catalog of described columns: rule-based descriptions, merging of model answers, and resumable builds."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.provider import Provider
from tessera.functions.texts import json_object
from tessera.operators.profile import KEYS, Constraints, profile
from tessera.plans.cluster import cut
from tessera.sources.sinks import path_exists, replace_path, write_table

VERSION = "1"
RESERVED = "__"  # names that begin so are no tables


def describe(profiles: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Rule-based texts of each column of ``profiles`` (see ``profile``): short, long and plain description, values, format."""
    top = F.array_join(F.transform(F.slice(F.coalesce("top_values", F.array().cast("array<struct<rank:int,v:string,n:bigint>>")), 1, 3), lambda x: x["v"]), ", ")
    role = F.when(F.col("likely_key"), "likely a key").otherwise("an ordinary attribute")
    filled = F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.round(F.col("non_nulls") * 100 / F.col("row_count"), 2))
    number = F.when(F.col("numeric_stats").isNotNull(), F.format_string("numbers from %s to %s with median %s", F.col("numeric_stats.min").cast("string"), F.col("numeric_stats.max").cast("string"), F.col("numeric_stats.p50").cast("string")))
    date = F.when(F.col("date_stats").isNotNull(), F.concat(F.lit("dates from "), "date_stats.min", F.lit(" to "), "date_stats.max"))
    flags = F.when(F.size("quality_flags") > 0, F.concat(F.lit("flags "), F.array_join("quality_flags", ", "))).otherwise("no flags")
    return profiles.select(
        *KEYS,
        F.concat("col", F.lit(" of type "), "declared", F.lit(", read as "), "semantic_type", F.lit(", "), role, F.lit(", cardinality "), "cardinality_class").alias("short_description"),
        F.concat_ws("; ", F.concat("col", F.lit(" of "), "tbl"), F.concat(F.col("distinct_count").cast("string"), F.lit(" distinct of "), F.col("non_nulls").cast("string"), F.lit(" values, "), F.col("nulls").cast("string"), F.lit(" nulls")), number, date, flags).alias("long_description"),
        F.concat("col", F.lit(" of type "), "declared", F.lit(", "), filled.cast("string"), F.lit(" % filled")).alias("description"),
        F.concat("format_hint", F.when(F.col("likely_key"), F.lit(" Suited to joins.")).otherwise(F.lit(""))).alias("format_hint"),
        top.alias("literal_hints"),
    )


def describe_tables(profiles: DataFrame, constraints: Constraints, candidates: DataFrame | None = None) -> DataFrame:
    """(tbl, table_summary, join_hints): size and keys of each table, declared and found joins."""
    spark = profiles.sparkSession
    rows = profiles.groupBy("tbl").agg(F.max("row_count").alias("n"), F.count("*").alias("columns"))
    keys = spark.createDataFrame([(t, ", ".join(c)) for t, c in constraints.primary.items()], "tbl string, pk string")
    known = spark.createDataFrame([(f[0], f"{f[1]} -> {f[2]}.{f[3]}") for f in constraints.foreign], "tbl string, j string")
    joins = known
    if candidates is not None:
        joins = joins.union(candidates.where("rank <= 2").select(F.col("from_table"), F.concat("from_column", F.lit(" ~ "), "to_table", F.lit("."), "to_column")))
    hints = joins.groupBy("tbl").agg(F.array_join(F.array_sort(F.collect_set("j")), "; ").alias("join_hints"))
    return rows.join(keys, "tbl", "left").join(hints, "tbl", "left").select(
        "tbl", F.concat("tbl", F.lit(": "), F.col("n").cast("string"), F.lit(" rows, "), F.col("columns").cast("string"), F.lit(" columns, "), F.coalesce(F.concat(F.lit("key "), "pk"), F.lit("no declared key"))).alias("table_summary"),
        F.coalesce("join_hints", F.lit("no known joins")).alias("join_hints"),
    )


def payload(profiles: DataFrame) -> DataFrame:
    """(tbl, payload): what a model is told of a table, as JSON: counts, types, ranges and the three top values of each column."""
    col = F.struct("col", "declared", "semantic_type", "nulls", "non_nulls", "distinct_count", "cardinality_class", "likely_key", "key_score", "min_value", "max_value", F.slice("top_values", 1, 3).alias("top_values"), "numeric_stats", "date_stats", "quality_flags")
    return profiles.groupBy("tbl").agg(F.to_json(F.struct(F.max("row_count").alias("row_count"), F.array_sort(F.collect_list(F.struct("ord", col.alias("column")))).alias("columns"))).alias("payload"))


FIELDS = ("short_description", "long_description", "description", "format_hint", "literal_hints")


def merge_description(answer: str | None, fallback: Mapping[str, Mapping[str, str]]) -> tuple[dict[str, dict[str, str]], str]:
    """Per column and field the model's text where it gave one, else the fallback's; an answer without an object is all fallback."""
    found = json_object(answer)
    columns = found.get("columns") if isinstance(found, dict) else None
    if not isinstance(found, dict):
        return {c: dict(f) for c, f in fallback.items()}, "fallback"
    out = {}
    for c, f in fallback.items():
        said = columns.get(c) if isinstance(columns, dict) else None
        said = said if isinstance(said, dict) else {}
        out[c] = {k: str(said.get(k) or f.get(k) or "") for k in FIELDS}
        if not said.get("description") and said.get("short_description"):
            out[c]["description"] = str(said["short_description"])
    return out, "model"


def enrich(payloads: DataFrame, provider: Provider) -> DataFrame:
    """(tbl, answer) of a model for each table; a failing call leaves answer null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for p in pdf["payload"]:
                try:
                    answers.append(provider.complete([{"role": "user", "content": f"Describe the columns of this table as JSON.\n{p}"}], json_mode=True))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"tbl": pdf["tbl"], "answer": answers})

    return payloads.mapInPandas(run, "tbl string, answer string")


def described(profiles: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Profiles of one table with the descriptions of its columns and where these come from: rules, or a model's answer merged over them."""
    spark, texts = profiles.sparkSession, describe(profiles)
    if provider is None:
        return profiles.join(texts.withColumnRenamed("format_hint", "described_format"), list(KEYS), "left").withColumn("described_by", F.lit("rules"))
    fallback = {r["col"]: {k: r[k] or "" for k in FIELDS} for r in texts.collect()}  # a row a column
    answers = [r["answer"] for r in enrich(payload(profiles), provider).collect()]
    merged, by = merge_description(answers[0] if answers else None, fallback)
    rows = [(c, *(f.get(k, "") for k in FIELDS), by if by == "model" else "rules") for c, f in merged.items()]
    names = [k if k != "format_hint" else "described_format" for k in FIELDS]
    return profiles.join(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ("col", *names, "described_by"))), "col", "left")


def _root(out_dir: str, db: str, settings: Mapping[str, str] | None) -> str:
    return os.path.join(out_dir, db, "-".join([VERSION, *[f"{k}={v}" for k, v in sorted((settings or {}).items())]]))


def _column_by_column(name: str, df: DataFrame, constraints: Constraints) -> tuple[DataFrame, dict[str, str]]:
    """The profiles of the columns that can be profiled, each on its own, and the errors of the others; none at all is an error."""
    found, bad = None, {}
    for i, c in enumerate(df.columns):
        try:
            one = cut(profile({name: df.select(F.col(f"`{c}`"))}, constraints).withColumn("ord", F.lit(i)))
            found = one if found is None else found.unionByName(one)
        except Exception as e:
            bad[f"{name}.{c}"] = str(e).splitlines()[0][:300]
    if found is None:
        raise ValueError(f"no column of {name} can be profiled")
    return found, bad


def build(tables: Mapping[str, DataFrame], out_dir: str, db: str, constraints: Constraints = Constraints(), settings: Mapping[str, str] | None = None, provider: Provider | None = None) -> dict:
    """Profiles and describes the tables that this version and these settings have not yet profiled, one at a time; returns the run's meta.

    Each table is its own Parquet folder on any file system that Spark reads, renamed to its final name last of all, so a
    stopped build resumes with the tables that are missing.  A column that fails is reported and left out, a table of which
    none can be read is reported and skipped.  The settings are
    part of the folder's name: a limited run is never taken for a full one.  Names with the reserved prefix are skipped.
    """
    root = _root(out_dir, db, settings)
    done, skipped, failed = [], [], {}
    for name, df in tables.items():
        if name.startswith(RESERVED) or name.startswith("sqlite_"):
            continue
        path = os.path.join(root, name)
        if path_exists(df.sparkSession, path):
            skipped.append(name)
            continue
        try:
            try:
                found = cut(profile({name: df}, constraints))
            except Exception:  # some column of it is bad: the others count
                found, bad = _column_by_column(name, df, constraints)
                failed.update(bad)
            write_table(described(found, provider).coalesce(1), path)
            done.append(name)
        except Exception as e:  # one bad table must not end the build
            failed[name] = str(e).splitlines()[0][:300]
    meta = {"db": db, "version": VERSION, "settings": dict(settings or {}), "profiled": done, "skipped": skipped, "failed": failed, "status": "in_progress" if failed else "completed"}
    if tables:
        spark = next(iter(tables.values())).sparkSession
        made = os.path.join(root, "_meta.part")
        spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(made)
        replace_path(spark, made, os.path.join(root, "_meta"))
    return meta


def read(spark: SparkSession, out_dir: str, db: str, settings: Mapping[str, str] | None = None) -> tuple[DataFrame, dict]:
    """The catalog that ``build`` wrote, all tables as one, and the meta of its last run; what was never built is an error."""
    root = _root(out_dir, db, settings)
    meta = json.loads(spark.read.text(os.path.join(root, "_meta")).first()[0])
    names = [*meta["profiled"], *meta["skipped"]]
    if not names:
        raise ValueError(f"no table of {db} is profiled")
    return spark.read.parquet(*[os.path.join(root, n) for n in names]), meta
