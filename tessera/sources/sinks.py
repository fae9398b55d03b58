"""Sinks: atomic JSON, appended JSON lines, vectors, result naming."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

STRATEGIES = ("timestamp", "increment", "overwrite")


def write_json(path: str, value: Any) -> None:
    """Writes beside the target and renames, so that readers see the old or the new file."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.tmp", path)


def append_json_line(path: str, value: Any) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False) + "\n")


def replace_path(spark: SparkSession, made: str, path: str) -> None:
    """Puts ``made`` in the place of ``path`` by renames of the file system that holds them, shared storage included."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, at, old = hadoop(made), hadoop(path), hadoop(f"{path}.old")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.delete(old, True)
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"cannot rename {made} to {path}")
    fs.delete(old, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet written beside the target and renamed, so that readers see the old or the new table."""
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    replace_path(df.sparkSession, f"{path}.tmp", path)


def write_vectors(df: DataFrame, path: str, key: str = "key", embedding: str = "embedding") -> None:
    """A vector index as Parquet: key and array<float>."""
    write_table(df.selectExpr(f"`{key}` AS key", f"CAST(`{embedding}` AS array<float>) AS embedding"), path)


def namespace(root: str, name: str | None = None, variable: str = "TESSERA_NAMESPACE") -> str:
    """The folder of a knowledge base below ``root``: by name, else by the environment variable, else the default one."""
    return os.path.join(root, slug(name or os.environ.get(variable, "") or "default"))


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_") or "run"


def result_path(base: str, strategy: str = "timestamp", tag: str | None = None, now: dt.datetime | None = None) -> str:
    """Where a run's results go: with the time, with the next free number, or over the last ones."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    stem, ext = os.path.splitext(base)
    if tag:
        stem = f"{stem}_{slug(tag)}"
    if strategy == "overwrite":
        return stem + ext
    if strategy == "timestamp":
        timed = f"{stem}_{(now or dt.datetime.now()):%Y%m%d_%H%M%S}"
        if not os.path.exists(timed + ext):
            return timed + ext
        stem = timed  # a run of the same second has it
    n = 1
    while os.path.exists(f"{stem}_{n:03d}{ext}"):
        n += 1
    return f"{stem}_{n:03d}{ext}"


def summary_path(result: str) -> str:
    stem, _ = os.path.splitext(result)
    return f"{stem}.summary.json"


def run_path(root: str, mode: str, dataset: str, hints: bool, limit: int | None, candidates: int, strategy: str = "timestamp", now: dt.datetime | None = None) -> str:
    """A result file below ``root`` whose name tells the settings of the run."""
    stem = os.path.splitext(os.path.basename(dataset))[0]
    name = "_".join(["results", slug(mode), slug(stem or "cases"), "hints" if hints else "nohints", f"n{int(limit)}" if limit else "full", f"c{max(1, int(candidates))}"])
    return result_path(os.path.join(root, f"{name}.json"), strategy, None, now)


def keep_summary(root: str, summary: dict) -> None:
    """Appends a run's summary to the history of ``root`` and makes it the latest one, of all and of its mode."""
    append_json_line(os.path.join(root, "history.jsonl"), summary)
    write_json(os.path.join(root, "latest.json"), summary)
    write_json(os.path.join(root, f"latest_{slug(str(summary.get('mode') or 'unknown'))}.json"), summary)
