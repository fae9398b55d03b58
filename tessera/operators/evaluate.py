"""Execute, vote and compare: results as multisets, candidates by majority, accuracy against gold queries."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.dialect import Dialect
from tessera.dialect.parse import SqlError

FAILED = "ERROR"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _positional(df: DataFrame, numbers_as_double: bool) -> DataFrame:
    cols = []
    for i, (c, t) in enumerate(df.toDF(*[f"c{i}" for i in range(len(df.columns))]).dtypes):
        x = F.col(c)
        if numbers_as_double and (t in NUMERIC or t.startswith("decimal") or t == "boolean"):
            x = x.cast("double")
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)  # no negative zero
        cols.append(x.alias(f"_{i}"))
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*cols)


def row_counts(df: DataFrame, numbers_as_double: bool = True) -> DataFrame:
    """(row, n): rows as JSON by position, names ignored, and how often each occurs.

    With numbers as doubles 1 and 1.0 agree (accuracy); without, the type tells them apart (votes).
    """
    p = _positional(df, numbers_as_double)
    types = "" if numbers_as_double else ",".join(t for _, t in p.dtypes) + "|"
    row = F.concat(F.lit(f"{len(p.columns)}|{types}"), F.to_json(F.struct(*p.columns), {"ignoreNullFields": "false"}))
    return p.groupBy(row.alias("row")).agg(F.count("*").alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, n_a, n_b) of the rows whose counts differ; empty when both hold the same rows equally often, in any order."""
    x, y = row_counts(a).withColumnRenamed("n", "n_a"), row_counts(b).withColumnRenamed("n", "n_b")
    j = x.join(y, "row", "full")
    return j.select("row", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a <> n_b")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether both results hold the same rows equally often; results with different numbers of columns differ unless both are empty."""
    return multiset_difference(a, b).isEmpty()


def result_key(df: DataFrame) -> str:
    """A fingerprint of the multiset of rows, taken on the executors: equal results have equal keys."""
    h = row_counts(df, numbers_as_double=False).select(F.xxhash64("row", "n").cast("decimal(38,0)").alias("h"), F.xxhash64("n", "row").cast("decimal(38,0)").alias("g"))
    r = h.agg(F.count("*").alias("k"), F.coalesce(F.sum("h"), F.lit(0)).alias("a"), F.coalesce(F.sum("g"), F.lit(0)).alias("b")).first()
    return f"{r['k']}:{r['a']}:{r['b']}"


def result_keys(df: DataFrame) -> tuple[str, str]:
    """Two fingerprints of the multiset of rows from one execution: for votes (types tell) and for accuracy (1 and 1.0 agree).

    Sums of two 64-bit hashes over the rows and their number do not depend on the order of rows and need no grouping.
    Results without rows agree whatever their columns.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    types = ",".join(t for _, t in plain.dtypes)
    as_json = lambda cols, head: F.concat(F.lit(f"{len(names)}|{head}"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    number = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)
    doubles = [number(F.col(c).cast("double")) if t in NUMERIC or t.startswith("decimal") or t == "boolean" else F.col(c) for c, t in plain.dtypes]
    rows = plain.select(as_json([F.col(c).alias(f"_{i}") for i, c in enumerate(names)], types + "|").alias("s"), as_json([x.alias(f"_{i}") for i, x in enumerate(doubles)], "").alias("l"))
    total = lambda *x: F.coalesce(F.sum(F.xxhash64(*x).cast("decimal(38,0)")), F.lit(0))
    r = rows.agg(F.count("*").alias("k"), total("s").alias("a"), total(F.lit(1), "s").alias("b"), total("l").alias("c"), total(F.lit(1), "l").alias("d")).first()
    return f"{r['k']}:{r['a']}:{r['b']}", f"{r['k']}:{r['c']}:{r['d']}"


def vote(candidates: DataFrame, case: Sequence[str]) -> DataFrame:
    """The winner of each case: most valid candidates with one result; first seen wins ties; within it the shortest query.

    ``candidates``: the case columns, idx, sql, valid, key (fingerprint of the result).  A case without valid candidates
    gets its last one.  Two partial aggregations: a hot case is combined before the shuffle, and no case is collected.
    """
    case = list(case)
    size = F.length(F.coalesce("sql", F.lit("")))
    voice = F.col("valid") & F.col("key").isNotNull()
    groups = candidates.where(voice).groupBy(*case, "key").agg(
        F.count("*").alias("votes"), F.min("idx").alias("first_idx"), F.min(F.struct(size.alias("s"), "idx", "sql")).alias("best")
    )
    won = groups.groupBy(*case).agg(F.max(F.struct("votes", (-F.col("first_idx")).alias("f"), "best")).alias("w"))
    failed = candidates.groupBy(*case).agg(F.max(F.struct("idx", "sql")).alias("last"), F.count("*").alias("candidates"))
    return failed.join(won, case, "left").select(
        *case, F.coalesce("w.best.idx", "last.idx").alias("idx"), F.when(F.col("w").isNotNull(), F.col("w.best.sql")).otherwise(F.col("last.sql")).alias("sql"),
        F.coalesce("w.votes", F.lit(0)).alias("votes"), "candidates",
    )


def outcome(predicted: Column, error: Column) -> Column:
    """generation_error, execution_error or executable."""
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(predicted.eqNullSafe(FAILED), "generation_error").when(failed, "execution_error").otherwise("executable")


def percent(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a * 100.0 / b)


def summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, executable rate and error counts of result rows, in one aggregation; no rows give no groups (or zeros without groups)."""
    kind = outcome(F.col("predicted_sql"), F.col("error_msg"))
    error = F.coalesce("error_msg", F.lit("")) != ""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    g = results.groupBy(*by).agg(
        F.count("*").alias("total"), one(F.coalesce("is_correct", F.lit(False))).alias("correct"), one(kind == "executable").alias("executable_count"),
        one(error).alias("error_count"), one(kind == "generation_error").alias("generation_error_count"), one(kind == "execution_error").alias("execution_error_count"),
    )
    return g.select(*by, "total", "correct", F.round(percent(F.col("correct"), F.col("total")), 4).alias("accuracy"), "executable_count", F.round(percent(F.col("executable_count"), F.col("total")), 4).alias("execution_success_rate"), "error_count", "generation_error_count", "execution_error_count")


@dataclass
class Attempt:
    sql: str
    error: str = ""
    frame: DataFrame | None = None
    key: str | None = None
    rows: str | None = None  # fingerprint with numbers as doubles

    @property
    def valid(self) -> bool:
        return self.sql != FAILED and not self.error and self.frame is not None


@dataclass
class Case:
    question_id: str | None
    db_id: str
    question: str
    gold_sql: str
    candidates: list[str] = field(default_factory=list)


class Evaluator:
    """Runs candidate queries of a case on its database, lets them vote and compares the winner with the gold query.

    Every query runs once: vote and comparison rest on fingerprints of that run, so that an unordered LIMIT is scored by the
    rows that were voted on.  Only queries run (the dialect refuses all else); ``seconds`` bounds each by cancelling its job group.
    """

    def __init__(self, databases: dict[str, Dialect], seconds: float | None = None):
        self.databases, self.seconds = databases, seconds

    def run(self, db_id: str, sql: str) -> Attempt:
        if sql == FAILED:
            return Attempt(sql, "no query was generated")
        db = self.databases.get(db_id)
        if db is None:
            return Attempt(sql, f"no such database: {db_id}")
        sc, tag = db.spark.sparkContext, f"eval-{time.monotonic_ns()}"
        timer = None
        try:
            if self.seconds:
                import threading

                sc.addJobTag(tag)
                timer = threading.Timer(self.seconds, lambda: sc.cancelJobsWithTag(tag))
                timer.start()
            frame = db.sql(sql)
            return Attempt(sql, "", frame, *result_keys(frame))
        except SqlError as e:
            return Attempt(sql, str(e))
        except Exception as e:
            return Attempt(sql, str(e).splitlines()[0][:500])
        finally:
            if timer:
                timer.cancel()
                sc.removeJobTag(tag)

    def evaluate(self, case: Case, index: int = 0, repair=None) -> dict:
        """The result row of a case; ``repair(case, sql, error)`` may give a second query for one that fails."""
        tried = []
        for sql in case.candidates:
            a = self.run(case.db_id, sql)
            if a.error and repair is not None and sql != FAILED:
                b = self.run(case.db_id, repair(case, sql, a.error))
                a = b if b.valid else a
            tried.append(a)
        valid = [a for a in tried if a.valid]
        if valid:
            votes: dict[str, list[Attempt]] = {}
            for a in valid:
                votes.setdefault(a.key or "", []).append(a)
            chosen = min(max(votes.values(), key=len), key=lambda a: len(a.sql))
        else:
            chosen = tried[-1] if tried else Attempt(FAILED, "no candidates")
        error, correct = chosen.error, False
        if chosen.valid:
            gold = self.run(case.db_id, case.gold_sql)
            if gold.valid:
                correct = gold.rows == chosen.rows
            else:
                error = gold.error
        return {"order_index": index, "question_id": case.question_id, "db_id": case.db_id, "question": case.question, "gold_sql": case.gold_sql, "predicted_sql": chosen.sql, "is_correct": correct, "error_msg": error}
