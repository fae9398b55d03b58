"""Queries over the append-only history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which modes are reported; others follow by name.
MODES = ("baseline", "official", "enhanced", "fused")
LATEX = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))


def moment() -> Column:
    """When a run ended, else started; unreadable and missing times come first of all."""
    end = F.when(F.coalesce("ended_at", F.lit("")) != "", F.col("ended_at")).otherwise(F.col("started_at"))
    return F.coalesce(F.try_to_timestamp(end), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def recent(history: DataFrame, n: int = 12) -> DataFrame:
    """The last n runs by (ended_at, run_tag), newest first."""
    return history.orderBy(F.desc(F.coalesce("ended_at", F.lit(""))), F.desc(F.coalesce("run_tag", F.lit("")))).limit(n)


def best_per_mode(history: DataFrame) -> DataFrame:
    """The run of highest accuracy of each mode; the earliest by (ended_at, run_tag) of equals."""
    key = F.struct(F.coalesce("accuracy", F.lit(0.0)).alias("a"))
    w = Window.partitionBy(F.coalesce("mode", F.lit("unknown"))).orderBy(F.desc(key), F.coalesce("ended_at", F.lit("")), F.coalesce("run_tag", F.lit("")))
    return history.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def latest_per_mode(history: DataFrame, dataset: str | None = None, total: int | None = None, candidates: int | None = None) -> DataFrame:
    """The latest run of each (mode, hints) among those that fit the filters, in report order (position)."""
    h = history
    if dataset is not None:
        h = h.where(F.col("dataset_path").contains(dataset))
    if total is not None:
        h = h.where(F.col("total") == total)
    if candidates is not None:
        h = h.where(F.col("candidate_count") == candidates)
    mode, hints = F.coalesce("mode", F.lit("unknown")), F.coalesce("include_dataset_evidence", F.lit(False))
    w = Window.partitionBy(mode, hints).orderBy(F.desc(moment()), F.coalesce("run_tag", F.lit("")))
    one = h.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    known = F.array_position(F.array(*map(F.lit, MODES)), mode)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.when(known > 0, known).otherwise(99), mode, hints))  # a row a mode
    return one.withColumn("position", order)


def comparison(history: DataFrame) -> DataFrame:
    """Best accuracy of each (mode, hints), and which of all is best; of equals the first in order wins."""
    mode, hints = F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("include_dataset_evidence", F.lit(False)).cast("int").alias("hints")
    g = history.groupBy(mode, hints).agg(F.count("*").alias("runs"), F.max(F.coalesce("accuracy", F.lit(0.0))).alias("best_accuracy"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("best_accuracy"), "mode", "hints")  # a row a mode
    return g.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))


def late_rows(results: DataFrame, history: DataFrame) -> DataFrame:
    """Result rows that were written after their run had ended; a run without an end has no late rows."""
    ends = history.where("run_tag is not null").select("run_tag", F.try_to_timestamp("ended_at").alias("ended")).where("ended is not null")
    return results.join(ends, "run_tag").where(F.col("written_at") > F.col("ended")).select("result_id", "run_tag")


def latex_escape(text: str) -> str:
    out = []
    table = dict(LATEX)
    for ch in text:
        out.append(table.get(ch, ch))
    return "".join(out)


def latex_table(rows: list[dict]) -> str:
    """A LaTeX table of runs: mode, hints, accuracy, executable rate, counts; percentages with two decimals."""
    lines = [r"\begin{tabular}{llrrr}", r"\hline", r"mode & hints & accuracy & executable & correct/total \\", r"\hline"]
    for r in rows:
        hints = "hints" if r.get("include_dataset_evidence") else "no hints"
        lines.append(f"{latex_escape(str(r.get('mode') or 'unknown'))} & {hints} & {float(r.get('accuracy') or 0):.2f} & {float(r.get('execution_success_rate') or 0):.2f} & {int(r.get('correct') or 0)}/{int(r.get('total') or 0)} " + r"\\")
    return "\n".join([*lines, r"\hline", r"\end{tabular}", ""])


def latex_plot(rows: list[dict]) -> str:
    """A bar plot of accuracy and executable rate per run."""
    names = [latex_escape(f"{r.get('mode') or 'unknown'}-{'hints' if r.get('include_dataset_evidence') else 'no-hints'}") for r in rows]
    bars = [" ".join(f"({n},{float(r.get(k) or 0):.2f})" for n, r in zip(names, rows)) for k in ("accuracy", "execution_success_rate")]
    return "\n".join([
        r"\begin{tikzpicture}", r"\begin{axis}[ybar, ymin=0, ymax=100, symbolic x coords={" + ",".join(names) + "}, xtick=data]",
        *[r"\addplot coordinates {" + b + "};" for b in bars], r"\legend{accuracy, executable}", r"\end{axis}", r"\end{tikzpicture}", "",
    ])
