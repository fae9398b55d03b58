"""Retrieval of columns for a question: dense vectors with cosine similarity, and keywords against a catalog."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.provider import Provider
from tessera.plans.cluster import cut

TOP_K, LEAST_SCORE, EMBED_BATCH, QUERY_BLOCK = 5, 0.35, 8, 4096
MAX_TABLES, MAX_COLUMNS, LEAST_TOKEN = 4, 4, 3

#: Question words that tell nothing about columns.
STOPWORDS = tuple(
    "the and for with from that this what which who whom whose when where into than then have has had been were was are is does did how "
    "much many more most least all not out list show give tell find year years month months between against among each per total average".split()
)
#: Fixed value: what a search word looks like, in lower case.
SEARCH_WORD = "[a-z][a-z0-9_]+"


# -- dense
def column_texts(columns: DataFrame) -> DataFrame:
    """(key, text): what is embedded of each column; its description falls back to the short, then the long one."""
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    desc = F.coalesce(some("description"), some("short_description"), some("long_description"), F.lit(""))
    parts = [F.concat(F.lit("table: "), "tbl"), F.concat(F.lit("column: "), "col"), F.concat(F.lit("meaning: "), desc)]
    parts += [F.concat(F.lit(f"{n}: "), some(c)) for n, c in (("details", "long_description"), ("values", "literal_hints"), ("format", "format_hint"))]
    return columns.select(F.concat_ws(".", "db", "tbl", "col").alias("key"), F.concat_ws("; ", *parts).alias("text"))


def embed(texts: DataFrame, provider: Provider, key: str = "key", text: str = "text") -> DataFrame:
    """(key, embedding array<float>) by a provider, in batches of ``EMBED_BATCH``; a failing batch ends the job after its retries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[lo : lo + EMBED_BATCH]
                yield pd.DataFrame({"key": part["key"], "embedding": [np.asarray(v, np.float32).tolist() for v in provider.embed(part["text"].tolist())]})

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, embedding array<float>")


def _block_topk(held, k: int):
    """The k best rows of a task for each broadcast query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, qn = held.value
        best: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["v"]]]
            if not len(pdf):
                continue
            x, xid = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy()
            s = (q @ x.T) / (qn[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-10)
            take = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take][:, None]
            r, c = np.nonzero(s >= kth)
            new = pd.DataFrame({"query": qid[r], "id": xid[c], "score": s[r, c]})
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
        if best is not None:
            yield best

    return run


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int = TOP_K, least: float | None = LEAST_SCORE, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, rank, id, score): the k rows most similar to each query, exactly; ties go to the smaller id.

    ``queries`` and ``rows`` have (id, v).  The queries are a stated set: they are taken in blocks of about ``block`` rows,
    each broadcast, by length of vector, while all rows stream past; every task keeps its own k best per query, so little is shuffled.  Null vectors
    score nothing, others only against those of their length; zero vectors score zero.
    """
    spark = rows.sparkSession
    schema = "query long, id long, score double"
    some = queries.where("v is not null").select("id", "v")
    parts = max(1, -(-some.count() // block))
    out = spark.createDataFrame([], schema)
    for i in range(parts):
        # about ``block`` queries; never all of them at once on the driver
        asked = some.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").collect()
        for width in sorted({len(r["v"]) for r in asked}):
            same = [r for r in asked if len(r["v"]) == width]
            m = np.array([r["v"] for r in same], np.float64)
            held = spark.sparkContext.broadcast((np.array([r["id"] for r in same]), m, np.linalg.norm(m, axis=1)))
            near = rows.where("v is not null").select("id", "v").mapInPandas(_block_topk(held, k), schema)
            if parts > 1:
                near = cut(near)
                held.destroy()
            out = out.union(near)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.where(F.col("score") > least).select("query", "rank", "id", "score") if least is not None else ranked.select("query", "rank", "id", "score")


def short_key(key: Column) -> Column:
    """``table.column`` of a ``db.table.column`` key; null where it has fewer than two parts."""
    p = F.split(key, r"\.")
    return F.when(F.size(p) >= 2, F.concat_ws(".", F.element_at(p, -2), F.element_at(p, -1)))


# -- keywords
def keywords(*texts: Column) -> Column:
    """Distinct search words: Latin words of at least three characters that are no stopword."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    words = F.regexp_extract_all(text, F.lit(SEARCH_WORD), F.lit(0))
    return F.array_except(F.filter(F.array_distinct(words), lambda w: F.length(w) >= LEAST_TOKEN), F.array(*map(F.lit, STOPWORDS)))


def _scores(tokens: DataFrame, hay: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per question and catalog entry the number of its tokens that occur in the entry's text.

    Distinct tokens meet the entries by three-character pieces, are verified, and only then spread to the questions.
    """
    entry = hay.select(*keys, F.lower("hay").alias("h"))
    piece = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("h") - 2, F.lit(1))), lambda i: F.substring("h", i, F.lit(3)))))
    t = tokens.select("token").distinct().withColumn("g", F.substring("token", 1, 3))
    hit = t.join(entry.select("*", piece.alias("g")), "g").where(F.contains("h", "token")).select("token", *keys)
    return tokens.join(hit, "token").groupBy("id", *keys).agg(F.count("*").alias(name))


def keyword_context(questions: DataFrame, columns: DataFrame, tables: DataFrame, max_tables: int = MAX_TABLES, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """(id, tbl, table_rank, table_score, col, col_rank, col_score): the tables and columns that answer to a question's words.

    ``questions``: id, question, evidence; ``columns``: tbl, col, hay; ``tables``: tbl, hay (a catalog of bounded size).  A
    table scores its own hits and its best column's; ties go by name.  Questions without words get nothing; a table found
    by its name alone has col null.
    """
    token = questions.select("id", F.explode(keywords(F.col("question"), F.col("evidence"))).alias("token"))
    col = _scores(token, columns, ["tbl", "col"], "col_score")
    best = col.groupBy("id", "tbl").agg(F.max("col_score").alias("best"))
    own = _scores(token, tables, ["tbl"], "own")
    tab = own.join(best, ["id", "tbl"], "full").select("id", "tbl", (F.coalesce("own", F.lit(0)) + F.coalesce("best", F.lit(0))).alias("table_score"))
    tab = tab.withColumn("table_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("table_score"), "tbl"))).where(F.col("table_rank") <= max_tables)
    col = col.withColumn("col_rank", F.row_number().over(Window.partitionBy("id", "tbl").orderBy(F.desc("col_score"), "col"))).where(F.col("col_rank") <= max_columns)
    return tab.join(col, ["id", "tbl"], "left").select("id", "tbl", "table_rank", "table_score", "col", "col_rank", "col_score")


def render_context(context: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, context): one text per question: a line per table with its summary and join hints, a line per column with its notes."""
    c = context.join(columns.select("tbl", "col", "description", "format_hint", "literal_hints"), ["tbl", "col"], "left")
    note = lambda name, col: F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(name), col))
    line = F.when(F.col("col").isNotNull(), F.concat_ws("; ", F.concat(F.lit("- "), "col"), note("", "description"), note("format: ", "format_hint"), note("values: ", "literal_hints")))
    per = c.groupBy("id", "tbl", "table_rank").agg(F.array_sort(F.collect_list(F.struct("col_rank", line.alias("line")))).alias("ls"))
    head = tables.select("tbl", F.concat_ws(": ", "tbl", "table_summary").alias("head"), F.when(F.col("join_hints") != "", F.concat(F.lit("joins: "), "join_hints")).alias("hints"))
    text = per.join(head, "tbl", "left").select("id", "table_rank", F.concat_ws("\n", F.coalesce("head", "tbl"), "hints", F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))
    return text.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
