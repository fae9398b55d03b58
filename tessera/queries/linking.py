"""Queries of the literal index, vector search, keyword context and text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.functions.provider import StubProvider
from tessera.operators import literal, retrieve
from tessera.plans.cluster import cut, table

INDEXED = ("region", "nation", "customer", "supplier", "part", "orders", "db_list", "subject_list", "mix_targets")

#: A catalog of the question corpus: table, column, and what is known of them.
CATALOG = [
    ("dev_tied_append", "record_id", "number of the record"), ("dev_tied_append", "question", "question in words about a share, a count or a list"), ("dev_tied_append", "evidence", "hint on columns and values"),
    ("dev_tied_append", "difficulty", "simple, moderate or challenging"), ("eval_results", "predicted_sql", "answer of a run"), ("eval_results", "is_correct", "whether results agree"), ("eval_results", "error_msg", "message of the engine"),
    ("vector_index", "embeddings", "numbers of a column vector"), ("documents", "contributor", "who wrote the text"), ("documents", "source", "where threads and walkthroughs come from"), ("documents", "added_at", "when a text was added later"),
    ("run_history", "mode", "mode of a run"), ("run_history", "accuracy", "percentage of correct answers"), ("run_history", "total", "questions recorded in a run"), ("db_list", "fact_table", "loans, pupils, printings, heroes, entries and fixtures"), ("db_list", "dim_table", "branch, campus, expansion and squad"),
]
TABLE_NOTES = [("dev_tied_append", "questions with hints"), ("eval_results", "answers held against records"), ("vector_index", "vectors of columns"), ("documents", "texts of threads"), ("run_history", "summaries of runs"), ("db_list", "databases by name")]


def _index(spark: SparkSession, d: str, per_column: int | None = literal.PER_COLUMN) -> DataFrame:
    return literal.literal_index({t: table(spark, d, t) for t in INDEXED}, per_column)


def literal_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("value", F.array_join("columns", ",").alias("columns"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dev_tied_append").select(F.col("record_id").alias("id"), "question", "evidence")


def literal_link(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose values a question names, of all their distinct values."""
    return literal.literal_links(_questions(spark, d), cut(_index(spark, d, None)))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five most similar rows, above the threshold, of every row whose id is divisible by 50."""
    v = _vectors(spark, d)
    return retrieve.cosine_topk(v.where("id % 50 = 0"), v).select("query", "rank", "id", F.round("score", 6).alias("score"))


def column_documents(spark: SparkSession, d: str) -> DataFrame:
    cols = spark.createDataFrame([("corpus", *c) for c in CATALOG], "db string, tbl string, col string, description string")
    none = F.lit(None).cast("string")
    return retrieve.column_texts(cols.select("*", none.alias("short_description"), none.alias("long_description"), none.alias("literal_hints"), none.alias("format_hint")))


def hybrid_link(spark: SparkSession, d: str) -> DataFrame:
    """Columns linked by literals, together with those linked by the offline stub's vectors, of every question."""
    docs = cut(retrieve.embed(column_documents(spark, d), StubProvider()).withColumn("id", F.xxhash64("key")))
    asked = retrieve.embed(_questions(spark, d).select(F.col("id").cast("string").alias("key"), F.col("question").alias("text")), StubProvider())
    asked = cut(asked.select(F.col("key").cast("long").alias("id"), F.col("embedding").alias("v")))
    near = retrieve.cosine_topk(asked, docs.select("id", F.col("embedding").alias("v")), least=None)
    linked = near.join(docs.select("id", "key"), "id").select(F.col("query").alias("id"), retrieve.short_key(F.col("key")).alias("column"))
    return literal.union_links(literal_link(spark, d), linked)


def question_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", F.array_join(F.array_sort(retrieve.keywords(F.col("question"), F.col("evidence"))), " ").alias("words"))


def _catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    cols = spark.createDataFrame(CATALOG, "tbl string, col string, description string").withColumn("hay", F.concat_ws(" ", "tbl", "col", "description"))
    tabs = spark.createDataFrame(TABLE_NOTES, "tbl string, table_summary string").withColumn("hay", F.concat_ws(" ", "tbl", "table_summary"))
    return cols, tabs


def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.keyword_context(_questions(spark, d), *_catalog(spark))


def context_text(spark: SparkSession, d: str) -> DataFrame:
    cols, tabs = _catalog(spark)
    found = retrieve.keyword_context(_questions(spark, d), cols, tabs)
    blank = F.lit("")
    return retrieve.render_context(found, cols.select("*", blank.alias("format_hint"), blank.alias("literal_hints")), tabs.select("*", blank.alias("join_hints")))


def extract_sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_results").select("result_id", texts.extract_sql(F.col("predicted_sql")).alias("query"))


def referenced_tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_results").select("result_id", F.array_join(texts.referenced_tables(F.col("predicted_sql")), ",").alias("tables"))


def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object of each event's text, found as in a model's answer."""
    return table(spark, d, "events").select("event_id", texts.json_object_udf(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("found"))


QUERIES = {f.__name__: f for f in (literal_index, literal_link, cosine_topk, column_documents, hybrid_link, question_keywords, keyword_context, context_text, extract_sql, referenced_tables, json_answers)}

#: The text columns of the indexed tables.
_TEXTS = {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority", "db_list": "db_id fact_table dim_table", "subject_list": "subject description", "mix_targets": "source"}
_IDX = "WITH l AS (" + " UNION ".join(f"SELECT '{t}.{c}' c, trim({c}) v FROM {t} WHERE trim({c}) <> ''" for t, cs in _TEXTS.items() for c in cs.split()) + "), i AS (SELECT v, list_sort(list(DISTINCT c)) cs FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY c ORDER BY v) <= 1000) GROUP BY v)"
_STOP = ", ".join(f"'{w}'" for w in retrieve.STOPWORDS)
_WORDS = f"""WITH q AS (SELECT record_id id, unnest(list_distinct(regexp_extract_all(lower(coalesce(question, '') || ' ' || coalesce(evidence, '')), '[a-z][a-z0-9_]+'))) token FROM dev_tied_append),
t AS (SELECT * FROM q WHERE length(token) >= 3 AND token NOT IN ({_STOP}))"""


def _rows(rows: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(VALUES {quoted}) x({names})"


_CONTEXT = _WORDS + f""", c AS (SELECT tbl, col, lower(concat_ws(' ', tbl, col, d)) h FROM {_rows(CATALOG, 'tbl, col, d')}), b AS (SELECT tbl, lower(concat_ws(' ', tbl, d)) h FROM {_rows(TABLE_NOTES, 'tbl, d')}),
u AS MATERIALIZED (SELECT DISTINCT token FROM t), cs AS (SELECT id, tbl, col, count(*) col_score FROM t JOIN (SELECT token, tbl, col FROM u JOIN c ON contains(h, token)) USING (token) GROUP BY ALL),
bs AS (SELECT id, tbl, count(*) own FROM t JOIN (SELECT token, tbl FROM u JOIN b ON contains(h, token)) USING (token) GROUP BY ALL),
s AS (SELECT id, tbl, coalesce(own, 0) + coalesce(best, 0) table_score FROM bs FULL JOIN (SELECT id, tbl, max(col_score) best FROM cs GROUP BY ALL) USING (id, tbl)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY table_score DESC, tbl) AS INT) table_rank FROM s QUALIFY table_rank <= 4),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id, tbl ORDER BY col_score DESC, col) AS INT) col_rank FROM cs QUALIFY col_rank <= 4)
SELECT id, tbl, table_rank, table_score, col, col_rank, col_score FROM r LEFT JOIN k USING (id, tbl)"""

SQL = {
    "json_answers": "SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN CAST(json(props) AS VARCHAR) END AS found FROM events",
    "literal_index": _IDX + " SELECT v AS value, array_to_string(cs, ',') AS columns FROM i",
    "literal_link": _IDX + " SELECT DISTINCT record_id id, unnest(cs) AS \"column\" FROM dev_tied_append JOIN i ON length(v) > 3 AND contains(lower(question), lower(v))",
    "cosine_topk": "SELECT * FROM (SELECT q.vec_id query, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS INT) rank, r.vec_id id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0) WHERE rank <= 5 AND score > 0.35",
    "column_documents": f"SELECT 'corpus.' || tbl || '.' || col AS key, 'table: ' || tbl || '; column: ' || col || '; meaning: ' || d AS text FROM {_rows(CATALOG, 'tbl, col, d')}",
    "question_keywords": _WORDS + " SELECT record_id id, coalesce(w, '') words FROM dev_tied_append LEFT JOIN (SELECT id, string_agg(token, ' ' ORDER BY token) w FROM t GROUP BY id) ON id = record_id",
    "keyword_context": _CONTEXT,
    "extract_sql": r"""SELECT result_id, CASE WHEN predicted_sql IS NULL THEN NULL WHEN len(m) > 0 THEN regexp_replace(m[-1], '^\s+|\s+$', '', 'g') WHEN len(f) > 0 THEN regexp_replace(f[-1], '^\s+|\s+$', '', 'g') ELSE replace(regexp_replace(predicted_sql, '^\s+|\s+$', '', 'g'), chr(10), ' ') END AS query
FROM (SELECT *, regexp_extract_all(predicted_sql, '(?is)```sql\n(.*?)\n```', 1) m, regexp_extract_all(predicted_sql, '(?is)```(.*?)```', 1) f FROM eval_results)""",
    "referenced_tables": """SELECT result_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS tables FROM (SELECT *, CASE WHEN predicted_sql IS NULL OR predicted_sql IN ('', 'ERROR') THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(predicted_sql, '(?i)\\b(?:from|join|update|into)\\s+[`\"]?([A-Za-z_][A-Za-z0-9_]*)[`\"]?', 1) END n FROM eval_results)""",
}
