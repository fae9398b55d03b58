"""Queries of voting, comparing, knowledge lookup, metrics and run history, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, history, knowledge
from tessera.plans.cluster import table
from tessera.queries.relational import database


def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Statuses and priorities of two halves of the orders, as multisets of rows: where their counts differ."""
    o = table(spark, d, "orders")
    cols = ["o_orderstatus", "o_orderpriority"]
    diff = evaluate.multiset_difference(o.where("o_orderkey % 2 = 0").select(*cols), o.where("o_orderkey % 2 = 1").select(*cols))
    return diff.select("n_a", "n_b")


def vote(spark: SparkSession, d: str) -> DataFrame:
    """The winner among all answers to each question, equal queries standing for equal results."""
    r = table(spark, d, "eval_results")
    valid = (F.coalesce("error_msg", F.lit("")) == "") & F.col("predicted_sql").isNotNull() & ~F.col("predicted_sql").eqNullSafe("ERROR")
    c = r.select("question_id", F.col("result_id").alias("idx"), F.col("predicted_sql").alias("sql"), valid.alias("valid"), F.md5("predicted_sql").alias("key"))
    return evaluate.vote(c, ["question_id"]).select("question_id", "idx", "votes", "candidates")


#: Candidate queries of made-up cases on the star schema, in the dialect.
VOTES = {
    0: ("SELECT COUNT(*) FROM nation", "SELECT COUNT(*) FROM region", "SELECT COUNT(n_nationkey) FROM nation"),
    1: ("SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    2: ("SELECT nope FROM nation", "SELECT SUM(p_size) FROM part", "ERROR"),
    3: ("SELECT nope FROM nation", "ERROR"),
    4: ("SELECT MAX(o_totalprice) FROM orders", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1", "SELECT MIN(o_totalprice) FROM orders"),
}


def vote_results(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each made-up case are run, and vote by the fingerprints of their results."""
    judge = evaluate.Evaluator({"star": database(spark, d)})
    tried = [(case, i, a.sql, a.valid, a.key) for case, sqls in VOTES.items() for i, a in enumerate(judge.run("star", s) for s in sqls)]
    return evaluate.vote(spark.createDataFrame(tried, "case_id int, idx long, sql string, valid boolean, key string"), ["case_id"]).select("case_id", "idx", "votes", "candidates")


#: Pairs of a gold query and an answer on the star schema.
PAIRS = [
    ("SELECT COUNT(*) FROM orders", "SELECT COUNT(o_orderkey) FROM orders"),
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name AS other FROM nation"),
    ("SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation"),
    ("SELECT 1", "SELECT 1.0"),
    ("SELECT r_regionkey, r_name FROM region", "SELECT r_name, r_regionkey FROM region"),
    ("SELECT COUNT(*) FROM part WHERE p_size > 10", "SELECT COUNT(*) FROM part WHERE p_sise > 10"),
]


def exec_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer gives the rows of its gold query, equally often and in any order."""
    run = evaluate.Evaluator({"star": database(spark, d)})
    rows = [run.evaluate(evaluate.Case(str(i), "star", "", gold, [said]), i) for i, (gold, said) in enumerate(PAIRS)]
    return spark.createDataFrame([(r["order_index"], int(r["is_correct"]), int(bool(r["error_msg"]))) for r in rows], "order_index int, is_correct int, failed int")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(table(spark, d, "eval_results"), ["run_tag"])


def total_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(table(spark, d, "eval_results"))


def result_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "eval_results")
    return r.groupBy("db_id", evaluate.outcome(F.col("predicted_sql"), F.col("error_msg")).alias("outcome")).agg(F.count("*").alias("n"))


def ordered_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_results").select("run_tag", "order_index", "result_id").orderBy("run_tag", "order_index", "result_id")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "dev_tied_append").select(F.col("record_id").alias("ord"), "question_id", "db_id", "question", "evidence")
    return knowledge.resolve(table(spark, d, "eval_results").select(F.col("result_id").alias("id"), "question_id", "db_id", "question"), k)


def knowledge_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def knowledge_match_counts(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("match_type").agg(F.count("*").alias("n"))


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(table(spark, d, "run_history")).select("run_tag", "mode", "ended_at", F.round("accuracy", 2).alias("accuracy"), "correct", "total")


def history_best(spark: SparkSession, d: str) -> DataFrame:
    return history.best_per_mode(table(spark, d, "run_history")).select("mode", "run_tag", "accuracy", "ended_at")


def history_latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_per_mode(table(spark, d, "run_history"), candidates=1).select("mode", F.col("include_dataset_evidence").cast("int").alias("hints"), "run_tag", "accuracy", "position")


def history_comparison(spark: SparkSession, d: str) -> DataFrame:
    return history.comparison(table(spark, d, "run_history"))


def late_rows(spark: SparkSession, d: str) -> DataFrame:
    return history.late_rows(table(spark, d, "eval_results"), table(spark, d, "run_history"))


QUERIES = {f.__name__: f for f in (multiset_diff, vote, vote_results, exec_accuracy, run_summary, total_summary, result_outcomes, ordered_results, knowledge_lookup, knowledge_match_counts, history_recent, history_best, history_latest, history_comparison, late_rows)}

_FAIL = "coalesce(error_msg, '') <> ''"
_KIND = f"CASE WHEN predicted_sql = 'ERROR' THEN 'generation_error' WHEN {_FAIL} THEN 'execution_error' ELSE 'executable' END"
_SUM = f"""count(*) total, count_if(is_correct) correct, round(coalesce(count_if(is_correct) * 100.0::DOUBLE / count(*), 0), 4) accuracy, count_if(k = 'executable') executable_count,
round(coalesce(count_if(k = 'executable') * 100.0::DOUBLE / count(*), 0), 4) execution_success_rate, count_if({_FAIL}) error_count, count_if(k = 'generation_error') generation_error_count, count_if(k = 'execution_error') execution_error_count FROM (SELECT *, {_KIND} k FROM eval_results)"""
_LINE = r"trim(regexp_replace(coalesce(question, ''), '\s+', ' ', 'g'))"
_KNOW = f"""WITH k AS (SELECT record_id ord, question_id, db_id, {_LINE} q, trim(coalesce(evidence, '')) evidence FROM dev_tied_append),
i AS (SELECT question_id, arg_max(coalesce(db_id, ''), ord) id_db, arg_max(evidence, ord) id_ev FROM k WHERE question_id IS NOT NULL GROUP BY question_id),
t AS (SELECT db_id, q, arg_max(evidence, ord) t_ev FROM k WHERE db_id <> '' AND q <> '' GROUP BY ALL),
m AS (SELECT result_id id, CASE WHEN ok THEN id_ev ELSE t_ev END evidence, CASE WHEN ok THEN 'question_id' WHEN t_ev IS NOT NULL THEN 'db_id+question' END match_type FROM (SELECT c.result_id, id_ev, t_ev, id_ev IS NOT NULL AND (c.db_id IS NULL OR id_db = '' OR id_db = c.db_id) ok
  FROM (SELECT *, {_LINE} q FROM eval_results) c LEFT JOIN i ON i.question_id = c.question_id LEFT JOIN t ON t.db_id = c.db_id AND t.q = c.q))"""
_WHEN = "coalesce(TRY_CAST(coalesce(nullif(ended_at, ''), started_at) AS TIMESTAMP), TIMESTAMP '0001-01-01')"

SQL = {
    "multiset_diff": "SELECT coalesce(a, 0) n_a, coalesce(b, 0) n_b FROM (SELECT o_orderstatus s, o_orderpriority p, count(*) a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) FULL JOIN (SELECT o_orderstatus s, o_orderpriority p, count(*) b FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) USING (s, p) WHERE coalesce(a, 0) <> coalesce(b, 0)",
    "vote": """WITH c AS (SELECT question_id, result_id idx, predicted_sql s, coalesce(error_msg, '') = '' AND predicted_sql IS NOT NULL AND predicted_sql <> 'ERROR' ok FROM eval_results),
g AS (SELECT question_id, s, count(*) votes, min(idx) f FROM c WHERE ok GROUP BY ALL), w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, f) = 1)
SELECT question_id, coalesce(w.f, l) idx, coalesce(votes, 0) votes, n candidates FROM (SELECT question_id, max(idx) l, count(*) n FROM c GROUP BY ALL) LEFT JOIN w USING (question_id)""",
    "vote_results": """WITH n AS (SELECT count(*) n, count(n_nationkey) k FROM nation), r AS (SELECT count(*) n FROM region),
l AS (SELECT coalesce(list_sort(list(n_name) FILTER (n_regionkey = 1)), []) a, coalesce(list_sort(list(n_name) FILTER (n_regionkey = 2)), []) b FROM nation),
v AS (SELECT 0 c, 0 i, 1 + CAST(n.n = n.k AS INT) + CAST(n.n = r.n AS INT) v, 3 k FROM n, r UNION ALL SELECT 1, 0, 2 + CAST(a = b AS INT), 3 FROM l UNION ALL SELECT 2, 1, 1, 3 UNION ALL SELECT 3, 1, 0, 2
UNION ALL SELECT 4, 0, 2 + CAST(min(o_totalprice) = max(o_totalprice) AS INT), 3 FROM orders)
SELECT c case_id, CAST(i AS BIGINT) idx, CAST(v AS BIGINT) votes, CAST(k AS BIGINT) candidates FROM v""",
    "exec_accuracy": "SELECT * FROM (VALUES (0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 0, 1)) t(order_index, is_correct, failed)",
    "run_summary": f"SELECT run_tag, {_SUM} GROUP BY run_tag",
    "total_summary": f"SELECT {_SUM}",
    "result_outcomes": f"SELECT db_id, {_KIND} outcome, count(*) n FROM eval_results GROUP BY ALL",
    "ordered_results": "SELECT run_tag, order_index, result_id FROM eval_results",
    "knowledge_lookup": _KNOW + " SELECT * FROM m",
    "knowledge_match_counts": _KNOW + " SELECT match_type, count(*) n FROM m GROUP BY ALL",
    "history_recent": "SELECT run_tag, mode, ended_at, round(accuracy, 2) accuracy, correct, total FROM run_history ORDER BY coalesce(ended_at, '') DESC, run_tag DESC LIMIT 12",
    "history_best": "SELECT mode, run_tag, accuracy, ended_at FROM run_history QUALIFY row_number() OVER (PARTITION BY coalesce(mode, 'unknown') ORDER BY coalesce(accuracy, 0) DESC, coalesce(ended_at, ''), run_tag) = 1",
    "history_latest": f"""SELECT mode, CAST(include_dataset_evidence AS INT) hints, run_tag, accuracy, CAST(row_number() OVER (ORDER BY coalesce(nullif(list_position(['baseline', 'official', 'enhanced', 'fused'], mode), 0), 99), mode, include_dataset_evidence) AS INT) AS position
FROM (SELECT * FROM run_history WHERE candidate_count = 1 QUALIFY row_number() OVER (PARTITION BY mode, include_dataset_evidence ORDER BY {_WHEN} DESC, run_tag) = 1)""",
    "history_comparison": "SELECT *, CAST(row_number() OVER (ORDER BY best_accuracy DESC, mode, hints) = 1 AS INT) is_best FROM (SELECT coalesce(mode, 'unknown') mode, CAST(coalesce(include_dataset_evidence, false) AS INT) hints, count(*) runs, max(coalesce(accuracy, 0)) best_accuracy FROM run_history GROUP BY ALL)",
    "late_rows": "SELECT result_id, run_tag FROM eval_results JOIN run_history USING (run_tag) WHERE written_at > TRY_CAST(ended_at AS TIMESTAMP)",
}
