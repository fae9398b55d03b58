"""Defects of answers."""

import pytest

from tessera.llm import answers as A

Q = "How many loans there are of arrears no less than 8347 having Jorsenkal for town?"
OK = "SELECT T1.a, COUNT(*) FROM t AS T1 INNER JOIN u AS T2 ON T1.x = T2.x WHERE T2.n = 'O''Brien' AND T1.d BETWEEN 1 AND 2 GROUP BY T1.a HAVING COUNT(*) > 1 ORDER BY T1.a DESC LIMIT 3"
CASES = {
    OK: None, f"```sql\n{OK};\n```": None, f"Here is the query:\n{OK}": None, f"-- {Q}\n{OK}": None, f"/* what's {Q} */ {OK}": None, f"```\n{OK.lower()}\n```": None,
    "SELECT 1": None, "SELECT COUNT(*) FROM t": None, "WITH q AS (SELECT 1) SELECT * FROM q": None, "SELECT * FROM t WHERE `a b` = 1": None, "SELECT a FROM t AS T1 ORDER BY T1.`unit price`": None,
    "SELECT CASE WHEN a THEN 1 END FROM t": None, "`SELECT a FROM t`": None, "SELECT 'sorry, I cannot' FROM t": None, "SELECT COUNT(*) FROM t WHERE note = 'I am unable to'": None,
    None: "empty", "": "empty", "  \n": "empty", "ERROR": "empty", "None": "empty", "null;": "empty", "--": "empty", "/* */": "empty", ";;": "empty", "```sql\n```": "empty", "```\nERROR\n```": "empty",
    "I'm sorry, but I cannot write this query.": "refusal", "Request declined (x).": "refusal", "-- Lo siento, no puedo responder sobre category.": "refusal", "抱歉，我无法为 x 编写查询。": "refusal",
    "Leider kann ich zu x keine Abfrage schreiben.": "refusal", "SELECT 'Unfortunately I can''t answer that question'": "refusal", "SELECT 'We can''t work with the tables shown.'": "refusal", "It would not be appropriate to look up x.": "refusal", "/* No query can be offered for x under the present policy. */": "refusal",
    "There is not enough information about x to build a query.": "refusal", "The request falls outside of what may be answered here: x.": "refusal", "```\nWe must decline to give personal records.\n```": "refusal", "Je ne peux pas écrire cette requête.": "refusal",
    "К сожалению, я не могу ответить.": "refusal", "申し訳ありませんが、お答えできません。": "refusal",
    Q: "copied_question", Q.upper(): "copied_question", f"-- {Q}": "copied_question", f'"{Q}" =>': "copied_question", " ".join(Q.split()[:13]): "copied_question",
    "for row in t:\n    if row['x']:\n        n += 1": "other_language", "db.t.find({ x: { $gt: 3 } }).limit(1)": "other_language", "MATCH (a:t)-[:HAS]->(b:u) RETURN b.x": "other_language", "Hay que unir la tabla t con u y ordenar.": "other_language",
    "先把表 a 和 b 连接起来。": "other_language", "library(dplyr)\nt %>% inner_join(u)": "other_language", "Die Werte stehen in der Tabelle t, dort muss man suchen.": "other_language", "const rows = t.map(x => x.y);": "other_language",
    "SELECT": "truncated", "SELECT a,": "truncated", "SELECT COUNT(": "truncated", "SELECT a FROM t WHERE": "truncated", "SELECT a FROM t WHERE x =": "truncated", "SELECT a FROM t WHERE x LIKE '%ab": "truncated", "SELECT T1.a, T2.b": "truncated",
    "SELECT a FROM t WHERE x BETWEEN 3": "truncated", "SELECT a FROM t WHERE x BETWEEN 3 AND": "truncated", "SELECT a FROM t ORDER": "truncated", "SELECT a FROM t GROUP BY": "truncated", "SELECT SUM(CASE WHEN a THEN 1 ELSE 0 EN": "truncated",
    "SELECT a FROM t INNER JOIN u AS": "truncated", "SELECT a FROM t AS T1 JOIN u AS T2 ON T1.": "truncated", "```sql\nSELECT a FROM t WHERE (x > 1": "truncated", "WITH q AS (SELECT 1": "truncated", "SELECT `a FROM t": "truncated", "SELECT a /": "truncated",
}


@pytest.mark.parametrize("text", list(CASES), ids=lambda t: repr(t)[:50])
def test_defect(text):
    assert A.defect_of(Q, text) == CASES[text]


def test_every_prefix_of_a_query_is_read():
    for i in range(1, len(OK)):
        assert A.defect_of(None, OK[:i]) in (None, "truncated", "other_language")
    assert A.defect_of(None, OK[: OK.index("'O''") + 5]) == "truncated"


def test_copied_needs_order_and_share():
    w = Q.split()
    assert A.defect_of(Q, " ".join(reversed(w))) != "copied_question"
    assert A.defect_of(Q, " ".join(w[:6])) != "copied_question"
    assert A.longest_in_order(list("abcde"), list("axbyce")) == 4 and A.tiled_words(list("abcde"), list("deabc")) == 5


def test_whole_column(spark):
    rows = [(i, Q, t) for i, t in enumerate(CASES)] + [(900, None, Q), (901, None, None), (902, "", ""), (903, Q, "SELECT " + "a, " * 100_000), (904, Q, "x " * 100_000)]
    df = spark.createDataFrame(rows, "result_id long, question string, predicted_sql string").withColumn("defect", __import__("pyspark").sql.functions.lit(1))
    got = {r[0]: r[1] for r in A.defective(df, "result_id", "question", "predicted_sql").collect()}
    assert got == {i: d for i, t in enumerate(CASES) if (d := CASES[t])} | {900: "other_language", 901: "empty", 902: "empty", 903: "truncated", 904: "other_language"}
    assert A.defective(df.limit(0), "result_id", "question", "predicted_sql").count() == 0
