"""Literal index, vectors, keywords, text functions, knowledge lookup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import provider, texts
from tessera.operators import knowledge, literal, retrieve
from tessera.queries import linking


def test_literal_index_and_links(spark):
    a = spark.createDataFrame([(" Paris ", 1), ("paris", 2), (None, 3), ("", 4), ("abc", 5), ("Rome", 6)], "city string, n int")
    b = spark.createDataFrame([("Rome", "x")], "town string, city string")
    idx = literal.literal_index({"a": a, "b": b})
    got = {r.value: r.columns for r in idx.collect()}
    assert got == {"Paris": ["a.city"], "paris": ["a.city"], "abc": ["a.city"], "Rome": ["a.city", "b.town"], "x": ["b.city"]}
    q = spark.createDataFrame([(1, "from ROME to pari"), (2, None), (3, "abc x"), (4, "PARISIAN"), (5, "")], "id long, question string")
    assert {(r.id, r.column) for r in literal.literal_links(q, idx).collect()} == {(1, "a.city"), (1, "b.town"), (4, "a.city")}
    assert literal.literal_index({"a": a}, per_column=2).count() == 2


def test_literal_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abAB "), rng.integers(1, 7))) for _ in range(150)]
    qs = ["".join(rng.choice(list("abAB "), rng.integers(0, 30))) for _ in range(60)]
    idx = literal.literal_index({"t": spark.createDataFrame([(w,) for w in words], "v string")})
    got = {(r.id, r.column) for r in literal.literal_links(spark.createDataFrame(list(enumerate(qs)), "id long, question string"), idx).collect()}
    assert got == {(i, "t.v") for i, q in enumerate(qs) if any(len(w.strip()) > 3 and w.strip().lower() in q.lower() for w in words)}


@pytest.mark.parametrize("block", [3, 4096])
def test_cosine_topk(spark, block):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (60, 8)).astype(float)
    x[5] = x[6]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])], "id long, v array<double>")
    ask = rows.where("id % 10 = 5 and id < 60")
    got = {}
    for r in retrieve.cosine_topk(ask, rows, 5, None, block).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    for q in range(5, 60, 10):
        s = np.round((x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]) + 1e-10), 12)
        want = np.lexsort((np.arange(60), -s))[:5]
        assert {i for _, i in got[q]} <= {int(i) for i in range(60) if s[i] >= s[want[-1]] - 1e-9} and len(got[q]) == 5
    assert retrieve.cosine_topk(ask, rows, 5, 2.0).count() == 0


def test_keywords_and_context(spark):
    q = spark.createDataFrame([(1, "What is the average loan_amount per branch?", "Branch town"), (2, None, None), (3, "the of", "")], "id long, question string, evidence string")
    assert sorted(q.where("id = 1").select(retrieve.keywords(F.col("question"), F.col("evidence"))).collect()[0][0]) == ["branch", "loan_amount", "town"]
    cols = spark.createDataFrame([("loan", "loan_amount", "loan loan_amount money"), ("loan", "town", "loan town"), ("branch", "x", "branch x")], "tbl string, col string, hay string")
    tabs = spark.createDataFrame([("loan", "loan"), ("branch", "branch office")], "tbl string, hay string")
    rows = retrieve.keyword_context(q, cols, tabs).collect()
    assert {(r.tbl, r.table_rank, r.table_score, r.col) for r in rows} == {("branch", 1, 2, "x"), ("loan", 2, 1, "loan_amount"), ("loan", 2, 1, "town")}
    assert all(r.id == 1 for r in rows)


def test_short_key_and_column_text(spark):
    df = spark.createDataFrame([("d.t.c",), ("c",), (None,)], "k string")
    assert [r[0] for r in df.select(retrieve.short_key(F.col("k"))).collect()] == ["t.c", None, None]
    c = spark.createDataFrame([("d", "t", "c", "", "short", "", None, "")], "db string, tbl string, col string, description string, short_description string, long_description string, literal_hints string, format_hint string")
    assert retrieve.column_texts(c).collect()[0] == ("d.t.c", "table: t; column: c; meaning: short")


def test_embedding_stub(spark):
    df = spark.createDataFrame([(f"k{i}", f"word {i}") for i in range(20)] + [("e", "")], "key string, text string")
    got = {r.key: r.embedding for r in retrieve.embed(df, provider.StubProvider()).collect()}
    assert len(got) == 21 and len(got["k3"]) == 64 and np.linalg.norm(got["k3"]) == pytest.approx(1, abs=1e-5) and not any(got["e"])


@pytest.mark.parametrize("text, want", [("```sql\nSELECT 1\n```\n```SQL\nSELECT 2\n```", "SELECT 2"), ("x ```SELECT 3``` y", "SELECT 3"), (" SELECT\n4 ", "SELECT 4"), ("", ""), (None, None)])
def test_extract_sql(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(texts.extract_sql(F.col("t"))).collect()[0][0] == want


def test_referenced_tables(spark):
    rows = [("SELECT * FROM a JOIN `b` ON 1 UNION SELECT 1 FROM a",), ("ERROR",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(texts.referenced_tables(F.col("t"))).collect()] == [["a", "b"], [], [], []]


@pytest.mark.parametrize("text, want", [('{"a": 1}', {"a": 1}), ('say ```json\n{"a": {"b": 2}}\n``` ok', {"a": {"b": 2}}), ('well {"a": 3} done', {"a": 3}), ("[1]", None), ("{bad", None), (None, None), ("", None)])
def test_json_object(text, want):
    assert texts.json_object(text) == want


def test_retry_and_limits():
    waits, tries = [], iter([TimeoutError("timed out"), RuntimeError("429"), None])

    def call():
        e = next(tries)
        if e:
            raise e
        return "ok"

    assert provider.with_retry(call, 3, 1.5, sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(KeyError):
        provider.with_retry(lambda: {}["x"], sleep=waits.append)
    assert provider.Limited(provider.StubProvider({"q": "a"})).complete([{"role": "user", "content": "q?"}]) == "a"
    with pytest.raises(RuntimeError):
        provider.require_env("TESSERA_SURELY_UNSET")


def test_knowledge(spark):
    k = spark.createDataFrame([(1, "7", "a", "How  many?", "old"), (2, "7", "a", "How many?", "new"), (3, "8", "b", "Which?", None), (4, None, "c", "Who?", "text")], "ord long, question_id string, db_id string, question string, evidence string")
    c = spark.createDataFrame([(1, 7, "a", "x"), (2, 7, "z", "How many?"), (3, 9, "a", " How\nmany? "), (4, 8, None, "q"), (5, None, "c", "Who?"), (6, None, None, None)], "id long, question_id long, db_id string, question string")
    got = {r.id: (r.evidence, r.match_type) for r in knowledge.resolve(c, k).collect()}
    assert got == {1: ("new", "question_id"), 2: (None, None), 3: ("new", "db_id+question"), 4: ("", "question_id"), 5: ("text", "db_id+question"), 6: (None, None)}


def test_literal_link_reads_values_beyond_the_index(spark, tmp_path):
    for t in linking.INDEXED:
        names = [(f"Customer#{i:09d}",) for i in range(1500)] if t == "customer" else [(f"only {t}",)]
        spark.createDataFrame(names, "name string").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    asked = [(1, "What did customer#000001234 order?", ""), (2, "Which customers?", ""), (3, "customer#000000007", "")]
    spark.createDataFrame(asked, "record_id long, question string, evidence string").write.parquet(f"{tmp_path}/dev_tied_append.parquet")
    assert {(r.id, r.column) for r in linking.literal_link(spark, str(tmp_path)).collect()} == {(1, "customer.name"), (3, "customer.name")}


def test_cosine_topk_takes_queries_of_every_length(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "id long, v array<double>")
    ask = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.1, 0.0])], "id long, v array<double>")
    assert sorted((r.query, r.rank, r.id) for r in retrieve.cosine_topk(ask, rows, 5, None).collect()) == [(7, 1, 1), (7, 2, 2), (8, 1, 3)]


def test_hybrid_link_embeds_every_question(spark, tmp_path):
    for t in linking.INDEXED:
        spark.createDataFrame([(f"only {t}",)], "name string").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    asked = [(i, "accuracy and mode of a run", "") for i in (1, 7, 50)]
    spark.createDataFrame(asked, "record_id long, question string, evidence string").write.parquet(f"{tmp_path}/dev_tied_append.parquet")
    got = {}
    for r in linking.hybrid_link(spark, str(tmp_path)).collect():
        got.setdefault(r.id, set()).add(r.column)
    assert set(got) == {1, 7, 50} and len(got[50]) == 5 and got[1] == got[7] == got[50]
