"""Multisets, votes, evaluation, metrics, history and reports."""

import pytest

from tessera.dialect import Dialect
from tessera.operators import evaluate, history
from tessera.operators.evaluate import Case, Evaluator


@pytest.fixture(scope="module")
def db(spark):
    return Dialect(spark, {"t": spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (2, "b", None), (None, None, 2.5)], "i int, s string, f double")})


def test_multisets(spark, db):
    same = lambda a, b: evaluate.same_multiset(db.sql(a), db.sql(b))
    assert same("SELECT i FROM t ORDER BY i", "SELECT i AS other FROM t ORDER BY i DESC")
    assert same("SELECT 1", "SELECT 1.0") and not same("SELECT 1", "SELECT '1'")
    assert not same("SELECT i FROM t", "SELECT DISTINCT i FROM t")
    assert not same("SELECT i, s FROM t", "SELECT s, i FROM t")
    assert not same("SELECT f FROM t", "SELECT s FROM t")
    assert same("SELECT i FROM t WHERE i > 9", "SELECT f FROM t WHERE i > 9")
    diff = evaluate.multiset_difference(db.sql("SELECT s FROM t"), db.sql("SELECT DISTINCT s FROM t")).collect()
    assert [(r.n_a, r.n_b) for r in diff] == [(2, 1)]


def test_result_keys_tell_types_apart(db):
    key = lambda q: evaluate.result_key(db.sql(q))
    assert key("SELECT i FROM t") == key("SELECT i AS x FROM t ORDER BY i DESC")
    assert key("SELECT 1") != key("SELECT 1.0") and key("SELECT i FROM t") != key("SELECT DISTINCT i FROM t")


def test_vote(spark):
    rows = [
        ("a", 0, "SELECT 11", True, "x"), ("a", 1, "SELECT 2", True, "y"), ("a", 2, "SELECT 1", True, "x"), ("a", 3, "bad", False, None),
        ("b", 0, "SELECT long", True, "x"), ("b", 1, "S", True, "y"), ("c", 0, "e", False, None), ("c", 1, None, False, None), ("d", 5, "q", True, None),
    ]
    got = {r.case: (r.idx, r.sql, r.votes) for r in evaluate.vote(spark.createDataFrame(rows, "case string, idx int, sql string, valid boolean, key string"), ["case"]).collect()}
    assert got == {"a": (2, "SELECT 1", 2), "b": (0, "SELECT long", 1), "c": (1, None, 0), "d": (5, "q", 0)}


def test_evaluator(db):
    run = Evaluator({"d": db}, seconds=60)
    out = run.evaluate(Case("1", "d", "?", "SELECT COUNT(*) FROM t", ["SELECT COUNT(s) FROM t", "SELECT COUNT(*) FROM t", "SELECT SUM(1) FROM t"]))
    assert out["is_correct"] and out["predicted_sql"] == "SELECT SUM(1) FROM t" and out["error_msg"] == ""
    assert run.evaluate(Case("1", "d", "?", "SELECT 1", ["DROP TABLE t"]))["error_msg"] == "only queries are accepted"
    assert "no such column" in run.evaluate(Case("1", "d", "?", "SELECT 1", ["SELECT nope FROM t"]))["error_msg"]
    assert run.evaluate(Case("1", "d", "?", "SELECT nope FROM t", ["SELECT 1"])) | {"error_msg": ""} == {"order_index": 0, "question_id": "1", "db_id": "d", "question": "?", "gold_sql": "SELECT nope FROM t", "predicted_sql": "SELECT 1", "is_correct": False, "error_msg": ""}
    fixed = run.evaluate(Case("1", "d", "?", "SELECT 1", ["SELECT nope FROM t"]), repair=lambda c, s, e: "SELECT 1")
    assert fixed["is_correct"] and run.evaluate(Case("1", "x", "?", "SELECT 1", ["SELECT 1"]))["error_msg"] == "no such database: x"
    assert run.evaluate(Case("1", "d", "?", "SELECT 1", ["ERROR"]))["error_msg"] and run.evaluate(Case("1", "d", "?", "SELECT 1", []))["predicted_sql"] == "ERROR"


def test_summary(spark):
    rows = [("r", "SELECT 1", True, ""), ("r", "SELECT 2", False, None), ("r", "ERROR", False, "timeout"), ("r", "SELECT 3", None, "bad"), (None, "ERROR", None, None)]
    df = spark.createDataFrame(rows, "run_tag string, predicted_sql string, is_correct boolean, error_msg string")
    got = {r.run_tag: r for r in evaluate.summary(df, ["run_tag"]).collect()}
    r = got["r"]
    assert (r.total, r.correct, r.accuracy, r.executable_count, r.error_count, r.generation_error_count, r.execution_error_count) == (4, 1, 25.0, 2, 2, 1, 1)
    assert got[None].execution_success_rate == 0.0
    assert evaluate.summary(df.limit(0)).collect()[0].total == 0


HISTORY = "mode string, run_tag string, started_at string, ended_at string, accuracy double, include_dataset_evidence boolean, dataset_path string, total int, candidate_count int, correct int, execution_success_rate double"


def test_history(spark):
    rows = [
        ("fused", "a", "2024-01-01", "2024-01-02 00:00:00", 50.0, True, "x/dev", 500, 1, 250, 90.0), ("fused", "b", "2024-01-01", "2024-01-03 00:00:00", 50.0, True, "x/dev", 500, 1, 250, 90.0),
        ("baseline", "c", "2024-02-01", None, 10.0, False, "x/dev", 500, 1, 50, 50.0), ("zeta", "d", "bad", "", None, None, None, 10, 3, 0, None), (None, "e", None, None, 5.0, None, "x", 500, 1, 1, 1.0),
    ]
    h = spark.createDataFrame(rows, HISTORY)
    assert [r.run_tag for r in history.recent(h, 2).collect()] == ["b", "a"]
    assert {r.run_tag for r in history.best_per_mode(h).collect()} == {"a", "c", "d", "e"}
    assert [r.run_tag for r in history.latest_per_mode(h).orderBy("position").collect()] == ["c", "b", "e", "d"]
    assert {r.run_tag for r in history.latest_per_mode(h, "dev", 500, 1).collect()} == {"b", "c"}
    best = [r for r in history.comparison(h).collect() if r.is_best]
    assert len(best) == 1 and (best[0].mode, best[0].hints) == ("fused", 1)
    text = history.latex_table([r.asDict() for r in h.collect()])
    assert "50.00 & 90.00 & 250/500" in text and history.latex_escape("a_b%") == r"a\_b\%" and "fused-hints" in history.latex_plot([h.collect()[0].asDict()])


def test_prefix_sums(spark):
    from tessera.operators.prefix import running_sum

    rows = [("a" if i % 3 else "b", (i * 7919 * 2**40) % 2**64 - 2**63, i, i % 5) for i in range(500)] + [("c", 0, 0, None)]
    got = {(r.g, r.id): r.before for r in running_sum(spark.createDataFrame(rows, "g string, key long, id long, size int"), ["g"], "key", "id", "size", 16).collect()}
    for g in "abc":
        total = 0
        for _, key, i, size in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            assert got[g, i] == total
            total += size or 0
