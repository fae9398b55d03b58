"""Providers over HTTP, result files, catalog round trip, knowledge forms, linked generation, evaluation from the command line."""

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera.dialect import Dialect
from tessera.functions import provider as P
from tessera.operators import catalog, evaluate, knowledge, runs
from tessera.sources import readers, sinks


@pytest.fixture()
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers["Authorization"]))
            if len(seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            answer = {"choices": [{"message": {"content": "```sql\nSELECT 2\n```"}}]} if "chat" in self.path else {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_provider_from_the_environment(service, monkeypatch):
    url, seen = service
    with pytest.raises(RuntimeError, match="NOPE_URL"):
        P.provider_from_env("NOPE")
    for k, v in (("URL", url), ("KEY", "k"), ("MODEL", "m"), ("EMBEDDING_MODEL", "e"), ("WAIT", "0.01")):
        monkeypatch.setenv(f"T_{k}", v)
    p = P.provider_from_env("T")
    assert p is P.provider_from_env("T") and runs.extract_query(p.complete([{"role": "user", "content": "q"}], 0.2, True)) == "SELECT 2"
    assert [s[0] for s in seen] == ["/v1/chat/completions"] * 2 and seen[1][2] == "Bearer k" and seen[1][1]["response_format"] == {"type": "json_object"}
    assert p.embed([str(i) for i in range(10)]) == [[float(i % 8)] for i in range(10)] and len(seen) == 4


def test_transient():
    class Busy(Exception):
        status = 429

    assert all(P.transient(e) for e in (TimeoutError(), ConnectionResetError(), Busy(), Exception("Network unreachable"), Exception("temporary failure"), Exception("server overload"), Exception("HTTP 502")))
    assert not any(P.transient(e) for e in (KeyError("x"), Exception("bad request 400"), ValueError("1500 rows")))


def test_result_files(tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    name = lambda: sinks.run_path(str(tmp_path), "fused", "/x/dev set.json", True, 20, 3, now=at)
    first = name()
    assert first.endswith("results_fused_dev_set_hints_n20_c3_20240506_070809.json")
    open(first, "w").close()
    assert name() != first
    sinks.keep_summary(str(tmp_path), {"mode": "fused", "accuracy": 1})
    sinks.keep_summary(str(tmp_path), {"mode": "base line", "accuracy": 2})
    assert json.load(open(tmp_path / "latest.json"))["accuracy"] == 2 and json.load(open(tmp_path / "latest_fused.json"))["accuracy"] == 1 and (tmp_path / "latest_base_line.json").exists()
    assert len(open(tmp_path / "history.jsonl").readlines()) == 2


def test_knowledge_forms(spark):
    e = {"question": "q", "evidence": "v"}
    rows = lambda raw: [(r.question_id, r.db_id, r.question, r.evidence) for r in knowledge.knowledge_entries(spark, raw).orderBy("ord").collect()]
    assert rows([e, 5, None]) == [(None, None, "q", "v")]
    assert rows({"12": e, "lab": [e, "x", {"db_id": "own", **e}], "n": 3}) == [("12", None, "q", "v"), (None, "lab", "q", "v"), (None, "own", "q", "v")]
    assert rows("text") == rows([]) == []


def test_catalog_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(i, f"n{i % 3}") for i in range(30)], "t_id int, name string")
    model = P.StubProvider(default="", replies={"Describe": json.dumps({"columns": {"name": {"description": "said by the model"}}})})
    meta = catalog.build({"t": t, "__skip": t}, str(tmp_path), "d", provider=model)
    assert meta["profiled"] == ["t"] and meta["status"] == "completed"
    assert catalog.build({"t": t, "u": t}, str(tmp_path), "d")["skipped"] == ["t"]
    got, meta = catalog.read(spark, str(tmp_path), "d")
    by = {(r.tbl, r.col): r for r in got.collect()}
    assert set(by) == {(x, c) for x in "tu" for c in ("t_id", "name")} and by["t", "name"].description == "said by the model" and by["t", "t_id"].short_description.startswith("t_id of type")
    assert by["t", "name"].described_by == "model" and by["u", "name"].described_by == "rules" and by["t", "t_id"].row_count == 30
    with pytest.raises(Exception):
        catalog.read(spark, str(tmp_path), "other")


def test_one_bad_column_does_not_end_a_table(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = F.udf(lambda x: 1 / 0, "int")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string").withColumn("broken", bad("i"))
    meta = catalog.build({"t": t, "u": t.select("broken")}, str(tmp_path), "d")
    assert meta["profiled"] == ["t"] and set(meta["failed"]) == {"t.broken", "u"} and meta["status"] == "in_progress"
    assert {(r.col, r.ord) for r in catalog.read(spark, str(tmp_path), "d")[0].collect()} == {("i", 0), ("s", 1)}


def test_linked_generation():
    asked = []

    class Model:
        def complete(self, messages, temperature=0.0, json_mode=False):
            asked.append(messages[0]["content"])
            return "```sql\nSELECT a FROM t\n```"

    assert runs.generate(Model(), "q", ["d.t.a", "t.b", "t.a"], {"t": "CREATE t", "u": "CREATE u"}, "mind this") == "SELECT a FROM t"
    assert "t: a, b" in asked[0] and "CREATE t" in asked[0] and "CREATE u" not in asked[0] and "mind this" in asked[0]
    runs.generate(Model(), "q", [], {"t": "CREATE t", "u": "CREATE u"})
    assert "CREATE u" in asked[1]


def test_runs_tell_links_and_declarations(spark):
    told = []

    class Model(P.StubProvider):
        def complete(self, messages, temperature=0.0, json_mode=False):
            told.append(messages[0]["content"])
            return "SELECT i FROM t"

    db = Dialect(spark, {"t": spark.createDataFrame([(1,)], "i int")})
    case = {"question_id": 1, "db_id": "d", "question": "q", "SQL": "SELECT 1"}
    rows, _ = runs.run({"d": db}, [case], Model(), "enhanced", catalog=lambda c: "the catalog", links=lambda c: ["t.i"])
    assert rows[0]["is_correct"] and "CREATE TABLE" in told[0] and "the catalog" in told[0] and "t: i" in told[0]


def test_one_execution_serves_vote_and_score(spark):
    k = lambda q: evaluate.result_keys(spark.sql(q))
    a, b = k("SELECT 1 AS x UNION ALL SELECT 2"), k("SELECT 2.0D AS y UNION ALL SELECT 1.0D")
    assert a[1] == b[1] and a[0] != b[0] and k("SELECT 1 AS x UNION ALL SELECT 1")[1] != k("SELECT 1 AS x")[1]
    assert k("SELECT -0.0D AS x")[1] == k("SELECT 0 AS x")[1] and k("SELECT 1 AS x WHERE false")[1] == k("SELECT 1 AS x, 2 AS y WHERE false")[1]
    assert k("SELECT CAST(NULL AS INT) AS x")[1] != k("SELECT 0 AS x")[1]


def test_tables_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
        con.execute("CREATE TABLE e (k TEXT PRIMARY KEY) WITHOUT ROWID")
        con.execute("CREATE TABLE m (n INTEGER, r INTEGER)")
        con.executemany("INSERT INTO w VALUES (?, ?)", [("a", 1), ("b", None)])
        con.executemany("INSERT INTO m VALUES (?, ?)", [(1, 2.5), ("x", 3)])
    assert sorted(map(tuple, readers.sqlite_table(spark, path, "w").collect())) == [("a", 1), ("b", None)]
    assert readers.sqlite_table(spark, path, "e").count() == 0
    assert readers.sqlite_table(spark, path, "m").dtypes == [("n", "string"), ("r", "double")]


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    (tmp_path / "db" / "d").mkdir(parents=True)
    spark.createDataFrame([(1,)], "i int").write.parquet(str(tmp_path / "db" / "d" / "t.parquet"))
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": 1, "db_id": "d", "question": "q", "evidence": "", "SQL": "SELECT 1"}, {"question_id": 2, "db_id": "gone", "question": "q", "evidence": "", "SQL": "SELECT 1"}]))
    (tmp_path / "k.json").write_text(json.dumps({"d": [{"question": "q", "evidence": "known"}]}))
    assert main(["evaluate", str(tmp_path / "db"), str(tmp_path / "q.json"), "--stub", "--mode", "official", "--runs", str(tmp_path / "runs"), "--knowledge", str(tmp_path / "k.json")]) == 0
    s = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (s["total"], s["correct"], s["mode"]) == (2, 1, "official") and (tmp_path / "runs" / "latest_official.json").exists()
    assert main(["sixway", str(tmp_path / "db"), str(tmp_path / "q.json"), "--stub", "--limit", "1", "--runs", str(tmp_path / "runs")]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "best official 100.00"
