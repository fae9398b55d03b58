"""The history stream agrees with the batch, and the command line runs."""

from tessera.__main__ import main
from tessera.sources.sinks import append_json_line
from tessera.streaming import history as H


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    runs = [("a", "fused", 10.0, "2024-01-01 00:00:00"), ("b", "fused", 30.0, "2024-01-02 00:00:00"), ("c", "base", None, None), ("d", "fused", 30.0, "2024-01-03 00:00:00")]
    for i, (tag, mode, acc, end) in enumerate(runs):
        append_json_line(f"{folder}/{i % 2}.jsonl", {"run_tag": tag, "mode": mode, "accuracy": acc, "ended_at": end})
    append_json_line(f"{folder}/0.jsonl", {"other": 1})
    q = H.keep_best(H.history_stream(spark, folder), "best_runs", str(tmp_path / "ck"))
    q.awaitTermination()
    want = {tuple(r) for r in H.best_so_far(spark.read.schema(H.SCHEMA).json(folder).where("run_tag is not null")).collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM best_runs").collect()} == want == {("fused", 30.0, "b", 3), ("base", 0.0, "c", 1)}
    # files that come later are added
    append_json_line(f"{folder}/9.jsonl", {"run_tag": "e", "mode": "base", "accuracy": 1.0})
    q = H.keep_best(H.history_stream(spark, folder), "best_runs2", str(tmp_path / "ck2"))
    q.awaitTermination()
    assert ("base", 1.0, "e", 2) in {tuple(r) for r in spark.sql("SELECT * FROM best_runs2").collect()}


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.parquet(str(tmp_path / "t.parquet"))
    assert main(["sql", str(tmp_path), "SELECT a / 2 AS h FROM t WHERE b LIKE 'X'"]) == 0
    assert main(["sql", str(tmp_path), "SELECT a FROM t", "--explain"]) == 0
    assert main(["profile", str(tmp_path), str(tmp_path / "out")]) == 0
    append_json_line(str(tmp_path / "h.jsonl"), {"run_tag": "a", "mode": "fused", "accuracy": 12.5, "correct": 1, "total": 8, "ended_at": "2024-01-01"})
    assert main(["history", "--history", str(tmp_path / "h.jsonl"), "--latex", str(tmp_path / "t.tex")]) == 0
    out = capsys.readouterr().out
    assert "'profiled': ['t']" in out and "12.5" in out and "12.50" in (tmp_path / "t.tex").read_text()
