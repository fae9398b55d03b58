"""Phrases that many documents hold are dealt to several tasks; nothing is lost or doubled."""

from tessera.llm import leaks as L


def test_hot_phrases(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SEEDS", 3)
    monkeypatch.setattr(L, "ITEMS_A_ROW", 2)
    phrase = " ".join(f"h{i}" for i in range(12))
    items = [(k, f"{phrase} tail{k}") for k in range(7)] + [(50, "one two three four five six seven eight nine ten eleven twelve")]
    docs = [(d, f"start{d} {phrase} end{d}") for d in range(20)] + [(100, "one two three four five six seven")]
    got = L.leaked(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "id long, text string"), 0).collect()
    assert sorted((r.doc_id, r.item_id, r.longest_run) for r in got) == sorted((d, k, 12) for d in range(20) for k in range(7))
