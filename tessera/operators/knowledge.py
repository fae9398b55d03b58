"""Knowledge lookup for questions: by question id where the database agrees, else by database and question text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.texts import one_line


ENTRIES = "ord long, question_id string, db_id string, question string, evidence string"


def knowledge_entries(spark: SparkSession, raw: object) -> DataFrame:
    """Entries of a knowledge file that was read as JSON: a list of entries, or entries or lists of entries under a key.

    A key of digits is the question id of the entries below it, any other their database, where they do not say so
    themselves.  What is no entry is left out; anything else than a list or a mapping gives no entries.
    """
    found: list[dict] = []

    def add(value: object, key: object = None) -> None:
        for entry in value if isinstance(value, list) else [value]:
            if isinstance(entry, dict):
                named = {} if key is None else {"question_id" if str(key).isdigit() else "db_id": key}
                found.append(named | entry)

    if isinstance(raw, list):
        add(raw)
    elif isinstance(raw, dict):
        for key, value in raw.items():
            add(value, key)
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([(i, *(text(e.get(c)) for c in ("question_id", "db_id", "question", "evidence"))) for i, e in enumerate(found)], ENTRIES)


def knowledge_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last entry per question id, and the last per (database, question); ``entries`` has ord, question_id, db_id, question, evidence."""
    e = entries.select("ord", F.col("question_id").cast("string").alias("qid"), "db_id", one_line(F.col("question")).alias("q"), F.trim(F.coalesce("evidence", F.lit(""))).alias("evidence"))
    last = lambda *c: F.max(F.struct("ord", *c)).alias("e")
    by_id = e.where("qid is not null and qid <> ''").groupBy("qid").agg(last("db_id", "evidence")).select("qid", F.col("e.db_id").alias("id_db"), F.col("e.evidence").alias("id_evidence"))
    by_text = e.where("db_id is not null and db_id <> '' and q <> ''").groupBy("db_id", "q").agg(last("evidence")).select("db_id", "q", F.col("e.evidence").alias("text_evidence"))
    return by_id, by_text


def resolve(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, evidence, match_type) of every case (id, question_id, db_id, question); match_type is null where nothing fits.

    Each index has one row per key, so the lookups keep the number of cases; a hot key of the cases is split by adaptive
    skew joins.
    """
    by_id, by_text = knowledge_index(entries)
    c = cases.select("id", F.col("question_id").cast("string").alias("qid"), "db_id", one_line(F.col("question")).alias("q"))
    j = c.join(by_id, "qid", "left").join(by_text, ["db_id", "q"], "left")
    agrees = F.col("id_evidence").isNotNull() & (F.col("db_id").isNull() | F.col("id_db").isNull() | (F.col("id_db") == "") | (F.col("id_db") == F.col("db_id")))
    return j.select(
        "id", F.when(agrees, F.col("id_evidence")).otherwise(F.col("text_evidence")).alias("evidence"),
        F.when(agrees, "question_id").when(F.col("text_evidence").isNotNull(), "db_id+question").alias("match_type"),
    )
