"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import answers, leaks, mixing, nearpairs, quotas, splits, subjects, variants, vectors
from tessera.plans.cluster import cut, table

SIMILARITY = 0.7  # p2: stated by the problem
DIM, NEIGHBOURS = 64, 5


def _sql_rows(spark: SparkSession, d: str) -> DataFrame:
    return variants.usable(table(spark, d, "dev"), "record_id", "sql", "db_id").unionByName(variants.usable(table(spark, d, "dev_tied_append"), "record_id", "sql", "db_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_copies(_sql_rows(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_groups(_sql_rows(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dev_tied_append")
    return t.select(F.col("record_id").alias("id"), nearpairs.words(F.col("question"), F.col("evidence")).alias("words"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearpairs.near_pairs(_questions(spark, d), SIMILARITY)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearpairs.near_groups(_questions(spark, d), SIMILARITY)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_index").select(F.col("vec_id").alias("id"), F.col("embeddings").alias("v"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest_rows(_vectors(spark, d), DIM, NEIGHBOURS)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The keys and ids of the most similar columns of every column."""
    near = vectors.nearest_rows(_vectors(spark, d), DIM, NEIGHBOURS)
    keys = table(spark, d, "vector_index").select("vec_id", "keys")
    named = near.join(keys.select(F.col("vec_id").alias("neighbour"), F.col("keys").alias("neighbour_keys")), "neighbour")
    return named.join(keys.withColumnRenamed("vec_id", "id"), "id").select(
        F.col("id").alias("vec_id"), "keys", F.col("neighbour").alias("neighbour_id"), "neighbour_keys", F.round("cosine", 9).alias("cosine")
    )


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """For the vectors whose id is divisible by 50: how many neighbours an exact search gives, and whether 0.9 of them are found."""
    got = vectors.recall(_vectors(spark, d), DIM, NEIGHBOURS)
    return got.select("queries", "sought", (F.col("found") >= F.col("sought") * 0.9).cast("int").alias("reached"))


def _strata_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dev_tied_append").select(F.col("record_id").alias("id"), F.col("question_id").alias("question"), "db_id", "difficulty")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quotas.report(_strata_rows(spark, d), table(spark, d, "sample_targets")).where("missing > 0").select("db_id", "difficulty")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.report(_strata_rows(spark, d), table(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    drawn = quotas.sample(_strata_rows(spark, d), table(spark, d, "sample_targets"))
    return drawn.select(F.col("id").alias("record_id"), F.col("question").alias("question_id"), "db_id", "difficulty")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defective(table(spark, d, "eval_results"), "result_id", "question", "predicted_sql", "error_msg")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("defect").agg(F.count("*").alias("answers"))


def _entity_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dev_tied_append").select(F.col("record_id").alias("id"), variants.name_key(F.col("db_id")).alias("a"), F.col("question_id").alias("b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    tied = cut(splits.tied_entities(_entity_rows(spark, d)))
    left, right = tied.select("component", F.col("node").alias("db_a")), tied.select("component", F.col("node").alias("db_b"))
    return left.join(right, "component").where("db_a < db_b").select("db_a", "db_b")


def p7_components(spark: SparkSession, d: str) -> DataFrame:
    """One row per tied database name: its component and the number of names in it."""
    tied = cut(splits.tied_entities(_entity_rows(spark, d)))
    size = tied.groupBy("component").agg(F.count("*").alias("names"))
    first = tied.groupBy("component").agg(F.min("node").alias("first_name"))
    return tied.join(size, "component").join(first, "component").select(F.col("node").alias("db_id"), "first_name", "names")


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_entity_rows(spark, d), table(spark, d, "split_targets")).select(F.col("id").alias("record_id"), "component", "split_name")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return leaks.leaked(docs, table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("longest_run") >= leaks.RUN_WORDS).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unmet(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")).select("slot", "source", "repeat", "block", F.col("id").alias("doc_id"), "piece", "tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_list"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


def p10_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each subject and their share of all documents."""
    every = table(spark, d, "documents").count()
    return p10_found(spark, d).groupBy("subject").agg(F.count("*").alias("documents")).select("subject", "documents", F.round(F.col("documents") / every, 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_groups, p3_found, p3_neighbours, p3_recall, p5_found, p5_report, p5_sample, p6_found, p6_counts, p7_found, p7_components, p7_splits, p8_found, p8_leaks, p9_found, p9_mixture, p9_shares, p10_found, p10_subjects, p10_corpus)}

_STRATA = """
with t as (select lower(trim(db_id)) a, lower(trim(difficulty)) b, sum(target_bp) bp, max(min_rows) least from sample_targets group by 1, 2),
c as (select t.a, t.b, t.bp, t.least, count(distinct q.question_id) n from t left join dev_tied_append q on lower(trim(q.db_id)) = t.a and lower(trim(q.difficulty)) = t.b group by 1, 2, 3, 4),
s as (select sum(n) // 5 size from c)
"""

_TIES = """
with recursive p as (select distinct lower(trim(db_id)) d, question_id q from dev_tied_append where db_id is not null and question_id is not null),
e as (select distinct x.d a, y.d b from p x join p y on x.q = y.q and x.d <> y.d),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_QUESTION = _WORDS.format("coalesce(question, '') || ' ' || coalesce(evidence, '')")


def _windows(name: str, table: str, key: str) -> str:
    return f"{name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {leaks.RUN_WORDS - 2}), lambda i: array_to_string(w[i:i + {leaks.RUN_WORDS - 1}], ' '))) g FROM (SELECT {key}, {_WORDS.format('text')} w FROM {table}))"


SQL = {
    "p2_found": f"""WITH w AS (SELECT record_id r, unnest(list_distinct({_QUESTION})) t FROM dev_tied_append), n AS (SELECT r, count(*) n FROM w GROUP BY r),
c AS (SELECT x.r a, y.r b, count(*) c FROM w x JOIN w y ON x.t = y.t AND x.r < y.r GROUP BY ALL)
SELECT a record_a, b record_b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c / (x.n + y.n - c) >= {SIMILARITY} - 1e-12""",
    "p8_found": f"WITH {_windows('d', 'documents', 'doc_id')}, {_windows('i', 'eval_items', 'item_id')} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p5_found": _STRATA + "select a db_id, b difficulty from c, s where n < greatest(least, size * bp // 10000)",
    "p7_found": _TIES + "select a db_a, b db_b from r where a < b",
    "p7_components": _TIES + "select a db_id, least(a, min(b)) first_name, count(distinct b) + (case when bool_or(a = b) then 0 else 1 end) \"names\" from r group by a",
    "p3_recall": f"""WITH v AS (SELECT vec_id, embeddings e FROM vector_index WHERE len(embeddings) = {DIM} AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
c AS (SELECT min(vec_id) r FROM v GROUP BY e) SELECT count(*) queries, CAST(coalesce(sum(least({NEIGHBOURS}, n - 1)), 0) AS BIGINT) sought, 1 reached FROM c, (SELECT count(*) n FROM c) WHERE r % 50 = 0""",
    "p2_groups": f"""WITH RECURSIVE t AS (SELECT record_id r, list_sort(list_distinct({_QUESTION})) w FROM dev_tied_append),
k AS (SELECT w, min(r) rep, count(*) copies FROM t WHERE len(w) > 0 GROUP BY w), u AS (SELECT rep, unnest(w) x, len(w) n FROM k),
c AS (SELECT p.rep a, q.rep b, count(*) c, any_value(p.n) m, any_value(q.n) n FROM u p JOIN u q ON p.x = q.x AND p.rep <> q.rep GROUP BY p.rep, q.rep),
e AS (SELECT a, b FROM c WHERE c / (m + n - c) >= {SIMILARITY} - 1e-12),
g(a, b) AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a),
f AS (SELECT a rep, least(a, min(b)) first FROM g GROUP BY a), d AS (SELECT a rep, count(*) links FROM e GROUP BY a)
SELECT t.r record_id, coalesce(f.first, k.rep, t.r) group_id, coalesce(k.copies, 1) copies, coalesce(d.links, 0) links FROM t LEFT JOIN k ON t.w = k.w LEFT JOIN f ON f.rep = k.rep LEFT JOIN d ON d.rep = k.rep""",
}
