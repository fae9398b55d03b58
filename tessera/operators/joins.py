"""Implicit joins: which columns of different tables hold the same values.

MinHash signatures, containment and names score every pair of columns that shares a value or a telling name; pairs that
share neither are never formed.  All distinct values of a column take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.profile import KEYS, Constraints, identifier_name, ratio
from tessera.plans.cluster import cut

SEEDS, TOKEN_CHARS = 32, 160
MIN_ROWS, MIN_DISTINCT, MIN_TOKENS = 20, 5, 15
MIN_SIGNAL, MIN_BONUS, MIN_SCORE, PER_COLUMN = 0.28, 0.12, 0.45, 5
HIGH, MEDIUM = 0.72, 0.58


def tokens(values: DataFrame) -> DataFrame:
    """(tbl, col, token): distinct normalised values."""
    t = F.substring(F.lower(F.trim("v")), 1, TOKEN_CHARS)
    return values.where("v is not null").select(*KEYS, t.alias("token")).where("token <> ''").distinct()


def eligible(count: DataFrame, token: DataFrame) -> DataFrame:
    """Columns with enough rows, values and tokens to be compared, and their number of tokens."""
    n = token.groupBy(*KEYS).agg(F.count("*").alias("tokens")).where(F.col("tokens") >= MIN_TOKENS)
    return count.where((F.col("non_nulls") >= MIN_ROWS) & (F.col("distinct_count") >= MIN_DISTINCT)).select(*KEYS).join(n, list(KEYS))


def minhash(values: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(tbl, col, signature): per seed the least of the first 16 hex digits of SHA-1 of "seed::value", which order as unsigned numbers."""
    raw = values.where("v is not null and trim(v) <> ''").groupBy("v").agg(F.collect_set(F.struct(*KEYS)).alias("at"))  # bounded by the schema
    # every distinct value is hashed once, whatever the number of columns that hold it
    hashed = raw.select("at", *[F.substring(F.sha1(F.concat(F.lit(f"{i}::"), "v")), 1, 16).alias(f"h{i}") for i in range(seeds)])
    least = [F.min(f"h{i}") for i in range(seeds)]
    return hashed.select(F.explode("at").alias("k"), *hashed.columns[1:]).groupBy("k.tbl", "k.col").agg(F.array(*least).alias("signature"))


def similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def overlaps(token: DataFrame) -> DataFrame:
    """(tbl, col, tbl2, col2, common): shared tokens of columns of different tables, both ways.

    Columns meet per token; their number is bounded by the schema, and pairs are counted before the shuffle.
    """
    at = token.groupBy("token").agg(F.array_sort(F.collect_set(F.struct(*KEYS))).alias("at")).where(F.size("at") > 1)
    pairs = at.select("at", F.explode("at").alias("a")).select("a", F.explode("at").alias("b")).where("a.tbl <> b.tbl")
    return pairs.groupBy(F.col("a.tbl").alias("tbl"), F.col("a.col").alias("col"), F.col("b.tbl").alias("tbl2"), F.col("b.col").alias("col2")).agg(F.count("*").alias("common"))


def compatible(a: Column, b: Column) -> Column:
    pair = F.concat_ws("/", F.least(a, b), F.greatest(a, b))
    return (a == "unknown") | (b == "unknown") | (a == b) | pair.isin("identifier/numeric", "identifier/text", "boolean/numeric")


def name_bonus(a: Column, b: Column) -> tuple[Column, Column]:
    """(bonus, relation) of two column names."""
    a, b = F.lower(a), F.lower(b)
    word = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))
    both = F.array_sort(F.array_intersect(word(a), word(b)))
    ids = a.endswith("id") & b.endswith("id")
    bonus = F.when(a == b, 0.25).when(ids, 0.12).when(F.size(both) > 0, 0.08).otherwise(0.0)
    relation = F.when(a == b, "same_name").when(ids, "both_id_like").when(F.size(both) > 0, F.concat(F.lit("token_overlap:"), F.array_join(F.slice(both, 1, 3), ","))).otherwise("none")
    return bonus, relation


def join_candidates(values: DataFrame, count: DataFrame, semantic: DataFrame, keys: DataFrame, constraints: Constraints) -> DataFrame:
    """Directed candidates (tbl, col) -> (tbl2, col2) with score and confidence, the best of each source column.

    Ties go to the target's name.  Declared foreign keys are left out.  Columns below the size limits never appear.
    """
    token = cut(tokens(values))
    able = cut(eligible(count, token))  # one row a column
    shared = cut(overlaps(token.join(able.select(*KEYS), list(KEYS))))
    named = able.select(*KEYS, F.lower("col").alias("name"))
    other = named.select(F.col("tbl").alias("tbl2"), F.col("col").alias("col2"), "name")
    same = named.join(other, "name").where("tbl <> tbl2").drop("name")
    # two identifiers of other names that share no value reach 0.12 + 0.21 at most, below MIN_SCORE: they need not meet
    pairs = cut(shared.select("tbl", "col", "tbl2", "col2").union(same).distinct())
    # only columns that stand in a pair need a signature
    info = (
        able.join(minhash(values.join(F.broadcast(pairs.select(*KEYS).distinct()), list(KEYS), "left_semi")), list(KEYS))  # at most one row a column
        .join(semantic.select(*KEYS, "semantic_type"), list(KEYS))
        .join(keys.select(*KEYS, "key_score", "likely_key"), list(KEYS))
        .join(count.select(*KEYS, "cardinality_class"), list(KEYS))
    )
    a = cut(info)
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns])
    j = pairs.join(a, list(KEYS)).join(b, ["tbl2", "col2"]).join(shared, ["tbl", "col", "tbl2", "col2"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    bonus, relation = name_bonus(F.col("col"), F.col("col2"))
    j = j.where(compatible(F.col("semantic_type"), F.col("semantic_type2"))).select(
        "*", similarity(F.col("signature"), F.col("signature2")).alias("sim"), bonus.alias("bonus"), relation.alias("name_relation"),
        ratio(F.col("common"), F.col("tokens"), 4).alias("contained"), ratio(F.col("common"), F.col("tokens2"), 4).alias("containing"),
        ratio(F.col("common"), F.col("tokens") + F.col("tokens2") - F.col("common"), 4).alias("jaccard"),
    )
    j = j.where((F.greatest("sim", "contained", "containing", "jaccard") >= MIN_SIGNAL) | (F.col("bonus") >= MIN_BONUS))
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    prior = (
        one(identifier_name(F.col("col")), 0.04) + one(F.col("semantic_type") == "identifier", 0.04) + one(F.col("likely_key2"), 0.08) + one(F.col("key_score2") >= 0.8, 0.05)
        - one(F.col("likely_key"), 0.04) - one(F.col("cardinality_class").isin("very_low", "low"), 0.05)
    )
    score = F.col("sim") * 0.40 + F.col("contained") * 0.30 + F.col("jaccard") * 0.12 + F.col("bonus") + prior
    j = j.withColumn("raw", F.round(score, 9)).where(F.col("raw") >= MIN_SCORE).withColumn("score", F.round("raw", 4))
    if constraints.foreign:
        spark = values.sparkSession
        known = spark.createDataFrame([tuple(x.lower() for x in f) for f in constraints.foreign], "ft string, fc string, tt string, tc string")
        j = j.join(known, (F.lower("tbl") == F.col("ft")) & (F.lower("col") == F.col("fc")) & (F.lower("tbl2") == F.col("tt")) & (F.lower("col2") == F.col("tc")), "left_anti")
    w = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "tbl2", "col2")
    best = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PER_COLUMN)
    confidence = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return best.select(
        F.col("tbl").alias("from_table"), F.col("col").alias("from_column"), F.col("tbl2").alias("to_table"), F.col("col2").alias("to_column"), "rank", "score", confidence.alias("confidence"),
        F.col("sim").alias("minhash_similarity"), "jaccard", F.col("contained").alias("containment"), F.col("containing").alias("reverse_containment"), F.col("common").alias("intersect_count"),
        "name_relation", F.col("likely_key2").alias("target_likely_key"), F.col("semantic_type2").alias("target_semantic_type"),
    )
