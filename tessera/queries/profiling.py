"""Profile and join-discovery queries over all star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, profile
from tessera.plans.cluster import cut, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
CONSTRAINTS = profile.Constraints(
    primary={"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",)},
    unique={"nation": ("n_name",)},
    foreign=(("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey")),
)


def frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in TABLES}


def _values(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(frames(spark, d))


def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.counts(_values(spark, d)).select("tbl", "col", "row_count", "nulls", "non_nulls", "distinct_count", "min_value", "max_value")


def profile_ratios(spark: SparkSession, d: str) -> DataFrame:
    return profile.counts(_values(spark, d)).select("tbl", "col", "null_ratio", "distinct_ratio", "non_null_distinct_ratio", "cardinality_class")


def profile_topk(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(_values(spark, d))


def profile_entropy(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d))
    return profile.top_stats(profile.top_values(v), profile.counts(v))


def profile_patterns(spark: SparkSession, d: str) -> DataFrame:
    return profile.patterns(cut(_values(spark, d)))


def profile_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return profile.prefixes(_values(spark, d))


def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    return profile.shapes(_values(spark, d))


def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.numbers(cut(profile.labelled(_values(spark, d))))


def profile_dates(spark: SparkSession, d: str) -> DataFrame:
    return profile.dates(_values(spark, d))


def profile_samples(spark: SparkSession, d: str) -> DataFrame:
    return profile.samples(_values(spark, d))


def _semantic(v: DataFrame, count: DataFrame | None = None) -> DataFrame:
    return profile.semantic_types(profile.counts(v) if count is None else count, profile.patterns(v), profile.top_values(v))


def profile_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(cut(_values(spark, d)))


def profile_key_score(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d))
    count = cut(profile.counts(v))
    return profile.key_scores(count, _semantic(v, count), CONSTRAINTS).select("tbl", "col", "key_score", F.col("likely_key").cast("int").alias("likely_key"))


def profile_flags(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d))
    count = cut(profile.counts(v))
    return profile.flags(count, profile.top_stats(profile.top_values(v), count)).select("tbl", "col", F.array_join("quality_flags", ",").alias("quality_flags"))


def profile_full(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic of every column, nested, in one row a column."""
    return profile.profile(frames(spark, d), CONSTRAINTS)


def profile_basic(spark: SparkSession, d: str) -> DataFrame:
    return profile.basic_profile(table(spark, d, "customer"), "customer", 5)


def minhash_sig(spark: SparkSession, d: str) -> DataFrame:
    return joins.minhash(_values(spark, d)).select("tbl", "col", F.array_join("signature", "").alias("signature"))


def minhash_sim(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the signatures of all key columns of integer type, over shared (seed, hash) pairs."""
    s = cut(joins.minhash(_values(spark, d)).where(F.col("col").endswith("key")).select("tbl", "col", F.posexplode("signature").alias("seed", "h")))
    b = s.select(F.col("tbl").alias("tbl2"), F.col("col").alias("col2"), "seed", "h")
    return s.join(b, ["seed", "h"]).where("tbl < tbl2").groupBy("tbl", "col", "tbl2", "col2").agg(F.round(F.count("*") / joins.SEEDS, 4).alias("similarity"))


def minhash_sim_all(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the signatures of all columns of different tables that agree in a seed; signatures meet per (seed, hash)."""
    s = cut(joins.minhash(_values(spark, d)).select("tbl", "col", F.posexplode("signature").alias("seed", "h")))
    b = s.select(F.col("tbl").alias("tbl2"), F.col("col").alias("col2"), "seed", "h")
    return s.join(b, ["seed", "h"]).where("tbl < tbl2").groupBy("tbl", "col", "tbl2", "col2").agg(F.round(F.count("*") / joins.SEEDS, 4).alias("similarity"))


def overlap(spark: SparkSession, d: str) -> DataFrame:
    return joins.overlaps(joins.tokens(_values(spark, d)))


def join_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d))
    count = cut(profile.counts(v))
    semantic = cut(_semantic(v, count))
    return joins.join_candidates(v, count, semantic, profile.key_scores(count, semantic, CONSTRAINTS), CONSTRAINTS).withColumn("target_likely_key", F.col("target_likely_key").cast("int"))


QUERIES = {f.__name__: f for f in (profile_counts, profile_ratios, profile_topk, profile_entropy, profile_patterns, profile_prefixes, profile_shape, profile_numeric, profile_dates, profile_samples, profile_semantic, profile_key_score, profile_flags, profile_full, profile_basic, minhash_sig, minhash_sim, minhash_sim_all, overlap, join_candidates)}

# --- SQL: the same statistics from one long view of all values

#: Columns of the tables and their declared types.
COLUMNS = {
    "region": "r_regionkey INTEGER, r_name TEXT",
    "nation": "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER",
    "customer": "c_custkey INTEGER, c_name TEXT, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT",
    "supplier": "s_suppkey INTEGER, s_name TEXT, s_nationkey INTEGER, s_acctbal REAL",
    "part": "p_partkey INTEGER, p_name TEXT, p_brand TEXT, p_type TEXT, p_size INTEGER, p_retailprice REAL",
    "orders": "o_orderkey INTEGER, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL, o_orderdate DATETIME, o_orderpriority TEXT",
    "lineitem": "l_orderkey INTEGER, l_partkey INTEGER, l_suppkey INTEGER, l_linenumber INTEGER, l_quantity REAL, l_extendedprice REAL, l_discount REAL, l_tax REAL, l_returnflag TEXT, l_linestatus TEXT, l_shipdate DATETIME",
    "events": "event_id INTEGER, ts DATETIME, user_id INTEGER, event_type TEXT, value REAL, props TEXT",
}


def _text(col: str, kind: str) -> str:
    return {"REAL": f"CAST(CAST({col} AS DECIMAL(30,4)) AS VARCHAR)", "DATETIME": f"strftime({col}, '%Y-%m-%d %H:%M:%S')"}.get(kind, f"CAST({col} AS VARCHAR)")


_CELLS = [(t, *c.split()) for t, cs in COLUMNS.items() for c in cs.split(", ")]
_LONG = " UNION ALL ".join(f"SELECT '{t}' tbl, '{c}' col, '{k}' declared, {_text(c, k)} v FROM {t}" for t, c, k in _CELLS)
_NUM = "declared IN ('INTEGER', 'REAL')"
_LABELS = " ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END," for n, p in profile.PATTERNS.items()).rstrip(",")
_BASE = f"""WITH a AS MATERIALIZED (SELECT tbl, col, declared, v, count(*) n FROM ({_LONG}) GROUP BY ALL),
w AS (SELECT *, trim(v) s FROM a WHERE trim(v) <> ''),
c0 AS (SELECT tbl, col, any_value(declared) declared, CAST(sum(n) AS BIGINT) row_count, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) nulls, count(v) distinct_count,
  CASE WHEN any_value({_NUM}) THEN arg_min(v, TRY_CAST(v AS DECIMAL(38,6))) FILTER ({_NUM}) ELSE min(v) END min_value,
  CASE WHEN any_value({_NUM}) THEN arg_max(v, TRY_CAST(v AS DECIMAL(38,6))) FILTER ({_NUM}) ELSE max(v) END max_value FROM a GROUP BY tbl, col),
c AS (SELECT *, row_count - nulls non_nulls, floor(nulls * 10000::DOUBLE / row_count + 0.5) / 10000 null_ratio, floor(distinct_count * 10000::DOUBLE / row_count + 0.5) / 10000 distinct_ratio,
  CASE WHEN row_count = nulls THEN 0.0 ELSE floor(distinct_count * 10000::DOUBLE / (row_count - nulls) + 0.5) / 10000 END non_null_distinct_ratio,
  CASE WHEN distinct_count <= 1 THEN 'constant' WHEN distinct_count / row_count <= 0.02 THEN 'very_low' WHEN distinct_count / row_count <= 0.1 THEN 'low' WHEN distinct_count / row_count <= 0.5 THEN 'medium' ELSE 'high' END cardinality_class FROM c0),
top AS (SELECT tbl, col, CAST(row_number() OVER (PARTITION BY tbl, col ORDER BY n DESC, v) AS INT) rank, v, n FROM a WHERE v IS NOT NULL QUALIFY rank <= 8),
e AS (SELECT tbl, col, sum(n) tn, max(n) fn, round(sum(-p * log2(p)), 6) h FROM (SELECT *, n / sum(n) OVER (PARTITION BY tbl, col) p FROM top) GROUP BY tbl, col),
st AS (SELECT c.tbl, c.col, coalesce(floor(tn * 10000::DOUBLE / non_nulls + 0.5) / 10000, 0) top_value_coverage, coalesce(floor(fn * 10000::DOUBLE / non_nulls + 0.5) / 10000, 0) dominant_value_ratio, coalesce(h, 0) top_value_entropy FROM c LEFT JOIN e USING (tbl, col)),
lab AS (SELECT tbl, col, n, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['text_like'] END) pattern FROM (SELECT *, list_filter([{_LABELS}], lambda x: x IS NOT NULL) l FROM w)),
pat AS (SELECT tbl, col, pattern, CAST(q.n AS BIGINT) n, floor(q.n * 1000::DOUBLE / c.non_nulls + 0.5) / 1000 share FROM (SELECT tbl, col, pattern, sum(n) n FROM lab GROUP BY tbl, col, pattern QUALIFY row_number() OVER (PARTITION BY tbl, col ORDER BY sum(n) DESC, pattern) <= 6) q JOIN c USING (tbl, col)),
sem AS (SELECT c.tbl, c.col, CASE WHEN list_contains(ps, 'json_like') THEN 'json' WHEN declared IN ('DATETIME', 'DATE') OR list_contains(ps, 'date_iso') OR list_contains(ps, 'datetime_iso') THEN 'datetime'
  WHEN c.col LIKE '%\\_id' ESCAPE '\\' OR c.col = 'id' OR (c.col LIKE '%id' AND list_contains(ps, 'code_like')) THEN 'identifier' WHEN {_NUM} THEN 'numeric'
  WHEN truth THEN 'boolean' WHEN declared = 'TEXT' THEN 'text' ELSE 'unknown' END semantic_type, declared FROM c
  LEFT JOIN (SELECT tbl, col, list(DISTINCT pattern) ps FROM pat GROUP BY ALL) USING (tbl, col)
  LEFT JOIN (SELECT tbl, col, bool_and(lower(trim(v)) IN ('', {", ".join(repr(b) for b in profile.BOOLEAN_TEXTS)})) truth FROM top WHERE rank <= 5 GROUP BY ALL) USING (tbl, col)),
k AS (SELECT tbl, col, round(least(greatest(
    CASE WHEN tbl || '.' || col IN ({", ".join(f"'{t}.{x}'" for t, xs in CONSTRAINTS.primary.items() for x in xs)}) THEN 0.7 ELSE 0 END + CASE WHEN tbl || '.' || col IN ({", ".join(f"'{t}.{x}'" for t, xs in CONSTRAINTS.unique.items() for x in xs)}) THEN 0.45 ELSE 0 END
    + CASE WHEN non_nulls > 0 AND distinct_count = non_nulls THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(col), '(id|uuid|code|key)$') THEN 0.12 ELSE 0 END
    + CASE WHEN semantic_type = 'identifier' THEN 0.12 ELSE 0 END - CASE WHEN nulls > 0 THEN 0.15 ELSE 0 END, 0), 1)::DOUBLE, 4) key_score FROM c JOIN sem USING (tbl, col)),
tok AS (SELECT DISTINCT tbl, col, substr(lower(trim(v)), 1, 160) token FROM w),
mh AS (SELECT tbl, col, [{", ".join(f"min(substr(sha1(concat('{i}::', v)), 1, 16))" for i in range(joins.SEEDS))}] sig FROM w GROUP BY ALL),
ov AS (SELECT x.tbl, x.col, y.tbl tbl2, y.col col2, count(*) common FROM tok x JOIN tok y ON x.token = y.token AND x.tbl <> y.tbl GROUP BY ALL)
"""
_JOIN = """, el AS (SELECT tbl, col, tokens, sig, semantic_type, key_score, key_score >= 0.52 likely_key, cardinality_class FROM c JOIN (SELECT tbl, col, count(*) tokens FROM tok GROUP BY ALL) USING (tbl, col) JOIN mh USING (tbl, col) JOIN sem USING (tbl, col) JOIN k USING (tbl, col) WHERE non_nulls >= 20 AND distinct_count >= 5 AND tokens >= 15),
pr AS (SELECT x.*, y.tbl tbl2, y.col col2, y.tokens tokens2, y.semantic_type st2, y.key_score ks2, y.likely_key lk2, coalesce(common, 0) common, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 32 sim,
  list_sort(list_intersect(list_distinct(regexp_extract_all(x.col, '[a-z0-9]+')), list_distinct(regexp_extract_all(y.col, '[a-z0-9]+')))) shared_words FROM el x JOIN el y ON x.tbl <> y.tbl LEFT JOIN ov ON ov.tbl = x.tbl AND ov.col = x.col AND ov.tbl2 = y.tbl AND ov.col2 = y.col
  WHERE x.semantic_type = y.semantic_type OR 'unknown' IN (x.semantic_type, y.semantic_type) OR list_sort([x.semantic_type, y.semantic_type]) IN (['identifier', 'numeric'], ['identifier', 'text'], ['boolean', 'numeric'])),
sc AS (SELECT *, CASE WHEN col = col2 THEN 0.25 WHEN col LIKE '%id' AND col2 LIKE '%id' THEN 0.12 WHEN len(shared_words) > 0 THEN 0.08 ELSE 0 END bonus,
  CASE WHEN col = col2 THEN 'same_name' WHEN col LIKE '%id' AND col2 LIKE '%id' THEN 'both_id_like' WHEN len(shared_words) > 0 THEN 'token_overlap:' || array_to_string(shared_words[1:3], ',') ELSE 'none' END name_relation,
  floor(common * 10000::DOUBLE / tokens + 0.5) / 10000 containment, floor(common * 10000::DOUBLE / tokens2 + 0.5) / 10000 reverse_containment, floor(common * 10000::DOUBLE / (tokens + tokens2 - common) + 0.5) / 10000 jaccard FROM pr),
fi AS (SELECT *, round(sim * 0.4 + containment * 0.3 + jaccard * 0.12 + bonus + CASE WHEN regexp_matches(col, '(id|uuid|code|key)$') THEN 0.04 ELSE 0 END + CASE WHEN semantic_type = 'identifier' THEN 0.04 ELSE 0 END + CASE WHEN lk2 THEN 0.08 ELSE 0 END
  + CASE WHEN ks2 >= 0.8 THEN 0.05 ELSE 0 END - CASE WHEN likely_key THEN 0.04 ELSE 0 END - CASE WHEN cardinality_class IN ('very_low', 'low') THEN 0.05 ELSE 0 END, 9) raw FROM sc WHERE (greatest(sim, containment, reverse_containment, jaccard) >= 0.28 OR bonus >= 0.12) AND (common > 0 OR bonus >= 0.12)
  AND (tbl, col, tbl2, col2) NOT IN (""" + ", ".join(str(f) for f in CONSTRAINTS.foreign) + """))
SELECT tbl from_table, col from_column, tbl2 to_table, col2 to_column, CAST(row_number() OVER (PARTITION BY tbl, col ORDER BY round(raw, 4) DESC, tbl2, col2) AS INT) rank, round(raw, 4) score,
  CASE WHEN round(raw, 4) >= 0.72 THEN 'high' WHEN round(raw, 4) >= 0.58 THEN 'medium' ELSE 'low' END confidence, sim minhash_similarity, jaccard, containment, reverse_containment, common intersect_count, name_relation, CAST(lk2 AS INT) target_likely_key, st2 target_semantic_type
FROM fi WHERE raw >= 0.45 QUALIFY rank <= 5"""
_HINT = "CASE WHEN semantic_type = 'numeric' THEN CASE WHEN declared = 'TEXT' THEN '{numeric_text}' ELSE '{numeric}' END WHEN semantic_type = 'boolean' THEN '{boolean}' WHEN semantic_type = 'datetime' THEN '{datetime}' WHEN semantic_type = 'json' THEN '{json}' WHEN semantic_type = 'identifier' THEN '{identifier}' ELSE '{text}' END".format(**profile.HINTS)
_DATE = "regexp_matches(s, '{}')".format(profile.PATTERNS["date_iso"])
_STAMP = "regexp_matches(s, '{}')".format(profile.PATTERNS["datetime_iso"])


def _cls(pattern: str) -> str:
    return f"sum((length(s) - length(regexp_replace(s, '{pattern}', '', 'g'))) * n)"


def _share(part: str) -> str:
    return f"floor({part} * 1000::DOUBLE / sum(length(s) * n) + 0.5) / 1000"


_ND, _LU, _LL, _L, _S = r"\p{Nd}", r"\p{Lu}", r"\p{Ll}", r"\p{L}", r"\s"

SQL = {
    "profile_counts": _BASE + "SELECT tbl, col, row_count, nulls, non_nulls, distinct_count, min_value, max_value FROM c",
    "profile_ratios": _BASE + "SELECT tbl, col, null_ratio, distinct_ratio, non_null_distinct_ratio, cardinality_class FROM c",
    "profile_topk": _BASE + "SELECT * FROM top",
    "profile_entropy": _BASE + "SELECT * FROM st",
    "profile_patterns": _BASE + "SELECT * FROM pat",
    "profile_prefixes": _BASE + "SELECT tbl, col, substr(s, 1, 3) prefix, CAST(sum(n) AS BIGINT) n FROM w GROUP BY tbl, col, substr(s, 1, 3) QUALIFY row_number() OVER (PARTITION BY tbl, col ORDER BY sum(n) DESC, substr(s, 1, 3)) <= 5",
    "profile_shape": _BASE
    + f"""SELECT tbl, col, CAST(min(length(s)) AS INT) min_length, CAST(max(length(s)) AS INT) max_length, floor(sum(length(s) * n) * 1000::DOUBLE / sum(n) + 0.5) / 1000 avg_length,
  {_share(_cls(_ND))} digit_share, {_share(_cls(_LU))} upper_share, {_share(_cls(_LL))} lower_share, {_share(f"({_cls(_L)} - {_cls(_LU)} - {_cls(_LL)})")} alpha_other_share,
  {_share(_cls(_S))} space_share, {_share(f"(sum(length(s) * n) - {_cls(_ND)} - {_cls(_L)} - {_cls(_S)})")} punct_share FROM w GROUP BY tbl, col""",
    "profile_numeric": _BASE
    + f""", x AS (SELECT tbl, col, CAST(s AS DOUBLE) x, unnest(range(n)) FROM w WHERE regexp_matches(s, '{profile.PATTERNS["numeric_like"]}'))
SELECT tbl, col, count(*) count, round(min(x), 4) min, round(max(x), 4) max, round(avg(x), 4) mean, round(stddev_pop(x), 4) std, round(quantile_cont(x, 0.1), 4) p10, round(quantile_cont(x, 0.5), 4) p50, round(quantile_cont(x, 0.9), 4) p90 FROM x GROUP BY tbl, col""",
    "profile_dates": _BASE + f"SELECT tbl, col, min(s) min, max(s) max, CAST(max(CAST({_STAMP} AS INT)) AS INT) has_time, CAST(sum(n) AS BIGINT) count FROM w WHERE {_DATE} OR {_STAMP} GROUP BY tbl, col",
    "profile_samples": _BASE + "SELECT tbl, col, v FROM a WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tbl, col ORDER BY md5(v), v) <= 8",
    "profile_semantic": _BASE + f"SELECT tbl, col, semantic_type, {_HINT} format_hint FROM sem",
    "profile_key_score": _BASE + "SELECT tbl, col, key_score, CAST(key_score >= 0.52 AS INT) likely_key FROM k",
    "profile_flags": _BASE
    + "SELECT tbl, col, array_to_string(list_filter([CASE WHEN null_ratio >= 0.8 THEN 'mostly_null' END, CASE WHEN non_nulls > 0 AND distinct_count <= 1 THEN 'constant_like' END, CASE WHEN cardinality_class IN ('very_low', 'low') AND dominant_value_ratio >= 0.6 THEN 'highly_skewed' END], lambda x: x IS NOT NULL), ',') quality_flags FROM c JOIN st USING (tbl, col)",
    "profile_basic": _BASE
    + "SELECT tbl, col, nulls, distinct_count, coalesce(t, '') top FROM c LEFT JOIN (SELECT tbl, col, string_agg(v || '=' || n, ', ' ORDER BY rank) t FROM top WHERE rank <= 3 GROUP BY ALL) USING (tbl, col) WHERE tbl = 'customer'",
    "minhash_sig": _BASE + "SELECT tbl, col, array_to_string(sig, '') signature FROM mh",
    "minhash_sim_all": _BASE + "SELECT x.tbl, x.col, y.tbl tbl2, y.col col2, round(len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 32, 4) similarity FROM mh x JOIN mh y ON x.tbl < y.tbl WHERE len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) > 0",
    "minhash_sim": _BASE + "SELECT x.tbl, x.col, y.tbl tbl2, y.col col2, round(len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 32, 4) similarity FROM mh x JOIN mh y ON x.tbl < y.tbl WHERE x.col LIKE '%key' AND y.col LIKE '%key' AND len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) > 0",
    "overlap": _BASE + "SELECT * FROM ov",
    "join_candidates": _BASE + _JOIN,
}
