"""Queries of the general numbered problems (2 to 5) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.near_duplicates import near_duplicate_groups, similar_pairs
from granary.operators.similar_vectors import similar_vectors, usable_vectors
from granary.operators.split_oversized import split_oversized
from granary.operators.top_n import top_n_per_group
from granary.sources.tables import table

NEIGHBOURS = 10
BEST = 5


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "emb_cache", "emb_id", "model_name", "embedding_json")
    dim = F.try_to_number(F.regexp_extract("model_name", r"(\d{1,6})$", 1), F.lit("999999")).cast("int")
    emb = usable_vectors(emb, F.concat(F.lit("emb_cache/"), "model_name"), F.col("emb_id"), F.col("embedding_json"), dim)
    sem = table(spark, d, "semantic_cache", "cache_id", "embedding")
    sem = usable_vectors(sem, F.lit("semantic_cache/"), F.col("cache_id"), F.col("embedding"), F.lit(64))
    return similar_vectors(emb.unionByName(sem), NEIGHBOURS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    n = _neighbours(spark, d).withColumn("table_name", F.split_part("grp", F.lit("/"), F.lit(1)))
    return n.select("table_name", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


P2_SQL = rf"""
WITH r AS (SELECT 'emb_cache' AS table_name, model_name AS grp, emb_id AS id, embedding_json AS j, TRY_CAST(regexp_extract(model_name, '([0-9]+)$', 1) AS BIGINT) AS dim FROM emb_cache
    UNION ALL SELECT 'semantic_cache', '', cache_id, embedding, 64 FROM semantic_cache),
a AS (SELECT table_name, grp, id, dim, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY' AND json_array_length(j) = dim THEN CAST(j AS JSON) END AS j FROM r WHERE grp IS NOT NULL),
u AS (SELECT table_name, grp, id, CAST(j AS DOUBLE[]) AS v FROM a WHERE j IS NOT NULL AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 0),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM u WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.table_name, a.id AS id, b.id AS near, round(list_dot_product(a.v, b.v) / (a.l * b.l), 9) AS cosine FROM n a JOIN n b ON a.table_name = b.table_name AND a.grp = b.grp AND a.id <> b.id),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY table_name, id ORDER BY cosine DESC, near) <= {NEIGHBOURS})
SELECT DISTINCT table_name, least(id, near) AS id_a, greatest(id, near) AS id_b FROM t"""


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = _neighbours(spark, d)
    return n.select("grp", "id", "position", "neighbour", "cosine")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "expanded_evidence", "question_id", "cross_encoder_score", "similarity", "ev_id")
    order = [("cross_encoder_score", "desc"), ("similarity", "desc"), ("ev_id", "asc")]
    return top_n_per_group(ev, "question_id", order, BEST, ["question_id", "ev_id"])


P3_SQL = f"""
SELECT question_id, ev_id FROM expanded_evidence
WHERE question_id IS NOT NULL AND cross_encoder_score IS NOT NULL AND NOT isnan(cross_encoder_score)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY cross_encoder_score DESC,
    CASE WHEN isnan(similarity) THEN NULL ELSE similarity END DESC NULLS LAST, ev_id) <= {BEST}
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "retrieved_chunks", "rc_id", "chunk_text")
    pairs = similar_pairs(chunks, "rc_id", "chunk_text", threshold=0.6, shingle=3, min_words=20)
    return pairs.select(F.col("id_a").alias("rc_id_a"), F.col("id_b").alias("rc_id_b")).distinct()


P4_SQL = r"""
WITH w AS (SELECT rc_id, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+') AS w FROM retrieved_chunks WHERE chunk_text IS NOT NULL),
s AS (SELECT rc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
e AS (SELECT rc_id, len(s) AS n, unnest(s) AS g FROM s)
SELECT a.rc_id AS rc_id_a, b.rc_id AS rc_id_b FROM e a JOIN e b ON a.g = b.g AND a.rc_id < b.rc_id GROUP BY 1, 2, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))"""


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "retrieved_chunks", "rc_id", "chunk_text")
    return near_duplicate_groups(chunks, "rc_id", "chunk_text", threshold=0.6, shingle=3, min_words=20)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda name, key, text: split_oversized(table(spark, d, name, key, text), key, text).select(F.lit(name).alias("table_name"), "*")
    return cut("chunker", "item_id", "content").unionByName(cut("retrieved_chunks", "rc_id", "chunk_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("table_name", F.col("key").alias("item_key")).distinct()


P5_SQL = r"""
WITH t AS (
  SELECT 'chunker' AS table_name, item_id AS item_key, content AS x FROM chunker
  UNION ALL SELECT 'retrieved_chunks', rc_id, chunk_text FROM retrieved_chunks)
SELECT DISTINCT table_name, item_key FROM t
WHERE len(regexp_extract_all(x, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]')) > 512
"""


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("key", "item_key")


QUERIES = {
    "p2_found": (p2_found, P2_SQL),
    "p2_neighbours": (p2_neighbours, None),
    "p3_found": (p3_found, P3_SQL),
    "p4_found": (p4_found, P4_SQL),
    "p4_groups": (p4_groups, None),
    "p5_found": (p5_found, P5_SQL),
    "p5_pieces": (p5_pieces, None),
}
